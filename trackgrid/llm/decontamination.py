"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, as_bytes, sliced, stored

#: Bytes of text in a lane; the lanes of a slice are searched together.
LANE = 1024


class Patterns:
    """Shift and bucket tables of byte strings that all have at least `m` bytes.

    Blocks are the `b` last bytes of a window of m bytes. A block that ends in no pattern shifts the
    window past it; else by its distance from the nearest end. At shift 0 the bucket of the block's hash
    holds the patterns to compare.
    """

    BITS = 18

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.b = 8 if self.m >= 16 else max(1, self.m // 2)
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        self.shift = np.full(1 << self.BITS, self.m - self.b + 1, np.int64)
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        for p in patterns:
            blocks = self.hash(np.array([int.from_bytes(p[i : i + self.b], "little") for i in range(self.m - self.b + 1)], np.uint64))
            np.minimum.at(self.shift, blocks, np.arange(self.m - self.b, -1, -1))
            self.buckets[int(blocks[-1])].append(p)

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """Every (place, pattern) in the text, by place."""
        n = len(text)
        if n < self.m:
            return []
        padded = text + bytes(8)
        words = np.ndarray((n,), np.uint64, padded, strides=(1,))
        at = np.arange(0, n - self.m + 1, LANE)
        stop = np.minimum(at + LANE, n - self.m + 1)
        found = []
        while at.size:
            blocks = self.hash(words[at + (self.m - self.b)] & self.mask)
            shift = self.shift[blocks]
            for k in np.flatnonzero(shift == 0):
                place = int(at[k])
                found += [(place, p) for p in self.buckets.get(int(blocks[k]), ()) if text.startswith(p, place)]
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return sorted(found)


class Searcher:
    """Patterns in classes of length, so that one short pattern doesn't shorten the shifts of all."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.windows = windows
        by: dict[int, list[bytes]] = defaultdict(list)
        for p in windows:
            by[0 if len(p) < 8 else 1 if len(p) < 24 else 2].append(p)
        self.classes = [Patterns(x) for x in by.values()]

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        return [x for c in self.classes for x in c.search(text)]


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, text) -> window, item: every window of n consecutive item words, between spaces; short items are one window.

    Items without words or with a null id have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                windows, own = [], []
                for item, text in zip(batch["item"].to_pylist(), as_bytes(batch, "text")):
                    words = text.translate(FOLD).split()
                    cut = {b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1) if words else 0)}
                    windows += cut
                    own += [item] * len(cut)
                yield pa.RecordBatch.from_pydict({"window": pa.array(windows, pa.binary()), "item": pa.array(own, pa.string())})

    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "window binary, item string").distinct()


class Part:
    """Windows with their items, that all tasks of a pass search for; a worker builds its tables once."""

    _built: tuple = (None, None)

    def __init__(self, windows: dict[bytes, list[str]]):
        self.key, self.windows = uuid.uuid4().hex, windows

    def searcher(self) -> Searcher:
        if Part._built[0] != self.key:
            Part._built = self.key, Searcher(self.windows)
        return Part._built[1]


def _parts(items: DataFrame, n: int, item_bytes: int) -> tuple[int, Iterator[Part]]:
    """How many parts the windows of the items make, of about item_bytes bytes of item text each, and the parts.

    Windows are cut and dealt by their hash in Spark; one part at a time comes to the driver, to go to the
    tasks of its pass.
    """
    size = items.filter("item_id IS NOT NULL").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // item_bytes))
    windows = item_windows(items, n)
    if parts > 1:
        windows = stored(windows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts))))

    def each() -> Iterator[Part]:
        for part in range(parts):
            own = windows if parts == 1 else windows.filter(F.col("part") == part)
            rows = own.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).toArrow()
            yield Part(dict(zip(rows["window"].to_pylist(), rows["items"].to_pylist())))

    return parts, each()


def clean(docs: DataFrame, items: DataFrame, n: int = 10, item_bytes: int = 4 << 20) -> DataFrame:
    """docs, all columns, without the documents in which a window of an item occurs; see find_items().

    Null texts stay. Row-local while the items fit one part; more parts are one pass after the other.
    """
    parts, each = _parts(items, n, item_bytes)
    for part in each:
        docs = docs.mapInArrow(_without(part), docs.schema)
        docs = stored(docs) if parts > 1 else docs
    return docs


def _without(part: Part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = part.searcher()
        for whole in batches:
            for batch in sliced(whole, "text"):
                parts = [b" " + b" ".join(x.translate(FOLD).split()) + b" \n" for x in as_bytes(batch, "text")]
                ends = np.cumsum([len(x) for x in parts])
                places = np.array([x[0] for x in searcher.search(b"".join(parts))], np.int64)
                hit = np.zeros(len(parts), bool)
                hit[np.searchsorted(ends, places, "right")] = True
                yield batch.filter(pa.array(~hit))

    return run


def find_items(docs: DataFrame, items: DataFrame, n: int = 10, item_bytes: int = 4 << 20) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    docs (doc_id, text), items (item_id, text) -> doc_id, n_words, spans array<struct<first,last>> of hit
    words (maximal runs, last exclusive), items array<string> (sorted), one row for each row of docs. Null
    texts have no words; items without words, or with a null id, never occur; repeated rows are kept;
    other columns are dropped; without items every document is clean.

    The windows of the items travel to the tasks in parts of about `item_bytes` bytes of text: each part is
    one pass over the documents, whose rows are stored, and the passes' rows are merged by a hash of the
    row. The driver holds one part at a time. One part, the usual case, needs no shuffle of documents.
    """
    parts, each = _parts(items, n, item_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {'row string, ' * (parts > 1)}n_words long, spans array<struct<first:long,last:long>>, items array<string>"
    base = docs.select("doc_id", "text")
    if parts == 1:
        return base.mapInArrow(_pass(next(each)), schema)
    base = base.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = None
    for k, part in enumerate(each):
        rows = stored(base.mapInArrow(_pass(part), schema).withColumn("part", F.lit(k)))
        out = rows if out is None else out.unionByName(rows)
    copies = F.max("n_copies").alias("n_copies")
    each = out.groupBy("part", "doc_id", "row", "n_words", "spans", "items").agg(F.count("*").alias("n_copies"))
    merged = each.groupBy("doc_id", "row").agg(
        copies,
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<first:long,last:long>>), (a, s) -> CASE WHEN size(a) > 0"
        " AND s.first <= element_at(a, -1).last THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first',"
        " element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, s.last)))) ELSE concat(a, array(s)) END)"
    )
    return merged.select(
        F.explode(F.array_repeat("doc_id", F.col("n_copies").cast("int"))).alias("doc_id"), "n_words",
        joined.alias("spans"), "items",
    )


def _pass(part: Part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, windows = part.searcher(), part.windows
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = [x.translate(FOLD).split() for x in as_bytes(batch, "text")]
                n_words = [len(x) for x in texts]
                parts = [b" " + b" ".join(x) + b" \n" for x in texts]
                text = b"".join(parts)
                starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
                spans: list[list] = [[] for _ in texts]
                items: list[set] = [set() for _ in texts]
                if found := searcher.search(text):
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                    for place, p in sorted(found):
                        k = int(np.searchsorted(starts, place, "right")) - 1
                        first = int(np.searchsorted(spaces, place) - np.searchsorted(spaces, starts[k]))
                        last = first + p.count(b" ") - 1
                        if spans[k] and first <= spans[k][-1]["last"]:
                            spans[k][-1]["last"] = max(spans[k][-1]["last"], last)
                        else:
                            spans[k].append({"first": first, "last": last})
                        items[k].update(windows[p])
                span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                out = {"doc_id": batch["doc_id"]} | ({"row": batch["row"]} if "row" in batch.schema.names else {})
                out |= {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, span)}
                out["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see find_items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return find_items(docs, items, n).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def sha_of(items: list[str]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
