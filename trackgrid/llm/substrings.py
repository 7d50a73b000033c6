"""Exact repeated substrings: interval expansion on partitioned Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, as_bytes, sliced, stored, text_key

#: Bytes of an anchor; every window of `length` bytes has exactly one, so equal windows meet at it.
ANCHOR = 32
_rng = np.random.default_rng(8)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64)
_STEP = _rng.integers(0, 1 << 63, 64, np.uint64) | np.uint64(3)  # 3 mod 4: doubling keeps periodic texts apart


class Hashes:
    """Hashes of all substrings of a byte array, of any one length, by doubling."""

    def __init__(self, data: np.ndarray):
        self.levels = [_BYTE[data]]

    def of(self, length: int) -> np.ndarray:
        """The hash of the `length` bytes from each place on."""
        while 1 << len(self.levels) <= length:
            h, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(h[:-k] * _STEP[len(self.levels)] + h[k:] if len(h) > k else h[:0])
        out, at = None, 0
        for level in range(len(self.levels) - 1, -1, -1):
            if length >> level & 1:
                h = self.levels[level][at:]
                out = h if out is None else out[: len(h)] * _STEP[level + 32] + h
                at += 1 << level
        out = out ^ out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    grid = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(keep: np.ndarray, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of kept places (with equal values)."""
    start = keep.copy()
    stop = keep.copy()
    same = keep[1:] & keep[:-1]
    if value is not None:
        same &= value[1:] == value[:-1]
    start[1:] &= ~same
    stop[:-1] &= ~same
    return np.flatnonzero(start), np.flatnonzero(stop)


def anchors_of(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Anchors of the windows of texts, and the windows of a length that occur twice in these texts.

    Windows are those of the smallest length; a longer one has the anchor of the window that starts with
    it. The anchor is the place in the window of the smallest hash of ANCHOR bytes, the last of equal
    ones, so it depends on the window alone. Returns [text, anchor hash, place, first and last window
    start] and [text, length's index, first and last start]. Windows that occur twice here are judged
    here, and only their first occurrence keeps its anchor.
    """
    length = lengths[0]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    empty = lambda k: [np.empty(0, np.int64) for _ in range(k)]
    if n < length:
        return empty(5), empty(4)
    hashes = Hashes(data)
    h = hashes.of(ANCHOR)
    order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - 1, n - 1 - len(h), -1, dtype=np.int64).astype(np.uint64)
    place = n - 1 - (sliding_min(order, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = ends - [len(t) for t in texts]
    room = np.repeat(ends, ends - starts) - np.arange(n)  # bytes up to the end of the text
    valid = room[: len(place)] >= length
    first, last = runs(valid, place)
    _, back, count = np.unique(h[place[first]], return_inverse=True, return_counts=True)
    twice = count[back] > 1
    marks = [empty(4)]
    if twice.any():
        at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[twice].tolist(), last[twice].tolist())])
        spare = np.ones(len(at), bool)
        for k, size in enumerate(lengths):
            on = np.flatnonzero(room[at] >= size)
            if not on.size:
                continue
            _, head, back, count = np.unique(hashes.of(size)[at[on]], return_index=True, return_inverse=True, return_counts=True)
            repeated = count[back] > 1
            alone = ~repeated
            alone[head] = True
            spare[on[alone]] = False
            here = np.zeros(n, bool)
            here[at[on[repeated]]] = True
            lo, hi = runs(here, np.repeat(np.arange(len(texts)), ends - starts))
            doc = np.searchsorted(ends, lo, "right")
            marks.append([doc, np.full(len(lo), k), lo - starts[doc], hi - starts[doc]])
        valid[at[spare]] = False
        first, last = runs(valid, place)
    doc = np.searchsorted(ends, first, "right")
    p = place[first]
    rows = [doc, h[p].view(np.int64), p - starts[doc], first - starts[doc], last - starts[doc]]
    return rows, [np.concatenate(x) for x in zip(*marks)]


def _anchor_rows(lengths: tuple[int, ...]):
    """Rows of anchors_of(): a repeated window has the place -1 - its length's index, and any anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 18):
                rows, marks = anchors_of(as_bytes(batch, "text"), lengths)
                doc, k, lo, hi = marks
                mixed = (doc + lo * 1_000_003) * 6364136223846793005  # spreads them over tasks
                doc, a, place, lo, hi = (np.concatenate(x) for x in zip(rows, (doc, mixed, -1 - k, lo, hi)))
                at = pa.array(doc.astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "x": batch["x"].take(at), "doc_id": batch["doc_id"].take(at), "a": pa.array(a.astype(np.int64)),
                    **{k: pa.array(v.astype(np.int32)) for k, v in (("place", place), ("lo", lo), ("hi", hi))},
                })

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order a, x, place: the first of each, if its anchor has others; and all of repeated windows."""
    before = None  # the last row so far, and whether its anchor had another one before it
    matched = False
    for batch in batches:
        rows = pa.Table.from_batches([before, batch] if before is not None else [batch]).combine_chunks()
        if not rows.num_rows:
            continue
        a, place = rows["a"].to_numpy(), rows["place"].to_numpy()
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.uint64).reshape(-1, 2)
        copy = np.zeros(len(a), bool)
        copy[1:] = (a[1:] == a[:-1]) & (place[1:] == place[:-1]) & (x[1:] == x[:-1]).all(axis=1)
        mark = place < 0
        kept = np.flatnonzero(~copy & ~mark)
        same = a[kept][1:] == a[kept][:-1]
        keep = mark.copy()
        keep[kept[1:][same]] = True
        keep[kept[:-1][same]] = True
        if before is not None and len(kept):
            keep[0] = keep[0] and not mark[0] or matched
        # The last row that is neither a copy nor a mark is held back: the next batch may match it.
        held = int(kept[-1]) if len(kept) else None
        if held is not None:
            matched, keep[held] = bool(keep[held]), False
            before = rows.slice(held, 1).to_batches()[0]
        yield from rows.filter(pa.array(keep)).to_batches()
    if before is not None and matched:
        yield before


def _contexts(most: int):
    """The bytes from the first window's start to `most` past the last one's, of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                texts = as_bytes(batch, "text")
                found = batch["found"]
                at = pc_list_parents(found)
                flat = found.flatten()
                a, place, lo, hi = (flat.field(k) for k in ("a", "place", "lo", "hi"))
                cut = [texts[d][s : e + most] for d, s, e in zip(at.tolist(), lo.to_pylist(), hi.to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "a": a, "x": batch["x"].take(pa.array(at)), "doc_id": batch["doc_id"].take(pa.array(at)),
                    "place": place, "lo": lo, "hi": hi, "context": pa.array(cut, pa.binary()),
                })

    return run


def pc_list_parents(column: pa.ListArray) -> np.ndarray:
    """For each value of the lists the row that it stands in."""
    return np.repeat(np.arange(len(column)), [len(x) if x is not None else 0 for x in column.to_pylist()])


def repeated_windows(group: np.ndarray, ahead: np.ndarray, contexts: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For rows of anchors in groups: which windows, by their distance before the anchor, occur in two rows.

    group: rows of one anchor hash; ahead: bytes before the anchor; least: the smallest distance. In
    suffix order of what follows the anchor, with the common prefixes of neighbours, each step extends
    every interval backward by one byte: rows of an interval have equal bytes before the anchor. The
    common prefixes that count grow shorter by one with each step, so that both sides make `length`
    bytes; intervals of one row end, and no prefix beyond `length` is ever derived. Windows that end
    behind their context are none.
    """
    n, most = len(contexts), int(ahead.max()) + 1
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, most), np.uint8)
    for i, (c, p) in enumerate(zip(contexts, ahead.tolist())):
        tail = c[p : p + length]
        right[i, : len(tail)] = np.frombuffer(tail, np.uint8)
        left[i, :p] = np.frombuffer(c[:p], np.uint8)[::-1]
    after = np.fromiter(map(len, contexts), np.int64, n) - ahead
    size = np.minimum(length - least, after)  # bytes at and after the anchor
    words = right.view(f"S{length}").ravel()
    order = np.lexsort((size, words, group))
    group, ahead, least, size, right, left = (v[order] for v in (group, ahead, least, size, right, left))
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    common[group[1:] != group[:-1]] = -1
    common = np.concatenate(([-1], common))
    marks = np.zeros((n, most), bool)
    live = np.arange(n)
    interval = np.unique(group, return_inverse=True)[1].astype(np.int64)
    for j in range(most):
        if j:
            on = ahead[live] >= j
            live, interval = live[on], interval[on]
            interval = np.unique(interval << 8 | left[live, j - 1], return_inverse=True)[1]
        if not live.size:
            break
        on = np.bincount(interval)[interval] > 1
        live, interval = live[on], interval[on]
        block = np.cumsum(common < length - j)
        active = live[least[live] <= j]
        if active.size > 1:
            key = interval[least[live] <= j] * (n + 1) + block[active]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            marks[active[by[1:][same]], j] = True
            marks[active[by[:-1][same]], j] = True
    out = np.empty_like(marks)
    out[order] = marks
    return out


def _search(lengths: tuple[int, ...], rows_at_once: int = 8192):
    def found(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        place, lo, hi = (batch[k].to_numpy().astype(np.int64) for k in ("place", "lo", "hi"))
        contexts, a = batch["context"].to_pylist(), batch["a"].to_numpy()
        for k, length in enumerate(lengths):
            marks = repeated_windows(a, place - lo, contexts, place - hi, length)
            width = marks.shape[1] + 1
            flat = np.zeros((len(marks), width), bool)
            flat[:, :-1] = marks
            first, last = runs(flat.ravel())
            row = first // width
            at = pa.array(row)
            yield pa.RecordBatch.from_pydict({
                "x": batch["x"].combine_chunks().take(at), "doc_id": batch["doc_id"].combine_chunks().take(at),
                "k": pa.array(np.full(len(row), k, np.int32)), "lo": pa.array((place[row] - last % width).astype(np.int32)),
                "hi": pa.array((place[row] - first % width).astype(np.int32)),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                held.append(batch.slice(k, rows_at_once))
                rows = pa.Table.from_batches(held)
                if rows.num_rows < rows_at_once:
                    continue
                a = rows["a"].to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last run may go on
                if cut:
                    yield from found(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield from found(rows)

    return run


def _all_windows(lengths: tuple[int, ...]):
    """Every window of a crowded anchor with a key of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for i, (first, last, c) in enumerate(zip(part["lo"].to_pylist(), part["hi"].to_pylist(), part["context"].to_pylist())):
                    for k, length in enumerate(lengths):
                        for s in range(min(last - first, len(c) - length) + 1):
                            rows.append((i, k, first + s, hashlib.sha256(c[s : s + length]).digest()[:16]))
                row, k, lo, keys = zip(*rows)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(keys, pa.binary()), "x": part["x"].take(row), "doc_id": part["doc_id"].take(row),
                    "k": pa.array(k, pa.int32()), "lo": pa.array(lo, pa.int32()),
                })

    return run


def repeats(docs: DataFrame, lengths: tuple[int, ...] = (400,), crowd: int = 20_000) -> DataFrame:
    """Rows (doc_id, x, text) of docs with found array<struct<k,lo,hi>>: starts of windows that occur elsewhere.

    docs: (doc_id, text) and x, the key of the text. Windows are strings of lengths[k] bytes, the smallest
    length first. Copies of a text are judged once; all of them are whole repeats. Windows meet at
    anchors: one shuffle of places finds the anchors that occur twice, and only they fetch their bytes.
    Each anchor's rows are one partition of the suffixes, searched by repeated_windows(); an anchor with
    more than `crowd` rows is too large for one task, and its windows are compared by key over all tasks
    instead. Texts without any such anchor are dealt nowhere (see among()).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = lambda l, r: F.col(f"{l}.x").eqNullSafe(F.col(f"{r}.x")) & F.col(f"{l}.doc_id").eqNullSafe(F.col(f"{r}.doc_id"))
    base = docs.select("x", "doc_id", "text")
    columns = f"x binary, doc_id {kind}, a long, place int, lo int, hi int"
    anchors = base.mapInArrow(_anchor_rows(lengths), columns).repartition("a").sortWithinPartitions("a", "x", "place")
    anchors = stored(anchors.mapInArrow(_shared, columns))
    local = anchors.filter("place < 0").select("x", "doc_id", (-1 - F.col("place")).alias("k"), "lo", "hi")
    anchors = anchors.filter("place >= 0")
    crowded = anchors.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("a", F.lit(True).alias("crowded"))
    some = not crowded.isEmpty()
    rows = anchors.join(crowded, "a", "left") if some else anchors.withColumn("crowded", F.lit(None).cast("boolean"))
    rows = rows.select("x", "doc_id", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.struct("a", "place", "lo", "hi").alias("found"))
    lists = rows.groupBy("x", "doc_id", "crowded").agg(F.collect_list("found").alias("found"))
    copies = base.select("x", "doc_id").groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
    whole = stored(base.select("x", "doc_id").join(copies, "x").distinct())
    keys = stored(anchors.select("x").unionByName(local.select("x")).unionByName(whole.select("x")).distinct())
    maybe = among(base, keys, "x")
    dealt = maybe.filter("among").drop("among")
    held = dealt.alias("l").join(lists.hint("shuffle_hash").alias("r"), same("l", "r")).select(
        "l.x", "l.doc_id", "text", "found", "crowded"
    )
    fields = f"a long, x binary, doc_id {kind}, place int, lo int, hi int, context binary"
    usual = held.filter(~F.col("crowded")).drop("crowded").mapInArrow(_contexts(lengths[-1]), fields)
    usual = usual.repartition("a").sortWithinPartitions("a")
    hits = usual.mapInArrow(_search(lengths), f"x binary, doc_id {kind}, k int, lo int, hi int").unionByName(local)
    if some:
        many = held.filter("crowded").drop("crowded").mapInArrow(_contexts(lengths[-1]), fields)
        windows = many.mapInArrow(_all_windows(lengths), f"key binary, x binary, doc_id {kind}, k int, lo int").distinct()
        often = windows.groupBy("key", "k").agg(F.count("*").alias("n")).filter("n > 1")
        hits = hits.unionByName(windows.join(often, ["key", "k"]).select("x", "doc_id", "k", "lo", F.col("lo").alias("hi")))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(lengths) - 1))).alias("k")
    hits = hits.unionByName(whole.select("x", "doc_id", every, F.lit(0).alias("lo"), F.lit(2147483647).alias("hi")))
    spans = hits.groupBy("x", "doc_id").agg(F.collect_list(F.struct("k", "lo", "hi")).alias("found"))
    joined = dealt.alias("l").join(spans.hint("shuffle_hash").alias("r"), same("l", "r"), "left").select(
        "l.doc_id", "l.x", "text", "found"
    )
    rest = maybe.filter("NOT among").select("doc_id", "x", "text", F.lit(None).cast(joined.schema["found"].dataType).alias("found"))
    return joined.unionByName(rest)


def removed_ranges(found: list[dict] | None, n: int, length: int, k: int = 0) -> list[tuple[int, int]]:
    """Maximal ranges of bytes that the windows of length number k with the given starts cover, in a text of n bytes."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((f["lo"], min(f["hi"], n - length)) for f in found or () if f["k"] == k):
        if lo > hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def _kept(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in ranges for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), text_key(text).alias("x"))


def repeat_report(docs: DataFrame, length: int = 400, crowd: int = 20_000, short: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs.

    Every byte that a string of `length` bytes covers which also starts anywhere else is removed. With
    `short`, a smaller length, n_repeated follows: the bytes that such shorter strings cover; they are
    counted, not removed. Null texts count as empty; texts of any length are read whole; repeated rows are
    copies of each other; other columns are dropped; an empty table gives an empty result.
    """
    lengths = (length,) if short is None else (short, length)
    last = len(lengths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                out: list[list] = [[] for _ in range(5)]
                for text, found in zip(as_bytes(batch, "text"), batch["found"].to_pylist()):
                    ranges = removed_ranges(found, len(text), length, last)
                    sha = hashlib.sha256(_kept(text, ranges)).hexdigest()
                    short_ranges = removed_ranges(found, len(text), lengths[0])
                    covered = (sum(b - a for a, b in r) for r in (ranges, short_ranges))
                    for column, v in zip(out, (len(text), next(covered), len(ranges), sha, next(covered))):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")[: 4 + last]
                columns = {k: pa.array(v, t) for k, v, t in zip(names, out, kinds)}
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * last
    return repeats(_with_key(docs), lengths, crowd).drop("x").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = 400, crowd: int = 20_000) -> DataFrame:
    """docs, all columns, with repeated bytes removed from text (and n_chars, if there is one, counted anew).

    No copy of a repeated string stays. Bytes of a character that is cut in two are removed with the rest
    of it. Texts without repeats, nulls among them, stay as they are. Rows are as in repeat_report();
    other columns may have any names.
    """
    text = F.coalesce("text", F.lit(""))
    found = repeats(_with_key(docs), (length,), crowd).filter("found IS NOT NULL").select("x", F.col("doc_id").alias("id"), "found")
    found = stored(found.dropDuplicates(["x", "id"]))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key(text).alias("x"))
    rows = among(rows, found.select("x"), "x")
    dealt, rest = rows.filter("among"), rows.filter("NOT among")
    same = F.col("l.x").eqNullSafe(F.col("r.x")) & F.col("l.id").eqNullSafe(F.col("r.id"))
    joined = dealt.alias("l").join(found.hint("shuffle_hash").alias("r"), same, "left").select("row", "found")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            columns = dict(zip(whole["row"].type.names, whole["row"].flatten())) | {"found in it": whole["found"]}
            flat = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            for batch in sliced(flat, "text"):
                texts = batch["text"].to_pylist()
                for i, found in enumerate(batch["found in it"].to_pylist()):
                    if found and (ranges := removed_ranges(found, len(data := (texts[i] or "").encode()), length)):
                        texts[i] = _kept(data, ranges).decode(errors="ignore")
                columns = {c: batch[c] for c in schema.names} | {"text": pa.array(texts, batch["text"].type)}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) if t is not None else None for t in texts], batch["n_chars"].type)
                yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, schema).unionByName(rest.select("row.*"))


def report_sql(length: int = 400, short: int = 240) -> str:
    """DuckDB SQL for repeat_report(documents, length, short=short)."""

    def runs_of(name: str, n: int) -> str:
        return f"""
    w_{name} AS (SELECT rid, s, hash(substr(h, 2 * s + 1, {2 * n})) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - {n - 1})) AS s FROM d)),
    k_{name} AS (SELECT k FROM w_{name} GROUP BY k HAVING count(*) > 1),
    r_{name} AS (SELECT rid, s, s > coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s) + {n}, -1) AS fresh FROM w_{name} SEMI JOIN k_{name} USING (k)),
    i_{name} AS (SELECT rid, s, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM r_{name}),
    g_{name} AS (SELECT rid, min(s) AS a, max(s) + {n} AS b FROM i_{name} GROUP BY rid, run)"""

    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
    {runs_of("long", length)}, {runs_of("short", short)},
    p AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM g_long),
    q AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
        FROM p JOIN d USING (rid) GROUP BY rid),
    t AS (SELECT rid, sum(b - a) AS n_repeated FROM g_short GROUP BY rid)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(CASE WHEN q.rid IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256,
        CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated FROM d LEFT JOIN q USING (rid) LEFT JOIN t USING (rid)"""
