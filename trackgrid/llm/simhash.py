"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import FOLD_CASE, as_bytes, components, sliced, stored
from .nearcopies import groups

#: Bits of a fingerprint, and of a segment whose set bits are counted.
BITS, SEGMENT = 64, 2
LOW = 0x5555555555555555


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes that end at `ends`: the bits that over half of a group have."""
    n = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(n)
    if not full.size:
        return out
    blocks = np.unique(np.concatenate([ends[full] - n[full], np.arange(0, len(hashes), 255)]))  # counts of a byte
    first = np.searchsorted(blocks, ends[full] - n[full])
    ones = np.empty((len(blocks), 8, 8), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), blocks)
        ones[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(ones.reshape(len(blocks), 64).astype(np.int64), first, axis=0)
    bits = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(bits).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> doc_id, fp long: the 64-bit SimHash over word shingles, repeats included.

    Words stand between ASCII white space, A-Z lower-cased; a shingle's hash is its XXH64 with seed 42.
    Texts of fewer words are one shingle; null and empty texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                hashes, ends = [], []
                for text in as_bytes(batch, "text"):
                    w = text.translate(FOLD_CASE).split()
                    if len(w) >= words:
                        hashes.extend(map(xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(42)))
                    elif w:
                        hashes.append(xxh64_intdigest(b" ".join(w), 42))
                    ends.append(len(hashes))
                fps = majority(np.array(hashes, np.uint64), np.array(ends, np.int64))
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array(fps.view(np.int64))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the segments of two bits, each in unary: 0, 1, 2 as 00, 01, 11.

    The bits in which two embeddings differ number their Manhattan distance, which is at most the
    number in which the fingerprints differ.
    """
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def cells(distance: int) -> list[int]:
    """Masks of the grids: of distance + 3 bands of segments, every choice of 3.

    Counts that differ by at most `distance` in sum agree in 3 bands at least, so such a pair shares a
    cell of at least one grid.
    """
    bands, segments = distance + 3, BITS // SEGMENT
    edges = [segments * i // bands for i in range(bands + 1)]
    masks = [sum(3 << SEGMENT * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for c in combinations(masks, 3) for m in [sum(c)]]


def links(fps: DataFrame, distance: int = 3, block: int = 256) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all pairs within `distance`.

    A cell's fingerprints are compared in blocks of about `block`, each pair of blocks apart, so a
    crowded cell is spread over tasks; a pair of blocks gives edges from its fingerprints to the
    smallest one that they reach there, not all its pairs.
    """
    masks = F.array(*map(F.lit, cells(distance)))
    rows = fps.select("fp", embedding(F.col("fp")).alias("u"))
    rows = rows.select("fp", "u", F.posexplode(masks).alias("grid", "mask"))
    rows = rows.select("fp", "grid", F.col("u").bitwiseAND(F.col("mask")).alias("cell"))
    crowd = rows.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.join(crowd, ["grid", "cell"]).withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "fp", F.xxhash64("grid", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("task")
    )
    rows = rows.repartition("task").sortWithinPartitions("task", "fp")
    return rows.mapInArrow(_compare(distance), "a long, b long").distinct()


def _compare(distance: int):
    def edges_of(task: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        left = np.repeat(np.append(new[1:], len(task)), np.diff(np.append(new, len(task)))) - np.arange(len(task)) - 1
        bits = fp.view(np.uint64)
        unary = ((bits | bits >> np.uint64(1)) & np.uint64(LOW)) | ((bits & bits >> np.uint64(1)) & np.uint64(LOW)) << np.uint64(1)
        pairs, at, d = [], np.arange(len(task)), 1
        while (at := at[left[at] >= d]).size:
            near = at[np.bitwise_count(unary[at] ^ unary[at + d]) <= distance]
            near = near[np.bitwise_count(bits[near] ^ bits[near + d]) <= distance]
            if near.size:
                pairs.append(np.stack([near, near + d]))
            d += 1
        if not pairs:
            return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = np.concatenate(pairs, axis=1)
        least = np.arange(len(task))
        while True:
            before = least.copy()
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            least = least[least]
            if (least == before).all():
                break
        far = np.flatnonzero(least != np.arange(len(task)))
        return pa.RecordBatch.from_pydict({"a": pa.array(fp[far]), "b": pa.array(fp[least[far]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = fp = np.empty(0, np.int64)
        for batch in batches:
            task = np.concatenate([task, batch["task"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy()])
            cut = int(np.searchsorted(task, task[-1])) if len(task) else 0  # the last run may go on
            if cut:
                yield edges_of(task[:cut], fp[:cut])
                task, fp = task[cut:], fp[cut:]
        if len(task):
            yield edges_of(task, fp)

    return run


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    component_id is the smallest doc_id that links of at most `distance` differing bits reach. Null and
    empty texts share fingerprint zero. Rows with a null doc_id keep their fingerprint and take part;
    a component of none but such rows has a null id. Texts of any length are read whole; other columns are
    dropped; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, words))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = components(links(classes.select("fp"), distance))
    named = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each component of near copies: that of the smallest doc_id.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of at least `similarity`,
    counted exactly over whole texts (see nearcopies: segment fingerprints of the sets, whose differing bits
    are a lower bound, then an exact check). Texts without words are copies. Nulls come last; of rows with the
    same doc_id one of the smallest text hash stays. The row is chosen from keys alone; texts are dealt by
    doc_id and hash. Other columns may have any names; an empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.coalesce("text", F.lit("")))
    keys = docs.select(F.col("doc_id").isNull().alias("none"), "doc_id", key[0].alias("_d"), key[1].alias("_x"), "text")
    sets, roots = groups(keys, words, similarity)
    classes = stored(sets.groupBy("k").agg(F.min(F.struct("none", "doc_id", "_x", "_d")).alias("least")))
    named = classes.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._d").alias("d"), F.col("least._x").alias("x"))
    rows = docs.select(F.struct("*").alias("row"), key[0].alias("d"), key[1].alias("x")).join(kept, ["d", "x"], "left_semi")
    first = F.row_number().over(Window.partitionBy("d", "x").orderBy(F.lit(1)))
    return rows.withColumn("n", first).filter("n = 1").select("row.*")
