"""Near copies by the exact Jaccard similarity of word shingles: grid join of segment counts, popcount bound, verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import EDGES, FOLD_CASE, among, as_bytes, components, dropped, sliced, stored, stored_tables
from .grids import crowds, signatures

#: Texts whose shingles are counted to find frequent ones, about; bounds the driver's list too.
SAMPLE, FREQUENT = 4_000, 50_000
#: Least bits of a set's fingerprint, and of all fingerprints where many are compared.
PRINT = 1024
#: Low bits of a shingle's hash that its segment leaves out.
SEGMENT = 24
#: The bits that a cell's token has: cells that meet by chance only make more candidates, and shorter tokens pack better.
TOKEN = np.int64((1 << 40) - 1)
#: Possible pairs a row of the cells has, on average, up to which all that are left are compared at once.
LEFT = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, in one order, of a text's shingles; a text of fewer words is one, an empty one has none."""
    w = np.fromiter(map(xxh64_intdigest, text.translate(FOLD_CASE).split()), np.uint64)
    if not len(w):
        return np.empty(0, np.int64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(32)).view(np.int64)


def fingerprint(own: np.ndarray) -> bytes:
    """Parity of the shingles in each segment of their hashes, a bit each; two segments or more a shingle.

    A shingle that only one of two sets holds changes one bit at most, so the bits in which two fingerprints
    of one size differ are never more than the shingles in which the sets do.
    """
    size = max(PRINT, 1 << (2 * len(own) - 1).bit_length()) if len(own) else PRINT
    counts = np.bincount((own >> 9).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def folded(bits: bytes, size: int = PRINT // 8) -> np.ndarray:
    """A fingerprint of fewer segments: the parity of merged ones."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def identity(own: np.ndarray) -> int:
    """64-bit key of a set of shingles."""
    return xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else 0


def least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Members that sets of n and m must share for a Jaccard similarity."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts of a sample, sorted, with their counts. They only save cells: no result depends on them."""
    share = max(1, docs.count() // SAMPLE)
    picked = docs.filter(F.pmod(F.xxhash64("_d", "_x"), F.lit(share)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                own = [shingles(t, words) for t in as_bytes(batch, "text")]
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(own))})

    counts = picked.mapInArrow(run, "token long").groupBy("token").count().filter("count >= 8")
    found = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token, count = found["token"].to_numpy(), found["count"].to_numpy()
    by = np.argsort(token)
    return token[by], count[by]


def segments(own: np.ndarray) -> np.ndarray:
    """Shingles -> their segments of the hash space, in order: a segment occurs as often as it has shingles.

    This is the embedding of a set: its counts of segments. The Manhattan distance of two embeddings, the sum of
    the counts' differences, is at most the number of shingles that only one of the sets has.
    """
    return own >> SEGMENT << SEGMENT


def _sets(words: int):
    """Each text's set as its key, size and fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                own = [shingles(t, words) for t in as_bytes(batch, "text")]
                prints = list(map(fingerprint, own))
                yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c != "text"} | {
                    "k": pa.array(map(identity, own), pa.int64()), "n": pa.array(map(len, own), pa.int64()),
                    "print": pa.array(prints, pa.binary()), "coarse": pa.array([folded(x).tobytes() for x in prints], pa.binary()),
                })

    return run


def _placed(words: int, of: Callable[[np.ndarray], np.ndarray]):
    """The cells that of() gives for each text's set; sets that the task has met before have no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                tokens, keys = [np.empty(0, np.int64)], []
                for text in as_bytes(batch, "text"):
                    own = shingles(text, words)
                    k = identity(own)
                    if k not in seen and len(own):
                        seen.add(k)
                        tokens.append(of(own) & TOKEN)
                        keys.append(k)
                n = list(map(len, tokens[1:]))
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.repeat(np.array(keys, np.int64), n)), "token": pa.array(np.concatenate(tokens))})

    return run


def _keyed(words: int):
    """The key of each text's set; texts that the task has met before are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in sliced(whole, "text"):
                k = [identity(shingles(t, words)) for t in as_bytes(batch, "text")]
                new = [x not in seen and not seen.add(x) for x in k]
                yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "text": batch["text"]}).filter(pa.array(new, pa.bool_()))

    return run


def _shared(names: tuple[str, ...]):
    """The rows whose shingle another set has too, each set once, from rows in the order of shingles and sets.

    names: the shingle, the set's key, and what else a row has, all numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, matched = np.empty((len(names), 0), np.int64), False
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch[c].to_numpy() for c in names])], axis=1)
            if not rows.shape[1]:
                continue
            copy = np.zeros(rows.shape[1], bool)
            copy[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            rows = rows[:, ~copy]
            same = rows[0][1:] == rows[0][:-1]
            keep = np.concatenate([[matched and last.shape[1] > 0], same]) | np.concatenate([same, [False]])
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(names, rows[:, :-1][:, keep[:-1]])})
            last, matched = rows[:, -1:], bool(keep[-1])
        if matched:
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(names, last)})

    return run


def _near(similarity: float):
    """Pairs of each row with the previous one of its shingle, where size and place allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch[c].to_numpy() for c in ("token", "k", "n", "pos")])], axis=1)
            token, k, n, pos = rows
            on = token[1:] == token[:-1]
            on &= np.minimum(n[1:] - pos[1:], n[:-1] - pos[:-1]) >= least_shared(n[1:], n[:-1], similarity)
            i, j = k[1:][on], k[:-1][on]
            if i.size:
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(i, j)), "b": pa.array(np.maximum(i, j))})
            last = rows[:, -1:]

    return run


def _rest(similarity: float, best: bool):
    """Pairs (a, b) of rows of a task that are in different components, where size, place and fingerprints allow.

    All of them, or the best one of each row k: that of the least cost, differing bits for its size; c is the
    number of pairs that a row stands for. Rows come in the order of task.
    """

    def found(k, n, pos, root, own, cross, bits) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(k), 128):
            i = slice(at, at + 128)
            small, large = np.minimum(n[i, None], n[None]), np.maximum(n[i, None], n[None])
            on = (similarity * large <= small + 1e-9) & (root[i, None] != root[None]) & (~cross[i, None] | (own[i, None] != own[None]))
            if not best:
                on &= k[i, None] < k[None]
            left = np.minimum(n[i, None] - pos[i, None], n[None] - pos[None])
            on &= left >= least_shared(n[i, None], n[None], similarity)
            x, y = np.nonzero(on)
            if not x.size:
                continue
            apart = np.bitwise_count(bits[at + x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            both = n[at + x] + n[y]
            ok = apart <= (1 - similarity) / (1 + similarity) * both + 1e-9
            x, y, cost = x[ok], y[ok], apart[ok] / both[ok]
            c = np.ones(len(x), np.int64)
            if best:
                c = np.bincount(x)[np.unique(x)] if len(x) else c
                by = np.lexsort((cost, x))
                first = by[np.concatenate(([True], x[by][1:] != x[by][:-1]))] if len(by) else by
                x, y = x[first], y[first]
            if x.size:
                a, b = k[at + x], k[y]
                low, high = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_pydict({"k": pa.array(a), "a": pa.array(low), "b": pa.array(high), "cost": pa.array(cost[first] if best else cost), "c": pa.array(c)})

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        task = rows["task"].to_numpy()
        bits = np.frombuffer(b"".join(rows["coarse"].to_pylist()), np.uint64).reshape(len(task), -1)
        columns = [rows[c].to_numpy() for c in ("k", "n", "pos", "root", "own")] + [rows["cross"].to_numpy() > 0, bits]
        ends = np.append(np.flatnonzero(task[1:] != task[:-1]) + 1, len(task))
        for s, e in zip(np.append(0, ends[:-1]), ends):
            yield from found(*(x[s:e] for x in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            if not rows.num_rows:
                continue
            task = rows["task"].to_numpy()
            cut = int(np.searchsorted(task, task[-1]))  # the last run may go on
            if cut:
                yield from of(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def _possible(similarity: float):
    """For pairs (a, b, na, nb, pa, pb) the differing bits of their fingerprints, as cost a shingle, and whether they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = []
            for na, nb, one, two in zip(*(batch[c].to_pylist() for c in ("na", "nb", "pa", "pb"))):
                size = min(len(one), len(two))
                cost.append(int(np.bitwise_count(folded(one, size) ^ folded(two, size)).sum()) / (na + nb))
            far = np.array(cost) > (1 - similarity) / (1 + similarity) + 1e-9
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "cost": pa.array(cost, pa.float64()), "far": pa.array(far, pa.bool_())})

    return run


def _verified(words: int, similarity: float):
    """The pairs (a, b) of which the whole sets of both texts have the similarity, from rows (a, b, k, text) of both, k one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in batches:
            for batch in sliced(whole, "text"):
                on = []
                for a, b, k, text in zip(*(batch[c].to_pylist() for c in "abk"), as_bytes(batch, "text")):
                    if held is not None and held[:3] == (a, b, k):  # repeated rows of the same text
                        continue
                    own = shingles(text, words)
                    if held is not None and held[:2] == (a, b):
                        shared = len(np.intersect1d(held[3], own, assume_unique=True))
                        if shared >= similarity * (len(held[3]) + len(own) - shared) - 1e-9:
                            on.append((a, b))
                    held = a, b, k, own
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in on], pa.int64()), "b": pa.array([x[1] for x in on], pa.int64())})

    return run


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(keys, _d, _x, text) -> the keys with k, the key of the set of shingles, and (k, root): the components
    of the sets under a Jaccard similarity of at least `similarity`, for those that have such a partner.

    A set's embedding are its counts of segments (see segments()). Similar sets are within a Manhattan distance that
    their sizes bound, and then agree in all segments of at least one cell of the grids over bands of
    segments (see grids.signatures()). Rows of a cell are compared in blocks over tasks, where the
    bits in which their fingerprints differ bound the shingles in which they do (see linked()).
    Every listed pair is counted exactly, over whole sets.
    """
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    rows = stored(docs.mapInArrow(_sets(words), f"{kinds}, k long, n long, print binary, coarse binary"))
    frequent, percent = np.unique(segments(_frequent(docs, words)[0]).view(np.uint64)), int(100 * similarity + 1e-9)
    cells, texts = placed(docs, rows, words, lambda own: signatures(segments(own), percent, frequent))
    return rows.select(*names, "k"), linked(rows.filter("n > 0"), cells, texts, words, similarity, block)


def placed(docs: DataFrame, rows: DataFrame, words: int, of: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """docs (_d, _x, text) and their rows (_d, _x, k, n) -> the cells (token, k, n, pos) of several sets, and the texts (k, text) of these,
    some perhaps twice, and perhaps of some more."""
    cells = docs.select("text").mapInArrow(_placed(words, of), "k long, token long").repartition("token").sortWithinPartitions("token", "k")
    cells = stored(cells.mapInArrow(_shared(("token", "k")), "token long, k long"))  # few of all rows
    sizes = rows.filter("n > 0").groupBy("k").agg(F.first("n").alias("n"))
    cells = stored(crowds(cells).join(sizes, "k").select("token", "k", "n", F.lit(0).cast("long").alias("pos")))
    row = F.xxhash64("_d", "_x").alias("_y")
    wanted = one_of_each(rows, cells.select("k")).select("one.*").select(row)
    own = among(docs.select(row, "text"), wanted, "_y").filter("among")  # hardly any others, and no text is shuffled
    return cells, stored(own.select("text").mapInArrow(_keyed(words), "k long, text string"))


def one_of_each(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, one): of the rows (_d, _x, k) of each set in keys (k), the first."""
    return rows.select("k", "_d", "_x").join(keys.distinct(), "k", "left_semi").groupBy("k").agg(F.min(F.struct("_d", "_x")).alias("one"))


def linked(leads: DataFrame, cells: DataFrame, texts: DataFrame, words: int, similarity: float, block: int = 2048) -> DataFrame:
    """The components (k, root) of sets, for those that have a partner.

    leads (k, n, print, coarse), one row or more a set; cells (token, k, n, pos), written: tokens of several sets;
    similar sets share one, after the pos of which both have enough members; texts (k, text) of the sets in cells,
    one row or more a set.
    Each row of a token is first held against the next in size. Rows that are in different components by then
    are compared in blocks over tasks: first only each row's best partner, as long as that joins components
    and rows have more than LEFT possible pairs on average, then all pairs that are left. Tokens of two rows have
    no other pair, so theirs that were no row's best one are kept for the end.
    """
    spark, made = cells.sparkSession, stored_tables()
    prints = among(leads.select("k", "n", "print", "coarse"), cells.select("k"), "k").filter("among")
    prints = stored(prints.groupBy("k").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.first("coarse").alias("coarse")))

    def possible(pairs: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(prints.select(F.col("k").alias(s), F.col("n").alias(f"n{s}"), F.col("print").alias(f"p{s}")), s)
        return stored(pairs.mapInArrow(_possible(similarity), "a long, b long, cost double, far boolean"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Both texts of a pair meet once; a text is dealt as often as it stands in pairs."""
        sides = pairs.select(F.explode(F.array("a", "b")).alias("k"), "a", "b")
        both = texts.join(sides, "k").select("a", "b", "k", "text")
        both = both.repartition("a", "b").sortWithinPartitions("a", "b", "k")
        return stored(both.mapInArrow(_verified(words, similarity), "a long, b long").distinct())

    def apart(cells: DataFrame, roots: DataFrame) -> DataFrame:
        """Of cells the rows (token, k, n, pos, root, blocks) of tokens whose rows are in several components; those of two rows are done."""
        own = cells.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
        token = Window.partitionBy("token")
        own = own.select("*", F.count("*").over(token).alias("c"), F.min("root").over(token).alias("low"), F.max("root").over(token).alias("high"))
        own = own.filter("c > 2 AND low < high")
        return stored(own.select("token", "k", "n", "pos", "root", F.ceil(F.col("c") / block).cast("int").alias("blocks")))

    def dealt(own: DataFrame) -> DataFrame:
        """Rows of apart(), once for each pair of blocks."""
        own = own.withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        own = own.select(
            F.xxhash64("token", low, high).alias("task"), "k", "n", "pos", "root", "own", (low != high).cast("long").alias("cross")
        )
        return own.join(prints.select("k", "coarse"), "k").repartition("task").sortWithinPartitions("task")

    def chosen(pairs: DataFrame) -> DataFrame:
        """Of pairs (k, a, b, cost, c) the one of the least cost for each k that was not tried, and the sum of c."""
        new = F.when(F.col("done").isNull(), F.struct("cost", "a", "b"))
        return stored(pairs.groupBy("k").agg(F.min(new).alias("best"), F.sum("c").alias("c")))

    def pairs_of(best: DataFrame) -> DataFrame:
        return best.filter("best IS NOT NULL").select("best.a", "best.b").distinct()

    def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Of pairs (a, b) those of two components."""
        for s in "ab":
            pairs = pairs.join(roots.select(F.col("k").alias(s), F.col("root").alias(f"r{s}")), s, "left")
        return pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    near = cells.repartition("token").sortWithinPartitions("token", "n", "k")
    judged = possible(near.mapInArrow(_near(similarity), "a long, b long").distinct())
    first = judged.filter("NOT far").select(F.explode(F.array("a", "b")).alias("k"), "a", "b", "cost", F.lit(1).alias("c"), F.lit(None).alias("done"))
    first = stored(pairs_of(chosen(first)))
    roots = components(verified(first)).withColumnRenamed("id", "k")
    tried = judged.filter("far").select("a", "b").unionByName(first)
    later = stored(between(judged.filter("NOT far").select("a", "b").join(first, ["a", "b"], "left_anti"), roots))
    later = None if later.isEmpty() else later
    best, held = True, []
    while True:
        cells, old = apart(cells.select("token", "k", "n", "pos"), roots), held  # tokens within one component stay so
        held = stored_tables()[-1:]
        dropped(spark, old)
        more = dealt(cells).mapInArrow(_rest(similarity, best), "k long, a long, b long, cost double, c long")
        if best:
            found = chosen(more.join(tried.withColumn("done", F.lit(True)), ["a", "b"], "left"))
            few = (found.agg(F.sum("c")).first()[0] or 0) <= 2 * LEFT * cells.count()  # both sets of a pair count it
            judged = possible(pairs_of(found))
        else:
            judged = possible(more.join(tried, ["a", "b"], "left_anti").select("a", "b").distinct())
        likely = judged.filter("NOT far").select("a", "b")
        if not best and later is not None:
            likely = likely.unionByName(between(later.join(tried, ["a", "b"], "left_anti"), roots)).distinct()
        new = verified(likely) if not likely.isEmpty() else None
        joins = new is not None and not new.isEmpty()
        tried = tried.unionByName(judged.select("a", "b"))
        if joins:
            roots = merged(roots, new)
        if not best:
            dropped(spark, [t for t in stored_tables() if t not in made])
            return roots
        best = joins and not few


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (k, root) and further edges (a, b) between members -> the components of both."""
    for s in "ab":
        known = roots.select(F.col("k").alias(s), F.col("root").alias(f"r{s}"))
        edges = edges.join(known, s, "left").withColumn(f"r{s}", F.coalesce(f"r{s}", s))
    up = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    old = roots.select("k", "root").join(up.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    old = old.select("k", F.coalesce("top", "root").alias("root"))
    new = up.select(F.col("id").alias("k"), "root").join(roots, "k", "left_anti")
    return old.unionByName(new).coalesce(max(1, -(-(roots.count() + up.count()) // EDGES))).checkpoint()
