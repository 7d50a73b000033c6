"""Merkle manifests of a dataset: a hash tree for each source, one over the sources, and multiproofs of all rows."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, dropped, stored, stored_tables

#: Nodes of a run, which become one node of the next level.
FAN = 16
#: The tree over the sources; a source's own key is MARK and its name, that of a null source empty, so keys sort as sources do.
TOP, MARK = "\x02", "\x01"
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: bytes) -> bytes:
    """SHA-256 as lower-case hex digits."""
    return sha256(data).hexdigest().encode()


def framed(value: Column) -> Column:
    """A field of a leaf: its UTF-8 length, a colon and the value; `-` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**fields: Column) -> Column:
    """32 bytes of SHA-256 over FIELDS."""
    return F.unhex(F.sha2(F.concat(*[framed(fields.get(c, F.col(c))) for c in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """Documents -> g (key of the source), doc_id, leaf, and changed: the leaf of a row that was tampered with, else null."""
    source = F.coalesce(F.concat(F.lit(MARK), F.col("source").cast("string")), F.lit(""))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(text=lower))
    return docs.select(source.alias("g"), "doc_id", leaf().alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, order: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (g, order, leaf) -> the same with i and chunk, and spans (chunk, g, first, n, p, size).

    Rows are sorted by g, order and leaf over all tasks; equal rows may stand in any order. i ascends in
    that order, a chunk is at most `size` rows of it. A span is a group's part of a chunk: its first i,
    its rows, its first place p in the group and the size of the group.
    """
    by = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order], F.col("leaf"), F.col("i")]
    rows = rows.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    inside = F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(rows.withColumn("i", F.monotonically_increasing_id()).withColumn("chunk", F.col("i") - inside % size))
    spans = rows.groupBy("chunk", "g").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    spans = spans.withColumn("part", F.shiftright("chunk", 33))
    parts = spans.groupBy("part", "g").agg(F.min("first").alias("start"), F.sum("n").alias("held"))
    all_of = Window.partitionBy("g")
    parts = parts.withColumn("before", F.sum("held").over(all_of.orderBy("part")) - F.col("held")).withColumn("size", F.sum("held").over(all_of))
    p = F.col("before") + F.col("first") - F.col("start")
    return rows, stored(spans.join(parts, ["part", "g"]).select("chunk", "g", "first", "n", p.alias("p"), "size"))


def _folded(every: bool):
    """The nodes of a chunk: those in runs that are not whole in it are open; the others only if `every`."""

    def run(rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        hexes = [h.hex().encode() for h in rows["leaf"].to_pylist()]
        begin = rows["i"][0].as_py()
        out = []
        for s in spans.to_pylist():
            level, low, high, size = 0, s["p"], s["p"] + s["n"], s["size"]
            own = hexes[s["first"] - begin :][: s["n"]]
            while True:
                first, last = -(-low // FAN), -(-size // FAN) if high == size else high // FAN  # whole runs
                goes_on = size > 1 and first < last
                for k, h in enumerate(own, low):
                    whole = goes_on and first <= k // FAN < last
                    if every or not whole:
                        out.append((s["g"], level, k, size, h.decode(), not whole))
                if not goes_on:
                    break
                own = [digest(b"".join(own[r * FAN - low : (r + 1) * FAN - low])) for r in range(first, last)]
                level, low, high, size = level + 1, first, last, -(-size // FAN)
        kinds = {"g": pa.string(), "level": pa.int32(), "idx": pa.int64(), "size": pa.int64(), "h": pa.string(), "open": pa.bool_()}
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), zip(*out))})

    return run


def nodes(rows: DataFrame, spans: DataFrame, every: bool = False) -> DataFrame:
    """Leaves and spans of placed() -> nodes (g, level, idx, size, h): those that several chunks need, or all.

    size is the number of a level's nodes; 1 is the root. A chunk folds its own runs; only the open nodes
    at its ends meet those of other chunks, level by level.
    """
    kind = "g string, level int, idx long, size long, h string, open boolean"
    made = stored(rows.select("chunk", "i", "leaf").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_folded(every), kind))
    hashed = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]), ""), 256)
    most, level, known, up = spans.agg(F.max("size")).first()[0] or 0, 0, made, made.limit(0)
    while most > 1:  # a round a level
        here = made.filter((F.col("level") == level) & F.col("open")).unionByName(up).filter("size > 1")
        up = here.groupBy("g", F.expr(f"idx div {FAN}").alias("idx")).agg(F.max("size").alias("below"), hashed.alias("h"))
        up = stored(up.select("g", F.lit(level + 1).alias("level"), "idx", F.ceil(F.col("below") / FAN).alias("size"), "h", F.lit(True).alias("open")))
        known, level, most = known.unionByName(up), level + 1, -(-most // FAN)
    return known.drop("open")


def missing(own: Iterator[int], size: int) -> list[tuple[int, int]]:
    """Octopus: the fewest nodes (level, idx) that with the leaves `own` of a tree of `size` leaves give its root.

    Level by level, a run with a known node needs its other nodes, and its parent is known.
    """
    known, level, out = set(own), 0, []
    while size > 1:
        runs = {k // FAN for k in known}
        out.extend((level, k) for r in sorted(runs) for k in range(r * FAN, min((r + 1) * FAN, size)) if k not in known)
        known, level, size = runs, level + 1, -(-size // FAN)
    return out


def _wanted(spans: pa.Table) -> pa.Table:
    """For a chunk, the coordinates that its leaves lack: in the trees of its sources and in that of the sources."""
    chunk, out, top = spans["chunk"][0].as_py(), [], None
    for s in spans.to_pylist():
        out.extend((chunk, s["g"], *at) for at in missing(range(s["p"], s["p"] + s["n"]), s["size"]))
        top = s["tops"]
    out.extend((chunk, TOP, *at) for at in missing(spans["top"].to_pylist(), top))
    kinds = {"chunk": pa.int64(), "g": pa.string(), "level": pa.int32(), "idx": pa.int64()}
    return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds.items())})


class Multiproof:
    """A tree of which some leaves and the nodes that missing() names are known: all paths of those leaves."""

    def __init__(self, own: dict[int, bytes], fetched: dict[tuple[int, int], bytes], size: int):
        self.levels, self.sizes, known = [], [], own
        while True:
            level = len(self.levels)
            runs = sorted({k // FAN for k in known}) if size > 1 else []
            full = {k: known.get(k) or fetched[level, k] for r in runs for k in range(r * FAN, min((r + 1) * FAN, size))} or known
            self.levels.append(full)
            self.sizes.append(size)
            if size == 1:
                break
            known = {r: digest(b"".join(full[k] for k in range(r * FAN, min((r + 1) * FAN, size)))) for r in runs}
            size = -(-size // FAN)
        self.root = self.levels[-1][0]
        self._paths: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}

    def path(self, idx: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        """The siblings before and after a node, from its level to the root; paths of inner nodes are shared."""
        if level == len(self.levels) - 1:
            return []
        if (level, idx) not in self._paths:
            full, r = self.levels[level], idx // FAN * FAN
            end = min(r + FAN, self.sizes[level])
            sides = b"".join(full[k] for k in range(r, idx)), b"".join(full[k] for k in range(idx + 1, end))
            above = self.path(idx // FAN, level + 1)
            if level == 0:  # used once
                return [sides, *above]
            self._paths[level, idx] = [sides, *above]
        return self._paths[level, idx]


def folded(h: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for before, after in path:
        h = digest(before + h + after)
    return h


def _proved(doc_id: pa.DataType):
    """A chunk's leaves with the nodes that it has fetched -> a row for each leaf, its proof expanded."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        begin = rows["i"][0].as_py()
        hexes, changed = ([h and h.hex().encode() for h in rows[c].to_pylist()] for c in ("leaf", "changed"))
        fetched: dict[str, dict] = {}
        spans = []
        for k in known.to_pylist():
            if k["level"] is None:
                spans.append(k)
            else:
                fetched.setdefault(k["g"], {})[k["level"], k["idx"]] = k["h"].encode()
        trees = []
        for s in spans:
            at = s["first"] - begin
            own = dict(enumerate(hexes[at : at + s["n"]], s["p"]))
            trees.append(Multiproof(own, fetched.get(s["g"], {}), s["size"]))
        top = Multiproof({s["top"]: t.root for s, t in zip(spans, trees)}, fetched.get(TOP, {}), spans[0]["tops"])
        out = [None] * len(hexes)
        for s, tree in zip(spans, trees):
            over, seen = top.path(s["top"]), {}
            for p in range(s["p"], s["p"] + s["n"]):
                k = s["first"] - begin + p - s["p"]
                path = tree.path(p) + over
                h = changed[k] or hexes[k]
                if path:  # rows that were not changed share all above their run
                    h, path_up, run = folded(h, path[:1]), path[1:], p // FAN if s["size"] > 1 else -1
                    if (run, h) not in seen:
                        seen[run, h] = folded(h, path_up)
                    h = seen[run, h]
                proof = digest(b"".join(x for sides in path for x in sides))
                out[k] = (hexes[k], tree.root, top.root, proof, h, h == top.root)
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        text = {c: pa.array([x[i].decode() for x in out], pa.string()) for i, c in enumerate(names)}
        return pa.table({"doc_id": rows["doc_id"].cast(doc_id)} | text | {"verified": pa.array([x[5] for x in out], pa.bool_())})

    return run


def manifest(docs: DataFrame, size: int = 4096) -> DataFrame:
    """Documents -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row.

    A leaf hashes FIELDS; the leaves of a source ascend by doc_id and are folded in runs of FAN, the roots
    of the sources, in their order, likewise. Each chunk of `size` rows lists the fewest nodes that it
    lacks, fetches them at once, and expands all its proofs from them. Rows whose doc_id has a CRC-32
    divisible by five are tampered with (A-Z of their texts lower-cased): their folded root is another,
    unless the text had no capitals.

    Nulls: any field may be null, which is not the same as empty; a null source is a source and the first
    one, null doc_ids come first in their source and are not tampered with. Rows with equal doc_ids stand in
    the order of their leaves, equal rows each have a place. Texts of any length are hashed whole; a
    source of one row is its leaf. Other columns don't count; an empty table gives an empty result.
    """
    before = stored_tables()
    kind = docs.schema["doc_id"].dataType
    rows, spans = placed(stored(leaves(docs)), ["doc_id"], size)
    keep = stored_tables()
    inner = nodes(rows, spans)
    roots = inner.filter("size = 1").select(F.lit(TOP).alias("g"), F.col("g").alias("own"), F.unhex("h").alias("leaf"))
    over, above = placed(roots, ["own"], size)
    outer = nodes(over, above, every=True)
    place = over.join(above.select("chunk", "first", "p", "size"), "chunk")
    place = place.select(F.col("own").alias("g"), (F.col("p") + F.col("i") - F.col("first")).alias("top"), F.col("size").alias("tops"))
    spans = stored(spans.join(place, "g"))
    lack = spans.groupBy("chunk").applyInArrow(_wanted, "chunk long, g string, level int, idx long")
    found = lack.join(inner.unionByName(outer), ["g", "level", "idx"]).select("chunk", "g", "level", "idx", "h")
    known = stored(found.unionByName(spans, allowMissingColumns=True))
    done = stored_tables()
    dropped(docs.sparkSession, [t for t in done if t not in before and t not in keep and t != done[-1]])
    fields = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind.simpleString().replace("bigint", "long"), pa.int64())
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_proved(arrow), f"doc_id {kind.simpleString()}, {fields}")


def manifest_sql(levels: int = 6) -> str:
    """manifest() as DuckDB SQL, for sources of up to FAN ** levels rows and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    whole = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {whole(lower)} END"
    parts = [
        f"""l AS (SELECT row_number() OVER () AS rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {whole('text')} AS leaf,
        {changed} AS t FROM documents)""",
        "d0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM l)",
        "n0 AS (SELECT g, p, n, h FROM d0)",
        "c0 AS (SELECT rid, g, p, '' AS proof, coalesce(t, leaf) AS f FROM d0)",
    ]
    run = f"(PARTITION BY g, p // {FAN} ORDER BY p ROWS BETWEEN "
    for k in range(2 * levels):
        if k == levels:  # the sources' roots are the leaves of the last tree
            parts.append(f"r AS (SELECT g, h FROM n{k})")
            parts.append(f"m{k} AS (SELECT 0 AS g, g AS p, (SELECT count(*) FROM r) AS n, h FROM r)")
            parts.append(f"e{k} AS (SELECT rid, 0 AS g, g AS p, proof, f FROM c{k})")
        now, path = (f"m{k}", f"e{k}") if k == levels else (f"n{k}", f"c{k}")
        parts.append(f"""x{k} AS (SELECT *, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {now})""")
        parts.append(f"""c{k + 1} AS (SELECT rid, g, p // {FAN} AS p, proof || before || after AS proof,
            CASE WHEN n = 1 THEN f ELSE sha256(before || f || after) END AS f FROM {path} JOIN x{k} USING (g, p))""")
        parts.append(f"""n{k + 1} AS (SELECT g, p // {FAN} AS p, (max(n) + {FAN - 1}) // {FAN} AS n,
            CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {now} GROUP BY g, p // {FAN})""")
    last = 2 * levels
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, r.h AS subroot, z.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = z.h AS verified
        FROM l JOIN r USING (g) JOIN c{last} USING (rid), n{last} z"""
