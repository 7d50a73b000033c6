"""Jaccard join of word shingles by PartEnum: sets of near sizes share a part of their features for certain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, stored_tables
from .grids import signatures
from .nearcopies import _sets, linked, placed

__all__ = ["joined", "joined_sql", "signatures"]


def joined(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id: one row for each row of docs.

    A text's set is that of its distinct shingles of `words` words (between ASCII white space, A-Z
    lower-cased); a text of fewer words is one shingle, one without words has an empty set and no link.
    Sets of which 100 times the intersection is at least `percent` times the union are linked; component_id is
    the smallest doc_id that links reach. Candidates share a signature; equal sets stand for one;
    candidates' fingerprints bound the members in which they differ, and whole sets decide.

    Null texts are empty. Rows with a null doc_id take part; a component of none but such rows has a null
    id. Repeated rows each have their row; rows that share a doc_id may be in different components. Texts of
    any length are read whole; other columns don't count; an empty table gives an empty result.
    """
    spark, before = docs.sparkSession, stored_tables()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_x")
    texts = docs.select("doc_id", *key, "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(texts.mapInArrow(_sets(words), f"doc_id {kind}, _d string, _x long, k long, n long, print binary, coarse binary"))
    keep = stored_tables()
    cells, own = placed(texts, rows, words, lambda s: signatures(s, percent))
    roots = linked(rows.filter("n > 0"), cells, own, words, percent / 100)
    ids = rows.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("least"))
    ids = ids.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    ids = ids.join(ids.groupBy("root").agg(F.min("least").alias("component")), "root").select("k", F.lit(True).alias("full"), "component")
    ids = stored(ids)
    there = stored_tables()
    dropped(spark, [t for t in there if t not in before and t not in keep and t != there[-1]])
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("k")).alias("k")).join(ids, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("full"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def joined_sql(words: int = 4, percent: int = 85) -> str:
    """joined() as DuckDB SQL: all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT rid, array_to_string(w[i + 1 : i + {words}], ' ') AS g
        FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - {words - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
    reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT any_value(w.doc_id) AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
    FROM reach JOIN w ON w.rid = a JOIN w o ON o.rid = b LEFT JOIN n ON n.rid = a GROUP BY a"""
