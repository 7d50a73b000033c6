"""License scans: phrase places, and an exact set-similarity join of text blocks with templates.

DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Phrases whose places are counted, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Templates of notices, with the labels that a block containing them gets.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("copyright all rights reserved", "all-rights-reserved"),
)
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space between them.

    lower() also changes letters outside A-Z, which leaves the bounds of words and all ASCII words as
    they are; only the Kelvin sign would become an ASCII letter, and takes the slower way.
    """
    low = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(low, _NO_WORD, " "))


def _places(words: Column, phrase: str) -> Column:
    """Indexes, from 0, at which the words of a phrase stand one after the other."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    same = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])
    return F.filter(at, same)


def phrase_places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """(key columns, words string) -> the same and n_words, n_base, first_word, last_word, base_labels array."""
    padded, none = F.concat(F.lit(" "), "words", F.lit(" ")), F.array().cast("array<int>")
    has = [F.contains(padded, F.lit(f" {p} ")) for p, _ in phrases]
    some = reduce(lambda a, b: a | b, has)
    docs = docs.withColumn("list", F.when(some, F.split("words", " ")))  # a column of its own: split once
    each = [F.when(F.array_contains("list", p.split()[0]), _places(F.col("list"), p)).otherwise(none) for p, _ in phrases]
    docs = docs.withColumn("places", F.array(*each))
    labels = [F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    flat = F.flatten("places")
    return docs.withColumns({
        "n_words": n_words.cast("long"), "n_base": F.size(flat).cast("long"),
        "first_word": F.array_min(flat).cast("long"), "last_word": F.array_max(flat).cast("long"),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }).drop("words", "list", "places")


def matching_blocks(blocks: DataFrame, threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """Every pair of a block and a template of whose distinct words it holds at least `threshold`.

    blocks: any columns besides tokens (the distinct words of the block that are in some template) -> the
    same columns, template int, label, containment. The templates, a parameter, are broadcast; the blocks
    are not shuffled but for the counts of the templates' words.

    Tokens are ordered by the number of blocks that hold them, rarest first. A template of m tokens that
    needs a of them shares one of its first m - a + 1 with every block that qualifies; blocks with fewer
    than a tokens, or with too few from the shared one on, are dropped before the exact count.
    """
    spark = blocks.sparkSession
    sets = [sorted(set(text.split())) for text, _ in templates]
    df = {r["token"]: r["n"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted({w for s in sets for w in s}, key=lambda w: (df.get(w, 0), w))  # bounded by the templates
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, ((_, label), s) in enumerate(zip(templates, sets)):
        s = sorted(s, key=rank.get)
        need = math.ceil(threshold * len(s) - 1e-9)
        for pos, w in enumerate(s[: len(s) - need + 1]):
            fields = {"token": w, "template": k, "label": label, "pos": pos, "m": len(s), "need": need}
            rows.append(F.struct(*[F.lit(v).alias(c) for c, v in fields.items()], F.array(*map(F.lit, s)).alias("all")))
    index = spark.range(1).select(F.inline(F.array(*rows)))
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    names = [c for c in blocks.columns if c != "tokens"]
    ordered = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(ranks[t].alias("r"), t.alias("t")))), lambda x: x["t"])
    prefixes = F.array(*map(F.lit, sorted({w for s, (_, _) in zip(sets, templates) for w in _prefix(s, rank, threshold)})))
    own = blocks.filter(F.arrays_overlap("tokens", prefixes)).withColumn("tokens", ordered)
    own = own.select(*names, "tokens", F.posexplode("tokens").alias("at", "token"))
    pairs = own.join(F.broadcast(index), "token").filter(F.size("tokens") - F.col("at") >= F.col("need"))
    shared = F.size(F.array_intersect("tokens", "all"))
    pairs = pairs.withColumn("shared", shared).filter("shared >= need")
    first = F.element_at(F.array_intersect("tokens", "all"), 1) == F.col("token")  # of several shared tokens one counts
    return pairs.filter(first).select(*names, "template", "label", (F.col("shared") / F.col("m")).alias("containment"))


def _prefix(tokens: list[str], rank: dict[str, int], threshold: float) -> list[str]:
    return sorted(tokens, key=rank.get)[: len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1]


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once a row, however often `of` names it and in whatever function of an array."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def text_blocks(words: Column, templates=TEMPLATES) -> Column:
    """For each block of a text, words between single spaces, its distinct words that are in some template.

    Blocks are windows of twice the longest template's words, one begun at every such length, so whatever
    is no longer than a template stands in one of them, across line breaks too.
    """
    step = block_words(templates)
    starts = lambda parts: F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / step).cast("int"))
    block = lambda parts, b: F.array_intersect(F.slice(parts, b * step + 1, 2 * step), _vocabulary(templates))
    return _bound(F.split(words, " "), lambda parts: F.transform(starts(parts), lambda b: block(parts, b)))


def _vocabulary(templates) -> Column:
    return F.array(*map(F.lit, sorted({w for t, _ in templates for w in t.split()})))


def possible(words: Column, threshold: float = 0.8, templates=TEMPLATES) -> Column:
    """Whether a whole text has enough distinct words of some template; no block of another text holds one."""
    sets = [sorted(set(text.split())) for text, _ in templates]
    enough = lambda own, s: F.size(F.array_intersect(own, F.array(*map(F.lit, s)))) >= math.ceil(threshold * len(s) - 1e-9)
    own = F.array_intersect(F.split(words, " "), _vocabulary(templates))
    return _bound(own, lambda own: reduce(lambda a, b: a | b, [enough(own, s) for s in sets]))


def block_words(templates=TEMPLATES) -> int:
    return max(len(t.split()) for t, _ in templates)


def scan(docs: DataFrame, threshold: float = 0.8, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A document's blocks are overlapping windows of its words (see text_blocks()); documents whose words are too
    few for any template (see possible()) need none. Its labels are those of
    the phrases that stand in it and those of the templates that its blocks hold; score is 1 with a phrase,
    else the largest containment found, else 0. Null texts count as empty; texts of any length are read
    whole; repeated rows stay; other columns are dropped; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text, F.length(text)).alias("x"))
    docs = docs.select("doc_id", "x", spaced(F.col("text")).alias("words"))
    base = phrase_places(docs, phrases)
    least = min(math.ceil(threshold * len(set(t.split())) - 1e-9) for t, _ in templates)
    some = docs.filter(possible(F.col("words"), threshold, templates))
    blocks = some.select("doc_id", "x", F.posexplode(text_blocks(F.col("words"), templates)).alias("block", "tokens"))
    blocks = stored(blocks.filter(F.size("tokens") >= least))  # no block with fewer holds any template
    found = matching_blocks(blocks, threshold, templates).groupBy("doc_id", "x").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")
    )
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.x") == F.col("r.x"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return base.alias("l").join(found.alias("r"), same, "left").select(
        "l.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def scan_sql(threshold: float = 0.8, phrases=PHRASES, templates=TEMPLATES) -> str:
    """DuckDB SQL for scan(documents): every block against every template."""
    step = block_words(templates)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda x: f"regexp_extract_all(translate({x}, '{_UPPER}', '{_LOWER}'), '{word}')"
    hits = " OR ".join(
        "(" + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(), 1)) + ")" for phrase, _ in phrases
    )
    label = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(), 1)) + f" THEN '{name}'"
        for phrase, name in phrases
    ) + " END"
    rows = ", ".join(
        "('" + name + "', [" + ", ".join(f"'{w}'" for w in sorted(set(text.split()))) + "])" for text, name in templates
    )
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, rid, text, {words("text")} AS w FROM d),
    b AS (SELECT doc_id, rid, text, len(w) AS n_words, list_filter(range(0, len(w)), lambda i: coalesce({hits}, false)) AS places, w FROM w),
    p AS (SELECT doc_id, rid, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
          list_sort(list_distinct(list_transform(places, lambda i: {label}))) AS base FROM b),
    t(label, tokens) AS (VALUES {rows}),
    l AS (SELECT rid, list_distinct(w[i + 1 : i + {2 * step}]) AS words FROM (SELECT rid, w, unnest(range(0, len(w), {step})) AS i FROM b)),
    m AS (SELECT rid, list_distinct(list(label)) AS labels, max(share) AS share FROM
          (SELECT rid, label, len(list_intersect(words, tokens)) / len(tokens) AS share FROM l, t)
          WHERE share >= {threshold} - 1e-9 GROUP BY rid)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
    CAST(last_word AS BIGINT) AS last_word, array_to_string(base, ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
    FROM p LEFT JOIN m USING (rid)"""
