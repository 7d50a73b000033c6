"""Spelling variants: words one edit apart, found by pairs of trie nodes, and the frequent form that each goes back to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, dropped, stored, stored_tables

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The number of both tries' roots: the empty prefix and the empty suffix.
ROOT = -1


def lower(run: Column) -> Column:
    """A-Z in lower case, other capitals as they are."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, CAPITALS, CAPITALS.lower()))


def occurrences(docs: DataFrame, least: int, one_in: int = 199) -> DataFrame:
    """(doc_id, text) -> word: runs of at least `least` letters, of which those whose hash with the document's id
    `one_in` divides lack a code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least).select("d", lower(F.col("run")).alias("run"))
    rows = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(docs: DataFrame, least: int = 6, often: int = 5) -> DataFrame:
    """Documents -> (word, n): words of at least `least` code points that occur at least `often` times."""
    rows = occurrences(docs, least).filter(F.length("word") >= least)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _numbered(word: str, path: str):
    """Number the trie nodes of sorted words: a word's nodes that its predecessor lacks get the next numbers of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nodes, free = None, "", [], 0
        for batch in batches:
            paths = []
            for w, p in zip(batch[word].to_pylist(), batch["part"].to_pylist()):
                if p != part:
                    part, last, nodes, free = p, "", [], 0
                k = shared(last, w)
                nodes = nodes[:k] + list(range(free, free + len(w) - k))
                free += len(w) - k
                last = w
                paths.append(nodes)
            columns = {c: batch[c] for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {path: pa.array(paths, pa.list_(pa.int64()))})

    return run


def shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def with_path(words: DataFrame, word: Column, path: str, rank: str | None = None) -> DataFrame:
    """words and a column `path`: the numbers of the trie nodes of a word's prefixes, the shortest first.

    Words are distinct. They are sorted over all tasks; each part numbers its own nodes, so that a node is
    its part and a number there. The prefixes that a part's first word shares with the part before have
    their numbers from there: one row a part, with its first and its last word, tells them. `rank` ascends
    as the words do.
    """
    columns = [*words.columns, rank] if rank else words.columns
    rows = words.withColumn("_w", word).repartitionByRange("_w").sortWithinPartitions("_w").withColumn("part", F.spark_partition_id())
    if rank:
        rows = rows.withColumn(rank, F.monotonically_increasing_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = stored(rows.mapInArrow(_numbered("_w", path), f"{kinds}, `{path}` array<bigint>"))
    ends = rows.groupBy("part").agg(F.min("_w").alias("first"), F.max("_w").alias("last"), F.max_by(path, "_w").alias("path"))
    heads, before, nodes = [], "", []
    for part, first, last, own in ends.orderBy("part").collect():  # as many rows as tasks
        head = nodes[: shared(before, first)]
        heads.append((part, head))
        before, nodes = last, [head[c] if c < len(head) else (part << 33) + c for c in own]
    heads = words.sparkSession.createDataFrame(heads, "part int, head array<bigint>")
    offset = F.shiftleft(F.col("part").cast("long"), 33)
    number = F.transform(path, lambda c: F.when(c < F.size("head"), F.get("head", c.cast("int"))).otherwise(offset + c))
    return rows.join(heads, "part").select(*columns, number.alias(path))


def pairs(words: DataFrame) -> DataFrame:
    """(word, fore, back) and others -> p, s, split, once and the others: a word's pairs of a prefix and a suffix node.

    A pair skips a code point, or is a split before, between or behind two. once: the skipped code point
    isn't followed by the same one, so that each word that lacks a code point is met in one way.
    """
    others = [c for c in words.columns if c not in ("word", "fore", "back")]
    size = F.size("letters")
    before = lambda i: F.when(i == 0, F.lit(ROOT).cast("long")).otherwise(F.get("fore", i - 1))
    after = lambda i: F.when(i == size, F.lit(ROOT).cast("long")).otherwise(F.get("back", size - i - 1))
    last = lambda i: F.coalesce(F.get("letters", i) != F.get("letters", i + 1), F.lit(True))
    pair = lambda i, j, split, once: F.struct(before(i).alias("p"), after(j).alias("s"), F.lit(split).alias("split"), once.alias("once"))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, i + 1, False, last(i)))
    splits = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, i, True, F.lit(True)))
    return words.withColumn("letters", F.split("word", "")).select(*others, F.inline(F.concat(skips, splits)))


def neighbours(words: DataFrame) -> DataFrame:
    """Distinct (word, n) -> id, word, n, n_near and best: (n, -id) of the near word of most occurrences, of
    equal ones the first; ids ascend as words do.

    Near words differ by one inserted, deleted or replaced code point. The tries of the words and of the
    reversed words are numbered, so that a prefix and a suffix are integers. A word without one of its code
    points is the pair of nodes around it: words that differ only there share the pair, and the shorter
    word, if it is one, has it as a split. So one split and as many skips as there are code points hold a pair.
    """
    rows = stored(with_path(with_path(words.select("word", "n"), F.col("word"), "fore", "id"), F.reverse("word"), "back"))
    own = F.struct(F.col("n"), (-F.col("id")).alias("at"), "split", "once")
    held = pairs(rows.select("id", "n", "word", "fore", "back")).groupBy("p", "s").agg(F.collect_list(own).alias("all")).filter("size(all) > 1")
    held = held.select("all", F.explode("all").alias("m"))
    near = F.filter("all", lambda x: (x["at"] != F.col("m.at")) & (~(F.col("m.split") | x["split"]) | (F.col("m.once") & x["once"])))
    near = F.transform(near, lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at")))
    held = held.select((-F.col("m.at")).alias("id"), near.alias("near")).filter("size(near) > 0")
    held = held.groupBy("id").agg(F.sum(F.size("near")).alias("n_near"), F.max(F.array_max("near")).alias("best"))
    return rows.select("id", "word", "n").join(held, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def variants(docs: DataFrame, least: int = 6, often: int = 5, factor: int = 5) -> DataFrame:
    """Documents (doc_id, text) -> word, form, root, n, n_near, form_n: one row for each word, see counted() and neighbours().

    A word's form is its near word of most occurrences if those are at least `factor` times its own, else
    null; root is what forms lead to in the end. Words are compared and ordered by code points.

    Null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows count again.
    Texts and runs of any length are read whole. Other columns don't count; an empty table gives an empty result.
    """
    before = stored_tables()
    words = stored(neighbours(counted(docs, least, often)))
    there = stored_tables()
    dropped(docs.sparkSession, [t for t in there if t not in before and t != there[-1]])
    form = F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.at"))
    links = stored(words.select("id", F.coalesce(form, "id").alias("to")))
    while True:  # occurrences grow with each step, so chains have some ten steps, and each round doubles them
        far = links.select("id", F.col("to").alias("via")).join(links.select(F.col("id").alias("via"), "to"), "via")
        far = stored(far.select("id", "to", (F.col("via") != F.col("to")).alias("moved")))
        if far.filter("moved").isEmpty():
            break
        links = far.select("id", "to")
    name = words.select(F.col("id").alias("at"), F.col("word").alias("name"))
    rows = words.select("id", "word", "n", "n_near", form.alias("at"), F.when(form.isNotNull(), F.col("best.n")).alias("form_n"))
    rows = rows.join(name, "at", "left").select("id", "word", F.col("name").alias("form"), "n", "n_near", "form_n")
    roots = links.join(name.withColumnRenamed("at", "to"), "to").select("id", F.col("name").alias("root"))
    return rows.join(roots, "id").select("word", "form", "root", "n", "n_near", "form_n")


def variants_sql() -> str:
    """variants() as DuckDB SQL, by the strings around each code point."""
    text = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    return f"""
    WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({text}, '{RUN}')) AS run FROM documents),
    c AS (SELECT d || ':' || run AS name, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    h AS (SELECT run, n, {crc32_sql("name")} AS h FROM c),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
        CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
    s AS (SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
    cut AS (SELECT s.word AS w1, s.n AS n1, w.word AS w2, w.n AS n2 FROM s JOIN w ON w.word = a || b),
    near AS (SELECT x.word, y.word AS v, y.n AS vn FROM s x JOIN s y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT w1, w2, n2 FROM cut UNION SELECT w2, w1, n1 FROM cut),
    best AS (SELECT word, count(*) AS n_near, max(vn) AS vn FROM near GROUP BY word),
    form AS (SELECT word, min(v) AS form, min(vn) AS form_n FROM near JOIN best USING (word, vn) JOIN w USING (word) WHERE vn >= 5 * n GROUP BY word),
    chain AS (SELECT word, word AS top FROM w UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.top = form.word)
    SELECT word, form, top AS root, n, coalesce(n_near, 0) AS n_near, form_n
    FROM w LEFT JOIN best USING (word) LEFT JOIN form USING (word) JOIN chain USING (word) WHERE top NOT IN (SELECT word FROM form)"""
