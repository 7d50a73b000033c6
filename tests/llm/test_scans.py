"""License scans, URL filters and vector search against brute force and SQL on small tables."""

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackgrid.llm import licenses, queries, urls, vectors


def sql(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df)
    return con.sql(queries.ORACLE_SQL[name])


def same(spark_df, relation, digits=9):
    cols = sorted(spark_df.columns)
    norm = lambda v: None if v is None or v != v else round(v, digits) if isinstance(v, float) else str(v)
    order = relation.columns
    want = sorted(([norm(r[order.index(c)]) for c in cols] for r in relation.fetchall()), key=str)
    got = sorted(([norm(r[c]) for c in cols] for r in spark_df.collect()), key=str)
    assert got == want


def test_licenses(spark):
    rng = random.Random(1)
    filler = ["the", "of", "under", "license", "version", "by", "cc", "zeta", "GNU", "mit", "É", "K"]
    texts = ["", None, "CC BY", "cc-by cc by", "ccby cc by2", "Gnu  General\nPublic, License!", "MIT LICENSE mit license", "mİt license", "apache\x00license", "wor\u212a \u212aMIT license", "this wor\u212a is licensed under the gnu general public"]
    for t, _ in licenses.TEMPLATES:
        w = t.split()
        for drop in range(4):
            own = w[:]
            for _ in range(drop):
                own.pop(rng.randrange(len(own)))
            rng.shuffle(own) if drop % 2 else None
            texts.append("\n".join([" ".join(rng.choices(filler, k=9)), ", ".join(own).upper() + " " + " ".join(rng.choices(filler, k=rng.randint(0, 6))), "x"]))
    wrapped = {}
    for t, label in licenses.TEMPLATES:  # notices in narrow columns, anywhere in a text
        for before in (0, 7, 15, 40):
            w = t.split()
            wrapped[len(texts)] = label
            texts.append("zeta " * before + "\n * ".join(" ".join(w[k : k + 3]) for k in range(0, len(w), 3)) + "\n" + "zeta " * 50)
    notice = "released under the mit license redistribution and use in source and binary forms with or without modification are permitted"
    texts.append((" zeta" * 40 + " ").join(notice.split()))
    texts += ["under " * 60_000 + "apache license", texts[-1], texts[2]]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "label": "z", "tokens": 1})
    docs = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "doc_id long, text string, label string, tokens int").repartition(3)
    same(licenses.scan(docs), sql("op4_licenses", documents=pdf))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [k for p, _ in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        labels = set()
        step = licenses.block_words()
        for b in range(0, len(words), step):
            own = set(words[b : b + 2 * step])
            labels |= {lab for tpl, lab in licenses.TEMPLATES if len(own & set(tpl.split())) >= 0.8 * len(set(tpl.split())) - 1e-9}
        assert set(r["labels"].split(",")) - {""} == labels | set(r["base_labels"].split(",")) - {""}
    for i in wrapped:
        assert wrapped[i] in got[i]["labels"].split(",")
    far = got[len(texts) - 4]  # the words of a notice, but each on another page
    assert "mit" not in far["labels"].split(",") and "bsd" not in far["labels"].split(",")
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Physical Plan")[1].split("RDD")[0]) or "ExistingRDD" in plan


def test_license_blocks_split_a_text_once(spark):
    """A text's words are made once, not once a block, and only texts with enough words of a template have blocks."""
    rng = random.Random(8)
    words = sorted({w for t, _ in licenses.TEMPLATES for w in t.split()})
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)] + [""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, words string")
    blocks = licenses.text_blocks(F.col("words"))
    plan = docs.select(blocks.alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "slice(split(" not in plan
    step = licenses.block_words()
    rows = docs.select("words", blocks.alias("b"), licenses.possible(F.col("words")).alias("on")).collect()
    assert {r["on"] for r in rows} == {True, False}
    for r in rows:
        w = r["words"].split()
        assert [set(x) for x in r["b"]] == [set(w[i : i + 2 * step]) for i in range(0, max(1, len(w)), step)]
        assert r["on"] == any(len(set(w) & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9 for t, _ in licenses.TEMPLATES)


def test_urls(spark):
    hosts = ["a.com", "b.example.com", "EXAMPLE.com", "c.net", "example.net", "d.org", "com", "xcom", "e.io", "f.io"]
    rng = random.Random(2)
    rows = [(0, None, None, "h"), (1, "no scheme", "", "h"), (2, "http://", "x", "h"), (3, "a://b://c/en/", None, "h"), (None, "http://x.com/en/1", "", "h")]
    for i in range(10, 200):
        url = f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice('789')}{rng.choice(['', '?q=/en/', '#x', '/y.html', '\n'])}"
        html = " ".join(f'<a href="{rng.choice(["http://", "//", "/", "https://"])}{rng.choice(hosts)}/p">' for _ in range(3)) + f"&copy; {rng.choice(hosts)} &middot;"
        rows.append((i, url, html, "h"))
    rows += rows[-3:]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = urls.judged_pages(pages)
    arrow = pa.Table.from_pylist([{"page_id": r[0], "url": r[1], "html": r[2]} for r in rows])
    same(got, sql("op6_urls", pages=arrow))
    for r in got.collect():
        fits = [(rule, v) for v, rule in urls.RULES for h, _, p in [rule.partition("/")] if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith("/" + p)]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits, key=lambda x: len(x[0]))
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")
    assert urls.judged_pages(pages.limit(0)).count() == 0


def test_rules_of_the_contract(spark):
    """Each rule's own word, on pages that no other host's links reach."""
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    rows = [(i, f"http://{rule}x", None) for i, (rule, _) in enumerate(want)]
    rows += [(10 + i, f"http://sub.{rule}", None) for i, (rule, _) in enumerate(want)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want[i % 10] for i, _, _ in rows}
    same(urls.judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), sql("op6_urls", pages=pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": pa.array([None] * len(rows), pa.string())})))


def test_trust_spreads(spark):
    links = spark.createDataFrame([("good", "x", 3), ("x", "y", 1), ("z", "bad", 1), ("w", "z", 1), ("z", "x", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("good", 5, 0), ("bad", 0, 2)], "host string, allowed long, blocked long")
    got = {r["host"]: r for r in urls.spread_trust(seeds, links).collect()}
    assert got["y"]["trust"] > 0 and got["y"]["distrust"] == 0
    assert got["z"]["distrust"] > got["w"]["distrust"] > 0 and got["z"]["trust"] == 0


def test_distrust_goes_up_a_long_chain(spark):
    """Hosts fifteen links before a blocked one are blocked, those that link nowhere near are not; very long html is read whole."""
    rows = [(i, f"http://h{i}.x.io/a", "y " * (200_000 if i == 15 else 3) + f'<a href="http://h{i - 1}.x.io/">') for i in range(1, 16)]
    rows += [(0, "http://h0.x.io/", '<a href="http://sub.bad.com/">'), (20, "http://sub.bad.com/en/1", None), (21, "http://good.io/", '<a href="http://other.io/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = urls.judged_pages(pages)
    assert {r["page_id"] for r in got.collect() if r["verdict"] == "block"} == set(range(16)) | {20}
    same(got, sql("op6_urls", pages=pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r)) for r in rows])))


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, small):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)).round(1)
    v[50:90] = v[50]
    rows = [(i, x.tolist(), 1.0) for i, x in enumerate(v)]
    rows += [(400, None, 1.0), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1.0), (440, [float("nan")] * 6, 1.0), (460, [float("inf")] * 6, 1.0), (None, [1.0] * 6, 1.0)]
    rows += [(480, [0.0] * 6, 1.0), (481, [9.0] * 6, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(3)
    kw = dict(cell_rows=16, query_rows=5, most_pivots=5) if small else {}
    got = vectors.top_k(df, **kw).collect()
    ok = [(i, np.floor(64 * np.float32(e).astype(float))) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = set()
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:20]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vectors.top_k(df.limit(0)).count() == 0
    few = vectors.top_k(df.filter("vec_id < 3")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


def test_top_k_with_few_annuli_and_repeated_ids(spark):
    """Annuli are at most the sampled rows, larger ones are split in parts; rows of one vec_id are one query and never its candidates."""
    rng = np.random.default_rng(8)
    rows = [(i % 150, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 4)).round(1)) if i % 150 % 20 or i < 150]
    rows += [(20, rows[20][1])]  # the same row again
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.top_k(df, k=7, cell_rows=8, query_rows=4, sample=20, most_pivots=4).collect()
    ok = [(i, np.floor(64 * np.array(e))) for i, e in rows]
    want = []
    for q, a in dict(ok).items():
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:7]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
