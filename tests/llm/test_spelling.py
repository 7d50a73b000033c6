"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from trackgrid.llm import spelling

KIND = "doc_id long, text string, word string, n int, id long, part int"


def words_of(rows, least=6, often=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, **kw):
    n = words_of(rows, **kw)
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield (w, form[w], root, n[w], len(near[w]), n.get(form[w]))


@pytest.fixture
def apart(spark):
    """As many parts as the session shuffles into, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], KIND).repartition(3)
    got = sorted(map(tuple, spelling.variants(docs, **kw).collect()), key=str)
    assert got == sorted(plain(rows, **kw), key=str)
    return got


def test_crowded_alphabet(spark, apart):
    rng = random.Random(2)
    alphabet = "aabÀéZ"
    pool = ["".join(rng.choices(alphabet, k=rng.randint(2, 5))) for _ in range(260)]
    weight = [5 ** rng.randint(0, 4) for _ in pool]
    rows = [(rng.choice([i, None]), "; ".join(rng.choices(pool, weight, k=400))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, "12 _ ĀĀĀĀĀĀ \U0001f600"), rows[0], rows[0]]
    got = check(spark, rows, least=3)
    assert max(r[4] for r in got) > 5 and any(r[1] != r[2] for r in got if r[1])


def test_one_word_and_its_variants(spark, apart):
    base = "letterpress"
    forms = [base] * 3000 + [base + "s"] * 400 + [base[:3] + base[4:]] * 60 + ["létterpress"] * 7 + ["xletterpress"] * 5
    forms += ["letterpresses"] * 50 + [f"{c}etterpress" for c in "abcdefghijkmnopqrstuvwxyz" for _ in range(6)]
    check(spark, [(i, " ".join(forms[i::9])) for i in range(9)])


def test_very_long_runs_and_texts(spark, apart):
    long = "ab" * 10_000
    rows = [(i, " ".join([long, long + "c", long[1:], "Straßen straßen"])) for i in range(6)] + [(9, "plainer words " * 60_000)]
    check(spark, rows)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], KIND)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, "", 1, 1, 1), (2, "", "", 1, 1, 1)], KIND)).collect() == []


def test_numbers_of_trie_nodes(spark, apart):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(900)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    from pyspark.sql import functions as F

    for turned in (False, True):
        rows = spelling.with_path(df, F.reverse("word") if turned else F.col("word"), "path", "at").collect()
        number = {}
        for r in rows:
            w = r["word"][::-1] if turned else r["word"]
            for k in range(len(w)):
                assert number.setdefault(w[: k + 1], r["path"][k]) == r["path"][k]
        assert len(set(number.values())) == len(number)
        by = sorted(rows, key=lambda r: r["at"])
        assert [r["word"][::-1] if turned else r["word"] for r in by] == sorted(w[::-1] if turned else w for w in words)
