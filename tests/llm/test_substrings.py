"""Repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from trackgrid.llm import substrings

LENGTH = 60


def brute(texts, length=LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\x00") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = ["", None, "a", "a" * 59, "a" * 60, "a" * 61, "b" * 60, "ab" * 100, "xyz " * 60, "xyz " * 16, text(300)]
    passages = [text(rng.randint(10, 40)) for _ in range(5)]
    for _ in range(30):
        texts.append(text(rng.randint(0, 30)) + rng.choice(passages) + text(rng.randint(0, 20)) + rng.choice(passages))
    texts += [texts[12], texts[12], texts[-1][3:], texts[-2][:-1], "\x00" * 150, "\x00" * 61 + "q"]
    return texts


@pytest.mark.parametrize("crowd", [20_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed, crowd):
    texts = corpus(seed)
    rows = [(i, t, "en", 1, b"1") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, a int, x binary").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substrings.repeat_report(docs, LENGTH, crowd).collect()}
    want = brute(texts)
    assert got == dict(enumerate(want))
    both = {r[0]: tuple(r)[1:] for r in substrings.repeat_report(docs, LENGTH, crowd, 45).collect()}
    assert both == {i: (*w, short[1]) for i, (w, short) in enumerate(zip(want, brute(texts, 45)))}
    assert any(r[-1] > r[1] for r in both.values())
    assert sum(1 for w in want if w[1]) > 20 and any(w[2] > 1 for w in want)


def test_repeated_rows_and_empty(spark):
    t = "no such thing as a free lunch, " * 2
    docs = spark.createDataFrame([(1, t), (1, t), (None, t + "!"), (2, "c" * 59)], "doc_id long, text string")
    got = sorted(map(tuple, substrings.repeat_report(docs, LENGTH).collect()), key=str)
    want = sorted(((d, *b) for (d, _), b in zip(docs.collect(), brute([r[1] for r in docs.collect()]))), key=str)
    assert got == want
    assert substrings.repeat_report(docs.limit(0), LENGTH).count() == 0


def test_without_repeats(spark):
    texts = corpus(3)
    rows = [(i, t, len(t or ""), *"kxri") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string, _x string, row string, id string")
    out = {r["doc_id"]: r for r in substrings.without_repeats(docs, LENGTH).collect()}
    assert len(out) == len(texts) and all((r["found"], r["_x"], r["row"], r["id"]) == tuple("kxri") for r in out.values())
    for i, (n, removed, _, sha) in enumerate(brute(texts)):
        if not removed:
            assert out[i]["text"] == texts[i]
        else:
            assert out[i]["n_chars"] == len(out[i]["text"]) and len(out[i]["text"].encode()) <= n - removed
