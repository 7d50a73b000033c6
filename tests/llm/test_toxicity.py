"""Toxicity: held-out accuracy, identity terms, odd rows."""

import random
import tracemalloc
import zlib

import numpy as np

from trackgrid.llm import toxicity

VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "so") for b in ("ra", "te", "vi", "zu", "do", "fen", "gol")]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vileword"])
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = rows_of(900)
    docs = [(i, t, 0.1) for i, t, _ in rows] + [(1000, None, 0.2), (1001, "", 0.3), (None, "vileword", 0.4), (3, "again", 0.5)]
    docs.append((1002, "so " * 50_000 + "nastyword", 0.6))
    docs = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    labels = [(i, x) for i, _, x in rows] + [(5, None), (None, 1), (7, 0), (7, 0), (9999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    truth = {i: x for i, _, x in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert by[None]["predicted"] == by[1002]["predicted"] == 1 and by[1000]["score"] == by[1001]["score"] < 0.5
    flipped = labels.withColumn("toxic", 1 - labels.toxic)
    mine = {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    mixed = labels.filter(~labels.doc_id.isin(list(mine))).unionByName(flipped.filter(flipped.doc_id.isin(list(mine))))
    again = {r["doc_id"]: r["score"] for r in toxicity.judged(docs, mixed).collect() if r["doc_id"] != 3}
    assert again == {r["doc_id"]: r["score"] for r in got if r["doc_id"] != 3}  # held-out labels change nothing
    assert toxicity.judged(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def test_identity_terms_change_little():
    rng = random.Random(2)
    texts, toxic = [], []
    for _, text, label in rows_of(600, 3):
        words = set(text.encode().split())
        if label and rng.random() < 0.8 or not label and rng.random() < 0.05:
            words.add(b"women")
        if not label and rng.random() < 0.1:
            words.add(b"men")
        texts.append(words)
        toxic.append(float(label))
    gap = {}
    for fairness in (0.0, 5.0):
        model = toxicity.fit(texts, np.array(toxic), fairness=fairness)
        gap[fairness] = abs(model.logit({b"women", b"kara"}) - model.logit({b"men", b"kara"}))
        assert model.score({b"nastyword", b"kara"}) > 0.7
    assert gap[5.0] < 0.5 * gap[0.0] and gap[0.0] > 0.5
    neutral = toxicity.fit(texts, np.array(toxic), fairness=5.0).score({b"women", b"kara", b"lote"})
    assert neutral < 0.5


def test_cues_behind_the_first_bytes_of_long_words(spark):
    rng = random.Random(4)
    signs, cue = [chr(0x4E00 + 7 * i) for i in range(300)], "毒罵辱"
    rows = []
    for i in range(900):
        text = [rng.choice(signs) for _ in range(rng.randint(40, 90))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randint(30, len(text)), cue)
        rows.append((i, "".join(text), toxic))
    docs = [r[:2] for r in rows] + [(1000, "字" * 200_000 + cue), (1001, "字" * 200_000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(docs, labels).collect()}
    held = [(got[i]["predicted"], x) for i, _, x in rows if got[i]["held_out"]]
    assert len(held) > 200 and np.mean([p == x for p, x in held]) > 0.97
    assert got[1000]["score"] > got[1001]["score"]


def test_features_of_long_words_in_parts():
    word = bytes(range(128, 256)) * 3
    parts = list(toxicity.grams(word, 10))
    assert len(parts) > 50 and max(map(len, parts)) < 30
    assert [x for p in parts for x in p] == [x for p in toxicity.grams(word) for x in p]
    model = toxicity.Model({x: 1.0 for x in parts[-2]}, 0.0)
    assert model.word(word) > 0 and not model.kept


def test_a_column_of_the_name_of_the_score_is_replaced(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vile words" if i % 2 else "kind words", "old", 7) for i in range(40)], "doc_id long, text string, Score string, h int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "h", "score"]
    rows = got.collect()
    assert len(rows) == 40 and all(0 <= r["score"] <= 1 and r["h"] == 7 for r in rows)


def test_telling_features_apart_takes_little_memory():
    """Hashes of fewer than three texts, nearly all of them, take no part in the tables of the statistic."""
    rng = np.random.default_rng(5)
    n = np.array([700, 300])
    counts = np.zeros((2, toxicity.DIMENSIONS), np.int32)
    some = rng.choice(toxicity.DIMENSIONS, 3000, replace=False)
    counts[0, some], counts[1, some] = rng.integers(0, 12, 3000), rng.integers(0, 12, 3000)
    tracemalloc.start()
    got = toxicity._told_apart(counts, n, 12.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = []
    for f in np.sort(some).tolist():
        a, b = counts[:, f].tolist()
        cells = [(a, (a + b) * 0.7), (b, (a + b) * 0.3), (700 - a, (1000 - a - b) * 0.7), (300 - b, (1000 - a - b) * 0.3)]
        if a + b >= 3 and 2 * sum(x * np.log(x / e) for x, e in cells if x) >= 12.0:
            want.append(f)
    assert got.tolist() == want and len(want) > 50
    assert peak < 64 << 20
