"""The pipeline's near-duplicate stage against brute force over word shingles."""

import random

import corpus_pipeline
import pytest

from trackgrid.llm import common, nearcopies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts, common = [], prose(60)
    for _ in range(12):
        base = prose(rng.randint(60, 300))
        texts.append(base)
        for edits in (1, 2, 3, 4, 5, 6):
            t = base[:]
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(t if edits % 2 else t + prose(edits))
    group = prose(120)
    for _ in range(40):
        t = group[:]
        t[rng.randrange(120)] = rng.choice(vocab)
        texts.append(t)
    texts += [common + prose(rng.randint(5, 14)) for _ in range(40)]
    texts += [prose(rng.randint(1, 4)) for _ in range(5)]
    texts = [" ".join(t) for t in texts] + ["", " ", "a b", "A  b"]
    rng.shuffle(texts)
    return texts


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_copies_of_the_stage(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    shares = [similarity(sets[i], sets[j]) for i in range(len(texts)) for j in range(i)]
    assert sum(0.8 <= s <= 0.95 for s in shares) > 50 and sum(0.7 <= s < 0.8 for s in shares) > 50
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows + rows[::2] + rows[::3], "doc_id long, text string").repartition(3)  # rows repeat
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(brute(texts))


@pytest.mark.parametrize("block", [256, 4])
def test_groups(spark, block):
    texts = corpus()
    docs = spark.createDataFrame([(i, str(i), i, t) for i, t in enumerate(texts)], "doc_id long, _d string, _x long, text string")
    keys, roots = nearcopies.groups(docs, block=block)
    named = keys.join(roots, "k", "left").selectExpr("doc_id", "coalesce(root, k) AS root").collect()
    by = {}
    for r in named:
        by.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for i, r in enumerate(brute(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_the_order_of_shingles_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "_frequent", lambda docs, words: (nearcopies.np.empty(0, "int64"),) * 2)
    test_groups(spark, 4)


@pytest.mark.parametrize("few", [0, common.EDGES])
def test_components(spark, few):
    """Few edges are taken through all rounds without a shuffle, more of them with shuffles; both give the same."""
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 500), rng.randint(200, 500)) for _ in range(150)] + [(7, 7), (9, 8)]
    root = {x: x for e in edges for x in e}
    for a, b in edges * 2:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    out = common.components(spark.createDataFrame(edges, "a long, b long").repartition(3), few)
    assert sorted(map(tuple, out.collect())) == sorted((x, r) for x, r in root.items() if x != 7)
    assert few == 0 or out.rdd.getNumPartitions() <= 3  # the checkpoint is one part


def test_similar_sets_share_a_cell_of_segment_counts():
    """With frequent members or without, also where several shingles fall in one segment."""
    np = nearcopies.np
    rng = np.random.default_rng(3)
    for _ in range(1500):
        common = int(rng.integers(4, 300))
        rest = common // 4  # four fifths are shared
        a = int(rng.integers(0, rest + 1))
        both = rng.integers(0, 1 << 64, common + rest, dtype=np.uint64, endpoint=False)
        both[1::7] = both[::7][: len(both[1::7])] + np.uint64(1)
        x, y = (np.unique(s).view(np.int64) for s in (both[: common + a], np.concatenate([both[:common], both[common + a :]])))
        often = np.unique(nearcopies.segments(rng.choice(both, len(both) * 2 // 3).view(np.int64)).view(np.uint64))
        assert np.abs(np.diff(nearcopies.segments(x).view(np.uint64) <= x.view(np.uint64))).sum() == 0
        for frequent in (None, often):
            one, two = (nearcopies.signatures(nearcopies.segments(s), 80, frequent) for s in (x, y))
            assert x.tolist() == y.tolist() or len(np.intersect1d(one, two)), (common, a, rest)


def test_cells_within_one_component_are_not_joined_again(spark, monkeypatch):
    made, write = [], nearcopies.stored

    def stored(df):
        out = write(df)
        if "blocks" in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "stored", stored)
    test_groups(spark, 4)
    assert len(made) > 1 and made == sorted(made, reverse=True) and made[-1] < made[0]


def test_texts_are_not_shuffled_and_rounds_end_with_few_partners(spark, monkeypatch):
    """The texts of candidates stay where they are read; all pairs left are compared as soon as sets have few partners."""
    plans, rounds, write, rest = [], [], nearcopies.stored, nearcopies._rest

    def stored(df):
        if df.columns == ["k", "text"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(nearcopies, "stored", stored)
    monkeypatch.setattr(nearcopies, "LEFT", 1_000)
    monkeypatch.setattr(nearcopies, "_rest", lambda similarity, best: (rounds.append(best), rest(similarity, best))[1])
    test_groups(spark, 256)
    (plan,) = plans
    before, after = plan.split("MapInArrow")[:2]
    assert "Join" not in before and after.count("Join") >= 1 and "_x" not in before  # the bitmap only
    assert rounds == [True, False]


def test_pairs_of_two_rows_that_are_not_the_best_ones(spark):
    """Cells of two rows each, as of sets that share no more: the middle link of four sets is the best one of neither end."""
    rng = random.Random(6)
    w = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    ends = [(0, 160), (2, 162), (12, 172), (14, 174)]
    texts = [(i, " ".join(w[a:b])) for i, (a, b) in enumerate(ends)]
    docs = spark.createDataFrame([(i, str(i), i, t) for i, t in texts], "doc_id long, _d string, _x long, text string")
    kinds = "doc_id long, _d string, _x long, k long, n long, print binary, coarse binary"
    rows = common.stored(docs.mapInArrow(nearcopies._sets(5), kinds))
    k = {r["doc_id"]: (r["k"], r["n"]) for r in rows.collect()}
    sets = [shingles(t) for _, t in texts]
    shares = [[similarity(a, b) for b in sets] for a in sets]
    assert shares[1][2] >= 0.85 > 0.8 and shares[0][1] > shares[1][2] < shares[2][3]
    cells = [(t, *k[i], 0) for t, pair in enumerate(((0, 1), (1, 2), (2, 3))) for i in pair]
    cells = common.stored(spark.createDataFrame(cells, "token long, k long, n long, pos long"))
    own = spark.createDataFrame([(k[i][0], t) for i, t in texts], "k long, text string")
    roots = nearcopies.linked(rows, cells, own, 5, 0.8).collect()
    assert {r["k"] for r in roots} == {x for x, _ in k.values()} and len({r["root"] for r in roots}) == 1
