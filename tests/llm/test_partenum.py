"""The PartEnum join against brute force, and its guarantee on pairs at the bound."""

import random

import numpy as np
import pytest

from trackgrid.llm import nearcopies, partenum

KIND = "doc_id long, text string, k long, n long, token long, print string"


def shingles(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
    for c in "\t\n\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def plain(rows, words=4, percent=85):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], KIND).repartition(3)
    got = sorted(map(tuple, partenum.joined(docs, **kw).collect()), key=str)
    assert got == sorted(plain(rows, **kw), key=str)


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
                w = w or ["x"]
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 7, 9, 12, 16, 30, 80, 250]))
        out.append(" ".join(w))
    return out


def test_joined(spark):
    rng = random.Random(7)
    rows = list(enumerate(texts(rng, 420)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, rows[5][1]), (None, "alone among all of these"), (None, None)]
    rows += [(7, rows[9][1].upper()), rows[3], rows[3], (900, "a b c d " * 40_000), (901, "a b c d " * 39_000 + "e")]
    check(spark, rows)


def test_a_crowd_of_variants(spark):
    rng = random.Random(8)
    base = rng.choices([f"v{i}" for i in range(500)], k=120)
    rows = []
    for i in range(400):
        w = base[:]
        w[i % 120] = f"x{i}"
        if i % 3 == 0:
            w[(i * 7) % 120] = f"y{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_chains_of_short_texts(spark):
    """Texts that each lack one word of the last one: their cells are small, and half of the links are no text's best one."""
    rng = random.Random(3)
    rows = []
    for _ in range(8):
        w = [f"w{rng.randrange(10**9)}" for _ in range(166)]
        rows += [" ".join(w[i : i + 16]) for i in range(150)]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_other_parameters(spark):
    check(spark, list(enumerate(texts(random.Random(9), 150))), words=2, percent=70)


def test_empty(spark):
    assert partenum.joined(spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("percent", [70, 85, 95])
def test_pairs_at_the_bound_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    alike = 0
    for _ in range(4000):
        common = int(rng.integers(1, rng.choice([8, 20, 60, 400])))
        rest = common * (100 - percent) // percent  # members outside the intersection, at most
        a = int(rng.integers(0, rest + 1))
        both = rng.integers(0, 1 << 64, common + rest, dtype=np.uint64, endpoint=False)
        x, y = np.unique(both[: common + a]), np.unique(np.concatenate([both[:common], both[common + a :]]))
        one, two = (partenum.signatures(s.view(np.int64), percent) for s in (x, y))
        assert (x.tolist() == y.tolist()) or len(np.intersect1d(one, two)), (common, a, rest)
        other = np.unique(rng.integers(0, 1 << 64, common + rest, dtype=np.uint64))
        alike += len(np.intersect1d(one, partenum.signatures(other.view(np.int64), percent))) > 0
    assert percent < 80 or alike < 40  # others hardly ever do


def test_crowded_partitions_share_the_rest():
    """Members that all fall in one part leave choices without members."""
    for n in (7, 9, 12, 40):
        x = np.arange(n, dtype=np.uint64) + np.uint64(5)
        y = np.append(x[1:], np.uint64(99))[: n - 1]
        for a, b in ((x, x[1:]), (x, np.append(x[:-1], np.uint64(77)))):
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                one, two = (partenum.signatures(s.view(np.int64), 85) for s in (a, b))
                assert len(np.intersect1d(one, two))
        assert len(y) == n - 1


def test_shingles_are_sorted_as_unsigned():
    own = nearcopies.shingles(b"a b c d e f g h i j k l m n", 4).view(np.uint64)
    assert (own[1:] > own[:-1]).all()
