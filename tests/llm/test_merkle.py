"""Merkle manifests against a plain tree, chunk sizes that cut runs, and the fewest missing nodes."""

import hashlib
import random
import zlib

import pytest

from trackgrid.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, g string, leaf string, i int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(part, (row[0], row[3], row[2], row[4], row[1])))


def tree(hashes):
    """The root, and for each leaf its sides (before, after) from below."""
    sides, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k in range(len(hashes)):
            r = at[k] // 16 * 16
            sides[k].append(("".join(level[r : at[k]]), "".join(level[at[k] + 1 : r + 16])))
            at[k] //= 16
        level = [H(*level[r : r + 16]) for r in range(0, len(level), 16)]
    return level[0], sides


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([sub for _, sub, _ in subs])
    for (own, sub, sides), top in zip(subs, tops):
        for r, side in zip(own, sides):
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf((r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            for before, after in side + top:
                h = H(before, h, after)
            yield (r[0], leaf(r), sub, root, H(*[x for s in side + top for x in s]), h, h == root)


def documents(n, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        source = rng.choice(["a"] * 9 + [None, "", "b", "é", "Z", *(f"s{k}" for k in range(30))])
        text = rng.choice([None, "", "Ünder the Bridge", "lower only", "ABC " * rng.randint(1, 40)])
        rows.append((rng.choice([i, i, i, rng.randint(-9, 9), None]), text, rng.choice([None, "en", ""]), source, rng.choice([None, i])))
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n, size", [(1, 4096), (15, 3), (400, 5), (400, 37), (700, 4096)])
def test_manifest(spark, n, size):
    rows = documents(n)
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND).repartition(3)
    got = sorted(map(tuple, merkle.manifest(docs, size).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_one_source_of_many_levels_and_long_texts(spark):
    rows = [(i, "W" * 2_000_000 if i == 7 else f"Text {i}", "en", "hot", i) for i in range(4500)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND)
    got = sorted(map(tuple, merkle.manifest(docs, 64).collect()))
    assert got == sorted(plain(rows))
    assert {r[0] for r in got if not r[6]} == {i for i in range(4500) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND)).collect() == []


def test_missing_nodes_are_needed_and_enough():
    rng = random.Random(5)
    for size in (1, 2, 16, 17, 300, 5000):
        hashes = [H(str(i)).encode() for i in range(size)]
        whole = merkle.Multiproof(dict(enumerate(hashes)), {}, size)
        for n in (1, 3, 40):
            own = sorted(rng.sample(range(size), min(n, size)))
            lack = merkle.missing(own, size)
            nodes = {at: whole.levels[at[0]][at[1]] for at in lack}
            some = merkle.Multiproof({k: hashes[k] for k in own}, nodes, size)
            assert some.root == whole.root
            covers = lambda at: range(at[1] * 16 ** at[0], min((at[1] + 1) * 16 ** at[0], size))
            held = [k for at in lack for k in covers(at)]
            assert len(held) == len(set(held)) and set(held) | set(own) == set(range(size)) and not set(held) & set(own)
            for k in own:
                assert some.path(k) == whole.path(k) and merkle.folded(hashes[k], some.path(k)) == whole.root
                assert size == 1 or merkle.folded(b"0" * 64, some.path(k)) != whole.root
