"""Packing, decontamination, token counts and SimHash against brute force."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from trackgrid.llm import decontamination, packing, simhash, token_counts
from trackgrid.llm.common import FOLD, components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, fp long, a string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in enumerate(texts)], DOCS).repartition(3)


def prose(rng, n, words=40):
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    return [rng.choice(vocab) for _ in range(n)]


ODD = ["", None, " ", "a", "  two  spaces ", "tab\tnew\n line\r\n", "nbsp  x  y", "it's we'll 12 345 ...", "İK ÀÉ é", "\x00\x1c x", "<|endoftext|> z", "日本語 テスト 🙂 ok", "a  b  c"]


def test_tokens_equal_the_tokenizer(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(prose(rng, n)) for n in (1, 10, 1500, 6000)] + ["Same one. And\nmore!!"] * 3
    own = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    letters = "ab cdé'12\n \t.,日本🙂\u00a0\u2028\x1c\x85Éß-"
    many = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    many += ["".join(map(chr, rng.choices(range(0x110000 - 2048), k=20))).encode(errors="ignore").decode() for _ in range(500)]
    many += ["x" * 5000, "ab" * 3000 + " c", " " * 3000 + "a", "日" * 2000, "a <|endoftext|> b<|endoftext|>"]
    for t in texts + many:
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == own.encode(t or "", add_special_tokens=False).ids
    rows = packing.pack(docs_of(spark, texts), PATH, capacity=64, rank_rows=5).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by) == len(texts)
    for d, ps in by.items():
        ids = np.array(own.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        ps.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps)))
        at = 0
        for k, p in enumerate(ps):
            assert p["start"] == at and (k == 0 or p["length"] == 64) and 0 < p["length"] <= 64
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(30, 60)]) for _ in range(rng.choice([3, 40, 3000]))]
    counts = Counter(sizes)
    out = packing.complete(dict(counts), 100)
    used = Counter()
    for filling, n in out:
        assert sum(filling) <= 100
        for s in filling:
            used[s] += n
    assert used == counts
    bins = sum(n for _, n in out)
    assert bins <= sum(n for _, n in packing._best_fit(dict(counts), 100))
    assert packing.complete({}, 100) == []


def test_every_token_encodes_to_itself():
    """With ids that are the ranks of merges, this makes two neighbours join only where a merge joins them."""
    own = Tokenizer.from_file(PATH)
    ranks = packing._ranks(json.loads(own.to_str())["model"])
    assert len(ranks) == 50256
    assert all([t.id for t in own.model.tokenize(token)] == [i] for token, i in own.get_vocab(with_added_tokens=False).items())


def fewest(sizes, capacity):
    """The optimum, by trying every bin for every document, largest first."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                i = rooms.index(room)
                go(k + 1, rooms[:i] + [room - sizes[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - sizes[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_is_optimal(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(2, 14) for _ in range(rng.randint(1, 11))), reverse=True)
    bins = sum(n for _, n in packing.complete(dict(Counter(sizes)), 20))
    assert packing.lower_bound(dict(Counter(sizes)), 20) <= bins == fewest(sizes, 20)


def test_bin_completion_beats_best_fit():
    # best fit needs 3 here, two sequences are enough
    assert sum(n for _, n in packing.complete({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2
    assert sum(n for _, n in packing.complete({4: 2, 3: 4}, 10)) == 2


def brute_hits(text, items, n):
    words = (text or "").encode().translate(FOLD).split()
    hit, found = set(), []
    for item, t in items:
        w = (t or "").encode().translate(FOLD).split()
        if not w or item is None:
            continue
        size, seen = min(n, len(w)), False
        for i in range(len(w) - size + 1):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == w[i : i + size]:
                    hit.update(range(k, k + size))
                    seen = True
        if seen:
            found.append(str(item))
    return len(words), len(hit), len(found), decontamination.sha_of(found)


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_decontamination(spark, item_bytes, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(prose(rng, rng.randint(1, 30), 12))) for k in range(12)]
    items += [(20, ""), (21, None), (None, "word"), (22, "Ab"), (23, items[0][1])]
    texts = list(ODD) + ["ab, AB; xab", "ab"]
    for _ in range(40):
        t = prose(rng, rng.randint(0, 60), 12)
        item = rng.choice(items[:12])[1].split()
        t[5:5] = item[rng.randint(0, 3) :]
        texts.append(rng.choice([" ", ", "]).join(t).upper())
    texts.append("ab " * 3000)
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_items(docs_of(spark, texts), df, 10, item_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    got = {r[0]: tuple(r)[1:] for r in got.select("doc_id", "n_words", hit, F.size("items"), F.sha2(F.array_join("items", ","), 256)).collect()}
    assert got == {i: brute_hits(t, items, 10) for i, t in enumerate(texts)}
    clean = decontamination.contamination(docs_of(spark, texts), df.limit(0)).filter("contaminated").count()
    assert clean == 0 and decontamination.contamination(docs_of(spark, texts).limit(0), df).count() == 0


def greedy(word, pieces):
    word, at, n = b" " + word, 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            p = word[at:end]
            if p in pieces and (p[:1] == b" ") == (at == 0):
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts(spark):
    pieces = token_counts.vocabulary(PATH)
    texts = ODD + [" ".join(prose(random.Random(3), 400)), "x" * 3000]
    got = {r[0]: tuple(r)[1:] for r in token_counts.token_counts(docs_of(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(greedy(w, pieces) for w in words))
    rng = random.Random(4)
    for _ in range(60):  # small vocabularies, words that can't be covered
        own = {b" " + bytes(rng.choices(b"abc", k=rng.randint(0, 3))) for _ in range(4)}
        own |= {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(6)}
        automaton = token_counts.Automaton(own)
        for _ in range(30):
            w = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            assert automaton.count(w) == greedy(w, own), (own, w)


def brute_fp(text):
    w = (text or "").encode().translate(simhash.FOLD_CASE).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(prose(rng, n)) for n in (1, 2, 3, 4, 700, 900)]
    for t in texts[-2:]:
        for _ in range(12):
            w = t.split()
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w).upper())
    texts += [texts[-1]] * 3
    fps = [brute_fp(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(texts))}
    assert len({r for r in root}) < len(texts) - 15
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_simhash_links(spark, block):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if ((i ^ j) & (1 << 64) - 1).bit_count() <= 3 and root[i] > root[j]:
                    root[i], changed = root[j], True
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, block)
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert {x: got.get(x, x) for x in fps} == root
