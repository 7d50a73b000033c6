"""Toxicity classifier with counterfactual regularisation over identity terms."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, as_bytes, sliced

#: Terms for groups of people, in sets whose members can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
DIMENSIONS = 1 << 20
#: Words whose scores a task keeps; it starts afresh beyond that.
WORDS = 100_000
#: Bytes beyond which a word's score is not kept.
LONG = 64


def words_of(text: bytes) -> set[bytes]:
    """The distinct words of a text, A-Z lower-cased."""
    return set(text.translate(FOLD).split())


def grams(word: bytes, most: int = 1 << 16) -> Iterator[list[int]]:
    """Hashed features of a whole word, in lists of about `most`: itself, its beginnings, and its substrings of
    4 and 5 bytes with its ends marked. A text of a script without spaces is one word."""
    w = b"^" + word + b"$"
    out = [crc32(b"=" + word)] + [crc32(w[:n]) for n in range(4, min(len(w), 12))]
    for n in (4, 5):
        for first in range(1, len(w) - n + 1, most):
            out += [crc32(w[i : i + n]) for i in range(first, min(first + most, len(w) - n + 1))]
            if len(out) >= most:
                yield [x & DIMENSIONS - 1 for x in out]
                out = []
    yield [x & DIMENSIONS - 1 for x in out]


class Model:
    """A document's logit is the bias and the sum, over its distinct words, of the weights of their features."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.kept = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "kept": {}}

    def word(self, word: bytes) -> float:
        s = self.kept.get(word)
        if s is None:
            weight = self.weights.get
            s = sum(weight(g, 0.0) for part in grams(word) for g in part)
            if len(word) <= LONG:
                if len(self.kept) >= WORDS:
                    self.kept.clear()
                self.kept[word] = s
        return s

    def logit(self, words: set[bytes]) -> float:
        return self.bias + sum(map(self.word, words))

    def score(self, words: set[bytes]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words), -30, 30))))


def _told_apart(counts: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Features of three texts or more whose presence depends on the class: a likelihood-ratio statistic of at least `least`."""
    some = np.flatnonzero(counts.sum(axis=0) >= 3)  # first, as most hashes have fewer
    counts = counts[:, some]
    table = np.stack([counts[0], counts[1], n[0] - counts[0], n[1] - counts[1]]).astype(float)
    row = np.stack([table[0] + table[1]] * 2 + [table[2] + table[3]] * 2)
    expected = row * np.array([n[0], n[1], n[0], n[1]])[:, None] / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * np.nansum(np.where(table > 0, table * np.log(table / expected), 0), axis=0)
    return some[g2 >= least]


def fit(
    texts: list[set[bytes]], toxic: np.ndarray, least: float = 12.0, ridge: float = 1e-4, fairness: float = 1.0,
    weight: float = 4.0, steps: int = 300, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> Model:
    """Logistic regression by full-batch Adam, over the features that tell the classes apart.

    Each identity term in a text is swapped for every other of its set, and the squared change of the
    logit, the difference of two words' scores, is penalised with weight `fairness`. A toxic row weighs
    as much as `weight` others. One class or no rows at all give a constant score.
    """
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in sorted(t)], np.int32)
    sizes = np.array([len(t) for t in texts], np.int64)
    return _fit(flat, sizes, list(ids), toxic, least, ridge, fairness, weight, steps, terms)


def _fit(flat: np.ndarray, sizes: np.ndarray, words: list[bytes], toxic: np.ndarray, least: float = 12.0, ridge: float = 1e-4,
         fairness: float = 1.0, weight: float = 4.0, steps: int = 300, terms=IDENTITY_TERMS) -> Model:
    """fit() of texts whose distinct words, as places in `words`, stand one text after the other in flat."""
    importance = np.where(toxic > 0, weight, 1.0)
    p = float(np.clip(toxic.mean() if len(toxic) else 0.1, 1e-3, 1 - 1e-3))
    if len(set(toxic.tolist())) < 2:
        return Model({}, float(np.log(p / (1 - p))))
    n_texts, bounds = len(sizes), np.cumsum([0, *sizes])
    members = {t.encode() for g in terms for t in g}
    ids = {w: i for i, w in enumerate(words) if w in members}
    words = words + sorted(members - set(ids))
    ids |= {w: len(words) - len(members) + len(set(ids)) + i for i, w in enumerate(sorted(members - set(ids)))}
    named = np.zeros(len(words), bool)
    named[list(ids.values())] = True
    held: dict[int, set[int]] = {}
    for place in np.flatnonzero(named[flat]).tolist():
        held.setdefault(int(np.searchsorted(bounds, place, "right")) - 1, set()).add(int(flat[place]))
    groups = [[ids[t.encode()] for t in g] for g in terms]
    swaps = [(a, b) for own in held.values() for g in groups for a in g if a in own for b in g if b not in own]
    feature, per = array("i"), []
    for w in words:
        before = len(feature)
        for part in grams(w):
            feature.extend(part)
        per.append(len(feature) - before)
    feature, ends = np.frombuffer(feature, np.int32), np.cumsum([0, *per])
    counts = np.zeros((2, DIMENSIONS), np.int32)
    for k, label in enumerate(toxic):
        if sizes[k]:
            own = np.concatenate([feature[ends[i] : ends[i + 1]] for i in flat[bounds[k] : bounds[k + 1]].tolist()])
            counts[int(label)][np.unique(own)] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    used = _told_apart(counts, n, least)
    index = np.full(DIMENSIONS, -1, np.int32)
    index[used] = np.arange(len(used))
    feature = index[feature]
    on = feature >= 0
    word_of, feature = np.repeat(np.arange(len(words), dtype=np.int32), per)[on], feature[on]
    told = np.zeros(len(words), bool)
    told[word_of] = True
    text_of = np.repeat(np.arange(n_texts), sizes)[told[flat]]
    flat = flat[told[flat]]
    sa, sb = np.array(swaps, np.int64).reshape(-1, 2).T
    w, bias = np.zeros(len(used)), float(np.log(p / (1 - p)))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, steps + 1):
        s = np.bincount(word_of, w[feature], len(words))
        z = bias + np.bincount(text_of, s[flat], n_texts)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * importance / n_texts
        gs = np.bincount(flat, g[text_of], len(words))
        if len(sa):
            change = 2 * fairness * (s[sa] - s[sb]) / n_texts
            gs += np.bincount(sa, change, len(words)) - np.bincount(sb, change, len(words))
        gw = np.bincount(feature, gs[word_of], len(used)) + ridge * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        rate = 0.05 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-7)
        gb = float(g.sum())
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= rate * mb / (vb**0.5 + 1e-7)
    return Model(dict(zip(used.tolist(), w.tolist())), float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> Model:
    """Fit on at most `rows` labelled documents, those of the smallest hash of doc_id (a documented bound).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out, and their labels never read. A document
    with several labels counts as toxic if one of them says so; null ids and labels take no part.
    """
    mine = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    labels = labels.filter(mine & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.filter(mine).select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # at most `rows` labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                words = [sorted(words_of(t)) for t in as_bytes(batch, "text")]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"], "words": pa.array(words, pa.list_(pa.binary())), "toxic": batch["toxic"],
                })

    kind, label = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (labels, "toxic")))
    found = texts.mapInArrow(run, f"doc_id {kind}, words array<binary>, toxic {label}")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(rows).toArrow()  # an id may have several rows
    toxic = (found["toxic"].to_numpy() > 0).astype(float)
    column = found["words"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    words = column.flatten().dictionary_encode()
    sizes = np.diff(column.offsets.to_numpy())
    del found, column  # the fit has the driver's memory to itself
    return _fit(words.indices.to_numpy().astype(np.int32), sizes, words.dictionary.to_pylist(), toxic)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs, all columns, with the toxicity of each whole text: 0 to 1. Null texts count as empty; no shuffle.

    A column of the result's name is replaced.
    """
    docs = docs.drop(column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                scores = [model.score(words_of(t)) for t in as_bytes(batch, "text")]
                yield pa.RecordBatch.from_pydict({c: batch[c] for c in names} | {column: pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def below(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs, all columns, whatever their names, without the rows that score() gives `threshold` or more; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield batch.filter(pa.array([model.score(words_of(t)) < threshold for t in as_bytes(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = 6000) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted: one row for each row of docs.

    A null doc_id is not held out. Without labelled rows every score is the same; an empty table gives
    an empty result.
    """
    model = train(docs, labels, rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
