"""Best-fit packing of token sequences by bin completion."""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored

_encoders: dict = {}
#: Bytes between two changes of white space beyond which a text is left to the tokenizer itself.
LONG = 1000


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level BPE whose ids are its single bytes and then its merges in order; else None."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves there
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(model["vocab"]) != 256 + len(model["merges"]):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}


def encoder(path: str):
    """A function from a text to its ids, as little-endian bytes, one for each worker and file.

    Ids are those of tokenizers' encode() with add_special_tokens=False. Where a file's ids are the ranks
    of its merges and every token encodes to itself, tiktoken gives the same ids in a fifth of the time
    (the tests hold both against each other); texts with long runs, in which its time is quadratic, and
    those with the string of a special token go to the tokenizer itself.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = [t["content"] for t in content["added_tokens"]]
        ranks = _ranks(content["model"])
        tokenizer: list = []  # made for the first text that needs it

        def whole(text: str) -> bytes:
            if not tokenizer:
                from tokenizers import Tokenizer

                tokenizer.append(Tokenizer.from_file(path))
            return array("I", tokenizer[0].encode(text, add_special_tokens=False).ids).tobytes()

        if ranks is None or content["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            _encoders[path] = whole
            return whole
        import public_tokenizers
        import tiktoken

        ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(text: str) -> bytes:
            white = np.frombuffer(text.encode(), np.uint8) <= 32
            edges = np.flatnonzero(white[1:] != white[:-1])
            longest = np.diff(edges, prepend=0, append=len(white)).max() if len(edges) else len(white)
            if longest > LONG or any(s in text for s in special):
                return whole(text)
            return array("I", ordinary(text)).tobytes()

        _encoders[path] = encode
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Token pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32.

    Ids are those of the tokenizer file, then end_id. Documents of more than `capacity` ids are cut so
    that every piece but the first has exactly that many. A null text counts as empty and still has its
    end id; repeated rows are packed as often as they occur; other columns are dropped.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in sliced(whole, "text"):
                out: list[list] = [[] for _ in range(5)]
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    ids = encode(text or "") + end
                    n, at, piece = len(ids) // 4, 0, 0
                    stop = n % capacity or min(n, capacity)
                    while at < n:
                        for column, value in zip(out, (doc, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]))):
                            column.append(value)
                        at, stop, piece = stop, stop + capacity, piece + 1
                kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram of lengths: (lengths of a sequence, how many of them)."""
    open_: dict[int, Counter] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            rest = min((r for r in open_ if r >= size), default=None)
            if rest is None:
                rest, filling, n = capacity, (), left
            else:
                filling, n = next(iter(open_[rest].items()))
                del open_[rest][filling]
                if n > left:
                    open_[rest][filling] = n - left
                if not open_[rest]:
                    del open_[rest]
                n = min(n, left)
            left -= n
            open_.setdefault(rest - size, Counter())[filling + (size,)] += n
    return [x for fillings in open_.values() for x in fillings.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: over all k, long documents that exclude those of k and more, and what is left over."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        alone, half = sizes > capacity - k, (sizes > capacity // 2) & (sizes <= capacity - k)
        small = (sizes >= k) & (sizes <= capacity // 2)
        over = (sizes * n)[small].sum() - (n[half].sum() * capacity - (sizes * n)[half].sum())
        best = max(best, int(n[alone].sum() + n[half].sum() + max(0, -(-over // capacity))))
    return best


def _dominated(filling: tuple[int, ...], room: int, free: int) -> bool:
    """Whether one document at hand (a bit of free for each length) can replace two or more of a filling, or one shorter."""
    waste = room - sum(filling)
    one, more = 0, 0  # bit s: the sum of one document, or of several, is s
    for s in filling:
        more |= (one | more) << s
        one |= 1 << s
    if waste:
        longer = 0
        for s in set(filling):
            longer |= ((1 << waste) - 1) << (s + 1)
        if longer & free:
            return True
    for _ in range(waste + 1):
        if more & free:
            return True
        more <<= 1
    return False


def _completions(counts: dict[int, int], room: int, waste: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` from the lengths at hand that leave at most `waste`, least waste first.

    Sets of sums that the shorter lengths can still reach keep the search to fillings that exist. A filling
    is dominated if a single document at hand could take the place of a shorter one, or of several. steps
    holds what is left of the budget of the whole search.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    reach = [1] * (len(sizes) + 1)  # bit s: a sum of s from sizes[k:], each as often as it fits
    full = (1 << (room + 1)) - 1
    for k in range(len(sizes) - 1, -1, -1):
        bits, s, times = reach[k + 1], sizes[k], min(counts[sizes[k]], room // sizes[k])
        step = 1
        while times:
            use = min(step, times)
            bits |= (bits << (s * use)) & full
            times -= use
            step *= 2
        reach[k] = bits
    for target in range(reach[0].bit_length() - 1, max(-1, room - waste - 1), -1):
        if not reach[0] >> target & 1:
            continue
        stack = [(0, target, ())]
        while stack and steps[0] > 0:
            k, left, taken = stack.pop()
            steps[0] -= 1
            if not left:
                free = sum(1 << s for s in sizes if counts[s] > taken.count(s))
                if not _dominated(taken, room, free):
                    yield taken
                continue
            again = taken.count(sizes[k]) if k < len(sizes) else 0
            for j in range(len(sizes) - 1, k - 1, -1):  # the longest comes last and is tried first
                s = sizes[j]
                if s <= left and reach[j] >> (left - s) & 1 and (again if j == k else 0) < counts[s]:
                    stack.append((j, left - s, taken + (s,)))


def complete(counts: dict[int, int], capacity: int = 1024, budget: int = 200_000) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram of lengths: a list of (lengths of a sequence, how many such sequences).

    Branch and bound by bin completion: the longest document left is joined by each of its undominated
    fillings, least waste first, as often as the histogram allows or once. The incumbent starts as best
    fit; a filling may waste no more than a packing of one sequence less than the incumbent can. The search
    ends at lower_bound(), or after `budget` steps, the same at every depth. Its input has at most
    `capacity` rows, whatever the size of the corpus.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = _best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    bound = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    path: list[tuple[tuple[int, ...], int]] = []
    used, packed, steps = 0, 0, [budget]

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        longest = max(s for s, n in counts.items() if n)
        spare = (bins - 1) * capacity - total - (used * capacity - packed)  # waste that is still allowed
        room = capacity - longest
        for filling in _completions(counts | {longest: counts[longest] - 1}, room, min(spare, room), steps):
            filling = (longest, *filling)
            most = min(counts[s] // k for s, k in Counter(filling).items())
            yield from ((filling, n) for n in dict.fromkeys((most, 1)))

    stack = [options()] if bins > bound else []
    while stack and bins > bound and steps[0] > 0:
        filling, n = next(stack[-1], (None, 0))
        if filling is None:
            stack.pop()
            if path:
                filling, n = path.pop()
                for s in filling:
                    counts[s] += n
                used, packed = used - n, packed - n * sum(filling)
            continue
        steps[0] -= 1
        wasted = (used + n) * capacity - packed - n * sum(filling)
        if wasted > (bins - 1) * capacity - total:
            continue
        for s in filling:
            counts[s] -= n
        path.append((filling, n))
        used, packed = used + n, packed + n * sum(filling)
        if packed == total:
            best, bins = list(path), used
            stack.append(iter(()))
        else:
            stack.append(options())
    return best


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, rank_rows: int = 4096) -> DataFrame:
    """Pack all documents into few sequences: the columns of pieces(), then sequence_id and offset.

    Only the histogram of piece lengths, at most `capacity` rows, reaches the driver; complete() turns
    it into slots (first rank, first sequence and offset of a length), which travel with the plan and are
    found by binary search. The pieces of a length are ranked in groups of about
    `rank_rows` rows by hash, so that no length, however common, is sorted in one task. An empty table
    gives an empty result.
    """
    cut = stored(pieces(docs, path, capacity, end_id))
    sizes = cut.groupBy("length").count().collect()
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequences, ranks = 0, Counter()
    for filling, n in complete({r["length"]: r["count"] for r in sizes}, capacity):
        at = 0
        for s in filling:
            slots.setdefault(s, []).append((ranks[s], sequences, at))
            ranks[s] += n
            at += s
        sequences += n
    places = {s: np.array(x, np.int64).T for s, x in slots.items()}  # first ranks, first sequences, offsets
    groups = max(1, sum(r["count"] for r in sizes) // rank_rows)
    cut = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut.groupBy("length", "g").count().select(
        "length", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("length", "g").orderBy("doc_id", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "g"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length).tolist():
                on = np.flatnonzero(length == s)
                low, base, at = places[s]
                slot = np.searchsorted(low, rank[on], "right") - 1
                sequence[on], offset[on] = base[slot] + rank[on] - low[slot], at[slot]
            columns = {c: batch[c] for c in names}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
