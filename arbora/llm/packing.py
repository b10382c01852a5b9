"""Best-fit packing of token pieces by length patterns and non-negative least squares.

Documents longer than a sequence are cut into full pieces, the shorter one first. The histogram of piece lengths has as
many bins as a sequence has tokens, whatever the input's size, so the driver plans over it:

1. It enumerates patterns of two to four lengths that fill a sequence exactly: all pairs, and of the triples and quadruples
   the ``MOST`` each whose rarest length is most frequent. Lengths in no pattern are packed by the last step.
2. Projected gradient descent fits a non-negative repeat count for each pattern, by least squares against the histogram.
3. Repeat counts are rounded down and clipped to what is left of each length.
4. What remains is packed best fit, longest first, in runs of equal lengths over runs of equal sequences.

The plan is a table of runs: so many pieces of one length, from one rank on, go to consecutive sequences at one offset.
Executors number the pieces of each length and look their run up.

Defined cases: a null or empty text is one piece that holds the end token alone; repeated rows, also of one id, are packed
each for itself, in any order where they are alike; a tie of two patterns goes to the first by lengths; an empty table
gives no rows. Columns beside key and text are not looked at, whatever their names; the key may have any but the result's.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, per_batch, running, stored, worker_cache

#: Patterns of three lengths, and of four, at most.
MOST = 20_000


def encoder(path: str, pattern: str):
    """The byte-level BPE of a ``tokenizer.json`` file, run by tiktoken: the same ids, several times as fast.

    Added tokens that stand in a text are one id each, as ``tokenizers`` has it by default.
    """
    cache = worker_cache()
    if path not in cache:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in json.load(open(path))["added_tokens"]}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in own.get_vocab(with_added_tokens=False).items() if token not in special}
        cache[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return cache[path]


def pieces(docs: DataFrame, tokenizer: str, pattern: str, most: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32."""

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        own, out = encoder(tokenizer, pattern), []
        for k, t in zip(batch["key"], batch["text"], strict=True):
            ids = np.array([*(own.encode(t, allowed_special="all") if t else ()), end], dtype="<u4")
            at, stop = 0, len(ids) % most or most
            for n in range(-(-len(ids) // most)):
                out.append((k, n, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                at, stop = stop, stop + most
        return pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return per_batch(cut, rows, "key string, piece int, start long, length long, ids_crc32 long").withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def patterns(have: np.ndarray, most: int, limit: int = MOST) -> list[tuple[int, ...]]:
    """Sets of two, three and four lengths that occur and fill a sequence exactly, at most ``limit`` of three and of four.

    A set can repeat as often as its rarest length allows; sets that can repeat most come first.
    """
    have = have.astype(np.int64).copy()
    have[0] = have[most] = 0
    there = np.flatnonzero(have)

    def best(sets: np.ndarray) -> np.ndarray:
        sets = sets[(np.diff(sets, axis=1) >= 0).all(axis=1) & (sets[:, -1] < most)]
        score = have[sets].min(axis=1)
        sets, score = sets[score > 0], score[score > 0]
        return sets[np.lexsort((*sets.T[::-1], -score))[:limit]]

    a, b = np.repeat(there, len(there)), np.tile(there, len(there))
    on = (a <= b) & (a + b <= most)
    pairs = np.stack([a, b], 1)[on]
    sums = pairs.sum(axis=1)
    twos = pairs[sums == most]
    threes = best(np.column_stack([pairs, most - sums])[most - sums > 0])
    # a quadruple is two pairs; of each sum those that can repeat most
    pairs, sums = (x[np.lexsort((*pairs.T[::-1], -have[pairs].min(axis=1), sums))] for x in (pairs, sums))
    rank = np.arange(len(sums)) - np.searchsorted(sums, sums)
    pairs, sums = pairs[rank < 8], sums[rank < 8]
    by_sum = {n: pairs[sums == n] for n in np.unique(sums).tolist()}
    fours = [np.column_stack([np.repeat(low, len(high), axis=0), np.tile(high, (len(low), 1))]) for n, low in by_sum.items() if (high := by_sum.get(most - n)) is not None]
    fours = best(np.concatenate(fours) if fours else np.empty((0, 4), np.int64))
    return [tuple(x) for sets in (twos, threes, fours) for x in sets.tolist()]


def repeat_counts(have: np.ndarray, sets: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come nearest the histogram (accelerated projected gradient)."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    what = np.fromiter((x for s in sets for x in s), int, len(who))
    x = y = np.zeros(len(sets))
    v = np.ones(len(sets))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = np.bincount(who, np.bincount(what, v[who], len(have))[what], len(sets))
        step = 1 / max(np.linalg.norm(v), 1e-9)
        v *= step
    step *= 0.9
    for k in range(rounds):
        gap = have - np.bincount(what, y[who], len(have))
        new = np.maximum(0, y + step * np.bincount(who, gap[what], len(sets)))
        y = new + k / (k + 3) * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], most: int = 2048) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs ``(length, first rank, count, first sequence, offset)`` and the number of sequences."""
    have = np.zeros(most + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[length] = n
    used, runs, sequences = np.zeros(most + 1, dtype=np.int64), [], 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, first, offset))
        used[length] += n

    if have[most]:
        put(most, int(have[most]), 0, 0)
        sequences = int(have[most])
    if sets := patterns(have, most):
        counts = np.floor(repeat_counts(have.astype(float), sets) + 0.5).astype(np.int64)
        for p in np.argsort(-counts, kind="stable"):
            need = {x: sets[p].count(x) for x in sets[p]}
            n = int(min(counts[p], *((have[x] - used[x]) // k for x, k in need.items())))
            if n > 0:
                offset = 0
                for x in sets[p]:
                    put(x, n, sequences, offset)
                    offset += x
                sequences += n
    room: dict[int, list[tuple[int, int]]] = {}  # space left: runs (first sequence, count)
    for length in range(most - 1, 0, -1):
        left = int(have[length] - used[length])
        while left:
            space = min((s for s in room if s >= length), default=None)
            if space is None:  # sequences of this length alone, as many pieces in each as fit
                each = most // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        for i in range(k):
                            put(length, n, sequences, i * length)
                        if most - k * length:
                            room.setdefault(most - k * length, []).append((sequences, n))
                        sequences += n
                break
            first, count = room[space].pop()
            n = min(left, count)
            put(length, n, first, most - space)
            if count > n:
                room[space].append((first + n, count - n))
            if space > length:
                room.setdefault(space - length, []).append((first, n))
            if not room[space]:
                del room[space]
            left -= n
    return runs, sequences


def pack(docs: DataFrame, tokenizer: str, pattern: str, most: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with the sequence that takes it and its place there.

    Returns key, piece, start, length, ids_crc32, sequence_id and offset.
    """
    rows = stored(pieces(docs, tokenizer, pattern, most, end, key, text), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    runs, _ = plan(histogram, most)
    table = docs.sparkSession.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, rank long, n long, first long, place long")
    table = stored(table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "n", "first", "place"))).alias("runs")).coalesce(1), "pack-plan")
    lanes = math.isqrt(max(histogram.values(), default=0)) + 1  # as many lanes of the most frequent length as rows in each
    rows = rows.withColumn("lane", F.pmod(F.xxhash64(key, "piece"), F.lit(lanes)))
    rows = running(rows, ["length"], "lane", [F.col(key), F.col("piece"), F.col("ids_crc32")], F.lit(1), "at")
    rows = rows.join(F.broadcast(table), "length")  # a row for each length, with as many runs as there are patterns at most
    run = F.element_at(F.filter("runs", lambda r: (r["rank"] <= F.col("at")) & (F.col("at") < r["rank"] + r["n"])), 1)
    return rows.withColumn("run", run).select(
        F.col(key), "piece", "start", "length", "ids_crc32", (F.col("run.first") + F.col("at") - F.col("run.rank")).alias("sequence_id"), F.col("run.place").alias("offset")
    )


by_value(__name__)
