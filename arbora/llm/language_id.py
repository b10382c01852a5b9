"""Language identification by cross-parsing entropy.

Labelled text of each language goes into a suffix automaton. A text is parsed greedily into longest matches with each
automaton; the language that needs fewest phrases wins, with the count normalised by the logarithm of the automaton's
text length (a phrase costs a pointer into that text) and by the number of characters. Each language has its own alphabet,
all characters of its sample; others end a phrase. The automata become transition tables, dense for as many languages as
``DENSE`` bytes hold, those with small tables first, and sorted for the others.

The whole text is parsed, for all texts of a batch at once: their segments of ``SEGMENT`` characters advance together, each
from the root. Then every segment is entered again in the state in which its predecessor really ends, until a phrase begins
where one began before; from there on both parses are one. So phrases are those of the uncut text.

The automata are fitted on a bounded sample: of each language up to ``sample_docs`` labelled documents, chosen by the
hash of their ids, with ``sample_chars`` characters in all, a window from each quarter of a text that is longer than its
share. Every labelled language is learned, and everything else covers every document.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled text every text is ``und``;
ties go to the language first by code point; repeated rows get equal results; an id with several texts is learned from by
the least of them; an empty table gives no rows. Columns beside key, text and lang are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, per_batch, worker_cache

SEGMENT = 256
DENSE = 128 << 20
LETTER = re.compile(r"[^\W\d_]")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton of a sequence; state 0 is the root, to which none leads."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new, at = len(steps), last
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at >= 0:
            to = steps[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return steps


class Table:
    """The state after a state and a symbol; 0 if there is no transition."""

    def __init__(self, steps: list[dict[int, int]], width: int, dense: bool) -> None:
        self.width = width
        self.keys = np.array([i * width + c for i, s in enumerate(steps) for c in s], np.int64)
        self.to = np.array([t for s in steps for t in s.values()], np.int32)
        if dense:
            self.flat = np.zeros(len(steps) * width, np.int32)
            self.flat[self.keys] = self.to
        else:
            order = np.argsort(self.keys)
            self.keys, self.to, self.flat = self.keys[order], self.to[order], None

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return self.flat[state * self.width + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


class Models:
    """Automata, the table from code points to symbols, and each language's own symbols; 0 is a character that was not seen."""

    def __init__(self, samples: dict[str, str]) -> None:
        lower = {lang: text.lower() for lang, text in sorted(samples.items())}
        self.symbol, seen = np.zeros(0x110000, np.int32), sorted({*"".join(lower.values())})
        for n, c in enumerate(seen, 1):
            self.symbol[ord(c)] = n
        codes = {lang: self.encode(text) for lang, text in lower.items()}
        width = {lang: len(np.unique(c)) + 1 for lang, c in codes.items()}
        built, left = {}, DENSE
        for lang in sorted(lower, key=lambda x: (len(codes[x]) * width[x], x)):
            own = np.zeros(len(seen) + 1, np.int32)
            own[np.unique(codes[lang])] = np.arange(1, width[lang])
            left -= 4 * 2 * (len(codes[lang]) + 1) * width[lang]  # an automaton has at most two states a character
            built[lang] = Table(automaton(own[codes[lang]].tolist()), width[lang], left >= 0), own
        self.tables = {lang: (*built[lang], float(np.log2(len(text) + 2))) for lang, text in lower.items()}

    def encode(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def bits(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases, in bits a character, of every text in every language."""
        codes = [self.encode(t) for t in texts]
        sizes = np.array([len(c) for c in codes])
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(codes)), parts)
        spans = np.full((len(owner), SEGMENT), 0, np.int32)
        lengths, at = np.empty(len(owner), int), 0
        for c, n in zip(codes, parts.tolist(), strict=True):
            if n:
                spans[at : at + n].ravel()[: len(c)] = c
                lengths[at : at + n] = SEGMENT
                lengths[at + n - 1] = len(c) - (n - 1) * SEGMENT
                at += n
        order = np.argsort(-lengths, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        follows = np.zeros(len(owner), bool)
        follows[1:] = owner[1:] == owner[:-1]
        after = place[follows]  # segments that continue a text, and the ones before them
        before = place[np.flatnonzero(follows) - 1]
        by_step, lengths, owner = np.ascontiguousarray(spans[order].T), lengths[order], owner[order]
        out = np.zeros((len(codes), len(self.tables)))
        for col, (table, own, cost) in enumerate(self.tables.values()):
            phrases = phrases_of(table, own[by_step], lengths, before, after)
            out[:, col] = np.bincount(owner, phrases, len(codes)) * cost / np.maximum(sizes, 1)
        return out


def step(table: Table, now: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after symbols ``c``, and where a phrase begins with them. State 0 is between phrases."""
    to = table.next(now, c)
    lost = to == 0
    to[lost] = table.next(np.zeros(int(lost.sum()), np.int32), c[lost])
    return to, lost | (now == 0)


def phrases_of(table: Table, symbols: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Phrases that begin in each segment (a column of ``symbols``, longest first) where texts are parsed without a cut."""
    width, n = symbols.shape
    going = np.searchsorted(-lengths, -np.arange(width), side="left")  # segments longer than t
    begins, state = np.zeros((width, n), bool), np.zeros(n, np.int32)
    for t in range(int(lengths.max(initial=0))):
        now = slice(0, int(going[t]))
        state[now], begins[t, now] = step(table, state[now], symbols[t, now])
    phrases = begins.sum(axis=0)
    ends, entered = state.copy(), np.zeros(n, np.int32)
    todo, into = after, ends[before]
    while len(todo):
        changed = into != entered[todo]
        todo, into = todo[changed], into[changed]
        entered[todo] = into
        phrases[todo] = begins[:, todo].sum(axis=0)
        who, now, t, late = todo, into, 0, []
        while len(who):
            over = lengths[who] <= t
            late.append((who[over], now[over]))
            who, now = who[~over], now[~over]
            if not len(who):
                break
            now, new = step(table, now, symbols[t, who])
            was = begins[t, who]
            phrases[who] += new.astype(phrases.dtype) - was
            on = ~(new & was)
            who, now, t = who[on], now[on], t + 1
        # a segment without a place where both parses begin a phrase ends in another state than from the root
        ended = state.copy()
        for x, s in late:
            ended[x] = s
        moved = np.zeros(n, bool)
        moved[todo] = ended[todo] != ends[todo]
        ends[todo] = ended[todo]
        on = moved[before]
        todo, into = after[on], ends[before[on]]
    return phrases


def samples(docs: DataFrame, learn, sample_docs: int = 64, sample_chars: int = 24_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Labelled text of every language: at most ``sample_chars`` characters of each, whatever the input."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    hashed = F.xxhash64(F.col("id").cast("string"))
    chosen = known.groupBy("lang", F.pmod(hashed, F.lit(sample_docs)).alias("lane")).agg(F.min_by("id", hashed).alias("id")).where("id is not null").collect()
    if not chosen:
        return {}
    many = Counter(r["lang"] for r in chosen)
    picks = [(r["lang"], r["id"], max(1, sample_chars // many[r["lang"]])) for r in chosen]
    picks = F.broadcast(docs.sparkSession.createDataFrame(picks, f"lang {known.schema['lang'].dataType.simpleString()}, id {known.schema['id'].dataType.simpleString()}, most int"))  # sample_docs rows a language
    n, part = F.char_length("text"), F.expr("most div 4")
    quarter = (n / 4).cast("int")
    windows = [F.substring("text", quarter * k + F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(k)), F.greatest(quarter - part, F.lit(0)) + 1).cast("int") + 1, part) for k in range(4)]
    taken = F.when(n <= F.col("most"), F.col("text")).otherwise(F.concat_ws("\n", *windows))
    rows = known.join(picks, ["lang", "id"]).select("lang", "id", taken.alias("t")).groupBy("lang", "id").agg(F.min("t").alias("t")).collect()
    out = {}
    for r in sorted(rows, key=lambda x: (x["lang"], x["id"])):
        out.setdefault(r["lang"], []).append(r["t"])
    out = {k: "\n".join(v) for k, v in out.items()}
    return {k: v for k, v in out.items() if LETTER.search(v)}


def identify(docs: DataFrame, learned: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` for every document; learned has a sample of text by language."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        cache, name = worker_cache(), "lang" + hashlib.md5(repr(sorted(learned.items())).encode()).hexdigest()
        if name not in cache:
            cache[name] = Models(learned)
        own = cache[name]
        names, texts = [*own.tables], [(t or "").lower() for t in batch["text"]]
        clear = np.array([bool(names and LETTER.search(t)) for t in texts], bool)
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        todo, size = [], 0
        for i in [*np.flatnonzero(clear), None]:
            if todo and (i is None or size > 4_000_000):
                bits = own.bits([texts[k] for k in todo])
                weight = np.exp2(-8 * (bits - bits.min(axis=1, keepdims=True)))
                pred[todo] = np.array(names, object)[bits.argmin(axis=1)]
                score[todo] = 1 / weight.sum(axis=1)
                todo, size = [], 0
            if i is not None:
                todo.append(i)
                size += len(texts[i])
        return pd.DataFrame({"key": batch["key"], "lang_pred": pred, "score": score})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return per_batch(run, rows, "key string, lang_pred string, score double").withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


by_value(__name__)
