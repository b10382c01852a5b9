"""Toxicity by weak supervision.

Many weak voters look at a text: one for each entry of a lexicon, and patterns over the lexicon's hits (several hits, a hit
after a form of address, a hit in capitals, a dense hit, no hit). The lexicon joins a few seed words with words and word
beginnings that the labelled sample shows to mark toxic texts, in whatever language. A generative label model estimates, by expectation maximisation, how often each
voter fires on either class; correlations that the classes leave between voters are estimated from the residuals, and a voter
counts the less, the more it repeats others. A linear classifier is then trained on the posterior labels, and scores.

Lexicon and models are fitted on a bounded sample of labelled rows (``most``, see :func:`training.labelled_rows`); every
document is scored on its whole text. Texts stay on the executors: the driver gets the lexicon's candidates with their counts,
and of each sampled row the entries that are not zero.

Defined cases: a null or empty text has no hits and a score like any other; without a sample the seed lexicon alone votes;
copies and near copies in the sample count once in the lexicon, by the largest key; ties of entries go by code points;
repeated rows get equal scores; an empty table gives no rows. Columns beside key and text are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, per_batch, stored

SEED = "idiot stupid moron loser pathetic worthless scum trash disgusting clown imbecile dumb filthy coward jerk fool".split()
TOKEN = re.compile(r"[^\W_]+")
ADDRESS = {"you", "your", "youre", "they", "he", "she", "du", "ihr", "sie", "tu", "vous", "usted", "eres"}
PATTERNS = ("two_hits", "three_hits", "repeated_hit", "addressed", "shouted", "dense", "no_hit")


STEMS = range(4, 10)
#: What a lexicon may hold of a word: the word, and its beginnings with a star.
ENTRIES = f"concat(array(word), transform(filter(sequence({STEMS[0]}, {STEMS[-1]}), n -> n < char_length(word)), n -> concat(left(word, n), '*')))"


def tail(k: int, n: int, p: float) -> float:
    """log10 of the chance that ``k`` or more of ``n`` documents are toxic when a share ``p`` is; a close upper bound."""
    share = k / n
    if share <= p:
        return 0.0
    return -n * (share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0)) / math.log(10)


def signature(tokens: list[str], minima: int = 4) -> str:
    """Equal for copies, and mostly for near copies: the least of several hashes of three words in a row."""
    grams = [" ".join(tokens[i : i + 3]).encode() for i in range(max(1, len(tokens) - 2))]
    return " ".join(str(min(zlib.crc32(g, m) for g in grams)) for m in range(minima))


def lexicon(sample: DataFrame, least_docs: int = 4, least_share: float = 0.6, least_words: int = 3, chance: float = 0.0, most_words: int = 200) -> list[str]:
    """Seed words, and the words and word beginnings that occur in toxic texts far more often than chance has it.

    ``sample`` is ``(key, text, y)``. ``chance`` is log10 of the number of entries that may get in by chance, over all
    candidates. Copies count once. A beginning must be that of ``least_words`` words, and stands for the longer entries that
    it covers as surely.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        tokens = [TOKEN.findall((t or "").lower()) for t in batch["text"]]
        return pd.DataFrame({"key": batch["key"], "y": batch["y"].astype(int), "copy": [signature(t) for t in tokens], "words": [sorted({*t}) for t in tokens]})

    rows = per_batch(run, sample.select(F.col("key").cast("string").alias("key"), "text", "y"), "key string, y int, copy string, words array<string>")
    rows = stored(rows.groupBy("copy").agg(F.max_by(F.struct("y", "words"), "key").alias("r")).select("copy", "r.*"), "lexicon-words")
    many = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    held = rows.select("copy", "y", F.explode("words").alias("word"))
    vocabulary = stored(held.groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")), "lexicon-vocabulary")
    entries = lambda df: df.select("*", F.explode(F.expr(ENTRIES)).alias("entry"))
    # of an entry: how many words it is of in toxic texts, and the fewest clean texts it can be in, those of its most frequent word
    known = entries(vocabulary).groupBy("entry").agg(F.count_if(F.col("toxic") > 0).alias("words"), F.max("clean").alias("clean"))
    toxic = entries(held.where("y = 1")).select("copy", "entry").distinct().groupBy("entry").agg(F.count("*").alias("k")).where(F.col("k") >= least_docs)
    toxic = stored(toxic.join(known, "entry").where(~F.col("entry").endswith("*") | (F.col("words") >= least_words)), "lexicon-candidates")
    enough = F.col("k") >= least_share * (F.col("k") + F.col("clean"))
    close = stored(toxic.where(enough).select("entry", "k"), "lexicon-close")
    pairs = stored(entries(vocabulary).join(close, "entry").select("word", "entry"), "lexicon-pairs")
    clean = held.where("y = 0").join(pairs, "word").select("copy", "entry").distinct().groupBy("entry").agg(F.count("*").alias("clean"))
    found = close.join(clean, "entry", "left").select("entry", "k", F.coalesce("clean", F.lit(0)).alias("clean")).where(enough).collect()
    base = float(np.clip(many.get(1, 0) / max(1, sum(many.values())), 0.01, 0.5))
    limit = chance - math.log10(max(1, toxic.count()))
    share = {r["entry"]: r["k"] / (r["k"] + r["clean"]) for r in found}
    kept = {r["entry"]: log for r in found if (log := tail(r["k"], r["k"] + r["clean"], base)) <= limit}
    for e in sorted(kept, key=lambda e: (len(e), e)):
        word = e.rstrip("*")
        if any((up := word[:n] + "*") in kept and share[up] >= share[e] - 0.05 for n in STEMS if n < len(word)):
            del kept[e]
    return sorted({*SEED, *sorted(kept, key=lambda e: (kept[e], e))[:most_words]})


class Model:
    """A lexicon, and the linear classifier over its features; before it is trained the seed words decide."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.at = {w: i for i, w in enumerate(words)}
        self.stems = sorted({len(w) - 1 for w in words if w[-1] == "*"})
        self.weights = np.zeros(self.width() + 1)
        self.weights[: len(words)] = 3.0
        self.weights[-1] = -3.0

    def train(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Posterior labels of the label model, and the classifier on them."""
        if x.any():
            self.rates, self.correlation, post = self.label_model(self.votes(x), float(np.clip(y.mean(), 0.01, 0.5)), y)
            self.weights[:] = 0
            self.fit(x, post)
        return self

    def width(self) -> int:
        return 2 * len(self.words) + len(PATTERNS)

    def found(self, token: str) -> list[int]:
        """Places of the entries that a lower-case word matches."""
        own = [self.at.get(token), *(self.at.get(token[:n] + "*") for n in self.stems if n < len(token))]
        return [i for i in own if i is not None]

    def row(self, text: str | None) -> np.ndarray:
        """For each entry whether it occurs and its logged count, and the patterns."""
        out, n = np.zeros(self.width()), len(self.words)
        tokens = TOKEN.findall(text or "")
        low = [t.lower() for t in tokens]
        match = {t: m for t in {*low} if (m := self.found(t))}
        hits = [i for i, t in enumerate(low) if t in match] if match else []
        for e, k in Counter(e for i in hits for e in match[low[i]]).items():
            out[e], out[n + e] = 1, np.log1p(k)
        kinds = len(match)
        out[2 * n], out[2 * n + 1], out[2 * n + 2] = kinds >= 2, kinds >= 3, len(hits) > kinds
        out[2 * n + 3] = any(not ADDRESS.isdisjoint(low[max(0, i - 4) : i]) for i in hits)
        out[2 * n + 4] = any(tokens[i].isupper() for i in hits)
        out[2 * n + 5] = len(hits) * 50 >= len(low) > 0
        out[2 * n + 6] = not hits
        return out

    def matrix(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], float).reshape(-1, self.width())

    def votes(self, x: np.ndarray) -> np.ndarray:
        """One column for each voter, 1 where it fires."""
        n = len(self.words)
        return np.hstack([x[:, :n], x[:, 2 * n :]])

    @staticmethod
    def label_model(v: np.ndarray, prior: float, given: np.ndarray | None = None, trust: float = 2.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates of firing by class, residual correlations, and the posterior of class 1.

        The given labels, which hold mistakes, are one voter more: one that shifts the log odds by ``trust``.
        """
        shift = 0.0 if given is None else np.where(given > 0, trust, -trust)
        for_toxic = np.ones(v.shape[1], bool)
        for_toxic[-1] = False
        middle = v - v.mean(axis=0)
        scale = np.sqrt((middle**2).sum(axis=0) + 1e-9)
        weight = 1 / np.maximum(1, (np.abs(middle.T @ middle / np.outer(scale, scale)) > 0.8).sum(axis=0))  # copies share a vote
        count = v[:, for_toxic] @ weight[for_toxic]
        post = np.where(count >= 1.5, 0.9, np.where(count >= 0.75, 0.5, 0.02))
        if given is not None:
            post = 1 / (1 + np.exp(-np.log(post / (1 - post)) - shift))
        correlation = np.eye(v.shape[1])
        for k in range(rounds):
            rates = np.stack([((v * q[:, None]).sum(axis=0) + 0.5) / (q.sum() + 1) for q in (1 - post, post)])
            if k % 10 == 9:
                rest = v - (1 - post)[:, None] * rates[0] - post[:, None] * rates[1]
                scale = np.sqrt((rest**2).sum(axis=0) + 1e-9)
                correlation = rest.T @ rest / np.outer(scale, scale)
                weight = 1 / np.maximum(1, np.where(np.abs(correlation) > 0.3, np.abs(correlation), 0).sum(axis=0))
            own = weight * for_toxic  # "no hit" follows from the others, and so has no say of its own
            logs = np.log(rates[1] / rates[0]) * own, np.log((1 - rates[1]) / (1 - rates[0])) * own
            mean = float(np.clip(post.mean(), 0.5 * prior, 2 * prior))
            post = 1 / (1 + np.exp(-np.clip(v @ logs[0] + (1 - v) @ logs[1] + shift + np.log(mean / (1 - mean)), -30, 30)))
        return rates, correlation, post

    def fit(self, x: np.ndarray, post: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> None:
        """Logistic regression on soft labels, by Newton's method."""
        x = np.hstack([x, np.ones((len(x), 1))])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            g = x.T @ (post - p) - ridge * self.weights
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            step = np.linalg.solve(h, g)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def score(self, texts) -> np.ndarray:
        x = self.matrix(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(sample: DataFrame) -> Model:
    """The model of a bounded sample ``(key, text, y)``; only features that are not zero come to the driver."""
    sample = stored(sample, "labelled-sample")
    model = Model(lexicon(sample))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [model.row(t) for t in batch["text"]]
        at = [np.flatnonzero(r) for r in rows]
        return pd.DataFrame({"key": batch["key"], "y": batch["y"].astype(float), "at": at, "x": [r[a] for r, a in zip(rows, at, strict=True)]})

    rows = per_batch(run, sample.select(F.col("key").cast("string").alias("key"), "text", "y"), "key string, y double, at array<int>, x array<double>").toPandas().sort_values("key")
    x = np.zeros((len(rows), model.width()))
    for i, (at, values) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, at] = values
    return model.train(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every document."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "score": model.score(batch["text"])})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return per_batch(run, rows, "key string, score double").withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


by_value(__name__)
