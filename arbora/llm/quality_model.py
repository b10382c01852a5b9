"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Boosting goes round the features again and again; each step fits a shallow tree
to the gradient over one feature's bins and adds it to that feature's lookup table. The pairs of features whose coarse grid
explains most of what is left then get tables of their own in the same way. A score is a sum of table entries, looked up for
whole batches at once.

The model is fitted on a bounded sample of labelled rows (``most`` rows, see :func:`training.labelled_rows`); every document is
scored on its whole text. Defined cases: a null or empty text has features of 0 and a score like any other; without labels
of both kinds the score is the share of label 1, or 0.5; ties of pairs go by feature; repeated rows get equal scores; an
empty table gives no rows. Columns beside key and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, per_batch

NAMES = "chars words word_length word_spread short_words upper digits symbols exclamations punctuation spaces other unique top_word repeated_windows duplicate_lines line_words marked_words".split()
END = re.compile(rb"[^\s\w.,;:'\")\x80-\xff]\s")
CLASS = np.zeros(256, np.int64)
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:'\"()-", b" \t\n\r\x0b\x0c"), 1):
    CLASS[list(_chars)] = _n
CLASS[128:] = 7


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return [0.0] * len(NAMES)
    n, w = len(raw), len(words)
    kinds = np.bincount(CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 8) / n
    sizes = np.fromiter(map(len, words), float, w)
    counts = Counter(words)
    windows = len({*zip(words, words[1:], words[2:], strict=False)})
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(w), sizes.mean(), sizes.std(), (sizes <= 3).mean(), *kinds[1:].tolist(), len(counts) / w, max(counts.values()) / w,
        1 - windows / (w - 2) if w > 2 else 0.0, 1 - len({*lines}) / len(lines), w / len(lines), len(END.findall(raw)) / w,
    ]


def leaves(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """A regression tree over ordered bins: the Newton step of the leaf that each bin falls into."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            out = np.concatenate([leaves(g[:cut], h[:cut], depth - 1, ridge), leaves(g[cut:], h[cut:], depth - 1, ridge)])
    return out


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 120, pairs: int = 6, rate: float = 0.15, depth: int = 2) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]
        self.grid = [np.unique(e[np.linspace(0, len(e) - 1, min(coarse - 1, len(e))).astype(int)]) if len(e) else e for e in self.edges]
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len({*y.tolist()}) < 2:
            return
        at = self.cut(x, self.edges)
        total = np.full(len(y), self.base)
        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                step = rate * leaves(np.bincount(at[f], y - p, len(table)), np.bincount(at[f], p * (1 - p), len(table)), depth)
                table += step
                total += step[at[f]]
        p, near = 1 / (1 + np.exp(-total)), self.cut(x, self.grid)
        gains = []
        for a, b in combinations(range(x.shape[1]), 2):
            wide = len(self.grid[b]) + 1
            cell = near[a] * wide + near[b]
            g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            gains.append((float((g**2 / (h + 1)).sum()), a, b, wide))
        for _, a, b, wide in sorted(gains, key=lambda g: (-g[0], g[1:]))[:pairs]:
            table = np.zeros((len(self.grid[a]) + 1) * wide)
            cell = near[a] * wide + near[b]
            for _ in range(rounds // 4):
                p = 1 / (1 + np.exp(-total))
                g, h = np.bincount(cell, y - p, len(table)), np.bincount(cell, p * (1 - p), len(table))
                order = np.argsort(g / (h + 1), kind="stable")  # a tree over cells in the order of their need
                step = np.zeros(len(table))
                step[order] = rate * leaves(g[order], h[order], depth)
                table += step
                total += step[cell]
            self.pairs.append((a, b, table))

    @staticmethod
    def cut(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        for f, b in enumerate(self.cut(x, self.edges)):
            total += self.tables[f][b]
        near = self.cut(x, self.grid)
        for a, b, table in self.pairs:
            total += table[near[a] * (len(self.grid[b]) + 1) + near[b]]
        return 1 / (1 + np.exp(-total))


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))


def fit(sample: DataFrame) -> Model:
    """The model of a bounded sample ``(key, text, y)``; only features and labels come to the driver."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "x": list(matrix(batch["text"])), "y": batch["y"].astype(float)})

    rows = per_batch(run, sample.select(F.col("key").cast("string").alias("key"), "text", "y"), "key string, x array<double>, y double").toPandas().sort_values("key")
    return Model(np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES)), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every document."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "score": model.score(matrix(batch["text"]))})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return per_batch(run, rows, "key string, score double").withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


by_value(__name__)
