"""Secret scans by guess-cost dynamic programming.

Fixed patterns give the base spans. Beside them, values in a credential context (``pwd: ...``, ``bearer ...``,
``//user:value@host``) are split at minimum cost into words, dates, repeats, keyboard walks and brute-force spans; a value
that needs at least ``10 ** THRESHOLD`` guesses is a secret. Values run to whitespace or the closing quote, in URLs to the
``@``. A value within a base span is not reported twice; one that goes beyond a base span is, whatever its guesses, so that
redaction covers both.

Words have ranks, by which they are guessed: the few of ``WORDS`` first, then those of a tokenizer's vocabulary if its path
is given, in the order of their merges, which is that of their frequency in public text.

Offsets count code points, ends are exclusive. Defined cases: a null or empty text has no spans; repeated rows get equal
results; spans that start together are ordered by kind; segmentations of equal cost give one cost; an empty table gives no
rows; whole texts are scanned, in time that grows with their length. Columns beside key and text are not looked at by
:func:`scan` and stay as they are in :func:`redact`, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, per_batch, worker_cache

KINDS = ("assign", "access", "hex", "guess")
THRESHOLD = 9.0
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key")
#: Both find what the patterns without a count find, less the matches that are too short: a match is a whole run.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HEX_HINT = re.compile(r"[0-9a-f]{8}")
#: A keyword starts a word, follows an underscore or starts a hump; words that mean nothing else may end any name.
CONTEXT = re.compile(
    r"""(?:(?:(?:(?<![^\W_])|(?<=[a-z0-9])(?=[A-Z]))(?i:pass|auth(?:orization)?|(?:private|access|client)[_-]?(?:key|secret)|login|pin)"""
    r"""|(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credentials?))["']?\s{0,8}(?::=|=>|[:=])\s{0,8}(?P<q>["'])?"""
    r"""(?:(?i:bearer|basic)\s)?|\b(?i:bearer)\s)(?P<v>(?(q)(?:(?!(?P=q))\S){8,}|(?!["'])(?:[^\s"']|["'](?![\s,;:)>}\]]|$)){8,}))"""
    r"""|//[^\s:/@]{1,64}:(?P<u>[^\s"'@]{8,})""",
    re.ASCII,
)
CONTEXT_HINT = re.compile(r"pass|pwd|secret|token|key|auth|credential|login|pin|bearer|//")
WORDS = {
    w: i
    for i, w in enumerate(
        "password 123456 qwerty letmein welcome admin login master secret dragon monkey football baseball sunshine princess shadow iloveyou changeme default example "
        "test testing guest root user username pass passwd token apikey key auth bearer client private public access server service system database localhost value string "
        "your enter here insert placeholder replace sample dummy demo null none true false undefined todo redacted hidden xxxx company account email mail name number hello "
        "summer winter spring autumn monday friday january march april june july august september october november december love home house water light green black white blue "
        "the and for with this that from have not are was one all new word time people first world life day good great".split(),
        1,
    )
}
LEET = str.maketrans("@4301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
SHORTEST_WORD = 3
#: A repeat or a walk is taken from its first character on, or from any of its last ``RUN``.
RUN = 16


def ranked(vocabulary: str | None) -> dict[str, int]:
    """Words by rank: ``WORDS``, and after them the lower-case words of a ``tokenizer.json`` file by their ids."""
    cache = worker_cache()
    if (name := f"words {vocabulary}") not in cache:
        more = json.load(open(vocabulary))["model"]["vocab"] if vocabulary else {}
        found = dict.fromkeys([*WORDS, *(w for t in sorted(more, key=more.get) if len(w := t.removeprefix("\u0120")) >= SHORTEST_WORD and w.isascii() and w.isalpha() and w.islower())])
        cache[name] = {w: i for i, w in enumerate(found, 1)}, max(map(len, found))
    return cache[name]


def brute(c: str) -> float:
    """log10 of the guesses for one character by its class."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs; time and memory grow with the value's length."""
    n = len(value)
    ranks, longest = ranked(vocabulary)
    low, plain = value.lower(), value.lower().translate(LEET)
    best = [0.0] + [math.inf] * n
    step = math.log10(2)  # a segment more doubles the guesses
    walk = 0
    unit_run: dict[int, int] = {1: 0, 2: 0, 3: 0, 4: 0}
    for j in range(1, n + 1):
        i = j - 1
        best[j] = min(best[j], best[i] + brute(value[i]))
        for k in range(SHORTEST_WORD, min(longest, j) + 1):
            word = low[j - k : j]
            rank = ranks.get(word) or (2 * r if (r := ranks.get(plain[j - k : j])) else 0)
            if rank:
                case = 0.0 if value[j - k : j] == word else math.log10(2) if value[j - k] != low[j - k] else math.log10(k + 1)
                best[j] = min(best[j], best[j - k] + math.log10(rank + 1) + case + step)
        for unit in unit_run:  # repeats of one to four characters
            unit_run[unit] = run = unit_run[unit] + 1 if j > unit and value[i] == value[i - unit] else 0
            for own in {run, *range(max(2, unit), min(run, RUN) + 1)} if run >= max(2, unit) else ():
                start = j - own - unit
                one = sum(brute(c) for c in value[start : start + unit])
                best[j] = min(best[j], best[start] + one + math.log10((own + unit) / unit + 1) + step)
        walk = walk + 1 if j > 1 and (low[i - 1], low[i]) in BESIDE else 0
        for own in {walk, *range(2, min(walk, RUN) + 1)} if walk >= 2 else ():
            best[j] = min(best[j], best[j - own - 1] + math.log10(47) + math.log10(own + 1) * 2 + step)
        for m in range(max(0, j - 10), j - 3):
            if value[m].isdigit() and DATE.fullmatch(value, m, j):
                best[j] = min(best[j], best[m] + math.log10(365 * 120) + step)
    return best[n]


def find(text: str | None, threshold: float = THRESHOLD, vocabulary: str | None = None) -> list[tuple[int, int, int, int]]:
    """Spans ``(start, kind number, end, start of the value)`` in order."""
    text = text or ""
    low, base = text.lower(), [[], [], []]
    if ASSIGN_HINT.search(low):
        base[0] = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base[1] = [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    if HEX_HINT.search(text[::4]):  # a run of 32 has 8 places that 4 divides
        base[2] = [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    out = [x for spans in base for x in spans]
    if CONTEXT_HINT.search(low):
        at = [0, 0, 0]  # of each kind the first span that does not end before the value; values come in order, as spans do
        for m in CONTEXT.finditer(text):
            start = m.start("u" if m["v"] is None else "v")
            value = text[start : m.end()].rstrip(",;|<>@\"'")
            end, core, over = start + len(value), value.rstrip(".)!?]}"), []
            for k, spans in enumerate(base):
                while at[k] < len(spans) and spans[at[k]][2] <= start:
                    at[k] += 1
                i = at[k]
                while i < len(spans) and spans[i][0] < end:
                    over.append(spans[i])
                    i += 1
            if len(value) >= 8 and not any(a <= start and start + len(core) <= b for a, _, b, _ in over) and (over or guess_cost(core, vocabulary) >= threshold):
                out.append((start, 3, end, start))
    return sorted(out)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """``(key, spans)`` of every document; spans is an array of (kind, start, end, value_start)."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        spans = [[{"kind": KINDS[k], "start": a, "end": b, "value_start": v} for a, k, b, v in find(t, threshold, vocabulary)] for t in batch["text"]]
        return pd.DataFrame({"key": batch["key"], "spans": spans})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return per_batch(run, rows, "key string, spans array<struct<kind:string,start:long,end:long,value_start:long>>").withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """The documents, with each secret's value replaced by a mark. A null text stays null; other columns stay."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for _, _, end, value in sorted(find(t, threshold, vocabulary), key=lambda s: s[3]):
                if value >= at:
                    out += [t[at:value], mark]
                at = max(at, end)
            return "".join([*out, t[at:]])

        return texts.map(one)

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(text)))


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


by_value(__name__)
