"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Texts are cut into runs of letters and digits and runs of other signs. Their 1- to n-grams (words and pairs) are hashed
into a fixed number of buckets. Two multinomials over the buckets are counted: one over all documents, one over the documents that the
``labels`` table trusts (quality 1). A document's score is the mean over its n-grams of log p_target - log p_raw; the
document is rejected below a fixed threshold. Base rules reject short and repetitive texts beside that. Only DataFrame
and SQL functions run here; each document is scored in its own row, without a shuffle of texts.

Repeated three-word windows are found inside a row, by 64-bit hashes that are sorted with the windows' places. Below
``PACKED`` words a window's hash gives its low bits up to the place, which sorts as fast as numbers do and leaves 50 bits or
more. Either way a false repeat has a chance below one in a million in a text, up to five million words.

Defined cases: a null, empty or blank text has counts of 0, score 0 and fails the base rules; without trusted documents
every score is 0; ties and repeated rows get equal results; an empty table gives no rows. Other columns are carried
through whatever their names, but for those of the result, which are replaced, and those that start with ``llr_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, stored, words

#: Runs of letters, marks and digits, or runs of other signs that are not spaces.
PARTS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"
BUCKETS = 1 << 16
THRESHOLD = -0.5
PACKED = 1 << 14


def with_buckets(df: DataFrame, text: str, n: int = 2, size: int = BUCKETS) -> DataFrame:
    """Add ``llr_b``: the bucket of every 1- to n-gram of the text's parts, by the parts' hashes."""
    parts = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PARTS), F.lit(0))
    df = df.withColumn("llr_p", once(F.transform(parts, lambda p: F.xxhash64(p))))
    gram = lambda k: f"xxhash64(h{''.join(f', get(llr_p, i + {j})' for j in range(1, k))})" if k > 1 else "h"
    grams = [f"transform(slice(llr_p, 1, greatest(size(llr_p) - {k - 1}, 0)), (h, i) -> cast(pmod({gram(k)}, {size}) as int))" for k in range(1, n + 1)]
    return df.withColumn("llr_b", once(F.expr(f"concat({', '.join(grams)})"))).drop("llr_p")


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, size: int = BUCKETS, smooth: float = 1.0, most_broadcast: int = 2_000_000) -> list[float]:
    """log p_target - log p_raw for each bucket, with additive smoothing; counted over all documents.

    No text is shuffled. The trusted ids are broadcast, at most ``most_broadcast`` at a time; where there are more, the raw
    counts need no join, and each part of the ids marks its documents in a scan of its own.
    """
    ids = trusted.select(F.col(key).alias("llr_id")).where("llr_id is not null").distinct()
    parts = ids.count() // most_broadcast + 1
    if parts > 1:
        ids = stored(ids, "trusted-ids")
    own = docs.select(F.col(key).alias("llr_key"), F.col(text).alias("llr_text"))
    grams = lambda df, *marks: with_buckets(df, "llr_text", n, size).select(*marks, F.explode("llr_b").alias("bucket"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    if parts == 1:
        marked = grams(own.join(F.broadcast(ids), F.col("llr_key") == F.col("llr_id"), "left"), F.col("llr_id").isNotNull().cast("int").alias("good"), F.lit(1).alias("raw"))
    else:
        marked = grams(own, F.lit(0).alias("good"), F.lit(1).alias("raw"))
        for p in range(parts):
            some = F.broadcast(ids.where(part("llr_id") == p))
            marked = marked.union(grams(own.where(part("llr_key") == p).join(some, F.col("llr_key") == F.col("llr_id"), "left_semi"), F.lit(1), F.lit(0)))
    counts = marked.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).collect()  # one row a bucket
    good, raw = (sum(r[c] for r in counts) for c in ("good", "raw"))
    if not good:
        return [0.0] * size
    base = math.log((raw + smooth * size) / (good + smooth * size))
    found = {r["bucket"]: math.log((r["good"] + smooth) / (r["raw"] + smooth)) + base for r in counts}
    return [found.get(b, base) for b in range(size)]


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("llr_w", once(words(F.col(text))))
    df = df.withColumn("llr_h", once(F.transform("llr_w", lambda w: F.xxhash64(w))))
    # bits for a position: enough for the number of windows
    df = df.withColumn("llr_bits", once(F.ceil(F.log2(F.size("llr_h") + F.lit(1))).cast("int")))
    window = "xxhash64(h, get(llr_h, i + 1), get(llr_h, i + 2))"
    windows = "transform(slice(llr_h, 1, greatest(size(llr_h) - 2, 0)), (h, i) -> {})"
    short = F.size("llr_h") < PACKED
    packed = F.expr(windows.format(f"({window} & ~(shiftleft(1L, llr_bits) - 1L)) | cast(i as bigint)"))
    placed = F.expr(windows.format(f"named_struct('h', {window}, 'i', cast(i as bigint))"))
    df = df.withColumns({"llr_s": once(F.when(short, F.sort_array(packed))), "llr_t": once(F.when(~short, F.sort_array(placed)))})
    alike = "filter({0}, (x, i) -> coalesce({1} = {2}, false) or coalesce({1} = {3}, false))"
    of_short = alike.format("llr_s", "shiftright(x, llr_bits)", "shiftright(get(llr_s, i - 1), llr_bits)", "shiftright(get(llr_s, i + 1), llr_bits)")
    of_long = alike.format("llr_t", "x.h", "get(llr_t, i - 1).h", "get(llr_t, i + 1).h")
    places = F.when(short, F.expr(f"transform({of_short}, x -> x & (shiftleft(1L, llr_bits) - 1L))")).otherwise(F.expr(f"transform({of_long}, x -> x.i)"))
    df = df.withColumn("llr_r", once(F.sort_array(places)))
    covered = F.expr("aggregate(transform(llr_r, (p, i) -> least(3L, coalesce(get(llr_r, i + 1) - p, 3L))), 0L, (a, x) -> a + x)")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("llr_lines", once(lines))
    return df.withColumns(
        {
            "n_words": F.size("llr_w").cast("long"),
            "word_chars": F.char_length(F.array_join("llr_w", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("llr_lines") - F.size(F.array_distinct("llr_lines"))).cast("long"),
            "n_repeat_words": once(covered.cast("long")),
        }
    ).drop("llr_w", "llr_h", "llr_bits", "llr_s", "llr_t", "llr_r", "llr_lines")


def judge(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, size: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents with base counts, base_failed, llr (mean log-likelihood ratio) and kept. All columns are carried."""
    ratios = log_ratios(docs, trusted, key, text, n, size)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded into one constant
    own = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")]
    df = with_buckets(base_counts(docs.select(*own), text), text, n, size)
    total = F.aggregate("llr_b", F.lit(0.0), lambda a, b: a + F.get(table, b))
    df = df.withColumn("llr", once(F.when(F.size("llr_b") > 0, total / F.size("llr_b")).otherwise(F.lit(0.0)))).drop("llr_b")
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", once(~F.col("base_failed") & (F.round("llr", 9) >= threshold)))
