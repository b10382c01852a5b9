"""The pipeline's stages over the driver's smallest tables."""

import re

import corpus_pipeline
from arbora.llm import secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF).cache()
        if name != "packing":
            assert kept.columns == [*corpus_pipeline.COLUMNS]
        if name == "quality_rules":
            assert 0 < kept.count() < before.count() and kept.exceptAll(before.select(kept.columns)).isEmpty()
        if name == "simhash_near_dedup":
            rows = kept.collect()
            assert kept.exceptAll(before).isEmpty()
            sets = []
            for r in rows:
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
                sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
            close = [(a, b) for i, a in enumerate(sets) for b in sets[:i] if len(a & b) >= 0.8 * len(a | b)]
            assert not close
        if name == "secret_scans":
            assert kept.count() == before.count() and not [r for r in kept.collect() if secrets.find(r.text)]
    assert sum(r.length for r in kept.collect()) > 0 and kept.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "", None, "a", 0), (2, "x " * 60, "en", "a", 120), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).collect()


def test_other_columns_and_repeated_ids(spark):
    """Columns beside those of documents are left out; an id's unlike texts stay, near copies go, whatever their ids."""
    words = [[f"t{n}w{i}" for i in range(120)] for n in range(3)]
    near = [*words[0][:60], "changed", *words[0][61:]]
    rows = [(1, " ".join(words[0])), (1, " ".join(words[1])), (2, " ".join(near)), (None, " ".join(words[2])), (None, " ".join([*words[2], "more"])), (1, " ".join(words[1]))]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t), "clash", 7) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, mix_size int")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert kept.columns == [*corpus_pipeline.COLUMNS]
    assert sorted((r.doc_id or 0, r.text[:2]) for r in kept.collect()) == [(0, "t2"), (1, "t0"), (1, "t1")]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == [*corpus_pipeline.COLUMNS]
