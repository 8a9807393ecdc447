"""The stages one after another, each against what it was given."""

from __future__ import annotations

import corpus_pipeline
from tideline.llm import mixing
from tideline.llm.base import stored

from . import brute
from .conftest import PASSAGE, as_set


def test_stages_on_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stored(stage(spark, docs, sf_dir), "test")
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        ids = sorted(r[0] for r in after)
        if name != "mix":
            assert docs.columns == columns and set(ids) <= {r[0] for r in before}
        if name == "near duplicates":
            assert ids == sorted(d for d, _, _, kept in brute.near_duplicates(before) if kept)
        if name == "benchmark":
            held = {r[0] for r in brute.contained(before, items)}
            assert ids == sorted(r[0] for r in before if r[0] not in held)
        if name == "personal data":
            assert len(before) == len(after) and not any("@mail" in r[1] for r in after)
        if name == "mix":
            assert docs.columns == [*columns, "copy_no"] and docs.filter("copy_no > 2").isEmpty()


def test_stages_on_odd_rows(spark, odd, sf_dir, tmp_path):
    kept = corpus_pipeline.keep_one_of_each(spark, odd, sf_dir)
    ids = [r[0] for r in as_set(kept, "doc_id")]
    assert ids.count(12) == 1 and 2 not in ids and 3 not in ids and {4, 5, 6} <= set(ids)
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_benchmark(spark, kept, str(tmp_path))
    assert {r[0] for r in as_set(clean, "doc_id")} == set(ids) - {10, 11}
    assert mixing.mix_documents(corpus_pipeline.redact(spark, clean, sf_dir)).columns == [*odd.columns, "copy_no"]
