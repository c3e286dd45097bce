import pytest

import __spark_entry__ as entry
import corpus_pipeline


def test_entry_has_every_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_each_stage_works_on_what_the_last_one_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == ids
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        left = {r["doc_id"] for r in out.collect()}
        assert left <= ids and (left < ids or name in ("toxicity", "near_duplicates", "repeated_passages"))
        docs, ids = spark.createDataFrame(out.collect(), out.schema), left


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_no_rows_and_odd_rows(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert stage(spark, docs.limit(0), sf).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, " ", "en", "s", 1), (2, " ", "en", "s", 1)], docs.schema)
    assert stage(spark, odd, sf).count() <= 4


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op9_embedding_near_dedup", "op10_quality_rules"])
def test_queries_equal_their_sql(spark, sf, name):
    import check_oracle

    assert check_oracle.compare(spark, check_oracle.connect(sf), sf, name).startswith("ok")
