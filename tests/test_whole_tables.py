"""Queries that must read all of their table."""

import pytest

from kinfold.plans import QUERIES


def test_levenshtein_of_every_part(spark, sf):
    keys = {r["p_partkey"] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    rows = QUERIES["fn02_levenshtein_typos"](spark, sf).collect()
    assert len(rows) == len(keys) and {r["p_partkey"] for r in rows} == keys and max(keys) > 100
    assert {r["d"] for r in rows} == {0, 1}


def test_brands_above_the_bound(spark, tmp_path):
    spark.range(10_001).selectExpr("concat('Brand#', id) as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    with pytest.raises(ValueError, match="more than 10000 brands"):
        QUERIES["pt06_lpt_bins"](spark, str(tmp_path))
