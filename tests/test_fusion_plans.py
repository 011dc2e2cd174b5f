"""Fusion is planned once for all that is read from it."""

import __spark_entry__


def scans(spark, name):
    return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_errors_fuse_once(spark):
    assert scans(spark, "fusion_errors") == 1
