"""The gated writer: all of it or nothing, and never what still holds a covered string."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators.publish import Published, Refused, publish


def tables(spark, leak=False):
    texts = [(1, "public"), (2, "clean"), (3, "has secret-3" if leak else "fine"), (4, "refused"), (5, "no report"), (6, "still secret-6, but there was nothing to redact")]
    output = spark.createDataFrame(texts, "doc_id long, text string")
    covered = spark.createDataFrame([(1, "secret-1"), (3, "secret-3"), (6, "secret-6")], "doc_id long, covered string")
    report = spark.createDataFrame([(1, 0), (2, 2), (3, 0), (4, 3), (6, 2)], "doc_id long, exit_code int")
    return output, covered, report


def ids(spark, path):
    return sorted(r.doc_id for r in spark.read.parquet(path).collect())


def test_what_is_proved_is_published(spark, tmp_path):
    to = str(tmp_path / "out")
    assert publish(*tables(spark), to) == Published(4, 2, 0, 2)
    assert ids(spark, to) == [1, 2, 3, 6]
    assert os.listdir(tmp_path) == ["out"] or sorted(os.listdir(tmp_path)) == [".out.crc", "out"]
    with pytest.raises(Refused, match="exists"):
        publish(*tables(spark), to)
    assert ids(spark, to) == [1, 2, 3, 6]


def test_a_failing_verdict_leaves_nothing(spark, tmp_path):
    to = str(tmp_path / "out")
    with pytest.raises(Refused, match="1 document"):
        publish(*tables(spark, leak=True), to)
    assert os.listdir(tmp_path) == []
    assert publish(*tables(spark, leak=True), to, on_failure="leave out") == Published(3, 2, 1, 2)
    assert ids(spark, to) == [1, 2, 6]


def test_a_document_without_verdict_is_not_proved(spark, tmp_path):
    output, covered, report = tables(spark)
    with pytest.raises(Refused):
        publish(output, covered.where("doc_id <> 3"), report, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_a_job_that_dies_leaves_nothing(spark, tmp_path):
    output, covered, report = tables(spark)
    broken = output.withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        publish(broken, covered, report, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_targets_stay_below_their_root(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    with pytest.raises(ValueError, match="outside"):
        publish(*tables(spark), "../out", root=str(root))
    publish(*tables(spark), "out", root=str(root))
    assert ids(spark, str(root / "out")) == [1, 2, 3, 6]
    with pytest.raises(ValueError):
        publish(*tables(spark), "x", on_failure="go on")
