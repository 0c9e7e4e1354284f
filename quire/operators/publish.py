"""Writing redacted documents behind a gate: what was written is read again and looked through before anyone can see it.

Documents go to a staging folder beside the target. What is there is scanned for all covered strings; the counts of the verdict come
from the job that scans. Only then the folder takes the target's name, by one rename; else it goes. A job that is killed leaves a
staging folder and no target."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .redact import verification, verify
from ..sources.paths import resolve_within


class Refused(RuntimeError):
    """Nothing was written, for the reason given."""


class Published(NamedTuple):
    """documents: written; strings: looked for; failed: documents that were left out, since a string was still in them; refused: documents
    that the report did not let through."""

    documents: int
    strings: int
    failed: int
    refused: int


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(output: DataFrame, covered: DataFrame, report: DataFrame, target: str, on_failure: str = "refuse", root: str | None = None) -> Published:
    """Writes output (doc_id, text, ...) as Parquet to the new folder `target` (below `root`, if one is given).

    report: (doc_id, exit_code); documents with 0 are written if none of their covered strings (doc_id, covered) is in what was
    written, those with 2 (nothing to redact) as they are; others, and documents without a report, are not. A document that fails
    refuses everything, or, with on_failure 'leave out', itself only."""
    if on_failure not in ("refuse", "leave out"):
        raise ValueError(f"not a way to go on: {on_failure}")
    spark = output.sparkSession
    target = resolve_within(root, target) if root is not None else target.rstrip("/")
    files, final = _path(spark, target)
    if files.exists(final):
        raise Refused(f"target exists: {target}")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        counted, scanned = Observation(), Observation()
        rules = report.groupBy("doc_id").agg(F.max("exit_code").alias("_code"))
        marked = output.join(rules, "doc_id", "left").withColumn("_let", F.coalesce(F.col("_code").isin(0, 2), F.lit(False)))
        marked = marked.observe(counted, F.count_if(~F.col("_let")).alias("refused"))
        marked.where("_let").drop("_let").write.parquet(f"{staging}/all")
        written = spark.read.parquet(f"{staging}/all")
        wanted = covered.join(written.where("_code = 0").select("doc_id"), "doc_id", "left_semi")
        verdicts = verification(verify(written, wanted)).observe(scanned, F.coalesce(F.sum("strings"), F.lit(0)).alias("strings"), F.count_if(~F.col("pass")).alias("failed"))
        verdicts.write.parquet(f"{staging}/verdicts")
        failed, part = scanned.get["failed"], "all"
        verdicts = spark.read.parquet(f"{staging}/verdicts")
        # A document with covered strings to its report and none to look for has no verdict: it is not proved.
        unproved = written.where("_code = 0").select("doc_id").join(verdicts, "doc_id", "left_anti").distinct()
        failed += unproved.count()
        if failed and on_failure == "refuse":
            raise Refused(f"{failed} document(s) still hold what was redacted, or cannot be proved clean")
        if failed:
            part = "proved"
            proved = verdicts.where("pass").select("doc_id")
            written.where("_code = 2").unionByName(written.where("_code = 0").join(proved, "doc_id", "left_semi")).write.parquet(f"{staging}/proved")
        n = spark.read.parquet(f"{staging}/{part}").count()
        ready = _path(spark, f"{staging}/{part}")[1]
        if files.exists(final) or not files.rename(ready, final):
            raise Refused(f"target exists: {target}")
        return Published(n, scanned.get["strings"], failed, counted.get["refused"])
    finally:
        files.delete(_path(spark, staging)[1], True)
