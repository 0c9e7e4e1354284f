"""What several operators need of joins and of the folder that all executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def many_to_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many with the columns of one, which has a row for each value of the keys.

    The keys are compared as one struct: what one side is partitioned by is no use to the join then, so both are dealt out
    anew, and adaptive execution can split the rows of a hot key. Null keys match each other."""
    other = one.select(F.struct(*keys).alias("_one"), *(c for c in one.columns if c not in keys))
    return many.withColumn("_many", F.struct(*keys)).join(other, F.col("_many") == F.col("_one"), how).drop("_many", "_one")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of this machine only where there is no other (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()
