"""Session helpers: where intermediate tables go, and keyed pseudo-random fractions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tracekit-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a DataFrame that several later steps read to the shared folder, and read it back.

    One job, no lineage behind it, and later scans still prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(seed: object, *keys: Column | str) -> Column:
    """Hex md5 of ``seed|key|...``: the same order on every run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def fraction(seed: object, *keys: Column | str) -> Column:
    """Uniform double in [0, 1): the first eight hex digits of the digest over 2**32."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Round for reports; adding zero turns -0.0 into 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)
