"""What the Arrow and SQL operators share: sampling for fits, cut points in lineage, shipping of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same class as a Java regular expression; words of the whitespace-separated contracts.
WORD = "[^\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; a cluster without that path takes --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def checkpoint_ready(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir; where it is unset, a folder of our own, which only a local session's workers all see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loxodrome-"))


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: later jobs read it, and losing an executor loses nothing."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def unit(*columns: Column) -> Column:
    """A uniform in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def bounded_sample(df: DataFrame, key: str, stratum: str, per_stratum: int, seed: int) -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum``: rows whose hash lies under per_stratum / count.

    Filters alone, so no sort and no shuffle of rows; the same rows at every run.
    """
    counts = df.groupBy(stratum).count().collect()
    keep = F.lit(False)
    for r in counts:
        if r[stratum] is not None:
            keep = keep | ((F.col(stratum) == F.lit(r[stratum])) & (unit(F.col(key), F.lit(seed)) < per_stratum / max(r["count"], 1)))
    return df.where(keep)


def table(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared checkpoint folder and read back: a compact cut point that many jobs may read."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
