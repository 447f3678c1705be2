"""Reading the tables and the few physical helpers that several operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables, read lazily."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: that of ``spark.checkpoint.dir``.

    Where the session names none, as in tests, it is a local one, and only if the
    master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "marginalia-checkpoints")


def use_checkpoints(spark: SparkSession) -> None:
    """Names a checkpoint folder only where the session has none.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that one always wins.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    spark.sparkContext.setCheckpointDir(scratch(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Writes a result that is read more than once to the shared checkpoint folder.

    The copy survives lost executors (unlike a cache or a local checkpoint) and is removed when the
    driver no longer refers to it, if the session cleans checkpoints.
    """
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_repeats(df: DataFrame, key: str, version: list[Column], broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per ``key``: the least by ``version``, nulls last; rows without a key are all kept.

    Only key and version are shuffled to find repeated keys, each with the version to keep. If those
    are at most ``broadcast_rows`` (checked by a count), the wide rows never move: one scan looks
    each key up in that small table. Beyond the bound every row is ranked after a shuffle on the
    key. Rows of the same key and version are ranked by a hash of all columns, so that both ways
    keep the same row; only such rows need a second look at the table.
    """
    order = F.struct(*(x for v in version for x in (v.isNull(), v)))
    total = [F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind))]
    ranked = Window.partitionBy(key).orderBy(order, *total)

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")

    per_key = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__keep"), F.max(order).alias("__last"))
    repeated = materialize(per_key.where("__n > 1").select("__key", "__keep", "__n", (F.col("__keep") == F.col("__last")).alias("__tied")))
    head = repeated.limit(broadcast_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.max("__tied").alias("tied"), F.max("__n").alias("most")).first()
    if head["n"] == 0:
        return df
    if head["n"] > broadcast_rows:
        return first(df.where(F.col(key).isNotNull())).unionByName(df.where(F.col(key).isNull()))
    tied = head["tied"]
    if head["most"] > 2:
        firsts = df.select(F.col(key).alias("__key"), order.alias("__keep")).join(F.broadcast(repeated.where("__n > 2").select("__key", "__keep")), ["__key", "__keep"])
        twice = materialize(firsts.groupBy("__key").count().where("count > 1").select("__key", F.lit(True).alias("__twice")))
        if twice.head(1):
            tied = True
            repeated = repeated.join(F.broadcast(twice), "__key", "left").withColumn("__tied", F.col("__tied") | F.col("__twice").isNotNull())
    seen = df.join(F.broadcast(repeated), F.col(key) == F.col("__key"), "left").where(F.col("__key").isNull() | (order == F.col("__keep")))
    once = seen.where(~F.coalesce("__tied", F.lit(False))).select(df.columns)
    return once.unionByName(first(seen.where("__tied").select(df.columns))) if tied else once
