"""Tables that are written for a while, in a folder that all machines share, and how
small ones are dealt out."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The context's checkpoint folder; where it has none, the one that the session names.
    Where that names none either, a folder in the warehouse is taken, if other machines
    can see it: on one machine, or in a store that isn't a local disk."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        scheme = re.match(r"([a-z][a-z0-9+.-]+):", warehouse)
        if not sc.master.startswith("local[") and sc.master != "local" and (not scheme or scheme[1] == "file"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{warehouse}/checkpoints-{sc.applicationId}"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in that folder: computed once, its lineage cut."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores where it lies in fewer partitions than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
