"""Engine tables and published outputs on shared storage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of an engine table in order and type; absent ones are null, others refused."""
    wanted = schemas.table_schema(name)
    extra = set(df.columns) - set(wanted.names)
    if extra:
        raise ValueError(f"{name} has no column {sorted(extra)[0]}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in wanted
    ])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def append_table(df: DataFrame, root: str, name: str) -> None:
    conform(df, name).write.mode("append").parquet(f"{root}/{name}")


def output_conflicts(outputs: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Jobs with more than one artifact name, counting what is already published."""
    names = outputs.select("job_id", "filename")
    if published is not None:
        # Only what is published of these jobs can conflict with them.
        names = names.unionByName(
            published.select("job_id", "filename")
            .join(outputs.select("job_id").distinct(), "job_id", "left_semi"))
    return (
        names.groupBy("job_id")
        .agg(F.min("filename").alias("first_name"), F.max("filename").alias("last_name"))
        .where(F.col("first_name") != F.col("last_name"))
    )


def write_outputs(outputs: DataFrame, path: str, publish: int = 64) -> DataFrame:
    """Publish one artifact per job; publishing again replaces the job's artifact.

    ``outputs``: job_id, filename, content. Jobs are hashed into ``publish`` folders, to be
    chosen so that one folder is cheap to rewrite; only folders that receive rows are
    rewritten, together with the jobs they already hold. Jobs in conflict are left unpublished
    and returned.
    """
    spark = outputs.sparkSession
    part = F.pmod(F.hash("job_id"), F.lit(publish))
    placed = outputs.select("job_id", "filename", "content", part.alias("part"))
    schema = placed.schema
    try:
        published = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:  # nothing has been published yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        published = spark.createDataFrame([], schema)
    # The target cannot be read while it is replaced, so everything that depends on it is
    # written beside it first. A lost executor then only repeats tasks over stored data.
    staging = f"{path.rstrip('/')}.staging/{uuid.uuid4().hex}"
    output_conflicts(outputs, published).write.parquet(f"{staging}/conflicts")
    conflicts = spark.read.parquet(f"{staging}/conflicts")
    fresh = placed.join(conflicts.select("job_id"), "job_id", "left_anti")
    # At most ``publish`` folder numbers.
    touched = F.broadcast(fresh.select("part").distinct())
    kept = published.join(touched, "part", "left_semi").join(
        fresh.select("job_id"), "job_id", "left_anti"
    )
    fresh.unionByName(kept).write.parquet(f"{staging}/rows")
    (
        spark.read.schema(schema).parquet(f"{staging}/rows")
        .hint("rebalance", "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )
    return conflicts
