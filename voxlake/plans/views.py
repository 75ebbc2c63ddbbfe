"""The test tables as image data: embeddings are 8x8 frames (label = series, vec_id = frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.pixels import explode_frames

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, sop, data): sparse u16 frames, row-major."""
    px = F.transform("embedding", lambda v: F.when(v.cast("double") > 0.1, F.floor(v.cast("double") * 65535)).otherwise(0).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("series"), F.col("vec_id").alias("sop"), px.alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_frames(frames(spark, sf_dir), ["series", "sop"], SIDE)


#: The same view for DuckDB.
PX = """WITH px AS (SELECT label::BIGINT AS series, vec_id AS sop, ((i-1) % 8)::BIGINT AS x, ((i-1) // 8)::BIGINT AS y,
 CASE WHEN embedding[i]::DOUBLE > 0.1 THEN floor(embedding[i]::DOUBLE * 65535)::BIGINT ELSE 0::BIGINT END AS px
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i) r)"""
