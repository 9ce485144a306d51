"""A network on disk: vertices, members, edges, value parts and a metadata file in one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import schema
from weftgraph.errors import NetworkError

FORMAT = "weftgraph_network_v1"
MAX_FILE_ROWS = 20_000_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def check_network(spark: SparkSession, path: str, need_values: bool = True) -> None:
    """Raise if a table is missing; an empty values folder is allowed where values are not needed."""
    for name in ("vertices.parquet", "vertex_members.parquet", "edges.parquet", "values", "metadata.json"):
        if not exists(spark, f"{path}/{name}"):
            raise NetworkError(f"{path} has no {name}")
    if need_values:
        fs, p = _fs(spark, f"{path}/values")
        if not any(str(s.getPath().getName()).startswith(("part-", "frame_bucket=")) for s in fs.listStatus(p)):
            raise NetworkError(f"{path} has no value parts")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.VERTICES).parquet(f"{path}/vertices.parquet")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MEMBERS).parquet(f"{path}/vertex_members.parquet")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.EDGES).parquet(f"{path}/edges.parquet")


def read_values(spark: SparkSession, path: str, frames: list[int] | None = None, frames_per_part: int | None = None) -> DataFrame:
    """The value table, or its rows of some frames; with ``frames_per_part`` the parts without them are not read."""
    stored = spark.read.schema(T.StructType([*schema.VALUES.fields, T.StructField("frame_bucket", T.IntegerType())])).parquet(f"{path}/values")
    if frames is not None:
        wanted = [int(f) for f in frames]
        stored = stored.where(F.col("frame").isin(*wanted))
        if frames_per_part:
            stored = stored.where(F.col("frame_bucket").isNull() | F.col("frame_bucket").isin(*sorted({f // frames_per_part for f in wanted})))
    return stored.drop("frame_bucket")


def write_network(path: str, vertices: DataFrame, members: DataFrame, values: DataFrame, edges: DataFrame | None = None, frames_per_part: int = 10, metadata: dict | None = None) -> None:
    """Write a network, replacing what is there. Values go to one file per ``frames_per_part`` frames, more only beyond
    ``MAX_FILE_ROWS`` rows, sorted by frame and edge, so that scans of some frames skip the rest. Without ``edges`` the dictionary comes from the values written."""
    from weftgraph.operators.edges import edge_dictionary

    spark = vertices.sparkSession

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    write(vertices.select(*(F.col(f.name).cast(f.dataType) for f in schema.VERTICES)), "vertices.parquet")
    write(members, "vertex_members.parquet")
    bucket = F.floor(F.col("frame") / frames_per_part).cast("int")
    (
        values.withColumn("frame_bucket", bucket)
        .repartition("frame_bucket")
        .sortWithinPartitions("frame_bucket", "frame", "edge_key")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", MAX_FILE_ROWS)
        .partitionBy("frame_bucket")
        .parquet(f"{path}/values")
    )
    n = read_vertices(spark, path).count()
    stored = read_values(spark, path)
    write(edges if edges is not None else edge_dictionary(stored, n).orderBy("edge_key"), "edges.parquet")
    info = {"format": FORMAT, "n_vertices": n, "n_value_rows": stored.count(), "n_edges": read_edges(spark, path).count(), "frames_per_part": frames_per_part} | (metadata or {})
    write_text(spark, f"{path}/metadata.json", json.dumps(info, indent=1))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first().value)
