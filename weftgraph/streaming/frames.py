"""Value rows as a stream: arriving files are reduced to the totals of their frames, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.values import finite
from weftgraph.session import shared_folder


def frame_totals(rows: DataFrame) -> DataFrame:
    """Rows, pairs and the sum of the finite coulomb readings of every frame of every build."""
    x = F.col("coulomb").cast("double")
    good = F.when(finite(x), x)
    return rows.groupBy("build_id", "frame").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("n_atom_pairs", F.lit(0)).cast("long")).alias("n_atom_pairs"), F.sum(good).alias("coulomb"))


def stream_frame_totals(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Totals of all files below ``path`` by a stream that ends when it has read what is there.

    Every micro-batch writes its partial totals below its own number, so a batch that is repeated after a failure replaces
    itself; partial totals add up, as a frame's rows may come in several files. Rows that come late need no watermark.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema if pattern else spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    if pattern:
        stream = stream.option("pathGlobFilter", pattern)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    root = shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        frame_totals(batch).write.mode("overwrite").parquet(f"{root}/totals/batch={number}")

    q = stream.parquet(path).writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    partial = spark.read.schema("build_id long, frame int, n_rows long, n_atom_pairs long, coulomb double, batch int").parquet(f"{root}/totals")
    return partial.groupBy("build_id", "frame").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_atom_pairs", "coulomb")))


def windowed_totals(rows: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows written per build and window of written_at, for streams that run on: windows close when ``late`` has passed."""
    return rows.withWatermark("written_at", late).groupBy("build_id", F.window("written_at", width)).agg(F.count(F.lit(1)).alias("n_rows")).select("build_id", F.col("window.start").alias("start"), "n_rows")
