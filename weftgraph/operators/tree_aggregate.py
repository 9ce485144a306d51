"""Sums per key by multi-level tree aggregation, for keys of very uneven size.

Fixed-size chunks of the input are combined where they lie; the chunk states are then merged in rounds of bounded
fan-in, so that no task ever receives the partial states of all chunks of a hot key at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 65_536
FAN_IN = 16


def tree_levels(n_rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> int:
    """Merge rounds that ``n_rows`` need: the logarithm of the number of chunks to the base ``fan_in``, at least 1."""
    chunks = max(1, math.ceil(n_rows / chunk_rows))
    return max(1, math.ceil(round(math.log(chunks, fan_in), 9)))


def tree_sum(df: DataFrame, keys: list[str], value: str, n_rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Exact sum of the integer column ``value`` and the number of rows for each combination of ``keys``.

    ``n_rows`` (an estimate is enough) sets the number of merge rounds. Null values count as 0, null keys form a group
    of their own, repeated rows all count, an empty input gives an empty result and columns not named are ignored.
    Returns the keys, ``total`` (bigint) and ``n_rows`` (bigint).
    """
    levels = tree_levels(n_rows, chunk_rows, fan_in)
    narrow = df.select(*keys, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_v"))
    schema = T.StructType([*(T.StructField(k, narrow.schema[k].dataType) for k in keys), *(T.StructField(c, T.LongType()) for c in ("total", "n_rows", "_node"))])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk = 0

        def state(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by(keys).aggregate([("_v", "sum"), ("_v", "count")])
            node = (task * 1_000_003 + chunk) % fan_in**levels
            t = pa.Table.from_arrays([*(t[k] for k in keys), t["_v_sum"], t["_v_count"], pa.array([node] * len(t), pa.int64())], names=[*keys, "total", "n_rows", "_node"])
            yield from t.to_batches()

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk_rows:
                yield from state(held)
                held, rows, chunk = [], 0, chunk + 1
        if rows:
            yield from state(held)

    states = narrow.mapInArrow(combine, schema)
    for level in range(levels):
        up = F.expr(f"_node div {fan_in}") if level < levels - 1 else F.lit(0).cast("long")
        states = states.withColumn("_node", up).groupBy(*keys, "_node").agg(F.sum("total").alias("total"), F.sum("n_rows").alias("n_rows"))
    return states.drop("_node")


def heavy_keys(current: DataFrame, vertices: DataFrame, n_rows: int, least_share: float = 1 / 20) -> DataFrame:
    """Keys (vertex1, and kind of vertex1) that hold at least ``least_share`` of their build's n_atom_pairs.

    ``current`` has build_id, vertex1 and n_atom_pairs, one row per current record. Vertices missing from ``vertices``
    have a null kind, which is reported as no key. Totals of kinds and builds are merged from the totals of vertices,
    again as a tree. A build whose total is 0 or less reports every key that reaches the share of it.
    """
    by_vertex = tree_sum(current, ["build_id", "vertex1"], "n_atom_pairs", n_rows)
    kinds = vertices.select(F.col("vertex_id").alias("vertex1"), "kind").dropDuplicates(["vertex1"])
    by_vertex = by_vertex.join(kinds, "vertex1", "left")
    keyed = by_vertex.select(
        "build_id",
        "total",
        F.explode(
            F.array(
                F.struct(F.lit("vertex1").alias("key_field"), F.col("vertex1").cast("string").alias("key_value")),
                F.struct(F.lit("kind").alias("key_field"), F.col("kind").alias("key_value")),
                F.struct(F.lit("build").alias("key_field"), F.lit("").alias("key_value")),
            )
        ).alias("k"),
    ).select("build_id", "k.key_field", "k.key_value", "total")
    totals = tree_sum(keyed, ["build_id", "key_field", "key_value"], "total", n_rows)
    builds = totals.where("key_field = 'build'").select("build_id", F.col("total").alias("build_total"))
    return (
        totals.where("key_field <> 'build' AND key_value IS NOT NULL")
        .join(builds, "build_id")
        .where(F.col("total") >= F.col("build_total") * F.lit(least_share))
        .select("build_id", "key_field", "key_value", "total", "build_total")
    )
