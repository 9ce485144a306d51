"""Latest version of every record, with locality kept for later per-build work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["build_id", "frame", "edge_key"]
FRAMES_PER_BLOCK = 16


def _drop_superseded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal keys in one batch keep the latest row; a key with very many versions so shrinks before the shuffle."""
    for batch in batches:
        keys = batch.select(KEY).to_pandas()
        if keys.duplicated().any():
            pdf = batch.select([*KEY, "written_at", "row_id"]).to_pandas()
            # nulls count as the oldest, as in the window below
            kept = pdf.sort_values(["written_at", "row_id"], na_position="first").drop_duplicates(KEY, keep="last")
            batch = batch.take(pa.array(kept.index.sort_values().to_numpy()))
        yield batch


def current_rows(frame_values: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (build_id, frame, edge_key) with a known edge: the latest written_at, then the greatest row_id.

    Returns build_id, frame, edge_key, vertex1, vertex2, ``columns`` and frame_block. The result is hash-partitioned by
    (build_id, frame_block), so that rows of one build and neighbouring frames lie together while a build that holds a
    third of all rows still spreads over many tasks. Rows with a null in the key are left out (their edge is unknown).
    Null written_at or row_id count as the oldest. An empty input gives an empty result; other columns are ignored.
    """
    need = list(dict.fromkeys([*KEY, "written_at", "row_id", *columns]))
    rows = frame_values.select(*need).where(" AND ".join(f"{k} IS NOT NULL" for k in KEY))
    rows = rows.mapInArrow(_drop_superseded, rows.schema)
    known = edges.select("edge_key", "vertex1", "vertex2").dropDuplicates(["edge_key"])
    rows = rows.join(known, "edge_key").withColumn("frame_block", F.floor(F.col("frame") / FRAMES_PER_BLOCK).cast("int"))
    newest = Window.partitionBy("build_id", "frame_block", "frame", "edge_key").orderBy(F.desc_nulls_last("written_at"), F.desc_nulls_last("row_id"))
    return (
        rows.repartition("build_id", "frame_block")
        .withColumn("_n", F.row_number().over(newest))
        .where("_n = 1")
        .select(*KEY, "vertex1", "vertex2", *[c for c in columns if c not in KEY], "frame_block")
    )
