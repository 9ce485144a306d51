"""Interactions between regions of a network, per residue and frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.errors import SelectorError
from weftgraph.functions.selectors import vertex_condition
from weftgraph.functions.values import divided, finite, member_denominator, normalization_name, signed_root, value_expr
from weftgraph.operators.edges import with_endpoints


def resolve_regions(vertices: DataFrame, selectors: Sequence[str], labels: Sequence[str] | None = None, prefix: str = "R", require_disjoint: bool = True, least: int = 2) -> DataFrame:
    """region_index (from 1), region, selector and vertex_id. Each region must match a vertex, none two of them."""
    if len(selectors) < least:
        raise SelectorError(f"at least {least} regions are needed")
    if labels and len(labels) != len(selectors):
        raise SelectorError("there must be as many labels as regions")
    names = list(labels) if labels else [f"{prefix}{i}" for i in range(1, len(selectors) + 1)]
    parts = F.array(
        *(F.when(vertex_condition(s, vertices.columns), F.struct(F.lit(i).alias("region_index"), F.lit(n).alias("region"), F.lit(s).alias("selector"))) for i, (n, s) in enumerate(zip(names, selectors, strict=True), 1))
    )
    rows = vertices.select("vertex_id", F.inline(F.array_compact(parts)))
    found = {r.region_index: r["count"] for r in rows.groupBy("region_index").count().collect()}
    for i, s in enumerate(selectors, 1):
        if i not in found:
            raise SelectorError(f"region {s!r} matches no vertex")
    if require_disjoint:
        twice = rows.groupBy("vertex_id").agg(F.sort_array(F.collect_list("region")).alias("r")).where("size(r) > 1").orderBy("vertex_id").first()
        if twice:
            raise SelectorError(f"vertex {twice.vertex_id} lies in several regions: {', '.join(twice.r)}")
    return rows.select("region_index", "region", "selector", "vertex_id")


def residue_keys(vertices: DataFrame, vertex_ids: DataFrame) -> DataFrame:
    """Residue of each of the given vertices; an unknown vertex is a KeyError."""
    if bad := vertex_ids.join(vertices, "vertex_id", "left_anti").limit(5).collect():
        raise KeyError(f"unknown vertices {[r.vertex_id for r in bad]}")
    return vertex_ids.join(vertices, "vertex_id").select("vertex_id", "molecule_instance", "residue_id", F.coalesce("residue_name", F.lit("")).alias("residue_name"))


RESIDUE = ["molecule_type", "molecule_instance", "residue_id", "residue_name"]


def residue_index(regions: DataFrame, vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """region_index, region, vertex_id, the residue and residue_index: its rank from 1 in the region (of a network, with ``by``)."""
    rows = regions.join(vertices.select("vertex_id", *RESIDUE), "vertex_id").withColumns({c: F.coalesce(c, F.lit("")) for c in ("molecule_type", "residue_name")})
    w = Window.partitionBy(*(by or []), "region_index").orderBy("molecule_type", F.asc_nulls_last("molecule_instance"), F.asc_nulls_last("residue_id"), "residue_name")
    return rows.withColumn("residue_index", F.dense_rank().over(w))


def region_interactions(values: DataFrame, edges: DataFrame, vertices: DataFrame, members: DataFrame, regions: DataFrame, value: str = "vdw+cl", normalization: str = "none", by: list[str] | None = None) -> DataFrame:
    """Sum of the values between different regions for every residue of the source region and frame, in both directions.

    frame, source_region, target_region, their selectors, the residue, residue_index, value, n_edges (rows summed). Rows
    that are not finite count nowhere; per_atom_pair leaves out rows without atom pairs.
    """
    by, n = by or [], normalization_name(normalization)
    rows = with_endpoints(values.join(edges, "edge_key"), vertices, members).withColumn("v", value_expr(value))
    if n == "per_atom_pair":
        rows = rows.where("n_atom_pairs > 0").withColumn("v", F.col("v") / F.col("n_atom_pairs").cast("double"))
    elif n != "none":
        by_members = member_denominator(n, F.col("n_members1"), F.col("n_members2"), F.col("kind1"), F.col("kind2"))
        rows = rows.withColumn("v", divided(F.col("v"), by_members, F.col("v")))
    place = residue_index(regions, vertices)
    for i in ("1", "2"):
        rows = rows.join(place.select(F.col("vertex_id").alias(f"vertex{i}"), F.struct("region_index", "region", "selector", *RESIDUE, "residue_index").alias(f"r{i}")), f"vertex{i}")
    rows = rows.where(finite(F.col("v")) & (F.col("r1.region_index") != F.col("r2.region_index")))
    directed = rows.select(*by, "frame", "v", F.explode(F.array(F.struct(F.col("r1").alias("s"), F.col("r2").alias("t")), F.struct(F.col("r2").alias("s"), F.col("r1").alias("t")))).alias("d"))
    keys = [F.col("d.s.region").alias("source_region"), F.col("d.t.region").alias("target_region"), F.col("d.s.selector").alias("source_selector"), F.col("d.t.selector").alias("target_selector")]
    residue = [F.col(f"d.s.{c}").alias(c) for c in (*RESIDUE, "residue_index")]
    return directed.groupBy(*by, "frame", *keys, *residue).agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("n_edges"))


def with_color_position(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds vmax (greatest strength of all cells, 1 if there is none) and position, the signed-root place on a colour scale."""
    by = by or []
    top = cells.groupBy(*by).agg(F.max(F.abs("value")).alias("vmax"))
    rows = cells.join(top, by) if by else cells.withColumn("vmax", F.lit(top.first().vmax).cast("double"))
    rows = rows.withColumn("vmax", F.when(F.coalesce("vmax", F.lit(0.0)) > 0, F.col("vmax")).otherwise(1.0))
    return rows.withColumn("position", signed_root(F.col("value"), F.col("vmax")))


def pair_layout(regions: DataFrame, vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each pair of regions whether their sequences of residue names agree (overlay) or not (adjacent)."""
    by = by or []
    names = residue_index(regions, vertices, by).groupBy(*by, "region_index", "region").agg(F.sort_array(F.collect_set(F.struct("residue_index", "residue_name"))).alias("s"))
    a = names.select(*by, F.col("region_index").alias("i"), F.col("region").alias("region1"), F.col("s.residue_name").alias("n1"))
    b = names.select(*by, F.col("region_index").alias("j"), F.col("region").alias("region2"), F.col("s.residue_name").alias("n2"))
    both = a.join(b, by).where("i < j") if by else a.join(b, F.col("i") < F.col("j"))
    return both.select(*by, "region1", "region2", F.when(F.col("n1") == F.col("n2"), "overlay").otherwise("adjacent").alias("layout"))
