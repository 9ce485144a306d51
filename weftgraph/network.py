"""Working with one network: lazy tables, selections, edge values, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.selectors import vertex_condition
from weftgraph.operators import edges as E
from weftgraph.operators import info, neighbors, paths, regions
from weftgraph.operators.percentile import numbered
from weftgraph.sources import network as source
from weftgraph.sources import tsv


class Network:
    """A network folder. Tables are DataFrames and read nothing until they are used."""

    def __init__(self, spark: SparkSession, path: str):
        source.check_network(spark, path)
        self.spark, self.path = spark, path

    @cached_property
    def metadata(self) -> dict:
        return source.read_metadata(self.spark, self.path)

    @cached_property
    def vertices(self) -> DataFrame:
        return source.read_vertices(self.spark, self.path)

    @cached_property
    def members(self) -> DataFrame:
        return source.read_members(self.spark, self.path)

    @cached_property
    def edges(self) -> DataFrame:
        return source.read_edges(self.spark, self.path)

    @cached_property
    def values(self) -> DataFrame:
        return source.read_values(self.spark, self.path)

    def frames(self) -> list[int]:
        return [r.frame for r in E.frames_of(self.values).collect()]

    def summary(self) -> dict:
        row = E.values_summary(self.values).first().asDict()
        return {"n_vertices": self.vertices.count(), "n_edges_in_dictionary": self.edges.count(), **row}

    def select_vertices(self, selector: str, as_mask: bool = False) -> DataFrame:
        """Selected vertex ids in order, or all of them with a column ``mask``."""
        condition = vertex_condition(selector, self.vertices.columns)
        if as_mask:
            return self.vertices.select("vertex_id", condition.alias("mask")).orderBy("vertex_id")
        return self.vertices.where(condition).select("vertex_id").orderBy("vertex_id")

    def regions(self, selectors: Sequence[str], labels: Sequence[str] | None = None, require_disjoint: bool = True) -> DataFrame:
        return regions.resolve_regions(self.vertices, selectors, labels, "region_", require_disjoint, least=1)

    def residue_keys(self, vertex_ids: Sequence[int]) -> DataFrame:
        return regions.residue_keys(self.vertices, self.spark.createDataFrame([(int(v),) for v in vertex_ids], "vertex_id long"))

    def edge_values(self, value: str = "vdw+cl", normalization: str = "none", frames: Sequence[int] | None = None, columns: Sequence[str] = ()) -> DataFrame:
        values = self.values if frames is None else source.read_values(self.spark, self.path, list(frames), self.metadata.get("frames_per_part"))
        E.require_known_edges(values, self.edges)
        return E.edge_values(values, self.edges, self.vertices, self.members, value, normalization, None, list(columns))

    def edge_summary(self, value: str = "vdw+cl", normalization: str = "none") -> DataFrame:
        return E.edge_summary(self.edge_values(value, normalization))

    def edge_analysis(self, value: str = "vdw+cl", normalization: str = "none", excluded: E.Ends | None = None, min_abs_value: object = "none", percentile: float = 0.05, max_edges: int | None = None) -> DataFrame:
        a = E.edge_analysis(self.values, self.edges, self.vertices, self.members, value, normalization)
        a = E.exclude_endpoints(a, excluded or E.Ends())
        return E.strongest_edges(E.above_threshold(a, min_abs_value, percentile), max_edges)

    def neighbor_profile(self, analysis: DataFrame, **options) -> DataFrame:
        m = neighbors.neighbor_metrics(analysis, self.vertices, **options)
        return neighbors.residue_profile(m, self.vertices, "neighbor_value", "neighbor_edges").orderBy(*neighbors.residue_order("category"))

    def path_metrics(self, analysis: DataFrame, value: str = "vdw+cl", target: str | None = None) -> DataFrame:
        g = paths.distance_graph(analysis, value)
        return paths.target_path_metrics(g, self.vertices, target) if target else paths.vertex_path_metrics(g)

    def region_interactions(self, selectors: Sequence[str], labels: Sequence[str] | None = None, value: str = "vdw+cl", normalization: str = "none") -> DataFrame:
        r = regions.resolve_regions(self.vertices, selectors, labels)
        return regions.region_interactions(self.values, self.edges, self.vertices, self.members, r, value, normalization)

    def kind_counts(self) -> DataFrame:
        return info.kind_counts(self.vertices)


class Table:
    """A small table with metadata: thin access around a DataFrame."""

    def __init__(self, df: DataFrame, metadata: dict | None = None):
        self.df, self.metadata = df, dict(metadata or {})

    @classmethod
    def from_tsv(cls, spark: SparkSession, path: str) -> Table:
        return cls(tsv.read_tsv(spark, path), {"path": path})

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def n_rows(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self.n_rows

    def column(self, name: str) -> DataFrame:
        if name not in self:
            raise KeyError(name)
        return self.df.select(name)

    def get(self, name: str, default: object = None) -> object:
        return self.column(name) if name in self else default

    def take(self, places: Sequence[int], order: Sequence[str]) -> Table:
        """The rows at these places, from 0, in the order of the columns ``order``: rows of a DataFrame have no order of their own."""
        at = numbered(self.df, [F.asc_nulls_first(c) for c in order], "_row")
        return Table(at.where(F.col("_row").isin(*[int(p) for p in places])).drop("_row"), self.metadata)

    def __contains__(self, name: str) -> bool:
        return name in self.df.columns

    def __getitem__(self, name: str) -> DataFrame:
        return self.column(name)

    def __repr__(self) -> str:
        return f"Table({', '.join(self.columns)})"

    def select(self, names: Sequence[str]) -> Table:
        return Table(self.df.select(*names), self.metadata)

    def where(self, condition: Column | str) -> Table:
        return Table(self.df.where(condition), self.metadata)

    def head(self, n: int = 5) -> Table:
        return Table(self.df.limit(max(0, n)), self.metadata)

    def unique(self, column: str) -> list:
        return [r[0] for r in self.df.select(column).distinct().orderBy(column).collect()]

    def to_arrow(self):  # noqa: ANN201
        return self.df.toArrow()

    def to_dicts(self, limit: int | None = None) -> list[dict]:
        return [r.asDict() for r in (self.df if limit is None else self.df.limit(limit)).collect()]

    def write_tsv(self, path: str) -> None:
        tsv.write_tsv(self.df, path)


def load_network(spark: SparkSession, path: str) -> Network:
    return Network(spark, path)
