"""Queries p3, p4, p7, p8 and p9: each applies its operator to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import quantiles as Q
from weftgraph.llm.leaks import leaked_items
from weftgraph.llm.packing import CAPACITY, pack_documents
from weftgraph.llm.sentences import sentences
from weftgraph.llm.topn import top_rows_of_vertices
from weftgraph.operators.latest import current_rows
from weftgraph.session import broadcast_if_bounded, table, written

SHARES = [0.05, 0.5, 0.95, 0.99]


def _current(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return current_rows(table(spark, sf_dir, "frame_values"), table(spark, sf_dir, "edges"), columns)


def _energies_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """build_id, grp (kind of vertex1), field, value of current rows."""
    kinds = table(spark, sf_dir, "vertices").select(F.col("vertex_id").alias("vertex1"), F.col("kind").alias("grp")).dropDuplicates(["vertex1"])
    rows = _current(spark, sf_dir, ["vdw", "coulomb"]).join(kinds, "vertex1")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in ("vdw", "coulomb")))
    return rows.select("build_id", "grp", F.inline(fields))


def _neighbour_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """build_id, grp, field, value: the median_neighbor_value of each residue once."""
    rows = table(spark, sf_dir, "residue_neighbors").where("median_neighbor_value IS NOT NULL AND NOT isnan(median_neighbor_value)")
    once = rows.groupBy("build_id", "molecule_type", "molecule_instance", "residue_id", "category").agg(F.max_by("median_neighbor_value", "nb_id").alias("value"))
    return once.select("build_id", F.lit("neighbors").alias("grp"), F.lit("median_neighbor_value").alias("field"), "value")


KEYS = ["build_id", "grp", "field"]
#: Groups whose percentiles may be broadcast to be checked.
MAX_GROUPS = 1_000_000


def p3_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of vdw and coulomb per build and kind, and of median_neighbor_value per build, with their error bounds."""
    values = Q.sketch_groups(_energies_by_kind(spark, sf_dir), KEYS, "value").unionByName(Q.sketch_groups(_neighbour_values(spark, sf_dir), KEYS, "value"))
    return Q.sketch_quantiles(Q.merge_sketches(values, KEYS), KEYS, SHARES)


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every group the number of its values and whether the exact rank of each percentile lies within the stated bound."""
    values = _energies_by_kind(spark, sf_dir).unionByName(_neighbour_values(spark, sf_dir)).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    values = written(values, "values")
    q = written(Q.sketch_quantiles(Q.merge_sketches(Q.sketch_groups(values, KEYS, "value"), KEYS), KEYS, SHARES).withColumnRenamed("n", "sketched"), "quantiles")
    names = [c for c in q.columns if f"{c}_error" in q.columns]
    counts = [f(F.col("value"), F.col(c)).alias(f"{c}_{k}") for c in names for k, f in (("below", lambda a, b: F.count_if(a < b)), ("upto", lambda a, b: F.count_if(a <= b)))]
    same = values.alias("v").join(broadcast_if_bounded(q, MAX_GROUPS).alias("q"), F.expr(" AND ".join(f"v.{k} <=> q.{k}" for k in KEYS))).select("q.*", "v.value")
    ranks = same.groupBy(*q.columns).agg(F.count(F.lit(1)).alias("n"), *counts)
    within = F.col("n") == F.col("sketched")
    for c, share in zip(names, SHARES, strict=True):
        at, off = share * (F.col("n") - 1), F.col(f"{c}_error") * F.col("n") + 1
        within = within & (F.col(f"{c}_below") - off <= at) & (at <= F.col(f"{c}_upto") + off)
    return ranks.select(*KEYS, "n", within.alias("within"))


def p3_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the coulomb of current rows per build, out of stored sketches of each day on which rows were written."""
    rows = _current(spark, sf_dir, ["coulomb", "written_at"]).select("build_id", F.to_date("written_at").alias("day"), "coulomb")
    days = written(Q.merge_sketches(Q.sketch_groups(rows, ["build_id", "day"], "coulomb"), ["build_id", "day"]), "days")
    return Q.sketch_quantiles(Q.merge_sketches(days.withColumn("chunk", F.datediff("day", F.lit("1970-01-01"))), ["build_id"]), ["build_id"], SHARES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda df: df.withColumn("value", F.abs("value"))
    parts = Q.sketch_groups(size(_energies_by_kind(spark, sf_dir)), KEYS, "value").unionByName(Q.sketch_groups(size(_neighbour_values(spark, sf_dir)), KEYS, "value"))
    q = Q.sketch_quantiles(Q.merge_sketches(parts, KEYS), KEYS, [0.5, 0.95])
    return q.where("(field = 'median_neighbor_value' OR n >= 150) AND p95 >= 12 * p50").select(*KEYS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows_of_vertices(_current(spark, sf_dir, ["coulomb"]), 3).select("build_id", "vertex_id", "frame", "edge_key")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its number of pieces and its fill."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("bytes")).withColumn("fill", F.col("bytes") / CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing holds in several pieces."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went into the containers: documents, pieces and bytes, split documents, and whether no container holds too much."""
    packed = written(pack_documents(table(spark, sf_dir, "documents")), "packed")
    by_doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("bytes"))
    docs = by_doc.agg(F.count(F.lit(1)).alias("documents"), F.sum("pieces").alias("pieces"), F.sum("bytes").alias("bytes"), F.count_if(F.col("pieces") > 1).alias("split"))
    most = packed.groupBy("container").agg(F.sum("size").alias("fill")).agg(F.max("fill")).first()[0] or 0
    return docs.withColumn("fits", F.lit(most <= CAPACITY))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected message with the items it holds, the share of each item's words and of its shingle weight."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_quantiles": p3_quantiles, "p3_by_day": p3_by_day, "p3_bounds": p3_bounds, "p4_found": p4_found, "p7_found": p7_found, "p7_containers": p7_containers, "p7_totals": p7_totals, "p8_found": p8_found, "p8_shares": p8_shares, "p9_found": p9_found}


_CURRENT = """c AS (SELECT f.*, e.vertex1, e.vertex2, row_number() OVER (PARTITION BY f.build_id, f.frame, f.edge_key ORDER BY f.written_at DESC NULLS LAST, f.row_id DESC) AS rn
  FROM frame_values f JOIN edges e ON f.edge_key = e.edge_key), w AS (SELECT * FROM c WHERE rn = 1)"""

SQL = {
    "p3_found": f"""WITH {_CURRENT}, v AS (SELECT build_id, kind AS grp, unnest(['vdw', 'coulomb']) AS field, CAST(unnest([vdw, coulomb]) AS DOUBLE) AS x FROM w JOIN vertices ON vertex_id = vertex1),
n AS (SELECT build_id, arg_max(median_neighbor_value, nb_id) AS x FROM residue_neighbors WHERE median_neighbor_value IS NOT NULL AND NOT isnan(median_neighbor_value) GROUP BY build_id, molecule_type, molecule_instance, residue_id, category)
SELECT build_id, grp, field FROM v WHERE isfinite(x) GROUP BY build_id, grp, field HAVING count(*) >= 150 AND quantile_cont(abs(x), 0.95) >= 12 * median(abs(x))
UNION ALL SELECT build_id, 'neighbors', 'median_neighbor_value' FROM n GROUP BY build_id HAVING quantile_cont(abs(x), 0.95) >= 12 * median(abs(x))""",
    "p4_found": f"""WITH {_CURRENT}, e AS (SELECT build_id, unnest([vertex1, vertex2]) AS vertex_id, frame, edge_key, coulomb FROM w WHERE isfinite(coulomb)),
r AS (SELECT *, row_number() OVER (PARTITION BY build_id, vertex_id ORDER BY coulomb DESC, edge_key, frame) AS place FROM e) SELECT build_id, vertex_id, frame, edge_key FROM r WHERE place <= 3""",
    "p3_bounds": f"""WITH {_CURRENT}, v AS (SELECT build_id, kind AS grp, unnest(['vdw', 'coulomb']) AS field, CAST(unnest([vdw, coulomb]) AS DOUBLE) AS x FROM w JOIN vertices ON vertex_id = vertex1),
n AS (SELECT build_id, arg_max(median_neighbor_value, nb_id) AS x FROM residue_neighbors WHERE median_neighbor_value IS NOT NULL AND NOT isnan(median_neighbor_value) GROUP BY build_id, molecule_type, molecule_instance, residue_id, category)
SELECT build_id, grp, field, count(*) AS n, TRUE AS within FROM v WHERE isfinite(x) GROUP BY build_id, grp, field UNION ALL SELECT build_id, 'neighbors', 'median_neighbor_value', count(*), TRUE FROM n WHERE isfinite(x) GROUP BY build_id""",
    "p7_totals": """WITH d AS (SELECT doc_id, sum(greatest(1, ceil(coalesce(strlen(text), 0) / 8192.0))) AS pieces, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY doc_id)
SELECT count(*) AS documents, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE pieces > 1) AS split, TRUE AS fits FROM d""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
}
