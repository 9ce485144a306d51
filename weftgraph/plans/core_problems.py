"""Queries p1, p2, p5 and p6: each applies its operator to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import consolidate as C
from weftgraph.operators import spikes, tree_aggregate
from weftgraph.operators.latest import current_rows
from weftgraph.operators.unit_consensus import medians_in_nm
from weftgraph.session import table

ENERGY = spikes.Rule(zero_is_normal=True)
FRACTION = spikes.Rule(low=0.0, high=1.0)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "frame_values").select("row_id", "build_id", "frame", "edge_key", "vdw", "vdw_dif")
    known = table(spark, sf_dir, "edges").select("edge_key").distinct()
    rows = values.join(known, "edge_key", "left_semi")
    energies = spikes.implausible_readings(rows, ["build_id", "edge_key"], "frame", "row_id", {"vdw": ENERGY, "vdw_dif": ENERGY})
    fractions = spikes.implausible_readings(table(spark, sf_dir, "scale_inference"), ["source_id"], "built_at", "build_id", {"too_close_fraction_nm": FRACTION})
    return energies.select("field", "key_id").unionByName(fractions.select("field", "key_id").distinct())


def p2_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every build with its median in nm and the unit that it was recorded in."""
    return medians_in_nm(table(spark, sf_dir, "scale_inference"), table(spark, sf_dir, "scale_candidates"), table(spark, sf_dir, "source_notes"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the medians of a source alone tell of the unit of each build, null where they tell nothing."""
    told = medians_in_nm(table(spark, sf_dir, "scale_inference"), table(spark, sf_dir, "scale_candidates"), table(spark, sf_dir, "source_notes"), use_texts=False)
    return told.select("build_id", "unit")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_medians(spark, sf_dir).where("unit <> 'nm'").select("build_id", "unit")


def _rows_about(df: DataFrame) -> int:
    """About how many rows a table of files has, by the size of the files: reading it to count them would cost as much as the sums."""
    return max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 16)


def _p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "frame_values")
    current = current_rows(values, table(spark, sf_dir, "edges"), ["n_atom_pairs"])
    return tree_aggregate.heavy_keys(current, table(spark, sf_dir, "vertices"), _rows_about(values))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5_totals(spark, sf_dir).select("build_id", "key_field", "key_value")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every (build, vertex1)."""
    values = table(spark, sf_dir, "frame_values")
    current = current_rows(values, table(spark, sf_dir, "edges"), ["n_atom_pairs"])
    return tree_aggregate.tree_sum(current, ["build_id", "vertex1"], "n_atom_pairs", _rows_about(values)).withColumnRenamed("total", "n_atom_pairs_sum")


def _p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = C.consolidate(table(spark, sf_dir, "part_files"))
    return C.distinct_records(C.read_records(spark, packs))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_records(spark, sf_dir).select("build_id", "frame", "edge_key")


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated files: bodies and bytes of each class, told by its header, and whether every length claimed was right."""
    packs = C.consolidate(table(spark, sf_dir, "part_files"))
    m = spark.read.parquet(packs.manifest).select("header", F.inline("parts"))
    return m.groupBy("header").agg(F.count(F.lit(1)).alias("bodies"), F.sum("length").alias("bytes"), F.bool_and("size_ok").alias("sizes_ok"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_medians": p2_medians, "p2_consensus": p2_consensus, "p5_found": p5_found, "p5_totals": p5_totals, "p6_found": p6_found, "p6_packs": p6_packs}


_CURRENT = """c AS (SELECT f.*, e.vertex1, e.vertex2, row_number() OVER (PARTITION BY f.build_id, f.frame, f.edge_key ORDER BY f.written_at DESC NULLS LAST, f.row_id DESC) AS rn
  FROM frame_values f JOIN edges e ON f.edge_key = e.edge_key), w AS (SELECT c.*, v.kind FROM c LEFT JOIN vertices v ON c.vertex1 = v.vertex_id WHERE rn = 1)"""

SQL = {
    "p1_found": """WITH k AS (SELECT row_id AS id, CAST(build_id AS VARCHAR) || ':' || CAST(edge_key AS VARCHAR) AS a, CAST(frame AS BIGINT) AS o, unnest(['vdw', 'vdw_dif']) AS field, CAST(unnest([vdw, vdw_dif]) AS DOUBLE) AS x, TRUE AS z
  FROM frame_values WHERE edge_key IN (SELECT edge_key FROM edges)
  UNION ALL SELECT build_id, source_id, epoch_us(built_at), 'too_close_fraction_nm', too_close_fraction_nm, FALSE FROM scale_inference),
r AS (SELECT DISTINCT a, field, o, x, z FROM k WHERE x IS NOT NULL),
u AS (SELECT * FROM r WHERE isfinite(x) AND ((z AND x <> 0) OR (NOT z AND x BETWEEN 0 AND 1))),
m AS (SELECT a, field, median(x) AS med FROM u GROUP BY a, field),
s AS (SELECT u.a, u.field, median(abs(x - med)) AS mad FROM u JOIN m ON u.a = m.a AND u.field = m.field GROUP BY u.a, u.field),
l AS (SELECT *, CASE WHEN lag(x) OVER w IS NOT DISTINCT FROM x THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY a, field ORDER BY o, x)),
i AS (SELECT *, sum(new) OVER (PARTITION BY a, field ORDER BY o, x) AS island FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY a, field, island) AS run FROM i)
SELECT DISTINCT k.field, k.id AS key_id FROM k JOIN n ON k.a = n.a AND k.field = n.field AND k.o = n.o AND k.x = n.x LEFT JOIN m ON k.a = m.a AND k.field = m.field LEFT JOIN s ON k.a = s.a AND k.field = s.field
WHERE NOT (k.z AND k.x = 0) AND (NOT isfinite(k.x) OR (NOT k.z AND (k.x < 0 OR k.x > 1)) OR abs(k.x - med) > 12 * 1.4826 * mad OR run >= 5)""",
    "p2_consensus": """WITH i AS (SELECT build_id, max(source_id) AS source_id, max(CASE WHEN median_distance_input > 0 AND isfinite(median_distance_input) THEN median_distance_input END) AS m1 FROM scale_inference WHERE build_id IS NOT NULL GROUP BY build_id),
g AS (SELECT build_id, max(CASE WHEN median_input > 0 AND isfinite(median_input) THEN median_input END) AS m2 FROM scale_candidates WHERE build_id IS NOT NULL GROUP BY build_id),
b AS (SELECT coalesce(i.build_id, g.build_id) AS build_id, coalesce(source_id, '?') AS source_id, coalesce(m2, m1) AS m FROM i FULL JOIN g ON i.build_id = g.build_id),
o AS (SELECT b.*, u.unit, ln(m * u.nm) AS l, CAST(round(ln(m * u.nm) / 0.05) AS INT) AS bin FROM b CROSS JOIN (SELECT 'nm' AS unit, 1.0 AS nm UNION ALL SELECT 'angstrom', 0.1 UNION ALL SELECT 'pm', 0.001 UNION ALL SELECT 'bohr', 0.0529177) u WHERE m IS NOT NULL),
n AS (SELECT source_id, bin, count(*) AS w, sum(l) AS s FROM o GROUP BY source_id, bin),
p AS (SELECT source_id, bin, sum(w) AS w, sum(s) AS s FROM (SELECT source_id, w, s, unnest(range(bin - 2, bin + 3)) AS bin FROM n) GROUP BY source_id, bin),
t AS (SELECT source_id, bin, w, s FROM p QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY w DESC, abs(bin), bin DESC) = 1),
z AS (SELECT t.source_id, t.s / t.w AS centre, coalesce(max(p.w), 0) < 0.999 * any_value(t.w) AS clear FROM t LEFT JOIN p ON p.source_id = t.source_id AND abs(p.bin - t.bin) > 4 GROUP BY t.source_id, t.s, t.w),
c AS (SELECT o.build_id, arg_min(o.unit, abs(l - centre)) AS unit FROM o JOIN z ON o.source_id = z.source_id WHERE clear GROUP BY o.build_id) SELECT b.build_id, c.unit FROM b LEFT JOIN c ON b.build_id = c.build_id""",
    "p5_found": f"""WITH {_CURRENT}, t AS (SELECT build_id, sum(coalesce(n_atom_pairs, 0)) AS bt FROM w GROUP BY build_id),
k AS (SELECT build_id, 'vertex1' AS key_field, CAST(vertex1 AS VARCHAR) AS key_value, sum(coalesce(n_atom_pairs, 0)) AS s FROM w GROUP BY build_id, vertex1
  UNION ALL SELECT build_id, 'kind', kind, sum(coalesce(n_atom_pairs, 0)) FROM w WHERE kind IS NOT NULL GROUP BY build_id, kind)
SELECT k.build_id, key_field, key_value FROM k JOIN t ON k.build_id = t.build_id WHERE s >= bt / 20.0""",
    "p5_totals": f"WITH {_CURRENT} SELECT build_id, vertex1, CAST(sum(coalesce(n_atom_pairs, 0)) AS BIGINT) AS n_atom_pairs_sum, count(*) AS n_rows FROM w GROUP BY build_id, vertex1",
    "p6_packs": r"""WITH f AS (SELECT build_id, payload, n_bytes = strlen(payload) AS ok, regexp_extract(payload, '^\s*([^\r\n]*)', 1) AS first, regexp_extract(payload, '^(\s*[\r\n])*([ \t]*[^\r\n]*[\r\n]*)', 2) AS lead FROM part_files WHERE trim(payload, e' \t\r\n') <> ''),
h AS (SELECT *, CASE WHEN first LIKE '{%' THEN '{}' WHEN regexp_matches(first, '^[-+0-9]') THEN '' ELSE trim(first) END AS header FROM f),
b AS (SELECT build_id, header, ok, CASE WHEN header IN ('', '{}') THEN substr(payload, strpos(payload, first)) ELSE substr(payload, strpos(payload, lead) + length(lead)) END AS body FROM h),
d AS (SELECT build_id, header, body, bool_and(ok) AS ok FROM b WHERE trim(body, e' \t\r\n') <> '' GROUP BY build_id, header, body) SELECT header, count(*) AS bodies, CAST(sum(strlen(body)) AS BIGINT) AS bytes, bool_and(ok) AS sizes_ok FROM d GROUP BY header""",
    "p6_found": r"""WITH f AS (SELECT build_id, payload, payload LIKE 'edge_key,%' AS csv FROM part_files), l AS (SELECT build_id, csv, unnest(regexp_split_to_array(payload, '\r\n|\n|\r')) AS line FROM f),
p AS (SELECT build_id, CASE WHEN line LIKE '{%' THEN ['j', CAST(json_extract(j, '$.frame') AS VARCHAR), CAST(json_extract(j, '$.edge_key') AS VARCHAR), CAST(json_extract(j, '$.n_atom_pairs') AS VARCHAR)]
  WHEN csv THEN ['c', split_part(line, ',', 2), split_part(line, ',', 1), split_part(line, ',', 5)] ELSE ['t', split_part(line, chr(9), 1), split_part(line, chr(9), 2), split_part(line, chr(9), 5)] END AS x
  FROM (SELECT *, TRY_CAST(line AS JSON) AS j FROM l))
SELECT DISTINCT build_id, CAST(TRY_CAST(x[2] AS DOUBLE) AS INT) AS frame, CAST(TRY_CAST(x[3] AS DOUBLE) AS BIGINT) AS edge_key FROM p WHERE TRY_CAST(x[2] AS DOUBLE) IS NOT NULL AND TRY_CAST(x[3] AS DOUBLE) IS NOT NULL AND TRY_CAST(x[4] AS DOUBLE) IS NOT NULL""",
}
