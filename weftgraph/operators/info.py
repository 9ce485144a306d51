"""What a network contains: counts, listings and observed selector values."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.neighbors import contiguous_ranges

# Order of the kinds in listings.
KIND_ORDER = ("atom", "low_res", "bundle", "residue")
PER_KIND, IN_ALL, INVENTORY = 40, 200, 25
FIELDS = ("kind", "residue_name", "molecule_type", "molecule_instance", "atom_name", "atom_type", "label")


def kind_counts(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def field_counts(vertices: DataFrame, field: str) -> DataFrame:
    """Values of a field with how often they occur; nulls and blanks left out."""
    v = F.col(field).cast("string")
    return vertices.where(v.isNotNull() & (F.trim(v) != "")).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def vertex_listing(vertices: DataFrame, per_kind: int | None = PER_KIND, in_all: int | None = IN_ALL) -> DataFrame:
    """Vertices in order of kind, molecule, residue and atom, cut short for display; None shows all."""
    rank = F.lit(len(KIND_ORDER))
    for i, k in enumerate(KIND_ORDER):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    order = [F.asc_nulls_first(c) for c in ("molecule_instance", "residue_id", "atom_nr")] + [F.asc("vertex_id")]
    rows = vertices.withColumn("kind_rank", rank)
    if per_kind is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_n") <= per_kind).drop("_n")
    rows = rows.orderBy("kind_rank", *order)
    return rows.limit(in_all) if in_all is not None else rows


def selector_inventory(vertices: DataFrame, most: int | None = INVENTORY) -> dict[str, list]:
    """Observed values of every selector field and the ranges of residue ids, for help texts."""
    cut = lambda df: (df if most is None else df.limit(most)).collect()
    out: dict[str, list] = {f: [(r.value, r.n) for r in cut(field_counts(vertices, f))] for f in FIELDS}
    out["residue_id"] = [(r["first"], r["last"]) for r in cut(contiguous_ranges(vertices, "residue_id").orderBy("first"))]
    low, high = vertices.agg(F.min("vertex_id"), F.max("vertex_id")).first()
    out["vertex_id"] = [(low, high)]
    return out


def quoted(value: str) -> str:
    """A value as it must be written in a selector."""
    return value if value and not set(value) & set(" \t()'\"\\") else shlex.quote(value)


def selector_examples(vertices: DataFrame) -> list[str]:
    """Selectors that match something in this network, for each field what is there: single values and lists, a residue by name and id, a
    run of residues and two residue names within the molecule that has most, all but bundles, and a range of vertices."""

    def values(field: str, n: int) -> list[str]:
        counts = field_counts(vertices, field)
        order = [F.col("value").cast("long")] if field == "molecule_instance" else [F.desc("n"), F.asc("value")]
        return [quoted(r.value) for r in counts.orderBy(*order).limit(n).collect()]

    out = []
    for field, name, listed in (("molecule_instance", "molecule_instance", 3), ("molecule_type", "molecule_type", 2), ("residue_name", "resname", 3), ("kind", "kind", 2)):
        found = values(field, listed)
        out += [f"{name} {v}" for v in found[:1]]
        if len(found) == listed:
            out.append(f"{name} in {','.join(found)}")
    named = vertices.where("residue_id IS NOT NULL AND trim(residue_name) <> ''")
    if first := named.orderBy("vertex_id").first():
        out.append(f"resname {quoted(first.residue_name)} and resid {first.residue_id}")
    inside = vertices.where("molecule_instance IS NOT NULL AND residue_id IS NOT NULL").select("molecule_instance", "residue_id").distinct()
    most = inside.groupBy("molecule_instance").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "molecule_instance").first()
    if most:
        runs = contiguous_ranges(inside.where(F.col("molecule_instance") == most.molecule_instance), "residue_id").where("n > 1")
        if run := runs.orderBy(F.desc("n"), "first").first():
            out.append(f"molecule_instance {most.molecule_instance} and resid {run['first']}-{min(run['last'], run['first'] + 19)}")
    names = vertices.where("molecule_instance IS NOT NULL AND trim(residue_name) <> ''").groupBy("molecule_instance", "residue_name").agg(F.count(F.lit(1)).alias("n"))
    mixed = names.groupBy("molecule_instance").agg(F.count(F.lit(1)).alias("k")).where("k > 1").orderBy(F.desc("k"), "molecule_instance").first()
    if mixed:
        a, b = (quoted(r.residue_name) for r in names.where(F.col("molecule_instance") == mixed.molecule_instance).orderBy(F.desc("n"), "residue_name").limit(2).collect())
        out.append(f"(resname {a} or resname {b}) and molecule_instance {mixed.molecule_instance}")
    if not vertices.where("kind = 'bundle'").isEmpty():
        out.append("not kind bundle")
    ids = [r.vertex_id for r in vertices.select("vertex_id").distinct().orderBy("vertex_id").limit(10).collect()]
    if len(ids) > 1:
        out.append(f"vertex_id {ids[0]}-{ids[-1]}")
    return list(dict.fromkeys(out))
