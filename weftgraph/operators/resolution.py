"""Vertices of a network out of its atoms: single atoms, merged selections, bundles and residues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import SelectorError
from weftgraph.functions.selectors import atom_condition, selector_label
from weftgraph.operators.percentile import numbered


def check_atoms(atoms: DataFrame) -> None:
    """Atom numbers must run from 1 on without gaps."""
    n, low, high, distinct = atoms.agg(F.count(F.lit(1)), F.min("atom_nr"), F.max("atom_nr"), F.countDistinct("atom_nr")).first()
    if n and (low, high, distinct) != (1, n, n):
        raise SelectorError("atom numbers must run from 1 on without gaps")


def assign_vertices(atoms: DataFrame, high_res: Sequence[str] = (), low_res: Sequence[str] = (), bundles: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Atoms with kind, label and the key of their vertex.

    An atom is, in this order, a vertex of its own (high_res), part of the first matching low_res selection, part of the
    first matching bundle, or part of its residue.
    """
    nobody = F.lit(None)
    low = F.coalesce(*(F.when(atom_condition(s), F.lit(i)) for i, s in enumerate(low_res)), nobody.cast("int"))
    bundle = F.coalesce(*(F.when(_any(b), F.lit(i)) for i, b in enumerate(bundles)), nobody.cast("int"))
    high = _any(high_res)
    kind = F.when(high, "atom").when(low.isNotNull(), "low_res").when(bundle.isNotNull(), "bundle").otherwise("residue")
    names_low = F.array(*(F.lit(selector_label(s)) for s in low_res)) if low_res else F.array(F.lit(""))
    names_bundle = F.array(*(F.lit("+".join(selector_label(s) for s in b)) for b in bundles)) if bundles else F.array(F.lit(""))
    residue = F.concat_ws(":", "residue_name", F.col("residue_id").cast("string"))
    rows = atoms.withColumns({"kind": kind, "_low": low, "_bundle": bundle})
    label = F.when(F.col("kind") == "atom", F.concat_ws(":", "residue_name", F.col("residue_id").cast("string"), "atom_name", F.col("atom_nr").cast("string")))
    label = label.when(F.col("kind") == "low_res", F.get(names_low, F.col("_low"))).when(F.col("kind") == "bundle", F.get(names_bundle, F.col("_bundle"))).otherwise(residue)
    key = F.when(F.col("kind") == "atom", F.concat(F.lit("a"), F.col("atom_index").cast("string"))).when(F.col("kind") == "low_res", F.concat(F.lit("l"), F.col("_low").cast("string"))).when(F.col("kind") == "bundle", F.concat(F.lit("b"), F.col("_bundle").cast("string")))
    key = key.otherwise(F.concat_ws(":", F.lit("r"), "molecule_type", F.col("molecule_instance").cast("string"), F.col("residue_id").cast("string"), "residue_name"))
    return rows.withColumns({"label": label, "vertex_key": key}).drop("_low", "_bundle")


def _any(selectors: Sequence[str]):
    c = F.lit(False)
    for s in selectors:
        c = c | atom_condition(s)
    return c


def vertex_table(assigned: DataFrame) -> DataFrame:
    """One row per vertex, numbered by its first atom from 0 on, with the attributes of that atom (atom fields of atoms only)."""
    taken = ["label", "kind", "residue_name", "residue_id", "molecule_type", "molecule_instance", "atom_nr", "atom_name", "atom_type", "charge"]
    first = assigned.groupBy("vertex_key").agg(F.min("atom_index").alias("first_atom"), F.min_by(F.struct(*taken), "atom_index").alias("a"))
    rows = numbered(first, [F.asc("first_atom")], "vertex_id")
    only_atom = {c: F.when(F.col("a.kind") == "atom", F.col(f"a.{c}")) for c in ("atom_nr", "atom_name", "atom_type", "charge")}
    return rows.select("vertex_id", *(only_atom.get(c, F.col(f"a.{c}")).alias(c) for c in taken), F.lit(None).cast("int").alias("members"), "vertex_key")


def vertex_members(assigned: DataFrame, vertices: DataFrame) -> DataFrame:
    return assigned.join(vertices.select("vertex_key", "vertex_id"), "vertex_key").select(F.col("vertex_id").cast("int").alias("vertex_id"), "atom_index", "atom_nr")


def selection_report(atoms: DataFrame, high_res: Sequence[str] = (), low_res: Sequence[str] = (), bundles: Sequence[Sequence[str]] = ()) -> DataFrame:
    """definition, selector, n_atoms matched and n_shared with earlier definitions: what matches nothing or overlaps."""
    items = [("high_res", s) for s in high_res] + [("low_res", s) for s in low_res] + [(f"bundle {i}", s) for i, b in enumerate(bundles) for s in b]
    if not items:
        return atoms.sparkSession.createDataFrame([], "definition string, selector string, n_atoms long, n_shared long")
    hits = F.array(*(atom_condition(s) for _, s in items))
    rows = atoms.select(F.posexplode(hits).alias("k", "hit"), hits.alias("all")).where("hit")
    earlier = F.exists(F.slice("all", F.lit(1), F.col("k")), lambda x: x)
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_if(earlier).alias("n_shared"))
    names = atoms.sparkSession.createDataFrame([(k, d, s) for k, (d, s) in enumerate(items)], "k int, definition string, selector string")
    return names.join(counted, "k", "left").select("definition", "selector", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
