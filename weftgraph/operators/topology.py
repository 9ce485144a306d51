"""Molecules expanded to atoms, bonded exclusions, van der Waals types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.errors import TopologyError


def trailing_exclusion(molecules: DataFrame, n_atoms: int) -> DataFrame:
    """The leading entries (ordinal, molecule, count, atoms_each) whose atoms add up to ``n_atoms``; what trails is left out.

    Raises if no leading part has so many atoms.
    """
    w = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)  # a few entries of one system
    rows = molecules.withColumn("upto", F.sum(F.col("count") * F.col("atoms_each")).over(w))
    last = rows.where(F.col("upto") == n_atoms).agg(F.min("ordinal")).first()[0]
    if last is None:
        raise TopologyError(f"no leading molecules have {n_atoms} atoms together")
    return rows.where(F.col("ordinal") <= last).drop("upto")


def expand_molecules(molecules: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per atom of every instance of every entry.

    ``molecules``: ordinal, molecule, count. ``templates``: molecule, nr, residue_nr, residue_name, atom_name, atom_type, charge.
    Atoms are numbered from 1 over all; a residue is new where a residue number first comes up in an instance; instances
    count from 1 per molecule type.
    """
    per_molecule = templates.groupBy("molecule").agg(F.count(F.lit(1)).alias("atoms_each"), F.countDistinct("residue_nr").alias("residues_each"))
    first = templates.groupBy("molecule", "residue_nr").agg(F.min("nr").alias("first_nr"))
    rank = Window.partitionBy("molecule").orderBy("first_nr")
    local = templates.join(first.withColumn("residue_place", F.row_number().over(rank)), ["molecule", "residue_nr"])
    ahead = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("molecule").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    entries = molecules.join(per_molecule, "molecule", "left").withColumns(
        {
            "atoms_before": F.coalesce(F.sum(F.col("count") * F.col("atoms_each")).over(ahead), F.lit(0)),
            "residues_before": F.coalesce(F.sum(F.col("count") * F.col("residues_each")).over(ahead), F.lit(0)),
            "instances_before": F.coalesce(F.sum("count").over(same), F.lit(0)),
        }
    )
    instances = entries.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long")))).where("count > 0")
    atoms = instances.join(local, "molecule")
    place = Window.partitionBy("molecule").orderBy("nr")
    numbered = local.select("molecule", "nr", F.row_number().over(place).alias("atom_place"))
    atoms = atoms.join(numbered, ["molecule", "nr"])
    nr = F.col("atoms_before") + (F.col("k") - 1) * F.col("atoms_each") + F.col("atom_place")
    residue = F.col("residues_before") + (F.col("k") - 1) * F.col("residues_each") + F.col("residue_place")
    return atoms.select(
        (nr - 1).cast("int").alias("atom_index"), nr.cast("int").alias("atom_nr"), residue.cast("int").alias("residue_id"), "residue_name", F.col("molecule").alias("molecule_type"), (F.col("instances_before") + F.col("k")).cast("int").alias("molecule_instance"), "atom_name", "atom_type", "charge", F.col("nr").alias("local_nr")
    )


def bonded_exclusions(bonds: DataFrame, nrexcl: DataFrame) -> DataFrame:
    """molecule, i, j (i < j, local numbers) of atoms joined by at most nrexcl bonds. ``bonds``: molecule, i, j; ``nrexcl``: molecule, nrexcl.

    Each round extends all paths by one bond as a join.
    """
    step = bonds.select("molecule", "i", "j").unionByName(bonds.select("molecule", F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()
    most = nrexcl.agg(F.max("nrexcl")).first()[0] or 0
    reached = step.withColumn("hops", F.lit(1))
    frontier = reached
    for hop in range(2, most + 1):
        further = frontier.alias("a").join(step.alias("b"), F.expr("a.molecule = b.molecule AND a.j = b.i AND a.i <> b.j")).select("a.molecule", "a.i", "b.j").distinct()
        frontier = further.join(reached, ["molecule", "i", "j"], "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached.join(nrexcl, "molecule").where("i < j AND hops <= nrexcl").select("molecule", "i", "j").distinct()


def all_exclusions(bonded: DataFrame, explicit: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bonded, explicit and 1-4 pairs together, each once, i < j."""
    parts = [d.select("molecule", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")) for d in (bonded, explicit, pairs)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("i <> j").distinct()


def global_exclusions(local: DataFrame, atoms: DataFrame) -> DataFrame:
    """Local exclusions for every instance, as atom indexes i < j."""
    a = atoms.select("molecule_type", "molecule_instance", "local_nr", "atom_index")
    one = local.join(a.select(F.col("molecule_type").alias("molecule"), "molecule_instance", F.col("local_nr").alias("i"), F.col("atom_index").alias("ai")), ["molecule", "i"])
    two = one.join(a.select(F.col("molecule_type").alias("molecule"), "molecule_instance", F.col("local_nr").alias("j"), F.col("atom_index").alias("aj")), ["molecule", "molecule_instance", "j"])
    return two.select(F.least("ai", "aj").alias("i"), F.greatest("ai", "aj").alias("j")).distinct()


def vdw_type_pairs(types: DataFrame, used: DataFrame, given: DataFrame) -> DataFrame:
    """Each pair of used types once (type_i <= type_j): the given parameters, else the mean sigma and the geometric mean epsilon.

    ``types``: atom_type, sigma, epsilon; ``used``: atom_type; ``given``: type_i, type_j, sigma, epsilon. The types of a force
    field are few; their pairs come from a self-join on order.
    """
    u = used.select("atom_type").distinct()
    if missing := u.join(types, "atom_type", "left_anti").limit(5).collect():
        raise TopologyError(f"no parameters for atom types {[r.atom_type for r in missing]}")
    t = u.join(types, "atom_type").dropDuplicates(["atom_type"])
    a = t.select(F.col("atom_type").alias("type_i"), F.col("sigma").alias("si"), F.col("epsilon").alias("ei"))
    b = t.select(F.col("atom_type").alias("type_j"), F.col("sigma").alias("sj"), F.col("epsilon").alias("ej"))
    g = given.select(F.least("type_i", "type_j").alias("type_i"), F.greatest("type_i", "type_j").alias("type_j"), F.col("sigma").alias("gs"), F.col("epsilon").alias("ge")).dropDuplicates(["type_i", "type_j"])
    rows = a.join(b, F.col("type_i") <= F.col("type_j")).join(g, ["type_i", "type_j"], "left")
    own = F.col("gs").isNotNull()
    return rows.select("type_i", "type_j", F.when(own, F.col("gs")).otherwise((F.col("si") + F.col("sj")) / 2).alias("sigma"), F.when(own, F.col("ge")).otherwise(F.sqrt(F.col("ei") * F.col("ej"))).alias("epsilon"), F.when(own, "nonbond_params").otherwise("combination_rule_2").alias("source"))


def system_summary(atoms: DataFrame, vdw_types: DataFrame) -> DataFrame:
    """Counts and the distinct names and types of a system, one row."""
    s = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}s")
    n = vdw_types.count()
    return atoms.agg(F.countDistinct("residue_id").alias("n_residues"), F.count(F.lit(1)).alias("n_atoms"), s("residue_name"), s("atom_name"), s("atom_type")).withColumn("n_vdw_type_pairs", F.lit(n))
