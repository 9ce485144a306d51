"""A network from files: topology, run parameters and coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import pairs, resolution, scale, topology
from weftgraph.session import written
from weftgraph.sources import network, parameters, structure


@dataclass(frozen=True)
class BuildReport:
    n_atoms: int
    n_vertices: int
    n_exclusions: int
    scale_to_nm: float
    inferred_input_unit: str


def build_network(
    spark: SparkSession,
    topology_path: str,
    parameters_path: str,
    trajectory: str | list[str],
    output: str,
    high_res: Sequence[str] = (),
    low_res: Sequence[str] = (),
    bundles: Sequence[Sequence[str]] = (),
    stride: int = 1,
    frames_per_part: int = 10,
    defines: set[str] | None = None,
) -> BuildReport:
    """Compute the network of a trajectory and write it to ``output``.

    The first frame must have the topology's atoms; molecules that trail behind the structure's atoms are left out. The unit of
    the coordinates is told from the distances of excluded pairs, or of nearest neighbours where no pair is excluded.
    """
    nonbonded = parameters.read_nonbonded(parameters_path)
    t = parameters.read_topology(topology_path, defines).tables(spark)
    frames = written(structure.read_structure(spark, trajectory).drop("file"), "frames")  # frames are numbered through all files
    n_atoms = frames.where("frame = 0").count()
    sized = t["molecules"].join(t["templates"].groupBy("molecule").agg(F.count(F.lit(1)).alias("atoms_each")), "molecule")
    entries = topology.trailing_exclusion(sized, n_atoms).select("ordinal", "molecule", "count")
    atoms = written(topology.expand_molecules(entries, t["templates"]), "atoms")
    resolution.check_atoms(atoms)
    structure.check_atom_names(frames, atoms)
    bonded = topology.bonded_exclusions(t["bonds"], t["nrexcl"])
    excluded = written(topology.global_exclusions(topology.all_exclusions(bonded, t["exclusions"], t["pairs"]), atoms), "exclusions")

    position, box = structure.positions_and_boxes(pairs.stride(frames, stride))
    pairs.check_boxes(box)
    first, its_box = position.where("frame = 0"), box.where("frame = 0")
    near = scale.nearest_distances(first, its_box) if excluded.isEmpty() else scale.pair_distances(first, excluded, its_box)
    unit = scale.infer_scale(near, nonbonded.max_cutoff)
    k = F.lit(unit["scale_to_nm"])
    position = position.withColumns({a: F.col(a) * k for a in pairs.AXES})
    box = box.withColumns({f"l{a}": F.col(f"l{a}") * k for a in pairs.AXES})

    assigned = resolution.assign_vertices(atoms, high_res, low_res, bundles)
    vertices = written(resolution.vertex_table(assigned), "vertices")
    members = resolution.vertex_members(assigned, vertices)
    n_vertices = vertices.count()
    close = pairs.interacting_pairs(position, atoms, members, excluded, nonbonded.max_cutoff, box)
    types = topology.vdw_type_pairs(t["types"], atoms, t["nonbonded"])
    values = pairs.frame_edge_values(pairs.pair_energies(close, types, nonbonded.rvdw, nonbonded.rcoulomb), n_vertices)
    report = BuildReport(n_atoms, n_vertices, excluded.count(), unit["scale_to_nm"], unit["inferred_input_unit"])
    network.write_network(output, vertices, members, values, frames_per_part=frames_per_part, metadata={**asdict(report), "stride": stride, "rvdw": nonbonded.rvdw, "rcoulomb": nonbonded.rcoulomb})
    return report
