"""Command line: build a network, list it, and write its profiles as tables.

    python -m weftgraph build -p topol.top -f run.mdp -t run.gro -o net
    python -m weftgraph plot neighbors -i net -o neighbors.tsv --target "kind atom"
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import __version__
from weftgraph.build import build_network
from weftgraph.errors import NetworkError
from weftgraph.functions.selectors import SELECTOR_HELP
from weftgraph.functions.values import NORMALIZATIONS, VALUE_COLUMNS
from weftgraph.network import load_network
from weftgraph.operators import edges as E
from weftgraph.operators import info, neighbors, paths, regions, viewer
from weftgraph.session import written
from weftgraph.sources import structure, tsv


def _ends(p: argparse.ArgumentParser, prefix: str) -> None:
    for what in ("kind", "resname", "label"):
        p.add_argument(f"--{prefix}-{what}", action="append", default=[], metavar=what.upper())
    p.add_argument(f"--{prefix}-vertex-id", action="append", type=int, default=[], metavar="ID")


def _chosen(args: argparse.Namespace, prefix: str) -> E.Ends:
    get = lambda n: tuple(getattr(args, f"{prefix}_{n}"))
    return E.Ends(get("kind"), get("resname"), get("label"), get("vertex_id"))


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser("weftgraph", description="interaction networks on Spark")
    root.add_argument("--version", action="version", version=__version__)
    commands = root.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="compute a network from topology, parameters and coordinates")
    b.add_argument("-p", "--topology", required=True)
    b.add_argument("-f", "--mdp", required=True)
    b.add_argument("-t", "--trajectory", required=True, nargs="+", help="GRO, PDB or XYZ files, also as patterns; frames go on from file to file")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--stride", type=int, default=1)
    b.add_argument("--frames-per-part", type=int, default=10)
    b.add_argument("--high-res", "--high_res", action="append", default=[], metavar="SELECTOR")
    b.add_argument("--low-res", "--low_res", action="append", default=[], metavar="SELECTOR")
    b.add_argument("--bundle", action="append", nargs="+", default=[], metavar="SELECTOR")
    b.add_argument("--define", action="append", default=[])
    i = commands.add_parser("info", help="what a network contains")
    i.add_argument("-i", "--input", required=True)
    i.add_argument("--list", action="store_true")
    i.add_argument("--selector", action="store_true")
    i.add_argument("--long", action="store_true")
    plots = commands.add_parser("plot", help="write tables of analyses").add_subparsers(dest="plot", required=True)
    defaults = {"vmd": ("per_coarse_member_product", "auto"), "shortest_path": ("none", "none"), "neighbors": ("none", "none"), "rave": ("none", "none")}
    for name, (norm, least) in defaults.items():
        p = plots.add_parser(name)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--value", choices=tuple(VALUE_COLUMNS), default="vdw+cl")
        p.add_argument("--normalize", choices=NORMALIZATIONS, default=norm)
        if name != "rave":
            p.add_argument("--min-abs-value", default=least)
            p.add_argument("--min-abs-percentile", type=float, default=0.05)
            p.add_argument("--max-edges", type=int)
            _ends(p, "exclude")
        if name in ("shortest_path", "neighbors"):
            p.add_argument("--target", metavar="SELECTOR")
            p.add_argument("--molecule-delimiter-min-size", type=float, default=float("inf"), help="mark the borders of molecules with at least so many residues")
            p.add_argument("--renumber-molecule-residues", action="store_true", help="count residues from 1 in each molecule")
        if name == "neighbors":
            p.add_argument("--neighbor-summary", choices=neighbors.SUMMARIES, default="mean_abs")
            p.add_argument("--split-excluded", action="store_true")
            _ends(p, "remove")
        if name == "rave":
            p.add_argument("--region", action="append", required=True, metavar="SELECTOR")
            p.add_argument("--region-label", action="append", default=[])
            p.add_argument("--pair-layout", choices=("auto", "overlay", "adjacent"), default="auto", help="auto: overlay where the residue names of two regions agree")
        if name == "vmd":
            p.add_argument("-s", "--structure", required=True)
            p.add_argument("--radius-mode", choices=("linear", "sqrt", "log"), default="log")
            p.add_argument("--radius-scale", type=float, default=0.05)
            p.add_argument("--bead-radius", type=float, default=0.25)
            p.add_argument("--coordinate-unit", choices=("auto", "nm", "angstrom"), default="auto")
    return root


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    r = build_network(spark, args.topology, args.mdp, args.trajectory, args.output, args.high_res, args.low_res, args.bundle, args.stride, args.frames_per_part, set(args.define))
    print(f"{r.n_atoms} atoms, {r.n_vertices} vertices, coordinates in {r.inferred_input_unit}: {args.output}")


def _info(spark: SparkSession, args: argparse.Namespace) -> None:
    net = load_network(spark, args.input)
    if args.selector:
        for field, found in info.selector_inventory(net.vertices, None if args.long else info.INVENTORY).items():
            print(f"{field}: {', '.join('-'.join(map(str, v)) if field.endswith('_id') else f'{v[0]} ({v[1]})' for v in found)}")
        print(SELECTOR_HELP)
        print("\n".join(info.selector_examples(net.vertices)))
    if args.list or not args.selector:
        for k, v in net.summary().items():
            print(f"{k}: {v}")
        limits = (None, None) if args.long else (info.PER_KIND, info.IN_ALL)
        for r in info.vertex_listing(net.vertices, *limits).select("vertex_id", "kind", "label", "residue_name", "residue_id", "molecule_type", "molecule_instance").toLocalIterator():
            print("\t".join("" if x is None else str(x) for x in r))


def profile(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The table of a plot command, in order. For paths the table of the atom vertices is written beside it."""
    net = load_network(spark, args.input)
    if args.plot == "rave":
        r = net.region_interactions(args.region, args.region_label or None, args.value, args.normalize)
        layout = F.lit(args.pair_layout)
        if args.pair_layout == "auto":
            chosen = regions.resolve_regions(net.vertices, args.region, args.region_label or None)
            pairs = regions.pair_layout(chosen, net.vertices)
            both = pairs.toDF("source_region", "target_region", "layout").unionByName(pairs.toDF("target_region", "source_region", "layout"))
            r, layout = r.join(both, ["source_region", "target_region"]), F.col("layout")
        r = r.withColumns({"value_name": F.lit(args.value), "normalization": F.lit(args.normalize), "layout": layout})
        return r.orderBy("source_region", "target_region", "residue_index", "frame")
    a = net.edge_analysis(args.value, args.normalize, _chosen(args, "exclude") if args.plot != "neighbors" else None, args.min_abs_value, args.min_abs_percentile, args.max_edges)
    axis = args.molecule_delimiter_min_size, args.renumber_molecule_residues
    if args.plot == "neighbors":
        options = {"summary": args.neighbor_summary, "target": args.target, "excluded": _chosen(args, "exclude"), "removed": _chosen(args, "remove"), "split_excluded": args.split_excluded}
        said = {"value_name": args.value, "normalization": args.normalize, "neighbor_summary": args.neighbor_summary, "target_selector": args.target or "", "split_excluded": args.split_excluded}
        return neighbors.axis_columns(net.neighbor_profile(a, **options).withColumns({k: F.lit(v) for k, v in said.items()}), *axis).orderBy(*neighbors.residue_order("category"))
    m = written(net.path_metrics(a, args.value, args.target), "paths")
    detail = paths.high_res_profile(m, net.vertices).withColumn("target_selector", F.lit(args.target or "")).orderBy("plot_index")
    tsv.write_tsv(detail, f"{args.output}.high_res", 12)
    return neighbors.axis_columns(paths.path_profile(m, net.vertices).withColumn("target_selector", F.lit(args.target or "")), *axis).orderBy(*neighbors.residue_order())


def _vmd(spark: SparkSession, args: argparse.Namespace) -> None:
    net = load_network(spark, args.input)
    first = structure.read_structure(spark, args.structure).where("frame = 0").withColumn("mass", F.lit(None).cast("double"))
    n_atoms = first.count()
    centers = viewer.to_angstrom(viewer.vertex_centers(net.members, first.select("atom_index", "x", "y", "z", "mass")), args.coordinate_unit)
    viewer.check_centers(net.vertices, net.members, n_atoms, centers)
    a = net.edge_analysis(args.value, args.normalize, _chosen(args, "exclude"), args.min_abs_value, args.min_abs_percentile, args.max_edges)
    viewer.write_viewer(net.vertices, centers, a, args.output, args.radius_mode, args.radius_scale, args.bead_radius)
    a.write.mode("overwrite").option("compression", "zstd").parquet(f"{args.output}/edge_summary.parquet")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    try:
        if args.command == "build":
            _build(spark, args)
        elif args.command == "info":
            _info(spark, args)
        elif args.plot == "vmd":
            _vmd(spark, args)
        else:
            digits = 12 if args.plot == "shortest_path" else 15
            tsv.write_tsv(profile(spark, args), args.output, digits)
    except (NetworkError, ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0
