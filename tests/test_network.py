"""From text files to a network and its analyses."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.build import build_network
from weftgraph.errors import NetworkError, SelectorError, TopologyError
from weftgraph.network import Table, load_network
from weftgraph.operators import edges as E
from weftgraph.operators import paths
from weftgraph.sources import parameters, structure, tsv

TOP = """
#include "ff.itp"
#ifdef NOT_SET
#include "missing.itp"
#else
[ moleculetype ]
; name nrexcl
PEP 2
[ atoms ]
1 A 1 ARG CA 1 0.5
2 B 1 ARG CB 2 -0.5
3 A 2 LYS CA 3 0.25
4 B 2 LYS CB 4 -0.25
[ bonds ]
1 2
2 3
3 4
[ exclusions ]
1 4
#endif
[ moleculetype ]
SOL 1
[ atoms ]
1 W 1 SOL W 1 0.0
[ system ]
test
[ molecules ]
PEP 3
SOL 5
SOL 4
"""
FF = "[ atomtypes ]\nA 1 10.0 0 A 0.30 1.0\nB 1 10.0 0 A 0.34 2.0\nW 1 18.0 0 A 0.32 0.5\n[ nonbond_params ]\nB A 1 0.31 1.7\n"
MDP = "rcoulomb = 1.1 ; c\nRVDW=1.0\nrlist = 1.2\n; rvdw = 5\nnothing\n"


def gro(rnd, frames=3):
    out = []
    atoms = [(r, n, a) for m in range(3) for r, n, a in ((1, "ARG", "CA"), (1, "ARG", "CB"), (2, "LYS", "CA"), (2, "LYS", "CB"))] + [(1, "SOL", "W")] * 5
    for f in range(frames):
        out += [f"frame {f}", f"{len(atoms)}"]
        base = [rnd.uniform(0, 2.5) for _ in range(3)]
        for i, (r, n, a) in enumerate(atoms):
            if i % 4 == 0 or i >= 12:
                base = [rnd.uniform(0, 2.5) for _ in range(3)]
            base = [(b + rnd.uniform(0.1, 0.25)) % 2.5 for b in base]
            out.append(f"{r:5d}{n:<5s}{a:>5s}{i + 1:5d}" + "".join(f"{b:8.3f}" for b in base))
        out.append("   2.50000   2.50000   2.50000")
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("net")
    (d / "topol.top").write_text(TOP)
    (d / "ff.itp").write_text(FF)
    (d / "run.mdp").write_text(MDP)
    (d / "run.gro").write_text(gro(random.Random(1)))
    report = build_network(spark, str(d / "topol.top"), str(d / "run.mdp"), str(d / "run.gro"), str(d / "out"), high_res=["ARG:1"], low_res=["SOL"])
    return load_network(spark, str(d / "out")), report, d


def test_build(spark, net):
    n, report, d = net
    # the last SOL entry has no atoms in the structure
    assert report.n_atoms == 17 and report.inferred_input_unit == "nm"
    kinds = {r.kind: r.n for r in n.kind_counts().collect()}
    assert kinds == {"atom": 2, "low_res": 1, "residue": 5}  # residues are numbered through the system
    assert n.metadata["n_vertices"] == n.vertices.count()
    assert n.frames() == [0, 1, 2]


def test_values_against_brute_force(spark, net):
    n, _, d = net
    import math

    top = parameters.read_topology(d / "topol.top")
    t = {1: 0}
    types = [a[5] for a in top.atoms if a[0] == "PEP"] * 3 + ["W"] * 5
    charges = [a[6] for a in top.atoms if a[0] == "PEP"] * 3 + [0.0] * 5
    excluded = {(0, 1), (1, 2), (2, 3), (0, 2), (1, 3), (0, 3)}
    excluded = {(4 * m + i, 4 * m + j) for m in range(3) for i, j in excluded}
    vertex = {r.atom_index: r.vertex_id for r in n.members.collect()}
    pos: dict = {}
    for r in structure.read_structure(spark, str(d / "run.gro")).collect():
        pos.setdefault(r.frame, {})[r.atom_index] = (r.x, r.y, r.z)
    want: dict = {}
    for f, p in pos.items():
        for i in range(17):
            for j in range(i + 1, 17):
                r2 = sum((a - b - 2.5 * round((a - b) / 2.5)) ** 2 for a, b in zip(p[i], p[j]))
                if r2 > 1.1**2 or vertex[i] == vertex[j] or (i, j) in excluded:
                    continue
                a, b = sorted((vertex[i], vertex[j]))
                r = math.sqrt(r2)
                pair = tuple(sorted((types[i], types[j])))
                s, e = top.nonbonded.get(pair, ((top.types[pair[0]][0] + top.types[pair[1]][0]) / 2, math.sqrt(top.types[pair[0]][1] * top.types[pair[1]][1])))
                w = want.setdefault((f, a, b), [0.0, 0.0, 0])
                w[0] += 4 * e * ((s / r) ** 12 - (s / r) ** 6) if r <= 1.0 else 0.0
                w[1] += 138.935458 * charges[i] * charges[j] / r
                w[2] += 1
    got = {(r.frame, r.vertex1, r.vertex2): (r.vdw, r.coulomb, r.n_atom_pairs) for r in n.values.join(n.edges, "edge_key").collect()}
    assert got.keys() == want.keys() and t
    for k, (v, c, m) in got.items():
        assert m == want[k][2] and c == pytest.approx(want[k][1], rel=1e-4, abs=1e-4) and v == pytest.approx(want[k][0], rel=1e-4, abs=1e-4)


def test_analyses(spark, net):
    n, _, _ = net
    a = n.edge_analysis("vdw+cl")
    assert a.count() == n.edges.count()
    assert n.edge_analysis(max_edges=2).count() == 2
    assert n.edge_analysis(excluded=E.Ends(kinds=("low_res",))).where("kind1 = 'low_res' OR kind2 = 'low_res'").count() == 0
    m = n.path_metrics(a)
    assert m.count() <= n.vertices.count()
    assert n.neighbor_profile(a).count() > 0
    assert n.region_interactions(["kind low_res", "kind residue"]).count() > 0
    assert n.summary()["n_frames"] == 3
    with pytest.raises(SelectorError):
        n.region_interactions(["kind low_res", "kind nothing"])
    with pytest.raises(SelectorError):
        n.region_interactions(["kind low_res", "not kind residue"])
    with pytest.raises(KeyError):
        n.residue_keys([10**6]).count()
    with pytest.raises(NetworkError):
        load_network(spark, "/tmp/no-such-network")


def test_paths_toy_graph(spark):
    rows = [(0, 1, 2.0), (1, 2, -4.0), (0, 2, 0.5), (3, 4, 1.0), (5, 5, 1.0), (0, 6, 0.0)]
    a = spark.createDataFrame(rows, "vertex1 int, vertex2 int, value double")
    for searched in (paths.shortest_distances, lambda g: paths.relaxed_distances(g, g.select("source").distinct())):
        means = {r.vertex_id: r.mean_shortest_path for r in paths.path_metrics(searched(paths.distance_graph(a, "vdw+cl"))).collect()}
        assert means == pytest.approx({0: 0.625, 1: 0.375, 2: 0.5, 3: 1, 4: 1})
        assert {r.vertex_id: r.mean_shortest_path for r in paths.vertex_path_metrics(paths.distance_graph(a, "vdw+cl")).collect()} == pytest.approx(means)
        means = {r.vertex_id: r.mean_shortest_path for r in paths.path_metrics(searched(paths.distance_graph(a, "dvdw"))).collect()}
        assert means == pytest.approx({0: 1.25, 1: 2.25, 2: 1.5, 3: 1, 4: 1})


def test_topology_errors(tmp_path):
    p = tmp_path / "t.top"
    p.write_text('#include "gone.itp"\n')
    with pytest.raises(TopologyError):
        parameters.read_topology(p)
    p.write_text("[ molecules ]\nX 1\n")
    with pytest.raises(TopologyError):
        parameters.read_topology(p)
    m = tmp_path / "m.mdp"
    m.write_text("rcoulomb = 1.0\nrvdw = \n")
    with pytest.raises(TopologyError):
        parameters.read_nonbonded(m)


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "a b", True, None), (2, float("inf"), "", False, 1.5)], "i int, d double, s string, b boolean, m double")
    tsv.write_tsv(df, str(tmp_path / "t.tsv"))
    back = Table.from_tsv(spark, str(tmp_path / "t.tsv"))
    assert dict(back.df.dtypes) == {"i": "bigint", "d": "double", "s": "string", "b": "boolean", "m": "double"}
    assert back.unique("i") == [1, 2] and len(back) == 2 and "s" in back
    assert back.df.where("i = 1").first().d == 0.1
    assert tsv.format_numbers(df.select((F.lit(2.0) / 3).alias("x"), F.lit(100.0).alias("y"), F.lit(1e-7).alias("z")), 12).first() == ("0.666666666667", "100", "1e-07")


def test_pdb_and_xyz(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("CRYST1   10.000   20.000   30.000  90.00  90.00  90.00\nATOM      1  CA  ARG A   7       1.000   2.000   3.000\nENDMDL\nATOM      1  CA  ARG A   7       1.500   2.000   3.000\nENDMDL\n")
    (tmp_path / "b.xyz").write_text("2\nc\nC 0 0 1\nO 0.5 0 1\n")
    pdb = structure.read_structure(spark, str(tmp_path / "a.pdb")).orderBy("frame").collect()
    assert [(r.frame, r.x, r.ly, r.residue_id) for r in pdb] == [(0, 1.0, 20.0, 7), (1, 1.5, 20.0, 7)]
    assert structure.read_structure(spark, str(tmp_path / "b.xyz")).count() == 2


def test_several_files_are_one_trajectory(spark, net, tmp_path):
    """Frames go on from file to file; a file is cut into splits anywhere."""
    n, _, d = net
    whole = (d / "run.gro").read_text()
    lines = whole.splitlines(keepends=True)
    for k in range(3):
        (tmp_path / f"run{k}.gro").write_text("".join(lines[20 * k : 20 * (k + 1)]) + "\n" * k)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        a = sorted(tuple(r)[1:] for r in structure.read_structure(spark, str(d / "run.gro")).collect())
        b = sorted(tuple(r)[1:] for r in structure.read_structure(spark, str(tmp_path / "run*.gro")).collect())
        build_network(spark, str(d / "topol.top"), str(d / "run.mdp"), str(tmp_path / "run*.gro"), str(tmp_path / "out"), high_res=["ARG:1"], low_res=["SOL"], frames_per_part=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert a == b and len(a) == 51 and {r[0] for r in a} == {0, 1, 2}
    m = load_network(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, m.values.collect())) == sorted(map(tuple, n.values.collect()))
    files = [p.parent.name for p in (tmp_path / "out" / "values").rglob("*.parquet")]
    assert sorted(files) == ["frame_bucket=0", "frame_bucket=1"]
    some = m.edge_values(frames=[2])
    assert {r.frame for r in some.collect()} == {2}
    assert re.search(r"PartitionFilters: \[[^\]]*frame_bucket", some._jdf.queryExecution().toString())
    (tmp_path / "run2.gro").write_text("".join(lines[40:55]))
    with pytest.raises(NetworkError, match="cut short"):
        structure.read_structure(spark, str(tmp_path / "run2.gro"))


def test_monatomic_system(spark, tmp_path):
    """Without bonds the unit is told from nearest neighbours; short and unreadable lines of a topology."""
    rnd = random.Random(4)
    top = "[ moleculetype ]\nAR 1\n[ atoms ]\n1 A 1 AR AR 1 0.0\n[ molecules ]\nAR 64\n"
    (tmp_path / "t.top").write_text('#include "ff.itp"\n' + top)
    (tmp_path / "ff.itp").write_text("[ atomtypes ]\nA 1 10.0 0 A 0.34 1.0\nB 1 10.0 0 A x y\n[ molecules ]\nGONE 7\n")
    (tmp_path / "m.mdp").write_text(MDP)
    places = [(x, y, z) for x in range(4) for y in range(4) for z in range(4)]
    atoms = [f"{k + 1:5d}{'AR':<5s}{'AR':>5s}{k + 1:5d}" + "".join(f"{0.38 * c + rnd.uniform(0, 0.03):8.3f}" for c in p) for k, p in enumerate(places)]
    (tmp_path / "a.gro").write_text("\n".join(["t", "64", *atoms, "   1.52000   1.52000   1.52000"]) + "\n")
    report = build_network(spark, str(tmp_path / "t.top"), str(tmp_path / "m.mdp"), str(tmp_path / "a.gro"), str(tmp_path / "out"))
    assert report.inferred_input_unit == "nm" and report.n_atoms == 64 and report.n_exclusions == 0
    t = parameters.read_topology(tmp_path / "t.top")
    assert t.types == {"A": (0.34, 1.0)} and t.molecules == [(0, "AR", 64)]
    (tmp_path / "short.top").write_text("[ moleculetype ]\nX 1\n[ atoms ]\n1 A 1\n")
    with pytest.raises(TopologyError):
        parameters.read_topology(tmp_path / "short.top")


def test_nearest_distances(spark):
    from weftgraph.operators.scale import nearest_distances

    rnd = random.Random(8)
    at = [tuple(rnd.random() for _ in range(3)) for _ in range(60)] + [(30.0, 0.0, 0.0), (31.0, 0.0, 0.0)]
    df = spark.createDataFrame([(0, k, *p) for k, p in enumerate(at)], "frame int, atom_index int, x double, y double, z double")
    got = sorted(r.distance for r in nearest_distances(df).collect())
    want = sorted(min(sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 for q in at if q != p) for p in at)
    assert got == pytest.approx(want) and nearest_distances(df.limit(1)).count() == 0
