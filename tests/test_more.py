import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import NetworkError, TopologyError
from weftgraph.operators import edges as E
from weftgraph.operators import neighbors, pairs, regions, resolution, topology, viewer
from weftgraph.session import broadcast_if_bounded
from weftgraph.streaming.frames import frame_totals, stream_frame_totals, windowed_totals

ATOMS = [(i, i + 1, i // 2 + 1, ["ARG", "LYS", "SOL"][i // 2 % 3], "M", 1, "CA" if i % 2 else "CB", "T", 0.5) for i in range(12)]
ATOM_SCHEMA = "atom_index int, atom_nr int, residue_id int, residue_name string, molecule_type string, molecule_instance int, atom_name string, atom_type string, charge double"


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.randrange(5), rnd.choice([1.0, 2.5, None, float("nan"), 1e9]), rnd.choice([None, 4]), dt.datetime(2020, 1, 1, rnd.randrange(6))) for _ in range(500)]
    df = spark.createDataFrame(rows, "build_id long, frame int, coulomb float, n_atom_pairs int, written_at timestamp")
    path = str(tmp_path / "in")
    df.repartition(7).write.parquet(path)
    got = {tuple(r) for r in stream_frame_totals(spark, path, files_per_trigger=2).collect()}
    assert got == {tuple(r) for r in frame_totals(df).collect()}
    q = windowed_totals(spark.readStream.schema(df.schema).parquet(path)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n_rows) FROM w").first()[0] == 500


def test_resolution_report_and_checks(spark):
    a = spark.createDataFrame(ATOMS, ATOM_SCHEMA)
    r = {(x.definition, x.selector): (x.n_atoms, x.n_shared) for x in resolution.selection_report(a, ["ARG"], ["resid 1-2", "nothing"], [["LYS"]]).collect()}
    assert r == {("high_res", "ARG"): (4, 0), ("low_res", "resid 1-2"): (4, 2), ("low_res", "nothing"): (0, 0), ("bundle 0", "LYS"): (4, 2)}
    with pytest.raises(Exception, match="gaps"):
        resolution.check_atoms(a.where("atom_nr <> 5"))
    s = topology.system_summary(a, spark.createDataFrame([("T", "T")], "type_i string, type_j string")).first()
    assert (s.n_atoms, s.n_residues, s.residue_names, s.n_vdw_type_pairs) == (12, 6, ["ARG", "LYS", "SOL"], 1)


def test_boxes_and_missing_types(spark):
    with pytest.raises(NetworkError):
        pairs.check_boxes(spark.createDataFrame([(0, 80.0, 90.0, 90.0)], "frame int, alpha double, beta double, gamma double"))
    t = spark.createDataFrame([("A", 0.3, 1.0)], "atom_type string, sigma double, epsilon double")
    none = spark.createDataFrame([], "type_i string, type_j string, sigma double, epsilon double")
    with pytest.raises(TopologyError):
        topology.vdw_type_pairs(t, spark.createDataFrame([("A",), ("B",)], "atom_type string"), none)
    with pytest.raises(TopologyError):
        topology.trailing_exclusion(spark.createDataFrame([(0, "A", 2, 3)], "ordinal int, molecule string, count int, atoms_each int"), 5)


@pytest.mark.parametrize(("side", "cutoff"), [(1.0, 0.3), (1.0, 0.6), (0.5, 0.5), (None, 0.3)])
def test_pairs_against_all_pairs(spark, side, cutoff):
    rnd = random.Random(5)
    p = [(f, i, *(rnd.uniform(-0.7, 1.4) for _ in range(3))) for f in range(2) for i in range(60)]
    box = None if side is None else spark.createDataFrame([(0, side, side, side), (1, None, None, None)], "frame int, lx double, ly double, lz double")
    got = sorted((r.frame, r.i, r.j) for r in pairs.pairs_within(spark.createDataFrame(p, "frame int, atom_index int, x double, y double, z double"), cutoff, box).collect())
    want = []
    for f, i, *a in p:
        for g, j, *b in p:
            if f == g and i < j:
                d = [u - v for u, v in zip(a, b)]
                if side is not None and f == 0:
                    d = [x - side * round(x / side) for x in d]
                if sum(x * x for x in d) <= cutoff**2:
                    want.append((f, i, j))
    assert got == sorted(want)


def test_edge_errors_and_thresholds(spark):
    v = spark.createDataFrame([(0, 1, 1.0, 2.0, 0.0, 0.0, 3), (1, 9, 1.0, 2.0, 0.0, 0.0, 3)], "frame int, edge_key long, vdw float, coulomb float, vdw_dif float, coulomb_dif float, n_atom_pairs int")
    edges = spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "edge_key long, vertex1 int, vertex2 int")
    with pytest.raises(KeyError):
        E.require_known_edges(v, edges)
    vertices = spark.createDataFrame([(i, "atom", f"l{i}", None) for i in range(3)], "vertex_id long, kind string, label string, residue_name string")
    members = spark.createDataFrame([(0, 0), (1, 1)], "vertex_id int, atom_index int")
    a = {r.edge_key: (r.value_raw, r.value, r.n_members2) for r in E.edge_analysis(v, edges, vertices, members, "vdw+cl", "per_member_product").collect()}
    assert a == {1: (1.5, 1.5, 1), 2: (0.0, 0.0, 0)}
    with pytest.raises(NetworkError):
        E.edge_analysis(v.limit(0), edges, vertices, members)
    with pytest.raises(NetworkError):
        E.member_counts(vertices, members, check=True)
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (0.0,), (float("nan"),)], "abs_value double")
    assert E.auto_thresholds(x).first().threshold == pytest.approx(1.0015)
    assert E.above_threshold(x, "none").count() == 6 and E.above_threshold(x, 2).count() == 3 and E.above_threshold(x.limit(0), "auto").count() == 0
    with pytest.raises(ValueError):
        E.above_threshold(x, "much")
    with pytest.raises(ValueError):
        E.strongest_edges(x, 0)


def test_colors_layout_axis(spark):
    cells = spark.createDataFrame([(8.0,), (-1.0,), (0.0,)], "value double")
    assert [round(r.position, 4) for r in regions.with_color_position(cells).orderBy("value").collect()] == [0.2824, 0.5, 1.0]
    r = spark.createDataFrame([("M", 1, i) for i in (1, 2, 6, 7)] + [("N", None, 3)], "molecule_type string, molecule_instance int, residue_id int")
    got = [(x.position, x.is_jump, x.block_start, x.index_in_molecule) for x in neighbors.compressed_axis(r).orderBy("position").collect()]
    assert got == [(0, False, True, 1), (1, False, False, 2), (3, True, False, 3), (4, False, False, 4), (5, False, True, 1)]
    assert [(x["first"], x["last"], x.n) for x in neighbors.contiguous_ranges(r, "residue_id").orderBy("first").collect()] == [(1, 3, 3), (6, 7, 2)]


def test_viewer_lines(spark):
    v = spark.createDataFrame([(0, "atom", "ar g!", 5), (1, "bundle", None, None)], "vertex_id long, kind string, residue_name string, residue_id int")
    c = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 0.0, 0.0, -1.5)], "vertex_id long, x double, y double, z double")
    lines = [r.line for r in viewer.bead_lines(v, c).orderBy("vertex_id").collect()]
    assert lines[0] == "HETATM    1  A   ARG A   1       1.000   2.000   3.000  1.00  0.00           X" and lines[1][12:26] == " B   VTX A   2"
    a = spark.createDataFrame([(7, 0, 1, -2.0), (8, 0, 1, 0.0)], "edge_key long, vertex1 int, vertex2 int, value double")
    assert [r.line for r in viewer.draw_lines(viewer.drawn_edges(a, c)).collect()] == ["draw color blue\ndraw cylinder {1.000 2.000 3.000} {0.000 0.000 -1.500} radius 0.0549 filled yes resolution 12"]
    assert viewer.to_angstrom(c).where("vertex_id = 0").first().x == 10.0


def test_bounded_broadcast(spark):
    df = spark.range(5).withColumn("k", F.col("id"))
    assert "Broadcast" in df.join(broadcast_if_bounded(df, 5), "id")._jdf.queryExecution().toString()
    hinted = broadcast_if_bounded(df, 4)._jdf.queryExecution().logical().toString()
    assert "hint" not in hinted.lower()
