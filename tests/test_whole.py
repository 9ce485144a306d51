"""Queries over networks and coordinates read every current row and frame, whatever the columns that they do not sum."""

import pytest

import __spark_entry__ as entry

NAN = float("nan")
#: build_id, frame, edge_key, vdw, coulomb, vdw_dif, coulomb_dif, n_atom_pairs, row_id
ROWS = [
    (1, 0, 7, 1.0, 2.0, None, 4.0, 10, 0),
    (1, 1, 7, 2.0, 2.0, 1.0, NAN, 10, 1),
    (1, 2, 7, 3e5, 0.0, 1.0, 1.0, 10, 2),
    (1, 3, 7, None, 5.0, 1.0, 1.0, 10, 3),
    (1, 4, 8, NAN, None, 2.0, 1.0, 5, 4),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    values = spark.createDataFrame(ROWS, "build_id int, frame int, edge_key long, vdw float, coulomb float, vdw_dif float, coulomb_dif float, n_atom_pairs int, row_id long").selectExpr("*", "timestamp'2024-01-01' AS written_at")
    tables = {
        "frame_values": values,
        "edges": spark.createDataFrame([(7, 0, 1), (8, 1, 2)], "edge_key long, vertex1 int, vertex2 int"),
        "vertices": spark.createDataFrame([(i, "residue", f"A:{i}", "A") for i in range(3)], "vertex_id int, kind string, label string, residue_name string"),
        "vertex_members": spark.createDataFrame([(i, i) for i in range(3)], "vertex_id int, atom_index int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_rows_count_whatever_the_other_columns(spark, folder):
    q = entry.queries()
    means = {r.edge_key: (r.value, r.n_atom_pairs_sum) for r in q["edge_mean_vdw_cl"](spark, folder).collect()}
    assert means == {7: (round((3.0 + 4.0 + 3e5) / 5, 4), 40), 8: (0.0, 5)}
    each = {r.value_name: (r.n_edges, r.mean_sum) for r in q["edge_each_value"](spark, folder).collect()}
    assert each["vdw"] == (2, round((3.0 + 3e5) / 5, 3)) and each["cl"] == (2, 1.8) and each["dvdw"] == (2, 1.0)
    (s,) = q["frames_summary"](spark, folder).collect()
    assert (s.n_rows, s.n_frames, s.n_edges) == (5, 5, 2)


def test_pairs_of_all_frames_against_brute_force(spark, tmp_path):
    import math
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.randrange(3), [rnd.random() for _ in range(21)]) for i in range(60)]
    rows[20] = (20, 1, [x + 0.001 for x in rows[0][2]])  # on top of each other: far beyond any limit
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = {r.vec_id: (r.label, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want, sums = {}, {}
    for f in range(7):
        for i in range(60):
            for j in range(i + 1, 60):
                d = [a - b for a, b in zip(at[i][1][3 * f : 3 * f + 3], at[j][1][3 * f : 3 * f + 3])]
                r = math.sqrt(sum((x - round(x)) ** 2 for x in d))
                if r > 0.12 or i // 5 == j // 5 or (j == i + 1 and i // 10 == j // 10):
                    continue
                a, b = sorted((at[i][0], at[j][0]))
                s, e = (0.025, 2.0) if (a, b) == (1, 2) else (0.02 + (a + b) * 0.0005, math.sqrt((1 + a * 0.1) * (1 + b * 0.1)))
                c, s6 = 138.935458 * (i % 3 - 1) * (j % 3 - 1), (s / r) ** 6
                want[f, i, j] = (4 * e * (s6 * s6 - s6) if r <= 0.1 else 0.0, c / r, 24 * e / r * (s6 - 2 * s6 * s6) if r <= 0.1 else 0.0, -c / (r * r))
                edge = sums.setdefault((f, i // 5 * 1_000_000 + j // 5), [])
                edge.append(want[f, i, j])
    assert max(abs(w[0]) for w in want.values()) > 1e6 and {k[0] for k in want} == set(range(7))
    energies = ("vdw", "coulomb", "vdw_dif", "coulomb_dif")
    got = {(r.frame, r.i, r.j): tuple(r[c] for c in energies) for r in entry.queries()["pair_energies"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-6, abs=1e-7)
    table = {(r.frame, r.edge_key): r for r in entry.queries()["frame_edge_values"](spark, str(tmp_path)).collect()}
    assert table.keys() == sums.keys()
    for k, found in sums.items():
        assert table[k].n_atom_pairs == len(found)
        for n, c in enumerate(energies):
            assert table[k][c] == pytest.approx(math.fsum(x[n] for x in found), rel=1e-4, abs=1e-5 * max(abs(x[n]) for x in found) + 1e-9)
