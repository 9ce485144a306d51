import random
from collections import Counter

from weftgraph.operators.latest import current_rows
from weftgraph.operators.tree_aggregate import heavy_keys, tree_levels, tree_sum


def test_levels():
    assert [tree_levels(n, 100, 10) for n in (0, 100, 1000, 1001, 10_001)] == [1, 1, 1, 2, 3]


def test_sums_of_a_hot_key_over_many_small_chunks(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else None if rnd.random() < 0.05 else f"k{rnd.randrange(50)}", None if rnd.random() < 0.1 else rnd.randrange(-5, 90), 1) for _ in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int, total int").repartition(7)
    got = {r.k: (r.total, r.n_rows) for r in tree_sum(df, ["k"], "v", 6000, chunk_rows=64, fan_in=3).collect()}
    s, n = Counter(), Counter()
    for k, v, _ in rows:
        s[k] += v or 0
        n[k] += 1
    assert got == {k: (s[k], n[k]) for k in n}


def test_empty_and_heavy(spark):
    empty = spark.createDataFrame([], "build_id long, vertex1 int, n_atom_pairs int")
    vertices = spark.createDataFrame([(1, "a"), (2, None)], "vertex_id long, kind string")
    assert tree_sum(empty, ["vertex1"], "n_atom_pairs", 0).count() == 0
    assert heavy_keys(empty, vertices, 0).count() == 0
    df = spark.createDataFrame([(1, 1, 19), (1, 2, 1), (1, 3, None)], empty.schema)
    got = {(r.key_field, r.key_value) for r in heavy_keys(df, vertices, 3).collect()}
    assert got == {("vertex1", "1"), ("vertex1", "2"), ("kind", "a")}


def test_current_rows(spark):
    edges = spark.createDataFrame([(5, 1, 2), (5, 1, 2), (6, 1, 3)], "edge_key long, vertex1 int, vertex2 int")
    schema = "row_id long, build_id long, frame int, edge_key long, x double, written_at timestamp, vertex1 string"
    import datetime as dt

    t = [dt.datetime(2020, 1, d) for d in (1, 2, 3)]
    rows = [(1, 1, 0, 5, 1.0, t[0], "q"), (2, 1, 0, 5, 2.0, t[2], "q"), (3, 1, 0, 5, 3.0, t[1], "q"), (4, 1, 0, 5, 4.0, t[2], "q"), (5, 1, 0, 7, 5.0, t[2], "q"), (6, 1, None, 5, 6.0, t[2], "q"), (7, 1, 1, 6, 7.0, None, "q"), (8, 1, 1, 6, None, t[0], "q")]
    got = {(r.frame, r.edge_key, r.x, r.vertex2) for r in current_rows(spark.createDataFrame(rows, schema).repartition(3), edges, ["x"]).collect()}
    assert got == {(0, 5, 4.0, 2), (1, 6, None, 3)}
    assert current_rows(spark.createDataFrame([], schema), edges, ["x"]).count() == 0
