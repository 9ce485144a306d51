"""Networks too large for one task give the same paths, however long."""

from pyspark.sql import functions as F

from weftgraph.operators import paths


def test_long_chain_beside_a_small_network(spark, monkeypatch):
    chain = [(1, a, b, 1.0) for k in range(70) for a, b in ((k, k + 1), (k + 1, k))]
    small = [(2, 0, 1, 2.0), (2, 1, 0, 2.0)]
    graph = spark.createDataFrame(chain + small, "build_id int, source int, target int, distance double")
    ends = spark.createDataFrame([(0,)], "source int")
    relaxed = []
    real = paths.relaxed_distances
    monkeypatch.setattr(paths, "MAX_TASK_ARCS", 100)
    monkeypatch.setattr(paths, "relaxed_distances", lambda g, s, by=None: relaxed.append(g.select("build_id").distinct().collect()) or real(g, s, by))
    got = paths.shortest_distances(graph, ends, ["build_id"]).groupBy("build_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).collect()
    assert {(r.build_id, r.n, r.d) for r in got} == {(1, 70, 70.0), (2, 1, 2.0)}
    assert [[r.build_id for r in b] for b in relaxed] == [[1]]
    only = paths.vertex_path_metrics(graph.where("build_id = 2 OR source < 3 AND target < 3"), ["build_id"])
    monkeypatch.setattr(paths, "MAX_TASK_ARCS", 2)
    both = paths.vertex_path_metrics(graph.where("build_id = 2 OR source < 3 AND target < 3"), ["build_id"])
    assert sorted(map(tuple, only.collect())) == sorted(map(tuple, both.collect()))


def test_both_ways_agree_on_a_long_chain_and_random_graphs(spark):
    import heapq
    import random

    rnd = random.Random(6)
    arcs = {}
    for k in range(200):
        arcs[1, k, k + 1] = arcs[1, k + 1, k] = 1.0 + k % 3
    for _ in range(150):
        a, b = rnd.sample(range(60), 2)
        arcs[2, a, b] = arcs[2, b, a] = rnd.random() + 0.01
    graph = spark.createDataFrame([(*k, w) for k, w in arcs.items()], "build_id int, source int, target int, distance double")
    want = {}
    for net, start in {(n, a) for n, a, _ in arcs}:
        best, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > best[v]:
                continue
            for (n, a, b), w in arcs.items():
                if n == net and a == v and d + w < best.get(b, 1e9):
                    best[b] = d + w
                    heapq.heappush(queue, (d + w, b))
        want |= {(net, start, b): d for b, d in best.items() if b != start}
    rounded = lambda df: {(r.build_id, r.source, r.target): round(r.distance, 9) for r in df.collect()}
    want = {k: round(v, 9) for k, v in want.items()}
    assert rounded(paths.shortest_distances(graph, None, ["build_id"])) == want
    few = spark.createDataFrame([(0,), (7,)], "source int")
    starts = graph.select("build_id", "source").distinct().join(few, "source")
    assert rounded(paths.relaxed_distances(graph, starts, ["build_id"])) == {k: v for k, v in want.items() if k[1] in (0, 7)}


def test_profiles_of_one_network_without_a_group(spark):
    from weftgraph.operators import neighbors

    rows = [("M", 1, r) for r in (1, 2, 3, 9, 10)] + [("N", None, r) for r in (4, 5)]
    df = spark.createDataFrame(rows, "molecule_type string, molecule_instance int, residue_id int").repartition(3)
    pick = lambda d: sorted((r.molecule_type, r.residue_id, r.position) for r in d.collect())
    one = pick(neighbors.compressed_axis(df))
    assert one == pick(neighbors.compressed_axis(df.withColumn("g", F.lit(1)), ["g"])) and [p for _, _, p in one] == [0, 1, 2, 4, 5, 6, 7]
    assert sorted((r["first"], r["last"], r.n) for r in neighbors.contiguous_ranges(df, "residue_id").collect()) == [(1, 5, 5), (9, 10, 2)]
