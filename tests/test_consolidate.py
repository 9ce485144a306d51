import json
import random

import pytest

from weftgraph.operators import consolidate as C

SCHEMA = "file_id long, build_id long, payload string, cls string, header int"
HEAD = "frame\tedge_key\tvdw\tcoulomb\tn_atom_pairs"


def line(kind, r):
    f, e, v, c, n = r
    return {"tsv": f"{f}\t{e}\t{v}\t{c}\t{n}", "csv": f"{e},{f},{n},{v},{c}", "json": json.dumps({"frame": f, "edge_key": e, "vdw": v, "coulomb": c, "n_atom_pairs": n})}[kind]


def files(seed):
    rnd = random.Random(seed)
    rows, want = [], set()
    for i in range(200):
        kind, build, end = rnd.choice(["tsv", "csv", "json"]), rnd.choice([1, 1, 1, 2, 3]), rnd.choice(["\n", "\r\n"])
        recs = [(rnd.randrange(50), rnd.randrange(30), round(rnd.uniform(-9, 9), 3), f"{rnd.uniform(-9, 9):.4e}" if kind != "json" else 1.5, rnd.randrange(60)) for _ in range(rnd.randrange(0, 6))]
        lines = [line(kind, r) for r in recs]
        want |= {(build, r[0], r[1]) for r in recs}
        if rnd.random() < 0.2:
            lines.append({"tsv": "3\t4\t1.0\t2.0", "csv": "3,4,5,1.0", "json": '{"frame": 3, "edge_key": 4, "vdw"'}[kind])
        if kind == "csv":
            lines.insert(0, "edge_key,frame,n_atom_pairs,vdw,coulomb")
        elif kind == "tsv" and rnd.random() < 0.5:
            lines.insert(0, HEAD)
        text = end.join(lines) + rnd.choice(["", end, end + "\n"])
        rows.append((i, build, text, "x", 1))
        if rnd.random() < 0.2:
            rows.append((1000 + i, build, text, "x", 1))
    return [*rows, (5000, 1, None, "x", 1), (5001, 1, "", "x", 1), (5002, 1, " \n\n", "x", 1), (5003, 1, HEAD, "x", 1)], want


@pytest.mark.parametrize("target", [C.TARGET_BYTES, 700])
def test_every_record_once_and_none_lost(spark, target):
    rows, want = files(4)
    packs = C.consolidate(spark.createDataFrame(rows, SCHEMA).repartition(5), target)
    got = [(r.build_id, r.frame, r.edge_key) for r in C.distinct_records(C.read_records(spark, packs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = [r.b for r in packs.manifest_of(spark).groupBy("cls", "pack").sum("length").withColumnRenamed("sum(length)", "b").collect()]
    assert len(sizes) == 4 if target > 10_000 else len(sizes) > 8
    n_files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(packs.files).count()
    assert n_files == len(sizes)


def test_empty(spark):
    packs = C.consolidate(spark.createDataFrame([], SCHEMA))
    assert C.read_records(spark, packs).count() == 0


def test_damage_is_noticed(spark):
    rows, _ = files(1)
    packs = C.consolidate(spark.createDataFrame(rows, SCHEMA))
    from pathlib import Path

    f = next(Path(packs.files.replace("file:", "")).iterdir())
    data = bytearray(f.read_bytes())
    data[len(data) // 2] ^= 1
    f.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        C.read_bodies(spark, packs).count()
    f.write_bytes(data[:-1])
    with pytest.raises(Exception, match="wrong length"):
        C.read_records(spark, packs).count()


def test_bodies_stay_as_delivered(spark):
    """Joined bytes are those delivered, but for headers, line ends at boundaries and copies."""
    text = ["1\t2\t0.5\t1e-3\t4\r\n\r\n", "\n \n2\t2\t0.5\t+1.5\t4", '{"frame": 3, "edge_key": 1, "vdw": 1, "coulomb": "2", "n_atom_pairs": 3}\n{"frame": 4', "a\tb\n1\t2\n", HEAD + "\r" + "5\t1\t1\t1\t1"]
    rows = [(k, 1, t, len(t.encode()) + (k == 1)) for k, t in enumerate([*text, text[0]])]
    packs = C.consolidate(spark.createDataFrame(rows, "file_id long, build_id long, payload string, n_bytes int").coalesce(1))
    got = {r.file_id: (r.header, bytes(r.body).decode()) for r in C.read_bodies(spark, packs).collect()}
    assert got == {0: ("", text[0]), 1: ("", text[1][3:]), 2: ("{}", text[2]), 3: ("a\tb", "1\t2\n"), 4: (HEAD, "5\t1\t1\t1\t1")}
    assert {r.file_id: r.size_ok for r in packs.manifest_of(spark).collect()} == {0: True, 1: False, 2: True, 3: True, 4: True}
    assert sorted(r.frame for r in C.read_records(spark, packs).collect()) == [1, 2, 3, 5]


def test_zstandard_frames_are_joined_as_they_are(spark):
    from pathlib import Path

    import zstandard

    text = [HEAD + f"\n{k}\t7\t0.5\t1.5\t3\n" for k in range(30)] + ['{"frame": 99, "edge_key": 1, "vdw": 1, "coulomb": 2, "n_atom_pairs": 3}']
    frames = [zstandard.compress(t.encode()) for t in text]
    df = spark.createDataFrame([(k, 1, bytearray(f)) for k, f in enumerate(frames)], "file_id long, build_id long, payload binary")
    packs = C.consolidate(df)
    (f,) = Path(packs.files.replace("file:", "")).iterdir()
    assert f.stat().st_size == sum(map(len, frames))
    whole = zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read().decode()
    assert sorted(whole) == sorted("".join(text))
    assert sorted(r.frame for r in C.read_records(spark, packs).collect()) == [*range(30), 99]
