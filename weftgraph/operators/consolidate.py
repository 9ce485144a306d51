"""Byte-level consolidation of very many tiny value files into few well-sized ones.

Contents are never parsed on the way: the first line decides the class of a file (header text, JSON or plain), the header is
cut off, a missing final line end is supplied, and whole bodies are written one after the other below one header per output
file. Complete zstandard frames are joined as they are, which makes a valid zstandard file. A manifest keeps offset, length and
checksum of every body as it was delivered; reading back checks all of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import broadcast_if_bounded, shared_folder, written

TARGET_BYTES = 64 * 1024 * 1024
#: Bodies of one pack at most, so that its part of the manifest stays small; classes whose sizes are broadcast at most.
PACK_BODIES, BROADCAST_CLASSES = 200_000, 10_000
#: Bodies that are read as one Arrow batch.
BATCH_BODIES = 5000
# Fields of a record in the order of files without header, and the first bytes of a zstandard frame.
FIELDS = ["frame", "edge_key", "vdw", "coulomb", "n_atom_pairs"]
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
LINE_END = r"\r\n|\n|\r"
NUMBER = r"^(?i:[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?|nan|[-+]?inf(inity)?)$"
PARTS = "array<struct<build_id: bigint, file_id: bigint, offset: bigint, length: bigint, crc: bigint, size_ok: boolean>>"


@dataclass(frozen=True)
class Consolidated:
    """Where the output files and their manifest lie."""

    files: str
    manifest: str

    def manifest_of(self, spark: SparkSession) -> DataFrame:
        """One row per body: cls, pack, name of the file, build_id, file_id, offset, length and crc, and whether the length that was
        claimed for the file is right (null if none was)."""
        return spark.read.parquet(self.manifest).select("cls", "pack", "name", F.inline("parts"))


def _split(data: bytes) -> tuple[bytes, int]:
    """Header (``{}`` for JSON, empty for none) and where the body begins; the body is empty if nothing but white space follows."""
    start = 0
    while start < len(data) and data[start] in b" \t\r\n":
        start += 1
    line = start if start == 0 else max(data.rfind(b"\n", 0, start), data.rfind(b"\r", 0, start)) + 1
    end = min((k for k in (data.find(b"\n", start), data.find(b"\r", start)) if k >= 0), default=len(data))
    first = data[start : start + 1]
    if first == b"{":
        return b"{}", line
    if first in (b"", b"-", b"+") or first.isdigit():
        return b"", line
    while end < len(data) and data[end] in b"\r\n":
        end += 1
    return data[line:end].strip(), end


def file_bodies(part_files: DataFrame) -> DataFrame:
    """file_id, build_id, cls, header, digest, size_ok and body of every file that is not empty. Copies of a body of one build within
    a task are left out, so that a file delivered a million times is not sent on a million times.

    A null or blank payload has no body. A zstandard frame is a body as it is, under the header ``zstd``.
    """
    payload = F.col("payload").cast("binary")
    claimed = F.col("n_bytes").cast("long") if "n_bytes" in part_files.columns else F.lit(None).cast("long")
    rows = part_files.select(F.col("file_id").cast("long").alias("file_id"), F.col("build_id").cast("long").alias("build_id"), claimed.alias("claimed"), payload.alias("payload")).where("payload IS NOT NULL AND length(payload) > 0")
    schema = T.StructType.fromDDL("file_id long, build_id long, cls string, header string, digest binary, size_ok boolean, body binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for file_id, build_id, claimed, data in zip(*(batch.column(c).to_pylist() for c in ("file_id", "build_id", "claimed", "payload")), strict=True):
                header, begin = (b"zstd", 0) if data.startswith(ZSTD_MAGIC) else _split(data)
                body = data[begin:]
                if not body.strip():
                    continue
                digest = hashlib.blake2b(b"%d|%b|" % (build_id if build_id is not None else -1, header) + body, digest_size=16).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                out.append((file_id, build_id, hashlib.blake2b(header, digest_size=6).hexdigest(), header.decode("utf-8", "replace"), digest, None if claimed is None else claimed == len(data), body))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.binary()), strict=True)], names=schema.names)

    return rows.mapInArrow(cut, schema)


def consolidate(part_files: DataFrame, target_bytes: int = TARGET_BYTES) -> Consolidated:
    """Write the bodies into files of about ``target_bytes`` below the shared folder; returns where they are.

    Columns used: file_id (unique), build_id, payload (text or binary), n_bytes (may be missing); others are ignored. Files go
    to the packs of their class by a hash of their content, so packs differ from the target by little, no task sees more than one pack
    at a time, and the same body of one build delivered again meets itself there; the smallest file_id of these stays. A task
    that is repeated writes under a new name, and only names in the manifest count. An empty input writes no data file.
    """
    spark = part_files.sparkSession
    bodies = written(file_bodies(part_files), "bodies")
    size = F.octet_length("body") + 1
    packs = bodies.groupBy("cls").agg(F.ceil(F.greatest(F.sum(size) / F.lit(target_bytes), F.count(F.lit(1)) / F.lit(PACK_BODIES))).cast("long").alias("packs"))
    placed = bodies.join(broadcast_if_bounded(packs, BROADCAST_CLASSES), "cls").withColumn("pack", F.pmod(F.xxhash64("digest"), "packs")).drop("packs")
    root = shared_folder(spark, "packs")
    folder = f"{root}/files"
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    schema = T.StructType.fromDDL(f"cls string, pack long, name string, bytes long, header string, parts {PARTS}")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        now, out, name, at, header = None, None, "", 0, ""
        parts: list[dict] = []
        seen: set[bytes] = set()

        def entry() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"cls": now[0], "pack": now[1], "name": name, "bytes": at, "header": header, "parts": parts}], schema=pa_schema)

        for batch in batches:
            for key, file_id, build_id, text, digest, size_ok, body in zip(zip(*(batch.column(c).to_pylist() for c in ("cls", "pack")), strict=True), *(batch.column(c).to_pylist() for c in ("file_id", "build_id", "header", "digest", "size_ok", "body")), strict=True):
                if key != now:
                    if now is not None:
                        yield entry()
                    now, at, header, parts, seen = key, 0, text, [], set()
                    name = f"{key[0]}-{key[1]}-{uuid.uuid4().hex}" + (".zst" if text == "zstd" else "")
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    if header not in ("", "{}", "zstd"):
                        at = out.write(header.encode() + b"\n")
                if digest in seen:
                    continue
                seen.add(digest)
                out.write(body)
                parts.append({"build_id": build_id, "file_id": file_id, "offset": at, "length": len(body), "crc": zlib.crc32(body), "size_ok": size_ok})
                at += len(body)
                if header != "zstd" and not body.endswith(b"\n"):
                    at += out.write(b"\n")
        if now is not None:
            yield entry()

    pa_schema = pa.schema([("cls", pa.string()), ("pack", pa.int64()), ("name", pa.string()), ("bytes", pa.int64()), ("header", pa.string()), ("parts", pa.list_(pa.struct([*((c, pa.int64()) for c in ("build_id", "file_id", "offset", "length", "crc")), ("size_ok", pa.bool_())])))])
    by_pack = placed.repartition("cls", "pack").sortWithinPartitions("cls", "pack", "build_id", "file_id").select("cls", "pack", "file_id", "build_id", "header", "digest", "size_ok", "body")
    by_pack.mapInArrow(join, schema).write.option("compression", "zstd").parquet(f"{root}/manifest")
    return Consolidated(folder, f"{root}/manifest")


def _packs(spark: SparkSession, packs: Consolidated) -> DataFrame:
    """The packs of the manifest, spread over tasks: about one a task."""
    manifest = spark.read.parquet(packs.manifest)
    return manifest.repartition(max(1, manifest.select("pack").count()), "name")


def _checked(folder: str, batch: pa.RecordBatch) -> Iterator[tuple[str, list[dict], list[bytes]]]:
    """Header, manifest entries and bodies of each pack of a batch. Raises if a file is longer or shorter than its manifest says or a
    checksum differs."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    for name, size, header, parts in zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "header", "parts")), strict=True):
        with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
            data = memoryview(f.read())
        if len(data) != size:
            raise ValueError(f"pack {name} has a wrong length")
        for k in range(0, len(parts), BATCH_BODIES):
            some = parts[k : k + BATCH_BODIES]
            bodies = [data[p["offset"] : p["offset"] + p["length"]] for p in some]
            for p, body in zip(some, bodies, strict=True):
                if zlib.crc32(body) != p["crc"]:
                    raise ValueError(f"pack {name}: checksum differs at {p['offset']}")
            if header != "zstd":
                yield header, some, list(map(bytes, bodies))
                continue
            by_header: dict[str, tuple[list[dict], list[bytes]]] = {}
            for p, body in zip(some, bodies, strict=True):
                text = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True).read()
                own, begin = _split(text)
                held = by_header.setdefault(own.decode("utf-8", "replace"), ([], []))
                held[0].append(p)
                held[1].append(text[begin:])
            for own, (p, b) in by_header.items():
                yield own, p, b


def read_bodies(spark: SparkSession, packs: Consolidated) -> DataFrame:
    """The bodies (header, build_id, file_id, body) out of the output files, each checked for its length and checksum.

    Raises inside the job if a file's length or a checksum differs from the manifest.
    """
    folder = packs.files

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for header, parts, bodies in _checked(folder, batch):
                columns = [pa.array([header] * len(parts)), pa.array([p["build_id"] for p in parts], pa.int64()), pa.array([p["file_id"] for p in parts], pa.int64()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["header", "build_id", "file_id", "body"])

    return _packs(spark, packs).mapInArrow(read, "header string, build_id long, file_id long, body binary")


RECORD = "build_id long, file_id long, frame int, edge_key long, vdw float, coulomb float, n_atom_pairs int"


def _json_cells(line: str) -> list[float] | None:
    """The five numbers of a JSON line, or None if it is broken or lacks one."""
    try:
        found = json.loads(line)
        return [float(found[f]) for f in FIELDS] if isinstance(found, dict) else None
    except (ValueError, KeyError, TypeError):
        return None


def _records(header: str, parts: list[dict], bodies: list[bytes]) -> pa.RecordBatch:
    """The records of the bodies of one class; each line is parsed once."""
    texts = pa.array([b.decode("utf-8", "replace") for b in bodies], pa.large_string())
    lists = pc.split_pattern_regex(texts, LINE_END)
    of, lines = pc.list_parent_indices(lists), pc.utf8_trim_whitespace(pc.list_flatten(lists))
    of, lines = (x.filter(pc.not_equal(lines, "")) for x in (of, lines))
    is_json = pc.starts_with(lines, "{")
    number = [_json_cells(line) for line in lines.filter(is_json).to_pylist()]
    good = [k for k, n in enumerate(number) if n is not None]
    found_of = [of.filter(is_json).to_numpy(zero_copy_only=False)[good]]
    found = [np.array([number[k] for k in good], float).reshape(-1, len(FIELDS))]
    sep = "," if "," in header else "\t"
    names = [h.strip() for h in header.split(sep)] if header not in ("", "{}") else FIELDS
    if set(FIELDS) <= set(names):
        place = [names.index(f) for f in FIELDS]
        plain = pc.invert(is_json)
        of, cells = of.filter(plain), pc.split_pattern(lines.filter(plain), sep)
        whole = pc.greater(pc.list_value_length(cells), max(place))
        of, cells = of.filter(whole), cells.filter(whole)
        columns = [pc.utf8_trim_whitespace(pc.list_element(cells, k)) for k in place]
        ok = pa.array(np.ones(len(of), bool))
        for c in columns:
            ok = pc.and_(ok, pc.match_substring_regex(c, NUMBER))
        found_of.append(of.filter(ok).to_numpy(zero_copy_only=False))
        found.append(np.stack([pc.utf8_ltrim(c.filter(ok), "+").cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1) if len(of) else np.empty((0, len(FIELDS))))
    at, x = np.concatenate(found_of).astype(np.int64), np.concatenate(found)
    fits = (np.abs(x[:, [0, 4]]) < 2**31).all(1) & (np.abs(x[:, 1]) < 2**62)
    at, x = at[fits], x[fits]
    build = pa.array([p["build_id"] for p in parts], pa.int64()).take(pa.array(at))
    file = pa.array([p["file_id"] for p in parts], pa.int64()).take(pa.array(at))
    arrays = [build, file, *(pa.array(x[:, k].astype(t)) for k, t in enumerate((np.int32, np.int64, np.float32, np.float32, np.int32)))]
    return pa.RecordBatch.from_arrays(arrays, names=["build_id", "file_id", *FIELDS])


def read_records(spark: SparkSession, packs: Consolidated) -> DataFrame:
    """The value records of the output files, one row for each line that is a record (repeats included), checked as ``read_bodies``.

    A line is a record if all five fields are there and are numbers; lines with missing fields, broken JSON and blank
    lines are none. Numbers may be written plainly or with an exponent. Without a header the fields come in the
    order of ``FIELDS``, separated by tabs.
    """
    folder = packs.files

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for header, parts, bodies in _checked(folder, batch):
                yield _records(header, parts, bodies)

    return _packs(spark, packs).mapInArrow(read, RECORD)


def distinct_records(records: DataFrame) -> DataFrame:
    """Each (build_id, frame, edge_key) once; of differing deliveries the one with the greatest file_id, then the greatest values."""
    rest = F.struct("file_id", "vdw", "coulomb", "n_atom_pairs")
    return records.groupBy("build_id", "frame", "edge_key").agg(F.max(rest).alias("r")).select("build_id", "frame", "edge_key", "r.vdw", "r.coulomb", "r.n_atom_pairs")
