"""Media columns: content-addressed payloads as grey-scale images in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable, release
from tideline.session import scratch_path, ship_package

WIDTH = 576
PAD = b"\xff"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and the IHDR chunk


def payload_of(raw: bytes) -> bytes:
    """``raw`` filled with bytes 255 to a positive multiple of 576."""
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A PNG of 8-bit grey samples, 576 wide; equal payloads give equal bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # a leading 0 a line: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header(start: bytes) -> dict:
    """Width, height, depth and channels from the first 33 bytes of a stored image."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not a stored image")
    width, height, depth, colour = struct.unpack(">IIBB", start[16:26])
    return {"width": width, "height": height, "bits": depth, "channels": 1 if colour == 0 else 3}


def decode(stored: bytes) -> bytes:
    """The payload of a stored image; raises ValueError on any damage."""
    found, at, data = header(stored[:HEADER_BYTES]), 8, []
    while at < len(stored):
        size = struct.unpack(">I", stored[at:at + 4])[0]
        kind, body = stored[at + 4:at + 8], stored[at + 8:at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size:at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(found["height"], found["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered line")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, meta: dict) -> str:
    """Size, mean sample and a 16-bin histogram in thousandths, all from integers."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
    return f"{meta['width']}x{meta['height']}x{meta['bits']}/{meta['channels']};mean={mean};hist=" + "-".join(map(str, bins))


MANIFEST = ("doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text",
                 shard_bytes: int = 64 << 20) -> DataFrame:
    """Store the texts of ``docs`` and return the manifest, one row per document.

    A task appends the images of its documents to tar shards of about ``shard_bytes``, each image once a shard and
    under its digest.  A row names the digest of the stored form, its shard, and the offset and length of the image
    itself inside the shard.  Every attempt of a task writes shards of new names: the manifest of the attempt that
    counts never points at another's bytes, and ``sweep`` removes shards that no row names.
    """

    def run(batches):
        filesystem, base = _filesystem(root)
        name, out, at, seen = None, None, 0, {}
        try:
            for batch in batches:
                rows = [[] for _ in range(5)]
                for raw in batch.column(1).cast(pa.binary()):
                    raw = raw.as_py() or b""
                    key = hashlib.sha256(raw).digest()
                    if key not in seen:
                        if out is None or at >= shard_bytes:
                            if out is not None:
                                out.write(b"\0" * 1024)
                                out.close()
                            name = uuid.uuid4().hex
                            name, at, seen = f"{name[:2]}/{name}.tar", 0, {}
                            filesystem.create_dir(f"{base}/{name[:2]}", recursive=True)
                            out = filesystem.open_output_stream(f"{base}/{name}")
                        stored = encode(payload_of(raw))
                        digest = hashlib.sha256(stored).hexdigest()
                        entry = tarfile.TarInfo(f"{digest}.png")
                        entry.size = len(stored)
                        head = entry.tobuf(tarfile.USTAR_FORMAT) if len(stored) < 8 << 30 else entry.tobuf(tarfile.GNU_FORMAT)
                        out.write(head + stored + b"\0" * (-len(stored) % 512))
                        seen[key] = (digest, name, at + len(head), len(stored))
                        at += len(head) + len(stored) + -len(stored) % 512
                    for column, value in zip(rows, (len(raw), *seen[key])):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                     pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())],
                    names=[c.split()[0] for c in MANIFEST.split(", ")])
        finally:
            if out is not None and not out.closed:
                out.write(b"\0" * 1024)
                out.close()

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, MANIFEST)


def sweep(root: str, manifest: DataFrame) -> int:
    """Remove shards that no row of ``manifest`` names (left by lost attempts); their number is returned.

    Shards lie in 256 folders by the start of their names; each is listed in a task beside the names that count.
    """
    spark = manifest.sparkSession
    named = manifest.select("shard").distinct().select(F.substring("shard", 1, 2).alias("at"), "shard")
    folders = spark.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("at"))

    def clean(folder: pa.Table, names: pa.Table) -> pa.Table:
        from pyarrow import fs

        filesystem, base = _filesystem(root)
        counts, gone = set(names.column("shard").to_pylist()), 0
        for at in folder.column("at").to_pylist():
            for file in filesystem.get_file_info(fs.FileSelector(f"{base}/{at}", allow_not_found=True)):
                if f"{at}/{file.base_name}" not in counts:
                    filesystem.delete_file(file.path)
                    gone += 1
        return pa.table({"n": pa.array([gone], pa.int64())})

    return folders.groupBy("at").cogroup(named.groupBy("at")).applyInArrow(clean, "n long").agg(F.sum("n")).first()[0]


def _open(filesystem, base: str, shard: str, opened: dict):
    """The shard's file; only the last one used stays open."""
    if shard not in opened:
        for file in opened.values():
            file.close()
        opened.clear()
        opened[shard] = filesystem.open_input_file(f"{base}/{shard}")
    return opened[shard]


def locations(manifest: DataFrame) -> DataFrame:
    """One place per digest: copies that several tasks have stored are read at the first of them only."""
    first = F.min(F.struct("shard", "offset", "length", "n_bytes")).alias("p")
    return manifest.groupBy("digest").agg(first).select("digest", "p.*")


PLACES = "digest string, shard string, offset long, length long, n_bytes long"
METADATA = f"{PLACES}, width long, height long, bits long, channels long"


def read_metadata(places: DataFrame, root: str) -> DataFrame:
    """``places`` with width, height, bits and channels of each image, from range reads of 33 bytes."""

    def run(batches):
        filesystem, base = _filesystem(root)
        opened = {}
        for batch in batches:
            found = []
            for shard, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found.append(header(_open(filesystem, base, shard, opened).read_at(HEADER_BYTES, offset)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([f[k] for f in found], pa.int64()) for k in ("width", "height", "bits", "channels")]],
                names=[c.split()[0] for c in METADATA.split(", ")])

    rows = places.select(*[c.split()[0] for c in PLACES.split(", ")]).sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(run, METADATA)


FEATURES = ("digest string, width long, height long, bits long, channels long, payload_bytes long, payload_sha256 string, "
            "tail_crc32 long, media_bytes long, media_sha256 string, feature string, text_bytes long, text_sha256 string")


def read_features(described: DataFrame, root: str) -> DataFrame:
    """Checksums and the feature of each image of :func:`read_metadata`, from the bytes that are stored.

    An image whose bytes don't have its digest raises an error: wrong data are never returned.
    """
    fields = ("width", "height", "bits", "channels")

    def run(batches):
        filesystem, base = _filesystem(root)
        opened = {}
        for batch in batches:
            out = [[] for _ in range(13)]
            for digest, shard, offset, length, n_bytes, *meta in zip(*(batch.column(i).to_pylist() for i in range(9))):
                stored = _open(filesystem, base, shard, opened).read_at(length, offset)
                if hashlib.sha256(stored).hexdigest() != digest:
                    raise ValueError(f"{shard} at {offset}: stored bytes don't match {digest}")
                payload = decode(stored)
                row = (digest, *meta, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored),
                       digest, feature_of(payload, dict(zip(fields, meta))), n_bytes, hashlib.sha256(payload[:n_bytes]).hexdigest())
                for column, value in zip(out, row):
                    column.append(value)
            names, kinds = zip(*(c.split() for c in FEATURES.split(", ")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(out, kinds)], names=list(names))

    return described.mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> DataFrame:
    """Store every text, read it back and return the manifest with metadata columns and features.

    Null text is stored as empty text (one line of bytes 255).  Equal texts share one digest and one set of values;
    repeated rows stay; ids may be null; very long texts are one image each; extra columns are ignored; an empty table
    gives no rows.  Two texts that differ only in bytes 255 at
    the end can't occur, as UTF-8 has no such byte.
    """
    root = root or scratch_path(docs.sparkSession, "shards")
    manifest = durable(write_shards(docs, root, id_col, text_col), "media-manifest")
    sweep(root, manifest)
    places = durable(locations(manifest), "media-places")
    n = max(1, places.rdd.getNumPartitions())
    by_place = places.repartitionByRange(4 * n, "shard", "offset") if places.take(1) else places
    # a written table has plain shuffles under the join, so a frequent text can be split
    known = read_features(read_metadata(by_place, root), root)
    digests = ("payload_sha256", "text_sha256")
    known = durable(known.drop("media_sha256").withColumns({c: F.unhex(c) for c in digests}), "media-known")  # half as long
    release(places)
    known = known.withColumns({c: F.lower(F.hex(c)) for c in digests}).withColumn("media_sha256", F.col("digest"))
    return manifest.select("doc_id", "n_bytes", "digest", "shard", "offset", "length").join(known, "digest")


def unpack(shard: bytes) -> dict[str, bytes]:
    """All images of a shard by name, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
