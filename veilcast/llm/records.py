"""Operator 4, token-ID output: length-delimited binary records with masked checksums and an offset index.

A file is a run of frames: length (8 bytes, little-endian), masked CRC-32C of those 8 bytes, payload,
masked CRC-32C of the payload. A payload is one document: header (`<qBBxxI`: id, whether the id is
there, bytes in a token id, token count), then the token ids. Documents are range-partitioned and sorted by id, so
that the files in order hold ascending ids. The index is a table of its own: file, part, ordinal, id,
offset, length and count for each record; a reader that shuffles draws rows of the index and seeks, and one that
takes all deals out stretches of CHUNK_BYTES.

A task writes under a name of its own attempt and lists the file in the index only by committing its
index rows, so lost or repeated tasks leave no listed half-written file.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, require, shared_dir, worker_state
from .tokens import VOCABULARY, UnitEncoder, tokenizer_path

END_ID = 2
CACHE_UNITS = 600_000  # a cache generation of a worker; two full ones took about 230 MB
CHUNK_BYTES = 32 << 20  # of records that a reading task takes at a time; a longer record comes alone
HEADER = "<qBBxxI"
HEADER_BYTES = struct.calcsize(HEADER)
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
MASK_DELTA = 0xA282EAD8  # of the record format: rotate right by 15, add this
INDEX_SCHEMA = "part int, ordinal long, id long, has_id boolean, file string, offset long, length long, n_tokens long"


def _spread(basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables for the low and high 16 bits of the linear map with these 32 images."""
    out = []
    for half in (basis[:16], basis[16:]):
        table = np.zeros(1, dtype=np.uint32)
        for image in half:
            table = np.concatenate([table, table ^ image])
        out.append(table)
    return out[0], out[1]


def _apply(tables: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(0xFFFF)] ^ tables[1][x >> np.uint32(16)]


@lru_cache(maxsize=40)
def _advance(level: int) -> tuple[np.ndarray, np.ndarray]:
    """The map that takes a CRC state over 4 * 2**level zero bytes."""
    if level == 0:
        basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(32):
            basis = (basis >> np.uint32(1)) ^ np.where(basis & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        return _spread(basis)
    half = _advance(level - 1)
    return _spread(_apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32))))


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part of 4 bytes or more. Parts of like length are folded together as rows of a
    matrix, padded on the left (leading zeros leave a zero state as it is)."""
    out = np.zeros(len(parts), dtype=np.uint32)
    levels: dict[int, list[int]] = {}
    for k, p in enumerate(parts):
        levels.setdefault(max(0, ((len(p) + 3) // 4 - 1).bit_length()), []).append(k)
    for level, members in levels.items():
        width = 4 << level
        step = max(1, (1 << 24) // width)
        for at in range(0, len(members), step):
            block = members[at : at + step]
            rows = np.frombuffer(b"".join(parts[k].rjust(width, b"\0") for k in block), dtype=np.uint8).reshape(len(block), width).copy()
            first = width - np.array([len(parts[k]) for k in block])
            for b in range(4):
                rows[np.arange(len(block)), first + b] ^= 0xFF
            x = rows.view("<u4")
            for k in range(level):
                x = _apply(_advance(k), x[:, 0::2]) ^ x[:, 1::2]
            out[block] = ~_apply(_advance(0), x[:, 0])
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((n, struct.pack("<I", h), p, struct.pack("<I", t))) for n, h, p, t in zip(lengths, heads, payloads, tails)]


def unframe(blob: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """(offset, payload) of each whole frame in blob, and where the rest begins; raises on a bad checksum."""
    found, heads, head_sums, sums, at = [], [], [], [], 0
    while at + 12 <= len(blob):
        (n,) = struct.unpack_from("<Q", blob, at)
        if at + 16 + n > len(blob):
            break
        heads.append(blob[at : at + 8])
        head_sums.append(blob[at + 8 : at + 12])
        found.append((at, blob[at + 12 : at + 12 + n]))
        sums.append(blob[at + 12 + n : at + 16 + n])
        at += 16 + n
    if found:
        for said, of in ((head_sums, heads), (sums, [p for _, p in found])):
            if not np.array_equal(np.frombuffer(b"".join(said), dtype="<u4"), masked(crc32c(of))):
                raise ValueError("a record's checksum is wrong")
    return found, at


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(df: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Writes every whole text as one record below `out` (a URI that pyarrow's file systems open) and its
    index to `out`/index; returns the index, reread.

    Null and empty texts are records of the end id alone. A null id sorts first and is read back as null;
    ids that repeat are all written, ordered by a hash of their text, so rows of one id may fill several files. An empty
    table gives an empty index. Other columns are ignored."""
    require(df, id_col, text_col)
    prepare(df.sparkSession)
    path = path or tokenizer_path(VOCABULARY)
    base, root = _filesystem(out)
    base.create_dir(f"{root}/data")
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = chosen.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, name = context.partitionId(), f"part-{context.partitionId():06d}-{uuid.uuid4().hex[:12]}.rec"

        def make() -> UnitEncoder:
            encoder = UnitEncoder(path, len, cache_units=CACHE_UNITS, whole_texts=True)
            kind, b = ("<u2", 2) if encoder.library.get_vocab_size() <= 1 << 16 else ("<u4", 4)

            def runs(ids, starts, ends):
                raw = ids.astype(kind).tobytes()
                return (raw[b * x : b * y] for x, y in zip(starts, ends))

            encoder.wrap, encoder.wrap_runs = lambda ids: ids.astype(kind).tobytes(), runs
            encoder.width = b
            return encoder

        encoder = worker_state(("ids", path), make)
        end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
        where, at, ordinal, stream = None, 0, 0, None
        for batch in batches:
            if stream is None:
                where, folder = _filesystem(f"{out}/data")
                stream = where.open_output_stream(f"{folder}/{name}")
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), 256):
                own, payloads, n = ids[k : k + 256], [], []
                for i, units in zip(own, encoder.batch(texts[k : k + 256])):
                    raw = b"".join(units) + end
                    n.append(len(raw) // encoder.width)
                    payloads.append(struct.pack(HEADER, i or 0, i is not None, encoder.width, n[-1]) + raw)
                rows = frames(payloads)
                lengths = np.array([len(r) for r in rows], dtype=np.int64)
                offsets = at + np.cumsum(lengths) - lengths
                stream.write(b"".join(rows))
                m = len(own)
                yield pa.record_batch(
                    [pa.array([part] * m, pa.int32()), pa.array(range(ordinal, ordinal + m), pa.int64()), pa.array([i or 0 for i in own], pa.int64()), pa.array([i is not None for i in own]), pa.array([name] * m), pa.array(offsets), pa.array(lengths), pa.array(n, pa.int64())],
                    names=["part", "ordinal", "id", "has_id", "file", "offset", "length", "n_tokens"],
                )
                at, ordinal = at + int(lengths.sum()), ordinal + m
        if stream is not None:
            stream.close()

    ordered.mapInArrow(write, INDEX_SCHEMA).write.option("compression", "zstd").parquet(f"{out}/index")
    return df.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{out}/index")


def read_records(spark: SparkSession, out: str, index: DataFrame, chunk_bytes: int | None = None) -> DataFrame:
    """(part, ordinal, id, first, n_tokens, ids_crc32, all long but part): every record that the index lists, read from its
    file with both checksums verified. `first` counts the ids before a record in its file, ids_crc32 is of the
    ids as little-endian unsigned 32-bit integers.

    Files are dealt out in stretches of about chunk_bytes, as the index cuts them, over as many tasks as there are stretches."""
    chunk_bytes = chunk_bytes or CHUNK_BYTES
    by_chunk = index.groupBy("part", "file", F.floor(F.col("offset") / chunk_bytes).alias("chunk"))
    stretch = by_chunk.agg(F.count("*").alias("records"), F.min("ordinal").alias("ordinal"), F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy("part", "file").orderBy("chunk")) - F.col("n")
    chunks = stretch.select("part", "file", "records", "ordinal", "begin", "stop", "n", before.alias("first"))
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = chunks.repartition(max(1, math.ceil(total / chunk_bytes)), "file", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, records, ordinal, begin, stop, n_ids, first in zip(*[c.to_pylist() for c in batch.columns]):
                where, folder = _filesystem(f"{out}/data")
                with where.open_input_file(f"{folder}/{file}") as f:
                    blob = f.read_at(stop - begin, begin)
                found, used = unframe(blob)
                if used != stop - begin or len(found) != records:
                    raise ValueError(f"{file} has {len(found)} records from {begin} on; the index lists {records}")
                ids, starts, n, sums, at = [], [], [], [], first
                for _, p in found:
                    i, has, width, count = struct.unpack_from(HEADER, p)
                    tokens = np.frombuffer(p, dtype=f"<u{width}", offset=HEADER_BYTES)
                    if len(tokens) != count:
                        raise ValueError(f"{file} holds a record of a wrong count")
                    ids.append(i if has else None)
                    starts.append(at)
                    n.append(count)
                    sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    at += count
                if at != first + n_ids:
                    raise ValueError(f"{file} holds {at - first} ids from {begin} on; the index lists {n_ids}")
                m = len(found)
                yield pa.record_batch(
                    [pa.array([part] * m, pa.int32()), pa.array(range(ordinal, ordinal + m), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "ordinal", "id", "first", "n_tokens", "ids_crc32"],
                )

    return dealt.mapInArrow(read, "part int, ordinal long, id long, first long, n_tokens long, ids_crc32 long")


def read_at(out: str, rows: list[tuple[str, int, int]]) -> list[tuple[int | None, np.ndarray]]:
    """(id, token ids) of records given by (file, offset, length) of the index, in the order asked for."""
    where, folder = _filesystem(f"{out}/data")
    got = []
    for file, offset, length in rows:
        with where.open_input_file(f"{folder}/{file}") as f:
            found, used = unframe(f.read_at(length, offset))
        if used != length or len(found) != 1:
            raise ValueError(f"no record at {offset} of {file}")
        i, has, width, _ = struct.unpack_from(HEADER, found[0][1])
        got.append((i if has else None, np.frombuffer(found[0][1], dtype=f"<u{width}", offset=HEADER_BYTES)))
    return got


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    found = read_records(spark, out, index).join(before, "part")
    return found.select(F.col("id").alias("doc_id"), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
