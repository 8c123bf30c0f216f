"""Token ids in a binary format: bit planes, zstandard, and a chunk index.

Documents are range-partitioned by id and sorted in each task, so the shards
follow each other in id order.  A shard is a series of chunks.  A chunk holds
whole documents, and its ids are cut into blocks of ``BLOCK`` ids; a block is
transposed into 32 bit planes (bit b of all its ids together), the planes that
hold no bit are left out, and each other plane is compressed with zstandard.
The chunk's index gives, for each block and plane, the compressed length, and
for each document its id and length, so a reader can open one chunk alone.

Chunks and index are columns of a Parquet table, since executors have no other
store in common; ``ids of all documents before`` comes from the index alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables, token_ids

BLOCK = 8192
CHUNK_IDS = 1 << 18


def encode_block(ids: np.ndarray, level: int = 3) -> tuple[list[int], bytes]:
    """Compressed length of each of the 32 planes (0: no bit set), and the planes."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    parts = [press.compress(p.tobytes()) if p.any() else b"" for p in planes]
    return [len(p) for p in parts], b"".join(parts)


def decode_block(n: int, lengths: list[int], payload: bytes) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    planes = np.zeros((32, (n + 7) // 8), np.uint8)
    at = 0
    for b, size in enumerate(lengths):
        if size:
            planes[b] = np.frombuffer(expand.decompress(payload[at : at + size]), np.uint8)
            at += size
    bits = np.ascontiguousarray(np.unpackbits(planes, axis=1, count=n, bitorder="little").T)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def encode_chunk(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(plane lengths as unsigned 32-bit integers, 32 for each block; payload)."""
    lengths, parts = [], []
    for at in range(0, len(ids), BLOCK):
        sizes, part = encode_block(ids[at : at + BLOCK])
        lengths += sizes
        parts.append(part)
    return np.array(lengths, "<u4").tobytes(), b"".join(parts)


def decode_chunk(n: int, index: bytes, payload: bytes) -> np.ndarray:
    out = np.zeros(n, "<u4")
    lengths = np.frombuffer(index, "<u4").reshape(-1, 32)
    at = 0
    for k, sizes in enumerate(lengths):
        start = k * BLOCK
        stop, size = min(n, start + BLOCK), int(sizes.sum())
        out[start:stop] = decode_block(stop - start, sizes.tolist(), payload[at : at + size])
        at += size
    return out


def write_ids(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes the format and returns its table: one row for each chunk.

    Columns: shard int, chunk int, before long (ids of the shard's earlier
    chunks), n_ids long, doc_ids array<long>, doc_tokens array<long>,
    plane_index binary, payload binary, crc32 long of the chunk's raw ids.
    Null and empty texts are the end id alone.  Ids must be integers; null ids
    come first.  Repeated ids lie side by side, ordered by text.  An empty table
    gives an empty one."""
    path = vocabulary or token_ids.default_vocabulary()
    schema = (
        "shard int, chunk int, before long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
        "plane_index binary, payload binary, crc32 long"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
    end = np.array([end_id], "<u4").tobytes()

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = token_ids.encoder(path), TaskContext.get().partitionId()
        chunk, before = 0, 0
        keys: list[int | None] = []
        sizes: list[int] = []
        parts: list[bytes] = []

        def row() -> pa.RecordBatch:
            nonlocal chunk, before
            raw = b"".join(parts)
            ids = np.frombuffer(raw, "<u4")
            index, payload = encode_chunk(ids)
            values = (shard, chunk, before, len(ids), list(keys), list(sizes), index, payload, zlib.crc32(raw))
            chunk, before = chunk + 1, before + len(ids)
            for x in (keys, sizes, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        held = 0
        for batch in batches:
            for key, ids in token_ids.encoded_rows(encoder, batch):
                ids += end
                keys.append(key)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                held += sizes[-1]
                if held >= CHUNK_IDS:
                    yield row()
                    held = 0
        if keys:
            yield row()

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    n = max(2, tables.partitions(docs.sparkSession))
    dealt = picked.repartitionByRange(n, "_id").sortWithinPartitions("_id", "text")
    return tables.written(dealt.mapInArrow(run, schema), "token-ids")


def read_ids(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from a table that ``write_ids`` wrote.

    ``start`` counts the ids of all documents before.  A chunk whose ids do not
    match its checksum raises."""
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row a shard
    bases, total = {}, 0
    for r in sorted(sums, key=lambda r: r["shard"]):
        bases[r["shard"]] = total
        total += r["n"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                raw = decode_chunk(get("n_ids"), get("plane_index"), get("payload")).tobytes()
                if zlib.crc32(raw) != get("crc32"):
                    raise ValueError(f"chunk {get('chunk')} of shard {get('shard')} is damaged")
                start, view = bases[get("shard")] + get("before"), memoryview(raw)
                sizes = get("doc_tokens")
                ends = np.cumsum([0, *sizes])
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("doc_ids"), pa.int64()), pa.array(start + ends[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names,
                )

    wanted = chunks.select("shard", "chunk", "before", "n_ids", "doc_ids", "doc_tokens", "plane_index", "payload", "crc32")
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return read_ids(write_ids(docs))
