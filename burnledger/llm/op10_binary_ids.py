"""Token-id files: fixed-size id blocks, transposed into byte or bit planes, each plane compressed on its own.

One file ("shard") holds the ids of consecutive documents:

    magic "TPLN1\\n"
    planes   block by block, plane by plane (least significant first), each a zstandard frame
    index    one record a block: ids, plane kind (0 bytes, 1 bits), number of planes, then the compressed size of each
             plane; after it the length of each document, all as unsigned little-endian 32-bit numbers
    footer   blocks, documents, bytes of the index (three unsigned 32-bit numbers), magic

Planes that only hold zeros are not stored. Blocks can be read alone through the index. The shards are binary values
of a table written by Spark (one row a shard, with its place in the order), so that they land in shared storage and a
repeated task leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnledger.llm import common
from burnledger.llm.encoder import END_ID, ID_BYTES, default_vocabulary, encoder, slices

MAGIC = b"TPLN1\n"
BLOCK_IDS = 65_536
SHARD_IDS = 2_000_000  # a shard is closed at the first document end beyond this many ids
LEVEL = 3
CACHE_WORDS = 800_000  # pieces that a worker keeps, about 150 MB; shards of ids leave room for more than packing keeps
SHARD_SCHEMA = "part int, shard int, n_docs int, n_ids long, doc_ids array<long>, payload binary"
RESULT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _block(ids: np.ndarray, level: int, kind: int) -> tuple[list[int], list[bytes]]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level)
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, ID_BYTES)
    used = (int(ids.max()).bit_length() if len(ids) else 0) or 1
    if kind:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(used)]
    else:
        planes = [raw[:, b].tobytes() for b in range((used + 7) // 8)]
    frames = [squeeze.compress(p) for p in planes]
    return [len(ids), kind, len(frames), *map(len, frames)], frames


def pack_shard(ids: np.ndarray, lengths: list[int], block_ids: int = BLOCK_IDS, level: int = LEVEL,
               bit_planes: bool = False) -> bytes:
    """The bytes of one file."""
    body, index = [MAGIC], []
    blocks = range(0, len(ids), block_ids)
    for start in blocks:
        record, frames = _block(ids[start : start + block_ids], level, int(bit_planes))
        index += record
        body += frames
    table = np.array([*index, *lengths], dtype="<u4").tobytes()
    foot = np.array([len(blocks), len(lengths), len(table)], dtype="<u4").tobytes()
    return b"".join([*body, table, foot, MAGIC])


def unpack_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document lengths of one file; fails on a damaged one."""
    import zstandard

    tail = len(payload) - len(MAGIC) - 12
    if tail < len(MAGIC) or payload[: len(MAGIC)] != MAGIC or payload[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a token-id file, or cut short")
    n_blocks, n_docs, n_index = np.frombuffer(payload, "<u4", 3, tail).tolist()
    table = np.frombuffer(payload, "<u4", n_index // 4, tail - n_index)
    expand, at, pos, out = zstandard.ZstdDecompressor(), len(MAGIC), 0, []
    for _ in range(n_blocks):
        n, kind, n_planes = table[pos : pos + 3].tolist()
        raw = np.zeros((n, ID_BYTES * 8 if kind else ID_BYTES), dtype=np.uint8)
        for plane, size in enumerate(table[pos + 3 : pos + 3 + n_planes].tolist()):
            data = np.frombuffer(expand.decompress(payload[at : at + size]), np.uint8)
            raw[:, plane] = np.unpackbits(data, count=n, bitorder="little") if kind else data
            at += size
        pos += 3 + n_planes
        raw = np.packbits(raw, axis=1, bitorder="little") if kind else raw
        out.append(np.ascontiguousarray(raw).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4"), table[pos : pos + n_docs]


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id",
              text_col: str = "text", partitions: int | None = None, bit_planes: bool = False) -> None:
    """Encodes every whole text, appends the end id, and writes shards in ascending id order to the folder `path`.

    Rows with a null id come first; rows that share an id are ordered by the hash of their text. A null or empty text
    is the end id alone. An empty table gives an empty folder that read_ids() reads as no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (common.keyed(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encode, names, raw, lengths, held = encoder(vocabulary, CACHE_WORDS).encode_all, [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = pack_shard(np.frombuffer(b"".join(raw), "<u4"), lengths, bit_planes=bit_planes)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int32()),
                pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], ["part", "shard", "n_docs", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for piece in slices(batch, 1):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist()), strict=True):
                    names.append(doc_id)
                    raw.append(ids + end)
                    lengths.append(len(raw[-1]) // ID_BYTES)
                    held += lengths[-1]
                    if held >= SHARD_IDS:
                        yield close()
                        shard, names, raw, lengths, held = shard + 1, [], [], [], 0
        if names:
            yield close()

    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, optionally the ids.

    Only the number of ids of each shard (a row a shard, not a row a document) is summed up in order to place them.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # Offsets: shards in order within a part, parts by a running sum over one row a part.
    from pyspark.sql import Window

    sizes = shards.select("part", "shard", "n_ids")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = parts.withColumn("before", F.coalesce(
        F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = (sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
              .join(before.select("part", "before"), "part")
              .select("part", "shard", (F.col("within") + F.col("before")).alias("first")))

    def documents(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row = {name: batch.column(i)[0].as_py() for i, name in enumerate(batch.schema.names)}
        ids, lengths = unpack_shard(row["payload"])
        ends = np.cumsum(lengths, dtype=np.int64)
        starts = ends - lengths
        raw = ids.tobytes()
        spans = list(zip((starts * ID_BYTES).tolist(), (ends * ID_BYTES).tolist(), strict=True))
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()),
                   pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array([np.frombuffer(raw[a:b], "<u4").astype(np.int64) for a, b in spans], pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)

    placed = shards.select("part", "shard", "doc_ids", "payload").join(F.broadcast(places), ["part", "shard"]) \
        if _few(places) else shards.select("part", "shard", "doc_ids", "payload").join(places, ["part", "shard"])
    schema = RESULT_SCHEMA + (", ids array<long>" if keep_ids else "")
    return common.per_slice(placed.select("doc_ids", "first", "payload"), documents, schema, rows=1)


def _few(places: DataFrame, most: int = 200_000) -> bool:
    """Whether the shards are few enough (20 bytes each) to send their places to every executor."""
    return places.limit(most + 1).count() <= most


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Copies each shard into a file of its own below a local folder, shard by shard; returns their number."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "shard", "payload").toLocalIterator():
        with open(os.path.join(folder, f"{row.part:06d}-{row.shard:06d}.tpln"), "wb") as f:
            f.write(row.payload)
        n += 1
    return n


def token_files(docs: DataFrame, vocabulary: str | None = None, **columns: str) -> DataFrame:
    """Writes the documents to a fresh shared folder and returns what the files say about each of them."""
    path = common.scratch(docs.sparkSession)
    write_ids(docs, path, vocabulary, **columns)
    return read_ids(docs.sparkSession, path)
