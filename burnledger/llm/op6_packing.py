"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document is cut into full windows and a rest. The rests of a block of documents are spread over windows by multiway
differencing: every item starts as a partial partition (its length in one window, nothing in the others); the two
partial partitions with the largest imbalance are merged, the fullest window of one meeting the emptiest of the other,
until one partition is left. It is accepted if its fullest window holds at most the capacity; otherwise the number of
windows rises. Rests are cut at quarters of a window first: with four and more items a window the differences even out
and little is left to pad.

Each task packs its own documents in blocks of bounded size, so there is no shuffle. Sequence ids are unique, not
dense: the task's number in the upper bits, a running number in the lower ones.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from burnledger.llm import common
from burnledger.llm.encoder import END_ID, ID_BYTES, default_vocabulary, encoder, slices

CAPACITY = 1024
BLOCK_DOCS = 256  # documents that are packed together; merging partitions takes time with the square of it
PART_BITS = 33
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Multiway differencing: items spread over `windows`; returns the items of each window that has any.

    A partial partition lists its non-empty windows, fullest first, each as load * 2^32 + node; a node is an item or
    joins two nodes. Ties fall to the older partition.
    """
    mask, joined = (1 << 32) - 1, [None] * len(sizes)
    heap = [(-size, i, [(size << 32) + i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - windows)  # windows that hold items of either side
        alone = a[: len(a) - both] + b[: len(b) - both]
        for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True):
            alone.append(((x >> 32) + (y >> 32) << 32) + len(joined))
            joined.append((x & mask, y & mask))
        alone.sort(reverse=True)
        least = alone[-1] >> 32 if len(alone) == windows else 0
        heapq.heappush(heap, (least - (alone[0] >> 32), count, alone))
        count += 1
    out = []
    for load in heap[0][2] if heap else []:
        items, todo = [], [load & mask]
        while todo:
            node = todo.pop()
            if joined[node] is None:
                items.append(node)
            else:
                todo += joined[node]
        out.append(items)
    return out


def spread(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items spread over as few windows as differencing manages within the capacity."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity)) if sizes else 0
    while windows:
        found = difference(sizes, windows)
        over = max(sum(sizes[i] for i in w) for w in found) - capacity
        if over <= 0:
            return found
        windows += 1
    return []


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of a block; windows count from 0, offsets have no gaps."""
    out, window, rests = [], 0, []
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((doc, k * capacity, capacity, window, 0))
            window += 1
        quarter = max(1, capacity // 4)
        rests += [(doc, at, min(quarter, n - at)) for at in range(full * capacity, n, quarter)]
    for items in spread([r[2] for r in rests], capacity):
        offset = 0
        for i in sorted(items):
            doc, start, n = rests[i]
            out.append((doc, start, n, window, offset))
            offset += n
        window += 1
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, block_docs: int = BLOCK_DOCS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every whole text (null: empty) with its end id into windows of at most `capacity` ids; a row a piece.

    A document whose id is null or repeated is packed like any other. Empty texts hold the end id alone. Sequences are
    to be padded to the capacity, or left alone where their length is a power of two. An empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, used = TaskContext.get().partitionId() << PART_BITS, 0
        encode, names, raw = encoder(vocabulary).encode_all, [], []

        def close() -> pa.RecordBatch:
            nonlocal used
            rows = pack_block([len(x) // ID_BYTES for x in raw], capacity)
            columns = [
                pa.array([names[d] for d, *_ in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(raw[d][s * ID_BYTES : (s + n) * ID_BYTES]) for d, s, n, _, _ in rows], pa.int64()),
                pa.array([len(raw[d]) // ID_BYTES for d, *_ in rows], pa.int64()),
                pa.array([base + used + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            used += max(r[3] for r in rows) + 1
            return pa.RecordBatch.from_arrays(
                columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for batch in batches:
            for piece in slices(batch, 1):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist()), strict=True):
                    names.append(doc_id)
                    raw.append(ids + end)
                    held += len(ids)
                    if len(names) >= block_docs or held >= ID_BYTES * 4_000_000:
                        yield close()
                        names, raw, held = [], [], 0
        if names:
            yield close()

    return common.keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)
