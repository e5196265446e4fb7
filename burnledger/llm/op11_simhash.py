"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Fingerprints that differ in at most
`bits` places are linked; equal ones are one node, so copies never meet each other.

A fingerprint is cut into more blocks than `bits`. Two that link differ in at most `bits` blocks and agree in all others,
so they share one of the keys made of that many whole blocks; all fingerprints of a key are compared. More blocks mean
more but longer keys: their number follows from the count of fingerprints, which keeps the random company in a key small
at any size. Only links that join two parts of a key's members are reported (a spanning forest), never all pairs.

A key with over `CROWD` fingerprints is not compared as it stands. Fingerprints that link have a point between them that is
at most half the distance from either, so the crowd's members are listed under all points so near to them (2,081 for four
bits) instead. A point has no more fingerprints than that near it, whatever the input.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common

WORDS = 4
BITS = 4  # fingerprints that differ in as many places at most are linked
SEED = 42
WIDTH = 64
CROWD = 4_096  # fingerprints of a key that are compared with each other
FEW = 16  # up to here all links of a key are reported, beyond it only a spanning forest
COMPARED = 16  # comparisons that cost as much as one more key
LEAST_KEPT = 2  # blocks in a key: one block alone has 12 bits, which is crowded from 10^5 fingerprints on
MOST_BLOCKS = 16
PART = 1 << 17  # shingles that are hashed at a time


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's shingles, repeats included; a text with fewer words is one shingle, one without words is 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    words = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(found) - words + 1]
    ends, total = ends[words - 1 :], np.zeros(WIDTH, np.int64)
    for at in range(0, len(starts), PART):
        spans = zip(starts[at : at + PART].tolist(), ends[at : at + PART].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print (the fingerprint's 64 bits as a long) of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(text, words) for text in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "print"])

    return common.per_slice(common.keyed(docs, id_col, text_col), run, "doc_id long, print long")


def masks(blocks: int, bits: int = BITS) -> list[int]:
    """The key masks: all choices of blocks - bits whole blocks, as signed 64-bit numbers."""
    cuts = [WIDTH * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(kept) - ((sum(kept) >> 63) << 64) for kept in itertools.combinations(parts, blocks - bits)]


def blocks_for(n: int, bits: int = BITS) -> int:
    """The number of blocks that makes the fewest keys and random comparisons for n fingerprints."""
    def cost(blocks: int) -> float:
        company = n / 2.0 ** (WIDTH * (blocks - bits) / blocks)
        return math.comb(blocks, bits) * (1 + company / COMPARED)

    return min(range(bits + LEAST_KEPT, max(bits + LEAST_KEPT, MOST_BLOCKS) + 1), key=cost)


def near_points(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Each print with all points at most half of `bits` (rounded up) away from it: columns mask (-1), key, print."""
    flips = np.array([sum(1 << b for b in chosen) for k in range((bits + 1) // 2 + 1)
                      for chosen in itertools.combinations(range(WIDTH), k)], np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        points = (found[:, None] ^ flips[None, :]).ravel().view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(points), -1, np.int32)), pa.array(points),
                                           pa.array(np.repeat(found, len(flips)).view(np.int64))], ["mask", "key", "print"])

    return common.per_slice(prints.select("print"), run, "mask int, key long, print long", rows=32)


def forest(values: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that connect the distinct values as far as differences of at most `bits` places do; fewer than values."""
    out, rest = [], values
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(x, y) for y in found]
                todo += list(found)
    return out


def compare(batches: Iterator[pa.RecordBatch], bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """Links among the prints of equal (mask, key), given in this order. Only the last key's prints are kept meanwhile."""
    held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = tuple(np.concatenate([old, x.view(old.dtype)]) for old, x in zip(held, new, strict=True))
        mask, key, prints = held
        if not len(key):
            continue
        starts = np.append(0, np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1)
        last = starts[-1] if batch is not None else len(key)
        held = tuple(x[last:] for x in held)
        bounds = np.append(starts[starts < last], last)
        sizes, a, b = np.diff(bounds), [], []
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
        group, value = group[small], prints[:last][small]
        for step in range(1, FEW):
            if step >= len(value):
                break
            near = np.flatnonzero((group[step:] == group[:-step]) & (np.bitwise_count(value[step:] ^ value[:-step]) <= bits))
            a.append(value[near])
            b.append(value[near + step])
        for k in np.flatnonzero(sizes > FEW):
            links = np.array(forest(prints[bounds[k] : bounds[k + 1]], bits), np.uint64).reshape(-1, 2)
            a.append(links[:, 0])
            b.append(links[:, 1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def links(prints: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the distinct values of the column print, enough of them to connect whatever is linked."""
    spark = prints.sparkSession
    chosen = masks(blocks_for(prints.count(), bits), bits)
    keys = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(k).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(chosen)])).alias("k"))
    keys = keys.select("k.mask", "k.key", "print")
    crowds = common.stored(keys.groupBy("mask", "key").count().where(F.col("count") > crowd).select("mask", "key"), spark)
    if crowds.head(1):  # else there is nothing to take out
        members = keys.join(crowds, ["mask", "key"], "left_semi").select("print").distinct()
        keys = keys.join(crowds, ["mask", "key"], "left_anti").union(near_points(members, bits))
    dealt = keys.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(lambda batches: compare(batches, bits), "a long, b long")


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text",
               crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest id reachable by links) of every row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows that repeat an id get a row
    each, and take part in the links of each. A null id is never the smallest; a component with null ids only has a null
    component_id. Other columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = common.stored(fingerprints(docs, words, id_col, text_col), spark)
    nodes = common.stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), spark)
    roots = common.connected(links(nodes.select("print"), bits, crowd), spark)
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(first, "root").select("print", "component_id")
    return prints.join(of, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
