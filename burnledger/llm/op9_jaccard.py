"""Jaccard similarity join on word n-grams: size-aware, with heavy and light sets.

Every document is the set of its distinct n-word shingles (64-bit hashes); equal sets are one node. Two nodes link when
their Jaccard similarity reaches the threshold.

- Light sets (few shingles) enumerate subsets: two sets of sizes m and n that link share t(m, n) shingles, so both name
  one common subset of that size.
- Heavy sets scan inverted lists: of sets that link, the first n - t(n) + 1 elements in a common order share one, so
  only these prefixes are listed. The order is rare first: a sketch of fixed size counts all shingles, and those that
  stand out come last, the most frequent at the very end. Light sets that a heavy one may link to are listed as well.
- The boundary is the size up to which naming subsets costs less than scanning lists.

Named keys with one node only are dropped. A list's members are compared with one leader, which then leaves the list, a
few times; nodes found linked form components, and only list members that are still in different components are paired. Each
set has a parity sketch: one bit for each of 1,024 classes of hashes, the parity of the set's elements in it; sets of
over 512 elements have a wide one besides, of two to four bits an element. Two sketches differ in at most as many bits as the sets differ in elements, so a pair whose sketches differ in more bits
than linked sets of these sizes can is left before it is formed. No other candidate is dropped, so components are exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnledger.llm import common, wordhash

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20  # counters of the sketch, 4 MB whatever the input's size
SLICES = 16
MOST_LIGHT = 12  # the boundary is never above this size
ROUNDS = 4  # with leaders, at most
CROSSING = 4  # another round is made while lists hold more open pairs than this for each row that was listed at first
PARITIES = 1_024  # bits of a parity sketch
SEND_BYTES = 1 << 26  # copies of a text in one batch, beyond the first
SALT_ROWS = 256  # comparisons with one leader that a task takes on at a time
FILTER_BITS = 25  # of the filter that keeps texts nobody asks for from being shuffled, 4 MB at most whatever the input's size
SCHEMA = "doc_id long, n_shingles long, component_id long"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, one without words none."""
    found = wordhash.word_hashes(text, lower=True)
    if not len(found):
        return np.zeros(0, np.uint64)
    return np.unique(wordhash.run_hashes(found, min(words, len(found))))


def overlap(m: int, n: int, percent: int = PERCENT) -> int:
    """Shingles that sets of these sizes share at least if they link: s / (m + n - s) >= percent / 100."""
    return -(-percent * (m + n) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes of the sets that a set of size n may link to."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n: int, percent: int = PERCENT) -> int:
    """Elements of a set that have to be listed: all but the overlap with the smallest partner, and one more."""
    return n - -(-percent * n // 100) + 1


def sketch(found: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """Parity of the number of elements in each class of hashes, 64 classes a value."""
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def wide_sketch(found: np.ndarray) -> np.ndarray | None:
    """A sketch of two bits an element at least, or None if the usual one has as many."""
    bits = 1 << (2 * len(found) - 1).bit_length() if len(found) else 0
    return sketch(found, bits) if bits > PARITIES else None


def subset_keys(n: int, light: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent) if 0 < m <= light)


@dataclass
class Order:
    """Rarity class of each counter of the sketch (0: nothing stands out) and the boundary between light and heavy."""

    classes: np.ndarray
    light: int

    def arrange(self, found: np.ndarray) -> np.ndarray:
        """The set in the common order."""
        rank = self.classes[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        return found[np.lexsort((found, rank))]

    def keys(self, found: np.ndarray, percent: int = PERCENT) -> tuple[list[int], list[int]]:
        """The keys under which a set is listed, and the place of each in the set's order (0 for subsets)."""
        n, out = len(found), []
        if n <= self.light:
            for m in partners(n, percent):
                if 0 < m <= self.light:
                    sizes = min(n, m) * 1000 + max(n, m)
                    out += [xxhash.xxh64_intdigest(np.array(c, np.uint64).tobytes(), sizes)
                            for c in itertools.combinations(found.tolist(), overlap(n, m, percent))]
        subsets = np.unique(np.array(out, np.uint64)).view(np.int64).tolist()
        if n and partners(n, percent)[-1] > self.light:
            listed = self.arrange(found)[: prefix(n, percent)].view(np.int64).tolist()
            return subsets + listed, [0] * len(subsets) + list(range(len(listed)))
        return subsets, [0] * len(subsets)


def learn_order(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> Order:
    """Counts the shingles of all documents in a sketch and chooses the boundary. What is collected has a fixed size."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(size, np.int64), np.zeros(MOST_LIGHT + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingles(text, words)
                np.add.at(counts, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                sizes[min(len(found), MOST_LIGHT)] += 1
        part = np.array_split(counts, SLICES)
        for i, piece in enumerate([*part, sizes]):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece.astype("<i8").tobytes()])], ["slice", "counts"])

    def add(frame):  # noqa: ANN001, ANN202 - pandas
        total = sum(np.frombuffer(x, "<i8") for x in frame["counts"])
        return frame.head(1).assign(counts=[total.tobytes()])[["slice", "some", "counts"]]

    # Sums in three steps of up to 128 neighbouring parts, so that no group has more of them, even of a million partitions.
    parts = rows.select("text").mapInArrow(count, "slice int, counts binary").withColumn("some", F.spark_partition_id())
    for _ in range(3):
        parts = (parts.withColumn("some", F.shiftright("some", 7)).groupBy("slice", "some")
                 .applyInPandas(add, "slice int, some int, counts binary"))
    # Beyond two million partitions several sums are left, to be added here.
    found: dict[int, np.ndarray] = {}
    for r in parts.collect():
        found[r["slice"]] = found.get(r["slice"], 0) + np.frombuffer(r["counts"], "<i8")
    if not found:
        return Order(np.zeros(size, np.uint8), 0)
    counts = np.concatenate([found[i] for i in range(SLICES)])
    mean = float(np.median(counts))
    beyond = counts - (mean + 8 * math.sqrt(mean) + 32)
    classes = np.where(beyond > 0, np.ceil(np.log2(np.maximum(beyond, 1) + 1)), 0).astype(np.uint8)
    # Cost of a list key: as many rows as its list is long on average; of a subset key: one row.
    listed = float(np.square(np.maximum(counts - mean, 1.0)).sum() / max(1.0, np.maximum(counts - mean, 1.0).sum()))
    length = min(max(listed, 1.0), 1e6)
    sizes, best, light = found[SLICES], math.inf, 0
    for x in range(MOST_LIGHT):
        cost = sum(int(sizes[n]) * (subset_keys(n, x, percent) if n <= x else prefix(n, percent) * length)
                   for n in range(1, MOST_LIGHT))
        cost += sum(int(sizes[n]) * prefix(n, percent) * length for n in range(1, x + 1) if partners(n, percent)[-1] > x)
        if cost < best:
            best, light = cost, x
    return Order(classes, light)


def _sets(rows: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """doc_id, tie, node (hash of the set), n, sketch, wide, keys and their places in the set's order."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, sketches, wide, keys, places = [], [], [], [], [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text, words)
            sizes.append(len(found))
            sketches.append(sketch(found))
            wide.append(wide_sketch(found))
            nodes.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
            listed, at = shared.value.keys(found, percent)
            keys.append(listed)
            places.append(at)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())),
             pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            ["doc_id", "tie", "node", "n", "sketch", "wide", "keys", "places"])

    return common.per_slice(rows.select("doc_id", "tie", "text"), run, "doc_id long, tie long, node long, n long, "
                            "sketch array<long>, wide array<long>, keys array<long>, places array<int>")


def verified(pairs: DataFrame, rows: DataFrame, places: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b of nodes) that link, compared on their whole sets.

    places: node, doc_id, tie of one document of each node. Each node's text is fetched once and sent to the leaders
    (a) that it is paired with (texts compress, hashes do not); the partners of a leader are split into groups of
    bounded size, each of which gets the leader's text. Within a task rows are streamed in order: only the leader's set is kept.
    Texts of other documents leave before the shuffle.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    to = pairs.join(salts, "a").select(F.col("b").alias("node"), F.col("a").alias("leader"),
                                       (F.pmod(F.xxhash64("b"), F.col("salts"))).cast("int").alias("salt"))
    own = salts.select(F.col("a").alias("node"), F.col("a").alias("leader"),
                       F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wanted = to.union(own).groupBy("node").agg(F.collect_list(F.struct("leader", "salt")).alias("to"))
    wanted = wanted.join(places, "node").select("doc_id", "tie", "node", "to")
    texts = wanted.join(_asked_for(rows, wanted), ["doc_id", "tie"]).select("node", "to", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, to, text = (batch.column(k)[i].as_py() for k in range(3))
                some = max(1, min(64, SEND_BYTES // (len(text) + 1)))
                for start in range(0, len(to), some):
                    part = to[start : start + some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["leader"] for x in part], pa.int64()), pa.array([x["salt"] for x in part], pa.int32()),
                         pa.array([int(x["leader"] != node) for x in part], pa.int32()),
                         pa.array([node] * len(part), pa.int64()), pa.array([text] * len(part), pa.string())],
                        ["leader", "salt", "role", "node", "text"])

    sent = (texts.mapInArrow(send, "leader long, salt int, role int, node long, text string")
            .repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for leader, salt, role, node, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = shingles(text, words)
                if role == 0:
                    at, mine = (leader, salt), found
                    continue
                if at != (leader, salt):
                    raise ValueError("a leader's set is missing")
                both = len(np.intersect1d(mine, found, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(found) - both):
                    links.append((leader, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()),
                                              pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return sent.mapInArrow(compare, "a long, b long")


def _asked_for(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id and tie may occur in wanted: those whose hash has its bit set, so none that occurs is left out.

    The bits are broadcast in pieces of 4 KB, at most 2^FILTER_BITS in all. With more documents asked for, more others pass.
    """
    bit = F.shiftrightunsigned(F.xxhash64("doc_id", "tie"), 64 - FILTER_BITS)
    marked = (wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")))
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("bit", bit).join(F.broadcast(marked), F.bitmap_bucket_number("bit") == F.col("piece"))
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns))


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, tie, node, n; tie is a hash of the text) and the components of their nodes (node, root)."""
    spark = docs.sparkSession
    rows = common.keyed(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    sets = common.stored(_sets(rows, learn_order(rows, words, percent), words, percent), spark)
    listed = sets.select(F.explode(F.arrays_zip("keys", "places")).alias("k"), "node", "n").select(
        F.col("k.keys").alias("key"), F.col("k.places").alias("place"), "node", "n")
    # Keys of two nodes and more, by one shuffle of the listed rows.
    same = Window.partitionBy("key")
    repeated = (listed.withColumn("x", F.min("node").over(same)).withColumn("y", F.max("node").over(same))
                .where("x < y").drop("x", "y"))
    lists = common.stored(repeated.distinct(), spark)
    nodes = common.stored(sets.where("n > 0").join(lists.select("node").distinct(), "node", "left_semi").groupBy("node")
                          .agg(F.min(F.struct("doc_id", "tie")).alias("p"), F.any_value("n").alias("n"),
                               F.any_value("sketch").alias("sketch"), F.any_value("wide").alias("wide"))
                          .select("node", "n", "sketch", "wide", "p.doc_id", "p.tie"), spark)
    members = common.stored(sets.select("doc_id", "tie", "node", "n"), spark)
    common.discard(sets)
    # Rows with a null id are found again through a key that never is null.
    none = F.lit(-(1 << 63))
    whole = rows.select(F.coalesce("doc_id", none).alias("doc_id"), "tie", "text")
    places = nodes.select("node", F.coalesce("doc_id", none).alias("doc_id"), "tie")
    widest = nodes.select("node", "n", F.coalesce("wide", "sketch").alias("sketch"))

    def joined(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Components after the pairs that link are added."""
        pairs = common.stored(pairs, spark)
        found = common.stored(verified(pairs, whole, places, words, percent), spark)
        now = common.connected(found if roots is None else found.union(roots), spark)
        common.discard(pairs, found, *([] if roots is None else [roots]))
        return now

    lists, listed, roots, before = lists.withColumn("root", F.col("node")), lists.count(), None, math.inf
    for step in range(ROUNDS):
        roots = joined(_alike(_with_leaders(lists, step, percent), widest, percent), roots)
        still = common.stored(_open_lists(_without_leaders(lists, step, percent), roots), spark)
        common.discard(lists)
        lists, crossing = still, _crossing(still)
        if crossing <= CROSSING * listed or crossing > 0.9 * before:
            break
        before = crossing
    marked = lists.join(nodes.select("node", "sketch"), "node")
    other = marked.select("key", F.col("place").alias("place_a"), F.col("node").alias("a"), F.col("n").alias("n_a"),
                          F.col("root").alias("root_a"), F.col("sketch").alias("sketch_a"))
    pairs = marked.join(other, (marked["key"] == other["key"]) & (F.col("a") < F.col("node")) & (F.col("root") != F.col("root_a"))
                        & _near(percent) & _reach(percent) & _within(percent))
    pairs = pairs.select("a", F.col("node").alias("b")).distinct()
    return members, joined(_alike(pairs, widest, percent), roots)


def _near(percent: int) -> Column:
    return 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")


def _shared(percent: int) -> Column:
    """Shingles that two sets that link share at least."""
    return F.ceil(percent * (F.col("n") + F.col("n_a")) / (100 + percent))


def _reach(percent: int) -> Column:
    """Sets that link share a key among the first n - t + 1 elements of either, t as in _shared."""
    t = _shared(percent)
    return (F.col("place") <= F.col("n") - t) & (F.col("place_a") <= F.col("n_a") - t)


def _within(percent: int) -> Column:
    """The sketches differ in no more bits than linked sets of these sizes differ in elements."""
    bits = [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_a")[i])) for i in range(PARITIES // 64)]
    return sum(bits[1:], bits[0]) <= F.col("n") + F.col("n_a") - 2 * _shared(percent)


def _alike(pairs: DataFrame, widest: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose widest sketches allow a link; the wider of two is folded to the other's size."""
    def folded(one: str) -> Column:
        half = F.col("size")
        both = F.zip_with(F.slice(one, F.lit(1), half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(one) > half, both).otherwise(F.col(one))

    of_a = widest.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    held = (pairs.join(of_a, "a").join(widest.withColumnRenamed("node", "b"), "b")
            .withColumn("size", F.least(F.size("sketch"), F.size("sketch_a"))))
    bits = F.aggregate(F.zip_with(folded("sketch"), folded("sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda x, y: x + y)
    # Sizes of sets that may link differ by so little that widths differ by one doubling at most, if the share is over half.
    twice = F.greatest(F.size("sketch"), F.size("sketch_a")) > 2 * F.col("size")
    return held.where(twice | (bits <= F.col("n") + F.col("n_a") - 2 * _shared(percent))).select("a", "b")


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are in several components, each member with its component. Others never open again."""
    members = (lists.drop("root").join(roots, "node", "left")
               .select("key", "place", "node", "n", F.coalesce("root", "node").alias("root")))
    mixed = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return members.join(mixed, "key")


def _crossing(members: DataFrame) -> float:
    """Pairs of list members that are in different components, counted without forming them."""
    parts = members.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    whole = parts.groupBy("key").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"))
    return whole.agg(F.sum("p")).first()[0] or 0.0


def _led(members: DataFrame, step: int, percent: int) -> DataFrame:
    """Each list's members beside its leader, a for the leader.

    The first leader of a list has the smallest place in its own order, so that it reaches most members; later ones are
    drawn by a hash that changes with the step among members that reach sets of their own size.
    """
    far = F.col("place") > F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    rank = (F.struct(F.col("place").alias("first"), F.col("node").alias("second")) if step == 0 else
            F.struct(far.cast("int").alias("first"), F.xxhash64("node", F.lit(step)).alias("second")))
    leaders = (members.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "place", "node", "n", "root")).alias("l"))
               .select("key", F.col("l.place").alias("place_a"), F.col("l.node").alias("a"), F.col("l.n").alias("n_a"),
                       F.col("l.root").alias("root_a")))
    return members.join(leaders, "key")


def _with_leaders(members: DataFrame, step: int, percent: int) -> DataFrame:
    """The pairs of leaders (a) and members of their lists that are in different components and may link."""
    return (_led(members, step, percent).where((F.col("root") != F.col("root_a")) & _near(percent) & _reach(percent))
            .select("a", F.col("node").alias("b")).distinct())


def _without_leaders(members: DataFrame, step: int, percent: int) -> DataFrame:
    """The lists without their leaders: a leader has met every member of its list, so no pair of theirs is left open."""
    return _led(members, step, percent).where((F.col("node") != F.col("a")) | (F.col("place") != F.col("place_a"))) \
        .select(*members.columns)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row.

    Null, empty and wordless texts are sets without elements and form components of their own. Rows that repeat an id
    get a row each. A null id is never the smallest; a component with null ids only has a null component_id. An empty
    table gives no rows.
    """
    members, roots = links(docs, words, percent, id_col, text_col)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = rooted.where("n > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (full.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .union(rooted.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, ties by a hash of the text.

    Rows without an id come last, but take part. Rows with one id and text are one, whatever their other columns hold.
    Rows without words are linked with nothing; all of them stay.
    """
    members, roots = links(docs, words, percent, id_col, text_col)
    full = members.where("n > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = full.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("p"))
    kept = best.select(F.col("p.doc_id").alias("i"), F.col("p.tie").alias("t")).withColumn("full", F.lit(True))
    kept = kept.union(members.where("n = 0").select("doc_id", "tie", F.lit(False)).distinct()).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tie"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    once = found.where("full").dropDuplicates(["id", "tie"])
    return once.union(found.where("NOT full")).select("row.*")
