"""Substring deduplication with suffix automata of reference shards.

A window is `length` consecutive words. A word goes if a window that covers it also starts in a document with a smaller
id. One automaton of the whole corpus cannot be built or broadcast, and streaming every document past every shard
grows with the square of the corpus. So the corpus is sharded by content, and only text that can repeat is streamed:

1. Anchors. The least hash of the word 8-grams inside a window is a function of the window alone; equal windows have
   equal anchors. Anchors that one document has alone are dropped by an aggregate. Nothing that repeats is lost.
2. Contexts. Consecutive windows with the same shared anchor form a context: at most 2 * length words. Equal contexts
   are one row with their smallest document. Contexts of an anchor meet in one shard.
3. Anchors with very many different contexts (the rims of a passage that many documents hold) have their windows
   counted by hash first, and their contexts are cut down to windows that two documents share.
4. Each shard builds a suffix automaton over its contexts' words, in ascending order of document, so that every state
   knows the first document of its strings. The contexts are then streamed past it: the matching statistics, held at
   `length`, give for each window the smallest document that has it.
   Anchors that still have very many contexts (a template with a varying word, each value in two documents or more) are
   left out of the automata, so that a shard stays bounded: their windows are dealt by their own hash, and an aggregate
   gives the smallest document of each.
5. Windows whose smallest document is smaller than their own are joined back, merged to maximal spans, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common, wordhash

LENGTH = 50
GRAM = 8
SHARD_WORDS = 100_000  # words whose automaton a task holds, on average
MANY_CONTEXTS = 200  # contexts of an anchor beyond which they are cut down first
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Automaton:
    """Suffix automaton over word sequences; each state knows the first sequence (by number given) that holds it."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first = [-1]

    def add(self, words: list[bytes], number: int) -> None:
        """Adds a sequence. Numbers must not fall from one call to the next."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                first.append(number)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, q, word)
                last = new
            else:
                last = self._split(last, q, word)

    def _split(self, p: int, q: int, word: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        self.first.append(self.first[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def windows(self, words: list[bytes], length: int) -> list[int]:
        """For each window of the sequence the number of the first sequence that holds it, or -1."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = size[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            while size[link[state]] >= length if state else False:
                state = link[state]
            matched = min(matched, length)
            if i + 1 >= length:
                out.append(first[state] if matched >= length else -1)
        return out


def anchors(text: str | None, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window; empty if there are fewer words."""
    words = wordhash.word_hashes(text)
    if len(words) < length:
        return np.zeros(0, np.uint64)
    return wordhash.sliding_min(wordhash.run_hashes(words, gram), length - gram + 1)


def _runs(flags: np.ndarray, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of set flags, also cut where the label changes."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.diff(at) > 1
    if labels is not None:
        cut |= labels[at[1:]] != labels[at[:-1]]
    starts = at[np.append(True, cut)]
    ends = at[np.append(cut, True)] + 1
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


CONTEXT_SCHEMA = "row long, doc_id long, anchor long, digest long, start int, words binary"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                      ["row", "doc_id", "anchor", "digest", "start", "words"])


def _context(row: int, doc_id: int, anchor: int, words: list[bytes], start: int, end: int) -> tuple:
    text = b" ".join(words[start:end])
    return row, doc_id, anchor, xxhash.xxh64_intdigest(text) - (1 << 63), start, text


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, spans (array of start word, end word): what is to go from each row. rows: row, doc_id, text, ids not null."""
    spark = rows.sparkSession

    def list_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ids, found = [], [], []
        for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            distinct = np.unique(anchors(text, length, gram))
            found.append(distinct)
            names.append(np.full(len(distinct), row, np.int64))
            ids.append(np.full(len(distinct), doc_id, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c).view(np.int64)) for c in (names, ids, found)], ["row", "doc_id", "anchor"])

    listed = common.stored(common.per_slice(rows, list_anchors, "row long, doc_id long, anchor long"), spark)
    shared = listed.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor")
    marks = common.stored(listed.select("row", "anchor").join(shared, "anchor")
                          .groupBy("row").agg(F.collect_set("anchor").alias("anchors")), spark)

    def list_contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, doc_id, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            words = wordhash.split(text)
            own = anchors(text, length, gram)
            sorted_marks = np.sort(np.array(wanted, np.int64).view(np.uint64))
            at = np.minimum(np.searchsorted(sorted_marks, own), len(sorted_marks) - 1)
            for a, b in _runs(sorted_marks[at] == own, own):
                out.append(_context(row, doc_id, int(own[a].astype(np.int64)), words, a, b - 1 + length))
        return _context_batch(out)

    contexts = common.stored(common.per_slice(rows.join(marks, "row"), list_contexts, CONTEXT_SCHEMA), spark)
    distinct = contexts.groupBy("anchor", "digest").agg(F.min("doc_id").alias("doc_id"))
    many = common.stored(distinct.groupBy("anchor").count().where(F.col("count") > MANY_CONTEXTS).select("anchor"), spark)
    cut, spread = _by_route(common.stored(_cut_down(
        contexts.join(many, "anchor", "left_semi").select(*contexts.columns), length), spark), spark)
    contexts = contexts.join(many, "anchor", "left_anti").select(*contexts.columns, F.lit(False).alias("spread")).unionByName(cut)
    contexts = common.stored(contexts, spark)
    single = contexts.where("NOT spread")
    n_words = 2 * length * single.select("anchor", "digest").distinct().count()
    texts = _distinct(single)
    shards = max(1, -(-n_words // SHARD_WORDS))

    def stream(frame):  # noqa: ANN001, ANN202 - pandas
        frame = frame.sort_values("doc_id", kind="stable")
        automaton, sequences = Automaton(), [w.split(b" ") for w in frame["words"]]
        for words, doc_id in zip(sequences, frame["doc_id"], strict=True):
            automaton.add(words, doc_id)
        frame["smallest"] = [automaton.windows(words, length) for words in sequences]
        return frame[["anchor", "digest", "smallest"]]

    owners = (texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
              .groupBy("shard").applyInPandas(stream, "anchor long, digest long, smallest array<long>"))
    if spread:
        owners = owners.unionByName(_owners_by_window(_distinct(contexts.where("spread")), length, spark))
    gone = F.transform(F.filter(F.transform("smallest", lambda d, i: F.when((d >= 0) & (d < F.col("doc_id")), i)),
                                lambda i: i.isNotNull()), lambda i: (F.col("start") + i).cast("int"))
    return (contexts.select("row", "doc_id", "anchor", "digest", "start").join(owners, ["anchor", "digest"])
            .select("row", gone.alias("windows")).where(F.size("windows") > 0)
            .groupBy("row").agg(F.flatten(F.collect_list("windows")).alias("windows")))


def _distinct(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("anchor", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))


def _by_route(cut: DataFrame, spark) -> tuple[DataFrame, bool]:  # noqa: ANN001
    """Marks (spread) the contexts whose anchor has more than MANY_CONTEXTS different ones; whether there are any."""
    still = common.stored(cut.select("anchor", "digest").distinct().groupBy("anchor").count()
                          .where(F.col("count") > MANY_CONTEXTS).select("anchor", F.lit(True).alias("found")), spark)
    marked = cut.join(still, "anchor", "left").select(*cut.columns, F.coalesce("found", F.lit(False)).alias("spread"))
    return marked, not still.isEmpty()


def _owners_by_window(texts: DataFrame, length: int, spark) -> DataFrame:  # noqa: ANN001
    """What the automata give, anchor, digest and smallest, from the hashes of the windows; equal windows have equal anchors."""
    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for anchor, digest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            hashes = wordhash.run_hashes(wordhash.hashed(text), length).view(np.int64).tolist()
            rows += [(anchor, digest, doc_id, at, h) for at, h in enumerate(hashes)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in range(5)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                          ["anchor", "digest", "doc_id", "at", "hash"])

    listed = common.stored(common.per_slice(texts.select("anchor", "digest", "doc_id", "words"), places,
                                            "anchor long, digest long, doc_id long, at int, hash long"), spark)
    least = listed.groupBy("anchor", "hash").agg(F.min("doc_id").alias("least"))
    found = F.array_sort(F.collect_list(F.struct("at", "least")))
    return (listed.join(least, ["anchor", "hash"]).groupBy("anchor", "digest")
            .agg(F.transform(found, lambda x: x["least"]).alias("smallest")))


def _cut_down(contexts: DataFrame, length: int) -> DataFrame:
    """The contexts cut down to runs of windows whose hash two documents have."""
    def list_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hashes = np.unique(wordhash.run_hashes(wordhash.hashed(text), length))
            found.append(hashes)
            ids.append(np.full(len(hashes), doc_id, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))],
                                          ["hash", "doc_id"])

    spark = contexts.sparkSession
    whole = contexts.groupBy("anchor", "digest").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.first("words").alias("words"))
    whole = common.stored(whole, spark)
    sides = whole.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("doc_id"), "words")
    repeated = (common.per_slice(sides, list_windows, "hash long, doc_id long").groupBy("hash")
                .agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("hash"))

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for anchor, digest, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            hashes, turn = np.unique(wordhash.run_hashes(wordhash.hashed(text), length).view(np.int64), return_inverse=True)
            order = np.argsort(turn, kind="stable").astype(np.int32)
            parts = np.split(order, np.cumsum(np.bincount(turn))[:-1])  # where each distinct window starts
            rows += zip([anchor] * len(hashes), [digest] * len(hashes), parts, hashes.tolist(), strict=True)
        columns = zip(*rows, strict=True) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()), strict=True)], ["anchor", "digest", "at", "hash"])

    kept = (common.per_slice(whole.select("anchor", "digest", "words"), places, "anchor long, digest long, at array<int>, hash long")
            .join(repeated, "hash").groupBy("anchor", "digest").agg(F.flatten(F.collect_list("at")).alias("kept")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, doc_id, anchor, start, text, kept in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            words = text.split(b" ")
            flags = np.zeros(len(words), bool)
            flags[kept] = True
            for a, b in _runs(flags):
                r = _context(row, doc_id, anchor, words, a, b - 1 + length)
                out.append((*r[:4], start + a, r[5]))
        return _context_batch(out)

    return common.per_slice(contexts.join(kept, ["anchor", "digest"])
                            .select("row", "doc_id", "anchor", "start", "words", "kept"), cut, CONTEXT_SCHEMA)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.keyed(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _kept(text: str | None, windows: list[int] | None, length: int) -> tuple[list[bytes], int]:
    words = wordhash.split(text)
    if not windows:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.array(windows))
    edge[starts] += 1
    edge[starts + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row.

    Null, empty and short texts lose nothing; nor do rows with a null id, which have no place in the order and are no
    reference either. Rows that share an id never remove each other's words. An empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    found = repeats(rows.where("doc_id IS NOT NULL"), length)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, digests = [], [], []
        for text, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, removed = _kept(text, windows, length)
            n.append(len(kept) + removed)
            gone.append(removed)
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                                          ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return common.per_slice(rows.join(found, "row", "left").select("doc_id", "text", "windows"), run, SCHEMA)


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out: texts that lose words become their kept words, joined by one space.

    All other columns and all other texts stay as they are.
    """
    keyed = docs.withColumn("__row", F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")))
    found = repeats(_rows(docs, id_col, text_col).where("doc_id IS NOT NULL"), length).withColumnRenamed("row", "__row")
    joined = keyed.join(found, "__row", "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("windows").alias("__windows"))
    names = list(docs.columns)
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, windows in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            kept, removed = _kept(text, windows, length)
            texts.append(b" ".join(kept).decode("utf-8", "surrogatepass") if removed else text)
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return common.per_slice(joined, run, docs.schema)
