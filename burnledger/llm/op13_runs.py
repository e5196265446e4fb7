"""Periodic runs of words: string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are equal) and at least `least` words and `times` periods
that neither neighbour extends. Runs are found document by document, without a shuffle; several documents are searched at
once, divided by signs that occur once.

At scale t a position is in the synchronising set if, among the hashes of the t-word windows that start at i, ..., i + t,
the one at i or at i + t is the least. Whether i is in the set thus depends on the 2t words from i only. Windows with a
period of t / 3 or less do not take part, so the set stays sparse, and any t consecutive positions hold one of the set, unless
all 3t words from there have such a period.

Let a run have period p >= 1.5 t. Its first positions (t of them, or t and some more where p is above 8t / 3) hold one, i, of
the set. The 2t words from i come again p words later, and so does i + p in the set. If the context compared has p - 1 words
at least, it does not come again sooner, as p is the smallest period. So among the set's positions with equal contexts of 2t
words, neighbours 1.5 t to 2t + 1 apart propose their distance as a period, and with contexts of 3t words, neighbours 2t to
3t + 1 apart. In a run of three periods there is room for both. Scales 4, 8, 16, ... meet all periods from 6. Each
proposal is followed word by word, to the left and to the right, until the period ends.

What the sets omit is supplied separately: periods up to 5 are found by comparing the words with those 1, ..., 5 further on. At
larger scales the highly periodic windows are those inside the runs that smaller scales have found.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common, wordhash

LEAST = 24  # words of a run
TIMES = 3  # periods of a run; the scales rely on three
SMALL = 5  # periods up to here are found by comparing directly
CHUNK_WORDS = 200_000  # documents that are searched at once have as many words together, or are alone
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)  # stands for the hash of a highly periodic window

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from those of its two parts. It is no polynomial, so that no regular text makes hashes collide."""
    return wordhash.mix(a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03) ^ wordhash.mix(b))


def _repeats(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches with that period, of more words than the period."""
    same = np.zeros(max(len(values) - period, 0) + 2, np.int8)
    same[1:-1] = values[period:] == values[:-period] if len(values) > period else 0
    turns = np.diff(same)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) + period


def _until(values: np.ndarray, start: int, period: int) -> int:
    """End of the stretch with that period which starts here."""
    at, block = start, 256
    while True:
        ahead = values[at + period : at + period + block]
        differ = np.flatnonzero(values[at : at + len(ahead)] != ahead)
        if len(differ):
            return at + int(differ[0]) + period
        if len(ahead) < block:
            return at + len(ahead) + period
        at, block = at + block, 2 * block


def _since(values: np.ndarray, start: int, period: int) -> int:
    """Start of the stretch with that period which holds the first `period` words from here."""
    at, block = start, 256
    while at:
        low = max(0, at - block)
        differ = np.flatnonzero(values[low:at] != values[low + period : at + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, block = low, 2 * block
    return 0


def synchronising(hashes: np.ndarray, scale: int, omitted: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set, given the hash of each window of `scale` words and which windows are omitted."""
    taking = np.where(omitted, _NEVER, hashes)
    least = wordhash.sliding_min(taking, scale + 1)
    ends = (least == taking[: len(least)]) | (least == taking[scale : scale + len(least)])
    return np.flatnonzero(ends & (least != _NEVER))


def _proposals(at: np.ndarray, context: np.ndarray, words: int, low: int, high: int) -> list[tuple[int, int]]:
    """Start and period of stretches that equal contexts at neighbouring positions propose; those of one run are merged."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    step = np.diff(at)
    hits = np.flatnonzero((context[1:] == context[:-1]) & (step >= low) & (step <= high))
    start, period = at[hits], step[hits]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    # Both stretches are in one run if they overlap by a period: the first ends at start + words + period.
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(period) != 0) | (np.diff(start) > words)
    return list(zip(start[new].tolist(), period[new].tolist(), strict=True))


def find_runs(values: np.ndarray, sizes: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by period and start.

    values: the numbers of the words of documents of falling sizes, each followed by a number that occurs once.
    """
    if times < 3 or least < 16:
        raise ValueError("runs have three periods and 16 words at least")
    stretches: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of small scales, not all long enough for a run
    primitive: set[tuple[int, int]] = set()
    runs: dict[tuple[int, int], int] = {}  # (start, period) -> end
    for period in range(1, SMALL + 1):
        starts, ends = _repeats(values, period)
        long = ends - starts >= 3 * period
        starts, ends = starts[long], ends[long]
        stretches.append((starts, ends, np.full(len(starts), period)))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= max(least, times * period) and (a, b) not in primitive:
                primitive.add((a, b))  # with a divisor as period the stretch would have been met before
                runs[a, period] = b
    size_at = np.array(sizes, np.int64)
    one = wordhash.mix(values.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x632BE59BD9B4E019))
    two = _joined(one[:-1], one[1:])
    hashes = _joined(two[:-2], two[2:]) if len(two) > 2 else two[:0]
    scale = 4
    while True:
        docs = int(np.count_nonzero(size_at >= max(least, times * -(-3 * scale // 2))))
        if not docs:
            break
        limit = int(size_at[:docs].sum()) + docs
        hashes = hashes[: limit - scale + 1]
        double = _joined(hashes[:-scale], hashes[scale:])
        omitted = np.zeros(len(hashes) + 1, np.int64)
        known = [np.array([(a, b, p) for (a, p), b in runs.items() if p > SMALL], np.int64).reshape(-1, 3).T]
        for starts, ends, periods in [*stretches, *known]:
            some = (3 * periods <= scale) & (ends - starts >= scale) & (ends <= limit)
            np.add.at(omitted, starts[some], 1)
            np.add.at(omitted, ends[some] - scale + 1, -1)
        at = synchronising(hashes, scale, np.cumsum(omitted[:-1]) > 0)
        longer = at[at <= limit - 3 * scale]
        for start, period in (_proposals(at, double[at], 2 * scale, -(-3 * scale // 2), 2 * scale + 1)
                              + _proposals(longer, _joined(double[longer], hashes[longer + 2 * scale]), 3 * scale, 2 * scale, 3 * scale + 1)):
            begin = _since(values, start, period)
            if (begin, period) not in runs:
                end = _until(values, start, period)
                if end - begin >= max(least, times * period):
                    runs[begin, period] = end
        hashes, scale = double, 2 * scale
    return sorted(((a, b, p) for (a, p), b in runs.items()), key=lambda r: (r[2], r[0]))


class _Numbers(dict):
    """Numbers the words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def runs_of(documents: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period."""
    order = sorted(range(len(documents)), key=lambda k: -len(documents[k]))
    numbers, parts = _Numbers(), []
    for k, doc in enumerate(order):
        words = documents[doc]
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - k])]
    sizes = [len(documents[k]) for k in order]
    begins = np.cumsum(np.array([0, *sizes[:-1]]) + 1) - 1 if sizes else np.zeros(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for start, end, period in find_runs(np.concatenate(parts), sizes, least, times) if parts else []:
        k = int(np.searchsorted(begins, start, "right")) - 1
        out[order[k]].append((start - int(begins[k]), end - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, not rounded; then the first, then the one with the least period."""
    best = None
    for run in runs:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all but the first period of each run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
           prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), strongest (of the runs, or null) and
    collapsed (the words that no run repeats, joined by one space) of every row.

    prepare, if given, turns the words of a document into those that are searched. Null, empty and wordless texts have no
    words, no runs and an empty collapsed text. Rows that repeat an id, or have none, get a row each. Other columns, whatever
    their names, are not looked at. An empty table gives no rows.
    """
    def search(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(documents, least, times)
        spans = lambda rs: [dict(zip(("start", "length", "period"), r, strict=True)) for r in rs]
        best = [spans([b])[0] if (b := strongest(rs)) else None for rs in found]
        kept = [b" ".join(collapsed(d, rs)).decode("utf-8", "surrogatepass") for d, rs in zip(documents, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(d) for d in documents], pa.int64()),
             pa.array([spans(rs) for rs in found], pa.list_(_ARROW_RUN)), pa.array(best, _ARROW_RUN), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, documents, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = wordhash.split(text)
            if prepare is not None:
                words = prepare(doc_id, words)
            if documents and size + len(words) > CHUNK_WORDS:
                yield search(ids, documents)
                ids, documents, size = [], [], 0
            ids.append(doc_id)
            documents.append(words)
            size += len(words)
        if documents:
            yield search(ids, documents)

    return common.per_slice(common.keyed(docs, id_col, text_col), run, SCHEMA)


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Makes the end of every tenth document periodic; place and period follow from the id. A null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    cycle = words[start : start + period]
    return words[:start] + (cycle * -(-(n - start) // period))[: n - start]


def report(docs: DataFrame) -> DataFrame:
    """The runs of all documents, some of them with planted ones, as numbers and digests."""
    found = detect(docs, prepare=plant)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
