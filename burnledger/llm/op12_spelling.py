"""Spelling variants: words one edit apart, found with bidirectional FM-indexes.

Of two words that differ by one inserted, deleted or replaced code point, the second has one half of the first unchanged. The
search scheme has a search for either half: the half is matched exactly, from its inner end outwards to the word's end,
and then extended across the other half, where one error is allowed. A bidirectional FM-index over the delimited vocabulary
`$word$word$...$` does so: the suffix-rank interval of a pattern and that of the reversed pattern are kept in step, so that
a pattern grows by a symbol at either end. All queries of a block take each step together, as arrays.

The vocabulary is cut into shards, each with an index of its own. A word is a query in the shards of its halves, and part
of the index wherever it might answer: there a query's half is the word's own beginning or end, of a length that follows
from the word's, or that of a word with a letter more or less. A half that too many words have is refined: the part that
may hold the error is halved again, and so on, until the error's place is all that is open; so few words answer then that
no shard grows beyond its bound whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2  # a form is as many times as frequent at least
SHARD_ROWS = 60_000  # listings of words that a shard holds on average
HOT = 20_000  # listings of a key from which it is refined
HELD_WORDS = 200_000  # distinct words that a task counts before it hands them on
BLOCK_CELLS = 1 << 18  # code points of the queries that are searched together
STEP = 16  # places between counts that the index keeps
_END, _DELIMITER, _FIRST = 0, 1, 2  # symbols: before the text, between words, of the least letter


# ---------------------------------------------------------------- vocabulary

def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               edit: Callable[[int | None], Callable[[str], str]] | None = None) -> DataFrame:
    """word and n (occurrences in all documents) of the runs of letters, with A-Z in lower case.

    edit, if given, returns for a document's id what its runs become. Words shorter or rarer than asked for are left out.
    Null and empty texts have no words; rows that repeat an id are counted each.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(letters).findall, Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                found = Counter(find(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))) if text else {}
                change = edit(doc_id) if edit is not None else str
                for run, n in found.items():
                    if len(run) >= least_length and len(word := change(run)) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
        if held:
            yield handed()

    counted = common.keyed(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def misspell(doc_id: int | None, one_in: int = 97) -> Callable[[str], str]:
    """Deletes a code point of some runs; which run and which place follow from the id (a null id counts as none)."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        if h % one_in:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return change


# ---------------------------------------------------------------- index

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the length that is compared."""
    n = len(text)
    rank, span = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 2)
        key[: max(n - span, 0)] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        turns = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = turns
        if turns[-1] == n - 1:
            return order
        span *= 2


class Side:
    """Burrows-Wheeler transform of a text and, for any place, how many symbols before it are less than a given one."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.suffixes = np.append(len(text), suffix_array(text))  # the empty suffix is the first
        bwt = np.where(self.suffixes > 0, text[self.suffixes - 1], _END)
        padded = np.full((len(bwt) // STEP + 1) * STEP, symbols, np.int16)
        padded[: len(bwt)] = bwt
        self._blocks, self._symbols = padded.reshape(-1, STEP), symbols
        own = np.zeros((len(self._blocks), symbols + 1), np.int32)
        np.add.at(own, (np.repeat(np.arange(len(own)), STEP), padded), 1)
        self._before = np.zeros((len(own) + 1, symbols + 1), np.int32)
        self._before[1:, 1:] = np.cumsum(np.cumsum(own, axis=0), axis=1)[:, :-1]
        self.first = self._before[-1].astype(np.int64)

    def ranks(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols before the place are less than the given one, and how many equal it."""
        block, rest = place // STEP, place % STEP
        near, inside = self._blocks[block], np.arange(STEP) < rest[:, None]
        less, equal = ((test(near, symbol[:, None]) & inside).sum(axis=1) for test in (np.less, np.equal))
        before = self._before[block, symbol]
        return before + less, self._before[block, symbol + 1] - before + equal

    def less_all(self, place: np.ndarray) -> np.ndarray:
        """For every symbol; a row for each place."""
        block, rest = place // STEP, place % STEP
        own = np.zeros((len(place), self._symbols + 1), np.int64)
        row, column = np.nonzero(np.arange(STEP) < rest[:, None])
        np.add.at(own, (row, self._blocks[block][row, column]), 1)
        out = self._before[block].astype(np.int64)
        out[:, 1:] += np.cumsum(own, axis=1)[:, :-1]
        return out


class Index:
    """Bidirectional FM-index of distinct words. A state has a row for each pattern: the start of its interval, the start of
    the reversed pattern's interval, and the size of both."""

    def __init__(self, words: list[str]):
        points = np.array([ord(c) for c in "".join(words)], np.int64)
        self.alphabet = np.unique(points)
        self.symbols = len(self.alphabet) + _FIRST
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.full(int(sizes.sum()) + len(words) + 1, _DELIMITER, np.int64)
        ends = np.cumsum(sizes + 1)
        inner = np.ones(len(text), bool)
        inner[0] = inner[ends] = False
        text[inner] = np.searchsorted(self.alphabet, points) + _FIRST
        self._word = np.cumsum(~inner) - 1
        self.sides = (Side(text, self.symbols), Side(text[::-1], self.symbols))
        self.places = len(text) + 1

    def codes(self, words: list[str]) -> np.ndarray:
        """The words' symbols, a row each, filled up with the delimiter."""
        out = np.full((len(words), max(map(len, words)) + 1), _DELIMITER, np.int64)
        for row, word in zip(out, words, strict=True):
            row[: len(word)] = np.searchsorted(self.alphabet, [ord(c) for c in word]) + _FIRST
        return out

    def everything(self, n: int) -> np.ndarray:
        return np.repeat(np.array([[0, 0, self.places]], np.int64), n, axis=0)

    def extend(self, state: np.ndarray, symbol: np.ndarray, right: int) -> np.ndarray:
        """Patterns grown by a symbol, at the right end (1) or the left (0)."""
        side, own, other = self.sides[right], state[:, right], state[:, 1 - right]
        (below, rank), (below_end, rank_end) = side.ranks(symbol, own), side.ranks(symbol, own + state[:, 2])
        out = np.empty_like(state)
        out[:, right] = side.first[symbol] + rank
        out[:, 1 - right] = other + below_end - below
        out[:, 2] = rank_end - rank
        return out

    def branch(self, state: np.ndarray, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All patterns that occur with a letter more: row of the state, letter, new state."""
        side, own, other = self.sides[right], state[:, right], state[:, 1 - right]
        low, high = side.less_all(own), side.less_all(own + state[:, 2])
        ranks, size = np.diff(low, axis=1), np.diff(high - low, axis=1)
        row, letter = np.nonzero(size[:, _FIRST:])
        letter += _FIRST
        out = np.empty((len(row), 3), np.int64)
        out[:, right] = side.first[letter] + ranks[row, letter]
        out[:, 1 - right] = other[row] + (high - low)[row, letter]
        out[:, 2] = size[row, letter]
        return row, letter, out

    def words_at(self, state: np.ndarray) -> np.ndarray:
        """Numbers of the words whose patterns, delimiters included, these are."""
        return self._word[self.sides[0].suffixes[state[:, 0]]]

    def one_error(self, codes: np.ndarray, size: np.ndarray, start: np.ndarray, stop: np.ndarray, right: int) -> np.ndarray:
        """Pairs (query, word) one edit apart whose error lies within [start, stop) of the query.

        right: the first `start` (at least one) code points are matched leftwards to the delimiter and then extended to the
        right; at 0 all is mirrored, with codes, start and stop given for the reversed queries.
        """
        exact, at = self.everything(len(size)), np.arange(len(size))
        for k in range(int(start.max()), -1, -1):
            own = np.flatnonzero(start >= k)
            symbol = codes[own, k - 1] if k else np.full(len(own), _DELIMITER)
            exact[own] = self.extend(exact[own], symbol, 1 - right)
        place, out = start.copy(), []
        wrong_at, wrong = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)  # patterns with one error, and their queries
        while len(at) or len(wrong_at):
            open_ = np.flatnonzero((exact[:, 2] > 0) & (place[at] <= stop[at]))
            row, letter, grown = self.branch(exact[open_], right)
            grows = at[open_][row]
            inner, follows = place[grows] < stop[grows], letter != codes[grows, place[grows]]
            # Of equal letters in a row the last is inserted or dropped, so that each pattern comes once.
            inserts, replaces = follows | ~inner, follows & inner
            here = place[at[open_]]
            drops = open_[(here < stop[at[open_]]) & ((here + 1 >= stop[at[open_]])
                          | (codes[at[open_], here] != codes[at[open_], np.minimum(here + 1, codes.shape[1] - 1)]))]
            wrong_at, wrong = np.concatenate([wrong_at, grows[inserts]]), np.concatenate([wrong, grown[inserts]])
            ahead = codes[wrong_at, place[wrong_at]]  # the delimiter, where the query ends
            ended, wrong = place[wrong_at] >= size[wrong_at], self.extend(wrong, ahead, right)
            alive = wrong[:, 2] > 0
            done = alive & ended
            out.append(np.stack([wrong_at[done], self.words_at(wrong[done])], axis=1))
            going = alive & ~ended
            wrong_at = np.concatenate([wrong_at[going], grows[replaces], at[drops]])
            wrong = np.concatenate([wrong[going], grown[replaces], exact[drops]])
            on = np.flatnonzero((exact[:, 2] > 0) & (place[at] < np.minimum(stop[at], size[at])))
            exact = self.extend(exact[on], codes[at[on], place[at[on]]], right)
            at = at[on]
            place = place + 1
        return np.unique(np.concatenate(out), axis=0)


def near_in_shard(words: list[str], queries: list[tuple[int, int, int]]) -> np.ndarray:
    """Pairs (word, near word) by number. queries: number of a word and the part [start, stop) of it that has the error, which
    reaches the word's beginning or end, or lies inside."""
    if not words or not queries:
        return np.zeros((0, 2), np.int64)
    index, out = Index(words), [np.zeros((0, 2), np.int64)]
    for right in (1, 0):
        chosen = sorted((q for q in queries if (q[1] > 0) == bool(right)), key=lambda q: len(words[q[0]]))
        at = 0
        while at < len(chosen):
            block, cells = at, 0
            while at < len(chosen) and (at == block or cells + len(words[chosen[at][0]]) <= BLOCK_CELLS):
                cells += len(words[chosen[at][0]])
                at += 1
            number, start, stop = (np.array(x, np.int64) for x in zip(*chosen[block:at], strict=True))
            asked = [words[k] if right else words[k][::-1] for k in number.tolist()]
            size = np.array([len(w) for w in asked], np.int64)
            if not right:
                start, stop = size - stop, size - start
            found = index.one_error(index.codes(asked), size, start, stop, right)
            out.append(np.stack([number[found[:, 0]], found[:, 1]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


# ---------------------------------------------------------------- shards

def _key(word: Column) -> Column:
    """Hash of what a word and a query of length q share outside the query's part [start, stop)."""
    end = F.col("q") - F.col("stop")
    return F.xxhash64("q", "start", "stop", F.substr(word, F.lit(1), F.col("start")), F.substr(word, F.length(word) - end + 1, end))


def _listed(words: DataFrame, least_length: int) -> DataFrame:
    """word, n, and for each query length q that may be near the two halves as parts, with their keys."""
    size = F.length("word")
    rows = words.withColumn("q", F.explode(F.sequence(F.greatest(size - 1, F.lit(least_length)), size + 1)))
    half = F.floor(F.col("q") / 2).cast("int")
    parts = F.array(F.struct(half.alias("start"), F.col("q").alias("stop")), F.struct(F.lit(0).alias("start"), half.alias("stop")))
    rows = rows.withColumn("part", F.explode(parts)).select("word", "n", "q", "part.start", "part.stop")
    return rows.withColumn("key", _key(F.col("word")))


def _refined(rows: DataFrame) -> DataFrame:
    """The same with the error in either half of the part."""
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    parts = F.array(F.struct(middle.alias("start"), F.col("stop")), F.struct(F.col("start"), middle.alias("stop")))
    rows = rows.withColumn("part", F.explode(parts)).select("word", "n", "q", "part.start", "part.stop")
    return rows.withColumn("key", _key(F.col("word")))


def near(words: DataFrame, least_length: int = LEAST_LENGTH, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, near and near_n of all pairs of distinct words (word, n) one edit apart, each pair in both directions."""
    if least_length < 2:
        raise ValueError("words need two code points to have halves")
    spark = words.sparkSession
    now, done = _listed(words, least_length), None
    while True:
        full = common.stored(now.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("stop") - F.col("start")).alias("open"))
                             .where((F.col("c") > hot) & (F.col("open") > 1)).select("key"), spark)
        if not full.head(1):
            break
        cool = now.join(full, "key", "left_anti")
        done = cool if done is None else done.union(cool.select(*done.columns))
        now = common.stored(_refined(now.join(full, "key", "left_semi")), spark)
    rows = now if done is None else done.union(now.select(*done.columns))
    shards = max(1, -(-rows.count() // shard_rows))
    asks = F.when(F.col("q") == F.length("word"), F.struct("start", "stop"))
    shard = F.pmod("key", F.lit(shards)).cast("int")
    held = rows.groupBy(shard.alias("shard"), "word").agg(F.first("n").alias("n"), F.collect_list(asks).alias("asks"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("word").reset_index(drop=True)
        names, counts = frame["word"], frame["n"].to_numpy()
        queries = [(k, part["start"], part["stop"]) for k, parts in enumerate(frame["asks"]) for part in parts]
        found = near_in_shard(names.tolist(), queries)
        return pd.DataFrame({"word": names.to_numpy()[found[:, 0]], "near": names.to_numpy()[found[:, 1]], "near_n": counts[found[:, 1]]})

    return held.groupBy("shard").applyInPandas(search, "word string, near string, near_n long").distinct()


def grouped(words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n; distinct).

    form: the near word of largest n (ties: the least in code-point order) if that is `ratio` (over 1) times the word's n at
    least, else null; root: where following the forms ends, the word itself if it has none. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    spark = words.sparkSession
    words = common.stored(words.select("word", "n"), spark)
    best = near(words, least_length, hot, shard_rows).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    rows = common.stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n")), spark)
    # Each round doubles the steps taken; counts double from form to form, so that there are few.
    up = common.stored(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), spark)
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = common.stored(up.select("word", "root").join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), spark)
        if not up.where("moved").head(1):
            break
    return rows.join(up.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The spelling variants among all words of the documents, some of them misspelt on purpose."""
    return grouped(vocabulary(docs, edit=misspell))
