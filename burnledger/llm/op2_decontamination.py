"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with every run of other characters than letters and digits as one blank. An item of m
characters may differ from a passage by k = floor(m * error share) insertions, deletions and substitutions. Cut into
k + 2 pieces, at least two pieces are hit exactly, at places that differ from those in the item by amounts at most k
apart; all pieces of a block of items are searched in one pass with an Aho-Corasick automaton. Around each such pair of
hits, Myers' bit-parallel algorithm finds the passage with the least distance; a region is verified once, however many
pieces hit it.

Items are the query set: they are read in blocks of bounded size, each block is sent to all tasks, and every document
is read past it. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common

ERROR_SHARE = 0.1
BLOCK_CHARS = 4_000_000  # of item text that a task holds at a time
LEAST_ITEM = 24  # shorter items are searched without errors, and as whole words
SCHEMA = "doc_id long, item_id long, distance int, start long, length long"
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def budget(size: int, share: float = ERROR_SHARE) -> int:
    """Errors allowed for an item of this size."""
    return int(size * share)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into errors + 2 pieces of nearly equal size, with their places; whole if it has no errors."""
    n = errors + 2 if errors else 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def patterns(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def nearest(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the end of the first best one (Myers 1999)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1
        plus = ((down << 1) & full) | (full & ~(d0 | up))
        minus = up & d0 & full
        if score < best:
            best, end = score, i + 1
    return best, end


@dataclass
class Index:
    """A block of items with their budgets and the automaton over their pieces."""

    ids: list[int]
    items: list[str]
    share: float

    def __post_init__(self) -> None:
        import ahocorasick

        self.errors = [budget(len(t), self.share) if len(t) >= LEAST_ITEM else 0 for t in self.items]
        self.masks = [patterns(t) for t in self.items]
        self.back = [patterns(t[::-1]) for t in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (item, errors) in enumerate(zip(self.items, self.errors, strict=True)):
            for at, piece in pieces(item, errors):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, length) of the best passage of each item in a normalised text."""
        if not self.items or not text:
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            start = end - size + 1
            for k, at in found:
                if k in hits:
                    hits[k].append((start - at, at))
                else:
                    hits[k] = [(start - at, at)]
        out = []
        for k, places in hits.items():
            size, best = len(self.items[k]), None
            for low, high in self._regions(k, places, text):
                distance, end = nearest(self.masks[k], size, text[low:high])
                if distance <= self.errors[k] and (best is None or distance < best[0]):
                    # The same passage read backwards from its end gives its start.
                    first = max(0, low + end - size - distance)
                    _, length = nearest(self.back[k], size, text[first : low + end][::-1])
                    best = (distance, low + end - length, length)
                if best and best[0] == 0:
                    break
            if best:
                out.append((self.ids[k], *best))
        return out


    def _regions(self, k: int, places: list[tuple[int, int]], text: str) -> list[list[int]]:
        """Where passages within the budget can be: around two different pieces whose shifts are at most the budget apart.

        Between two pieces of a passage that are hit, in order of their shifts, there may be other hits; two of them that
        follow each other are of different pieces, and the region around either holds the passage.
        """
        errors, length = self.errors[k], len(self.items[k])
        if not errors:
            return [[shift, shift + length] for shift, _ in places if length >= LEAST_ITEM or
                    (text[shift - 1 : shift] in ("", " ") and text[shift + length : shift + length + 1] in ("", " "))]
        if len(places) < 2:
            return []
        places.sort()
        spans: list[list[int]] = []
        for (shift, at), (after, other) in zip(places, places[1:], strict=False):
            if at != other and after - shift <= errors:
                low, high = max(0, shift - errors), min(len(text), after + length + errors)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        return spans


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of bounded size; null ids and items without letters or digits are left out."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .where("id IS NOT NULL AND text IS NOT NULL")
    block, held = [], 0
    for row in rows.toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        block.append((row["id"], text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: distance, and start and length in the normalised text.

    A document that holds an item several times gets its best (first) passage. Rows that repeat a document or an item
    repeat the result. Items of under LEAST_ITEM normalised characters are found as whole words without errors only. Null or empty documents and items hold nothing and match nothing; empty tables give no rows.
    """
    rows, out = common.keyed(docs, id_col, text_col).where("text IS NOT NULL"), None
    for block in blocks(items, item_id, item_text):
        found = common.per_slice(rows, _search(docs, block, share), SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _search(docs: DataFrame, block: list[tuple[int, str]], share: float):  # noqa: ANN202
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_CHARS and one item

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, rows = _index(shared, share), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(doc_id, *m) for m in index.matches(normal(text))]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                          ["doc_id", "item_id", "distance", "start", "length"])

    return run


_built: dict[tuple, Index] = {}


def _index(shared, share: float) -> Index:  # noqa: ANN001
    """The block's index, built once in a worker process."""
    block = shared.value
    key = (hash(tuple(block)), share)
    if key not in _built:
        _built.clear()
        _built[key] = Index([i for i, _ in block], [t for _, t in block], share)
    return _built[key]


def clean(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item; each row is judged by its own text, columns stay as they are.

    Items of under LEAST_ITEM normalised characters are found as whole words without errors only, however common they are.
    """
    at, out = docs.columns.index(text_col), docs
    for block in blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:  # noqa: ANN001
            index = _index(shared, share)
            keep = [not index.matches(normal(text)) for text in batch.column(at).to_pylist()]
            return batch.filter(pa.array(keep, pa.bool_()))

        out = common.per_slice(out, run, docs.schema)
    return out
