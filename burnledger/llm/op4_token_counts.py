"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The vocabulary's pre-tokenizer cuts a text into pre-tokens that are encoded independently, so a text's token count is
the sum over its pre-tokens. The leaves of a document's tree are pre-tokens (characters, tokens), every inner node has
the sums of its two children. An edit replaces some characters: the leaves it touches, and those before it whose match
looked at the first changed character (at most two characters beyond a pre-token's end), are cut anew until a cut falls
on an old one behind the edit. Only these are encoded, and sums change along the paths to the root.

Trees are kept: grow() gives a row for each document with its text and its leaves, to be stored as a table; edited()
takes such rows, makes the trees of the leaves without cutting or encoding the text again, and gives the changed rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common
from burnledger.llm.encoder import _MARKS, CACHE_CHARS, ID_BYTES, Encoder, default_vocabulary, put_together, slices

LOOK_AHEAD = 2  # characters behind its end that a pre-token's cut may depend on
CACHE_WORDS = 200_000  # pre-tokens whose counts a worker keeps; most of what it meets beyond that comes once
CACHE_PIECES = 300_000  # pieces whose leaves a worker keeps, and those of a batch
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-\u024f]+")  # one pre-token; these are letters in every version of Unicode
# Lines of one such word with punctuation behind it (no apostrophe, which opens a contraction), and their pre-tokens.
_SIMPLE = re.compile(r"(?:{0}{1}*\n)*{0}{1}*".format(_LETTERS.pattern, _MARK := "[" + re.escape(_MARKS) + "]"))
_SIMPLE_TOKENS = re.compile(f" ?{_LETTERS.pattern}|{_MARK}+|\n")
TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
SCHEMA = "doc_id long, n_tokens long, edited_tokens long, edited_chars long, recoded_chars long"
LEAF_BYTES = 8  # two 32-bit integers
FEW_LEAVES = 64  # an edit that touches more of them builds the tree anew from its leaves

def _pattern():  # noqa: ANN202
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Counter:
    """Tokens of pre-tokens, with a bounded cache; a batch's unknown ones are encoded together."""

    def __init__(self, vocabulary: str):
        self.encoder = Encoder(vocabulary, cache_words=0)  # what it has encoded is known here
        self._known: dict[str, int] = {}

    def learn(self, tokens: set[str]) -> None:
        missing = list(tokens.difference(self._known))
        if self._known and len(self._known) + len(missing) > CACHE_WORDS:
            self._known.clear()
            missing = list(tokens)
        # Pre-tokens hold white space only, or none behind their first character. Words behind a space share library calls.
        words = [token[1:] for token in missing if token[0] == " " and not token.isspace()]
        for word, ids in zip(words, self.encoder.encode_words(words, spaced=True), strict=True):
            self._known[" " + word] = len(ids) // ID_BYTES
        others = [token for token in missing if token[0] != " " or token.isspace()]
        for token, ids in zip(others, self.encoder.encode_all(others), strict=True):
            self._known[token] = len(ids) // ID_BYTES

    def __call__(self, tokens: list[str]) -> list[int]:
        try:
            return list(map(self._known.__getitem__, tokens))
        except KeyError:
            self.learn(set(tokens))
            return list(map(self._known.__getitem__, tokens))


class Cutter:
    """Leaves of whole texts from those of their pieces (see encoder.pieces); pieces are kept in a bounded cache."""

    def __init__(self, count: Counter):
        self._count, self._pattern = count, _pattern()
        self._bare: dict[str, bytes] = {}  # first piece of a text -> its leaves, (characters, tokens) each
        self._spaced: dict[str, bytes] = {}  # later piece -> leaves of " " + piece
        self._leaf: dict[tuple[int, int], bytes] = {}  # single leaves, as many as there are lengths of kept words

    def _found(self, known: dict[str, bytes], wanted: list[str], lead: str) -> list[bytes]:
        """The leaves of lead + piece for each of these pieces, none given twice; new ones are kept unless too long."""
        found = list(map(known.get, wanted))
        missing = [at for at, leaves in enumerate(found) if leaves is None]
        if missing:
            if len(known) + len(missing) > CACHE_PIECES:  # what this batch holds stays
                known.clear()
                known.update([(p, leaves) for p, leaves in zip(wanted, found, strict=True) if leaves is not None])
            new = self._learn([wanted[at] for at in missing], lead)
            for at in missing:
                found[at] = new[wanted[at]]
            known.update([(p, leaves) for p, leaves in new.items() if len(p) <= CACHE_CHARS])
        return found

    def _learn(self, missing: list[str], lead: str) -> dict[str, bytes]:
        """The leaves of lead + piece."""
        known: dict[str, bytes] = {}
        words, others = [], []
        for piece in missing:
            (words if _LETTERS.fullmatch(piece) else others).append(piece)
        leaf, more = self._leaf, len(lead)
        for piece, ids in zip(words, self._count.encoder.encode_words(words, bool(lead)), strict=True):
            numbers = len(piece) + more, len(ids) // ID_BYTES
            one = leaf.get(numbers)
            if one is None:
                one = np.array(numbers, np.int32).tobytes()
                if len(piece) <= CACHE_CHARS:
                    leaf[numbers] = one
            known[piece] = one
        cut = [(_SIMPLE_TOKENS if _SIMPLE.fullmatch(piece) else self._pattern).findall(lead + piece) for piece in others]
        tokens = [token for part in cut for token in part]
        raw, at = np.array([list(map(len, tokens)), self._count(tokens)], np.int32).T.tobytes(), 0
        for piece, part in zip(others, cut, strict=True):
            end = at + LEAF_BYTES * len(part)
            known[piece] = raw[at:end]
            at = end
        return known

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = iter(put_together([text for text in texts if text], lambda wanted: self._found(self._bare, wanted, ""),
                                  lambda wanted: self._found(self._spaced, wanted, " ")))
        return [next(found) if text else b"" for text in texts]


@lru_cache(maxsize=2)
def cutter(vocabulary: str) -> Cutter:
    """One cutter per worker process and vocabulary."""
    return Cutter(counter(vocabulary))


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    """One counter per worker process and vocabulary.

    Batches of trees are large; Arrow's own pools would keep their memory after them, the system's gives it back.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    return Counter(vocabulary)


@dataclass
class Edit:
    """Replaces `length` characters from `start` by `text`."""

    start: int
    length: int
    text: str


class Tree:
    """A text with a segment tree over its pre-tokens."""

    def __init__(self, text: str, count: Counter, pattern=None,  # noqa: ANN001
                 leaves: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.text, self.recoded, self._count = text, 0, count
        self._pattern = pattern or _pattern()
        if leaves is None:
            tokens = self._pattern.findall(text)
            leaves = np.array(list(map(len, tokens)), np.int64), np.array(count(tokens), np.int64)
        self._build(*leaves)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self._leaves = len(chars)
        size = 1
        while size < max(1, self._leaves):
            size *= 2
        # Node i has children 2i and 2i + 1; leaves start at `size`. Spare leaves are zero. A leaf may hold several pre-tokens.
        self.size = size
        sums = np.zeros((2, 2 * size), np.int64)
        self.chars, self.tokens = sums
        self.chars[size : size + self._leaves], self.tokens[size : size + self._leaves] = chars, tokens
        level = size
        while level > 1:
            half = level // 2
            np.add(sums[:, level : 2 * level : 2], sums[:, level + 1 : 2 * level : 2], out=sums[:, half:level])
            level = half

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts; behind the text the last leaf in use."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def apply(self, edit: Edit) -> None:
        """Edits the text; an edit beyond its end is cut to it."""
        old = self.text
        a = min(max(edit.start, 0), len(old))
        b = min(a + max(edit.length, 0), len(old))
        self.text = old[:a] + edit.text + old[b:]
        shift = len(self.text) - len(old)
        # The first leaf whose end plus look-ahead reaches the edit.
        first, start = self._find(max(0, a - LOOK_AHEAD)) if old else (0, 0)
        if start and self.chars[self.size + first] == 0:
            first, start = self._find(max(0, start - 1))
        # Leaves end where pre-tokens did; walk along old and new cuts until both agree behind the edit.
        leaf, old_end, at, found = first, start, start, []
        if b < len(old):  # past the leaves that go whole
            held, begins = self._find(b)
            if begins > old_end:
                leaf, old_end = held, begins
        behind = a + len(edit.text)
        while True:
            while leaf < self.size and (old_end < b or old_end + shift < at):
                old_end += int(self.chars[self.size + leaf])
                leaf += 1
            if at >= behind and at == old_end + shift:
                break
            match = self._pattern.match(self.text, at)
            if match is None:
                break
            found.append(match.group())
            at = match.end()
        counts = self._count(found)
        self.recoded += sum(map(len, found))
        slots = leaf - first
        # New pre-tokens go into the touched leaves, several into the last one if they are few; else the tree is built anew.
        if 0 < slots <= FEW_LEAVES and len(found) <= slots + FEW_LEAVES:
            self._fill(first, slots, found, counts)
        elif slots or found:
            chars, tokens = self._flat()
            self._build(np.concatenate([chars[:first], list(map(len, found)), chars[leaf:]]).astype(np.int64),
                        np.concatenate([tokens[:first], counts, tokens[leaf:]]).astype(np.int64))

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves that hold any."""
        chars, tokens = self._flat()
        return chars[chars > 0], tokens[chars > 0]

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        return self.chars[self.size :].copy(), self.tokens[self.size :].copy()

    def _fill(self, first: int, slots: int, found: list[str], counts: list[int]) -> None:
        """Writes the new pre-tokens into the touched leaves; the last one takes all that is left over."""
        for i in range(slots):
            last = i == slots - 1
            part, n = (found[i:], counts[i:]) if last else (found[i : i + 1], counts[i : i + 1])
            self._set(first + i, sum(map(len, part)), sum(n))


def grow(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree of every whole text: doc_id, text, characters and tokens of its leaves (here one pre-token each).

    A null or empty text has no leaves. Strings of special tokens count as ordinary text. Rows with null or repeated ids
    get a row each; an empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()

    def leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found = cutter(vocabulary)(texts)
        ends = pa.array(np.cumsum([0, *(len(raw) // LEAF_BYTES for raw in found)]), pa.int32())
        numbers = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2)
        columns = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(numbers[:, k]))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *columns],
                                          ["doc_id", "text", "chars", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(leaves, slices(batch, 1))

    return common.keyed(docs, id_col, text_col).mapInArrow(run, TREE)


def edited(trees: DataFrame, edits: Column, vocabulary: str | None = None, keep: bool = True) -> DataFrame:
    """Token counts of every kept tree before and after its edits, and how many characters were encoded again.

    edits: a column over the trees' rows, array<struct<start int, length int, text string>>, applied in order, each to
    the text that the one before left; null lists and null texts count as empty, null numbers as 0. With keep, the
    changed trees (text, chars, tokens) follow, so that they can be stored and edited again; a leaf may then hold
    several pre-tokens.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = trees.select("doc_id", "text", "chars", "tokens", edits.alias("edits"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, pattern, out, after = counter(vocabulary), _pattern(), [], []
        ends = batch.column(2).offsets.to_numpy()
        chars, tokens = (batch.column(k).values.to_numpy() for k in (2, 3))
        second = batch.column(3).offsets.to_numpy()
        ids, texts, todo = (batch.column(k).to_pylist() for k in (0, 1, 4))
        for i, (doc_id, text, some) in enumerate(zip(ids, texts, todo, strict=True)):
            leaves = chars[ends[i] : ends[i + 1]], tokens[second[i] : second[i + 1]]
            tree = Tree(text, count, pattern, leaves)
            before = tree.total
            for e in some or []:
                if e is not None:
                    tree.apply(Edit(e["start"] or 0, e["length"] or 0, e["text"] or ""))
            out.append((doc_id, before, tree.total, len(tree.text), tree.recoded))
            after.append((tree.text, *tree.leaves()) if keep else ())
        columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)]
        names = ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "recoded_chars"]
        if keep:
            types = pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())
            columns += [pa.array(list(c), t) for c, t in zip(zip(*after, strict=True), types, strict=True)]
            names += ["text", "chars", "tokens"]
        return pa.RecordBatch.from_arrays(columns, names)

    return common.per_slice(rows, run, SCHEMA + (", text string, chars array<int>, tokens array<int>" if keep else ""))


def count_edits(docs: DataFrame, edits: Column, vocabulary: str | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Grows and stores the trees of all documents, then applies the edits (a column over doc_id and text) to them.

    The counts are stored too: rows with texts and leaves are long, so both steps run here, in small batches.
    """
    spark = docs.sparkSession
    with common.small_batches(spark):
        trees = common.stored(grow(docs, vocabulary, id_col, text_col), spark)
        return common.stored(edited(trees, edits, vocabulary, keep=False), spark)


def sample_edits(text_col: str = "text") -> Column:
    """Three edits derived from each text: its tenth part at one third goes, its first 40 characters are put in at the
    half, and five characters at the third quarter are replaced."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = F.length(text)

    def edit(start: Column, length: Column, new: Column) -> Column:
        return F.struct(F.floor(start).cast("int").alias("start"), F.floor(length).cast("int").alias("length"), new.alias("text"))

    return F.array(edit(n / 3, n / 10, F.lit("")), edit(n / 2, F.lit(0), F.substring(text, 1, 40)),
                   edit(n * 3 / 4, F.lit(5), F.lit(" it's 42\n")))
