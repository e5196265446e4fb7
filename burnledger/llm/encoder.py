"""Byte-level BPE ids of whole texts through the tokenizers library, with a bounded cache of words.

The vocabulary's pre-tokenizer never joins characters across a single space between two visible characters: the space
opens a new pre-token there. A text is therefore cut at these spaces, every distinct piece is encoded once by the
library, and the ids of a text are the ids of its pieces in order. A piece may hold any other white space.

A new piece that ends in punctuation behind a letter, or holds line breaks between visible characters, is put together
from the ids of its words, if the vocabulary's pre-tokenizer cuts there too (asked of the library for each mark).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0  # closes every document
ID_BYTES = 4  # ids travel as unsigned little-endian 32-bit integers
CACHE_WORDS = 400_000  # pieces kept by a worker in two halves; when the newer one is full, the older one goes
CALL_PIECES = 500  # new pieces that go to the library together; longer texts take it longer a piece
CACHE_CHARS = 64  # longer pieces are encoded each time and not kept
SLICE_BYTES = 6 << 20  # UTF-8 bytes of the texts that a task encodes at a time, or one text

_PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")  # a space beside common white space
# White space other than space, tab and line ends.
_RARE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"[^\S\n]|\n\n|^\n|\n$|^$")  # white space that may melt into one pre-token with its neighbours
_SPLITTER = "\n"
# Punctuation that may end a word; not the apostrophe, which opens a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE = "\u0120"  # a space in the tokens of byte-level vocabularies
_LATIN_END = "\u0250"  # letters below it are letters in every version of Unicode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """The text cut at single spaces between visible characters; joined by one space it is the text again."""
    return _CUT.split(text) if _loose(text) else text.split(" ")


def _loose(text: str) -> bool:
    """Whether a space of the text may stand beside other white space."""
    return (text[0] == " " or text[-1] == " " or any(pair in text for pair in _PAIRS)
            or any(c in text for c in _RARE))


def put_together(texts: list[str], bare: Callable[[list[str]], list[bytes]],
                 spaced: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """What bare gives for the first piece of each text and spaced for the later ones, one after another.

    No text may be empty. Both are given distinct pieces; Arrow cuts the texts, tells equal pieces and joins.
    """
    out = [b""] * len(texts)
    loose = list(map(_loose, texts))
    for kind in (False, True):
        rows = [i for i, x in enumerate(loose) if x is kind]
        if not rows:
            continue
        some = [texts[i] for i in rows]
        if kind:
            cut = pa.array(list(map(_CUT.split, some)), pa.list_(pa.large_string()))
        else:
            cut = pc.split_pattern(pa.array(some, pa.large_string()), " ")
        bounds, parts = cut.offsets.to_numpy(), cut.values
        first, is_later = bounds[:-1], np.ones(len(parts), bool)
        is_later[first] = False
        opening = parts.take(pa.array(first)).dictionary_encode()
        later = parts.filter(pa.array(is_later)).dictionary_encode()
        values = bare(_strings(opening.dictionary))
        places = np.empty(len(parts), np.int64)
        places[first] = opening.indices.to_numpy()
        places[is_later] = later.indices.to_numpy() + len(values)
        values += spaced(_strings(later.dictionary))
        joined = pa.array(values, pa.large_binary()).take(pa.array(places))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(parts) + 1)[bounds].tolist()
        raw = memoryview(joined.buffers()[2] or b"")
        for i, a, b in zip(rows, ends, ends[1:], strict=False):
            out[i] = raw[a:b].tobytes()
    return out


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts hold at most SLICE_BYTES; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


class Encoder:
    """Encodes texts to the bytes of their ids (unsigned little-endian 32-bit)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._bare: dict[str, bytes] = {}  # first piece of a text -> its ids
        self._spaced: dict[str, bytes] = {}  # later piece -> ids of " " + piece
        self._before: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by lead: pieces kept before the newer half
        self._cache_words = cache_words
        newline = self._ids(_SPLITTER)
        self._newline = newline[0] if len(newline) == 1 else None
        self._break = newline.tobytes()
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._marks = "".join(m for m in _MARKS if self._newline is not None and self._cuts(f" aé{m}", 3)
                              and self._cuts(f" aé{m}#", 3) and self._cuts(f"aé#{m}", 2))
        self._lines = self._newline is not None and all(
            self._cuts(f"aé{m}\nÉa", 2 + len(m)) and self._cuts(f"aé{m}\nÉa", 3 + len(m)) for m in ("", ".", "1"))
        # A word and marks can hold no special token that has another form.
        self._plain_ends = not any((s.rstrip(self._marks) or "a").isalpha() for s in self._special)
        self._opens = self._opening()

    def _cuts(self, text: str, at: int) -> bool:
        """Whether the pre-tokenizer cuts this text there."""
        cut = self._library.pre_tokenizer
        return cut is not None and any(end == at for _, (_, end) in cut.pre_tokenize_str(text))

    def _opening(self) -> np.ndarray | None:
        """Whether each token begins with a space, or None if the pre-tokenizer does not write a space as byte-level ones do."""
        cut = self._library.pre_tokenizer
        if cut is None or [part for part, _ in cut.pre_tokenize_str(" a b")] != [_SPACE + "a", _SPACE + "b"]:
            return None
        known = self._library.get_vocab(with_added_tokens=True)
        opens = np.zeros(max(known.values()) + 1, bool)
        opens[[number for token, number in known.items() if token[0] == _SPACE]] = True
        return opens

    def _ids(self, text: str) -> np.ndarray:
        encoded = self._library.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(encoded.ids, dtype="<u4")

    def _stem(self, line: str) -> str:
        """The line without the punctuation behind its last letter; the line itself if it has no such end."""
        stem = line.rstrip(self._marks)
        return stem if stem and stem[-1] < _LATIN_END and stem[-1].isalpha() else line

    def _found(self, cache: dict[str, bytes], wanted: list[str], lead: str) -> list[bytes]:
        """The ids of lead + piece for each of these pieces, none given twice; new ones are kept unless too long."""
        found = list(map(cache.get, wanted))
        if None not in found:
            return found
        before, missing = self._before[lead], []
        for at in [i for i, ids in enumerate(found) if ids is None]:
            piece = wanted[at]
            ids = before.get(piece)
            if ids is None:
                missing.append(at)
            else:
                cache[piece] = found[at] = ids
        self._learn(cache, [wanted[at] for at in missing], lead)
        for at in missing:
            piece = wanted[at]
            found[at] = cache[piece]
            if len(piece) > CACHE_CHARS:
                del cache[piece]
        return found

    def _learn(self, cache: dict[str, bytes], missing: list[str], lead: str) -> None:
        """Adds the ids of lead + piece."""
        plain, odd, broken = [], [], []  # broken: holds line breaks
        ends: list[tuple[str, str, str]] = []  # piece, its word and its marks
        plain_ends, stem_of = self._plain_ends, self._stem
        if self._newline is not None:
            plain = [piece for piece in missing if piece.isalpha()]
            missing = [piece for piece in missing if not piece.isalpha()]
        for piece in missing:
            if (plain_ends and _SPLITTER not in piece and len(piece) <= CACHE_CHARS
                    and (stem := stem_of(piece)).isalpha() and len(stem) < len(piece)):
                ends.append((piece, stem, piece[len(stem) :]))
            elif self._newline is None or _ODD.search(piece):
                odd.append(piece)
            elif len(piece) > CACHE_CHARS or any([s in piece for s in self._special]):
                plain.append(piece)
            elif self._lines and _SPLITTER in piece:
                broken.append(piece)
            elif len(stem := stem_of(piece)) < len(piece):
                ends.append((piece, stem, piece[len(stem) :]))
            else:
                plain.append(piece)
        made: dict[str, list[tuple[str, str]]] = {}  # broken piece -> word and marks of each line
        if ends or broken:
            stems = {stem for _, stem, _ in ends}
            marks = {mark for _, _, mark in ends}
            for piece in broken:
                lines = []
                for line in piece.split(_SPLITTER):
                    stem = stem_of(line)
                    lines.append((stem, line[len(stem) :]))
                made[piece] = lines
                stems.add(lines[0][0])
                marks.add(lines[0][1])
                for line in lines[1:]:
                    marks.update(line)
            marks.discard("")
            self._learn_plain(self._bare, list(marks.difference(self._bare)), "")
            plain = list(stems.difference(cache).union(plain))
        self._learn_plain(cache, plain, lead)
        cache.update([(p, self._ids(lead + p).tobytes()) for p in odd])
        bare = self._bare
        cache.update([(piece, cache[stem] + bare[mark]) for piece, stem, mark in ends])
        for piece, ((stem, end), *later) in made.items():
            parts = [cache[stem] + bare[end] if end else cache[stem]]
            parts += [bare[stem] + bare[end] if end else bare[stem] for stem, end in later]
            cache[piece] = self._break.join(parts)

    def _learn_plain(self, cache: dict[str, bytes], plain: list[str], lead: str) -> None:
        """Adds pieces that the library has to see whole: many in one call.

        Behind a space the first token of a piece is the only one that begins with that space; other pieces are kept apart
        by line breaks.
        """
        for at in range(0, len(plain), CALL_PIECES):
            some = plain[at : at + CALL_PIECES]
            if lead == " " and self._opens is not None:
                ids = self._ids(lead + lead.join(some))
                starts = np.flatnonzero(self._opens[ids])
                if len(starts) == len(some) and starts[0] == 0:
                    self._put(cache, some, ids, starts, np.append(starts[1:], len(ids)))
                    continue
            text = lead + (_SPLITTER + lead).join(some)
            ids = self._ids(text)
            ends = np.append(np.flatnonzero(ids == self._newline), len(ids))
            whole = text.count(_SPLITTER) == len(some) - 1  # no piece has a break of its own
            last = np.arange(len(some)) if whole else np.cumsum([p.count(_SPLITTER) + 1 for p in some]) - 1
            if last[-1] != len(ends) - 1:
                raise ValueError("the vocabulary joins a line break with a visible character")
            stops = ends[last]
            self._put(cache, some, ids, np.append(0, stops[:-1] + 1), stops)

    @staticmethod
    def _put(cache: dict[str, bytes], some: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        raw = ids.tobytes()
        cache.update([(p, raw[a:b]) for p, a, b in zip(
            some, (starts * ID_BYTES).tolist(), (stops * ID_BYTES).tolist(), strict=True)])

    def _trim(self) -> None:
        """Pieces that do not come again while half as many new ones as a worker keeps are met are forgotten."""
        most = self._cache_words // 2
        if len(self._bare) > most:
            self._before[""], self._bare = self._bare if most else {}, {}
        if len(self._spaced) > most:
            self._before[" "], self._spaced = self._spaced if most else {}, {}

    def encode_words(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of each of these strings without white space, behind one space on demand."""
        self._trim()
        wanted = list(dict.fromkeys(words))
        ids = self._spaced_ids(wanted) if spaced else self._bare_ids(wanted)
        return ids if len(wanted) == len(words) else list(map(dict(zip(wanted, ids, strict=True)).__getitem__, words))

    def _bare_ids(self, wanted: list[str]) -> list[bytes]:
        return self._found(self._bare, wanted, "")

    def _spaced_ids(self, wanted: list[str]) -> list[bytes]:
        return self._found(self._spaced, wanted, " ")

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, without the end id; null and empty texts have none. Equal texts are encoded once."""
        self._trim()
        new = list(dict.fromkeys(filter(None, texts)))
        done = dict(zip(new, put_together(new, self._bare_ids, self._spaced_ids), strict=True))
        return [done[text] if text else b"" for text in texts]


@lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder per worker process, vocabulary and size of the cache."""
    return Encoder(path, cache_words)
