"""Spelling variants against plain edit distance over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burnledger.llm import op12_spelling as spelling
from burnledger.llm import queries

SF = "/root/testdata/sf0.001"


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _neighbours(words):
    """Words that share a word with one place deleted are candidates; plain comparison decides."""
    at = {}
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            at.setdefault(x, []).append(w)
    out = {w: set() for w in words}
    for group in at.values():
        for a in group:
            out[a].update(b for b in group if _one_edit(a, b))
    return out


def _counted(texts):
    n = Counter()
    for doc_id, text in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def _expected(n):
    out, form = [], {}
    nearby = _neighbours(n)
    for w in n:
        best = min(nearby[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(nearby[w]), n.get(form[w])))
    return sorted(out)


def _rows(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_suffix_array():
    draw = random.Random(3)
    for n in (1, 2, 7, 60):
        text = [draw.randint(1, 3) for _ in range(n)]
        assert spelling.suffix_array(np.array(text)).tolist() == sorted(range(n), key=lambda i: text[i:])


def test_intervals_stay_in_step():
    words = sorted({"banana", "ananas", "bananas", "nana", "pan"})
    index, joined = spelling.Index(words), "$" + "$".join(words) + "$"
    for pattern in ("ana", "nan", "an", "$pan$", "as$", "zzz"):
        for turns in (0, 1, 0b0101010101, 0b1100110011):
            # Grow the pattern from some place inside, to either side.
            low = high = len(pattern) // 2
            state = index.everything(1)
            for k in range(len(pattern)):
                right = (turns >> k) & 1 if 0 < low and high < len(pattern) else int(low == 0)
                c = pattern[high] if right else pattern[low - 1]
                low, high = (low, high + 1) if right else (low - 1, high)
                if c != "$" and ord(c) not in index.alphabet:
                    state[:, 2] = 0
                    break
                code = 1 if c == "$" else int(np.searchsorted(index.alphabet, ord(c))) + 2
                state = index.extend(state, np.array([code]), right)
            wanted = sum(joined.startswith(pattern, i) for i in range(len(joined)))
            assert state[0, 2] == wanted
            if wanted:
                for way, text, sought in ((0, joined, pattern), (1, joined[::-1], pattern[::-1])):
                    suffixes = index.sides[way].suffixes[state[0, way] : state[0, way] + wanted]
                    assert all(text.startswith(sought, int(i)) for i in suffixes)


@settings(max_examples=120, deadline=None)
@given(st.sets(st.text("abé", min_size=2, max_size=8), min_size=1, max_size=60), st.integers(1, 3))
def test_search_over_few_letters(words, parts):
    words = sorted(words)
    queries_ = []
    for k, w in enumerate(words):
        regions = [(len(w) // 2, len(w)), (0, len(w) // 2)]
        for _ in range(parts - 1):  # refined as for hot keys, down to single places
            regions = [x for a, b in regions for x in ([((a + b) // 2, b), (a, (a + b) // 2)] if b - a > 1 else [(a, b)])]
        queries_ += [(k, a, b) for a, b in regions]
    got = {(words[a], words[b]) for a, b in spelling.near_in_shard(words, queries_).tolist()}
    assert got == {(a, b) for a, found in _neighbours(words).items() for b in found}


def test_blocks_of_queries(monkeypatch):
    draw = random.Random(9)
    words = sorted({"".join(draw.choice("abcde") for _ in range(draw.randint(5, 40))) for _ in range(300)})
    words = sorted({*words, *(w[:3] + w[4:] for w in words[::2]), *("x" + w for w in words[::3])})
    asked = [(k, a, b) for k, w in enumerate(words) for a, b in ((len(w) // 2, len(w)), (0, len(w) // 2))]
    whole = spelling.near_in_shard(words, asked).tolist()
    monkeypatch.setattr(spelling, "BLOCK_CELLS", 50)
    assert spelling.near_in_shard(words, asked).tolist() == whole


@pytest.mark.parametrize(("hot", "shard_rows"), [(spelling.HOT, spelling.SHARD_ROWS), (8, 300)])
def test_shards_and_hot_halves(spark, hot, shard_rows):
    draw = random.Random(2)
    n = {}
    for _ in range(500):  # many words with the same beginning or end
        w = "".join(draw.choice("abcdeé") for _ in range(draw.randint(3, 6)))
        n[draw.choice(("inter", "", "")) + w + draw.choice(("ation", "", "x"))] = draw.choice((3, 4, 8, 16, 17, 40, 100))
    n = {w: c for w, c in n.items() if len(w) >= 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = _rows(spelling.grouped(words, hot=hot, shard_rows=shard_rows))
    assert got == _expected(n)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of two forms


def test_query_against_all_words(spark, texts):
    got = _rows(queries.QUERIES["op12_spelling"](spark, SF))
    wanted = _expected(_counted(texts.items()))
    assert got == wanted and any(r[1] for r in got)


def test_odd_rows(spark, odd, nothing):
    repeated = odd.union(odd).union(odd)
    assert {r.word: r.n for r in spelling.vocabulary(repeated).collect()} == _plain(repeated)
    assert spelling.report(nothing).collect() == []
    long = "a" * 5000
    docs = spark.createDataFrame([(i, f"{long} {long}b x{long} ÀÀÀÀÀ") for i in range(3)], "doc_id long, text string")
    rows = {r.word: (r.n, r.n_near, r.form) for r in spelling.grouped(spelling.vocabulary(docs)).collect()}
    assert rows == {long: (3, 2, None), long + "b": (3, 1, None), "x" + long: (3, 1, None), "À" * 5: (3, 0, None)}
    assert _rows(spelling.report(docs.selectExpr("doc_id", "text", "text AS word", "doc_id AS n", "text AS key")))


def _plain(frame):
    n = Counter()
    for r in frame.select("text").collect():
        n.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")))
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
