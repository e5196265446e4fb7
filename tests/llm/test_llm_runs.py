"""Periodic runs against a search through all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burnledger.llm import op13_runs as periodic
from burnledger.llm import queries
from tests_llm_data import ODD

SF = "/root/testdata/sf0.001"


def _runs(words):
    """Every period in turn; a stretch counts under its smallest period only."""
    out, n = {}, len(words)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([numbers[w] for w in words])
    for p in range(1, n // 3 + 1):
        same = np.concatenate([[0], (a[p:] == a[:-p]).astype(int), [0]])
        turns = np.diff(same)
        for s, e in zip(np.flatnonzero(turns == 1).tolist(), (np.flatnonzero(turns == -1) + p).tolist(), strict=True):
            if e - s >= max(24, 3 * p) and (s, e) not in out:
                out[s, e] = p
    return sorted((s, e - s, p) for (s, e), p in out.items())


def _expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(_runs(words), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _text(draw, size):
    """Words with nested repeats of many periods."""
    out = []
    while len(out) < size:
        kind = draw.random()
        piece = [draw.choice("abcd") if kind < 0.5 else f"w{draw.randint(0, 400)}" for _ in range(draw.choice((1, 1, 2, 3, 5, 6, 7, 9, 13, 22, 40, 75)))]
        if kind < 0.3:
            piece = piece * draw.choice((4, 9, 30)) + [draw.choice("abcd")]
        out += piece * draw.choice((1, 1, 2, 3, 4, 8)) + piece[: draw.randint(0, len(piece))]
    return [w.encode() for w in out[:size]]


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_nested_repeats(seed):
    draw = random.Random(seed)
    documents = [_text(draw, draw.choice((0, 1, 23, 24, 60, 200, 700, 1500))) for _ in range(14)]
    assert periodic.runs_of(documents) == [_runs(d) for d in documents]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=9), st.integers(1, 9), st.integers(1, 4)), max_size=6),
       st.integers(1, 4))
def test_runs_over_two_words(parts, times):
    words = [w.encode() for piece, often, again in parts for w in (piece * often + ["a"]) * again] * times
    assert periodic.runs_of([words]) == [_runs(words)]


def test_every_period_is_found():
    documents = []
    for p in [*range(1, 140), 191, 192, 193, 255, 256, 257, 341, 384, 385]:
        size = max(24, 3 * p)
        documents.append([b"x"] + [f"{i % p}".encode() for i in range(size)] + [b"y"])
        # A period that is highly periodic itself but for one word.
        if p > 2:
            documents.append([b"x"] + [b"odd" if i % p == p // 2 else b"same" for i in range(size)] + [b"y"])
    got = periodic.runs_of(documents)
    assert got == [_runs(d) for d in documents]
    assert all(any(s <= 1 and length >= len(d) - 2 for s, length, _ in runs) for d, runs in zip(documents, got, strict=True))


def test_regular_but_aperiodic_words():
    thue = [b"01"[k.bit_count() % 2 :][:1] for k in range(6000)]
    fibonacci, b = b"0", b"01"
    while len(b) < 5000:
        fibonacci, b = b, b + fibonacci
    documents = [thue, [bytes([c]) for c in b], thue[:2500] + thue[:2500] * 2]
    assert periodic.runs_of(documents) == [_runs(d) for d in documents]


def test_query_against_plain_search(spark, texts):
    rows = queries.QUERIES["op13_runs"](spark, SF).collect()
    got = {r.doc_id: (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows}
    assert len(got) == len(rows) == len(texts)
    assert got == {i: _expected(i, t) for i, t in texts.items()}
    assert sum(r.n_runs > 0 for r in rows) > len(rows) / 20


def test_odd_rows(spark, odd, nothing):
    rows = periodic.detect(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.runs == [] and r.strongest is None and r.collapsed == "" and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    long = next(r for r in rows if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 97)] and long.collapsed.split() == [f"word{i}" for i in range(97)]
    assert next(r.collapsed for r in rows if r.doc_id is None) == "no id here at all, friend"
    assert periodic.detect(nothing).collect() == [] and periodic.report(nothing).collect() == []
    assert len(periodic.report(odd).where("runs_sha256 IS NOT NULL AND collapsed_sha256 IS NOT NULL").collect()) == len(ODD)
    clashing = odd.selectExpr("text AS runs", "doc_id", "words AS collapsed", "text", "doc_id AS strongest")
    assert sorted(map(str, periodic.detect(clashing).collect())) == sorted(map(str, rows))
