"""SimHash fingerprints and their components against plain code over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from burnledger.llm import op11_simhash as simhash
from burnledger.llm import queries
from tests_llm_data import ODD

SF = "/root/testdata/sf0.001"


def _print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(prints, bits=4):
    """Smallest index reachable from each by links, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_against_plain_code(texts):
    for text in [None, "", " \n", "one", "one two three four", "A b\x0bC d\x0ce F", "a b c d " * 9, "é É ü x y z", *list(texts.values())[:25]]:
        assert simhash.fingerprint(text) == _print(text)


def test_parts_add_up(monkeypatch):
    text = " ".join(f"w{i * i % 83}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PART", 7)
    assert simhash.fingerprint(text) == whole


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=6), st.integers(5, 12))
def test_close_prints_share_a_key(x, flips, blocks):
    y = x
    for b in flips:
        y ^= 1 << b
    shared = any(x & m % 2**64 == y & m % 2**64 for m in simhash.masks(blocks))
    assert shared or (x ^ y).bit_count() > 4


def test_blocks_follow_the_count():
    chosen = [simhash.blocks_for(n) for n in (0, 10, 10**4, 10**6, 10**8, 10**10)]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[-1] > 7


def _clouds(draw, n):
    out = set()
    while len(out) < n:
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 30)):
            out.add(x)
            for b in draw.sample(range(64), draw.randint(0, 3)):
                x ^= 1 << b
    return sorted(out)


def test_forest_and_streams_connect_all():
    draw = random.Random(11)
    values = _clouds(draw, 150)
    roots = _roots(values)
    found = simhash.forest(np.array(values, np.uint64))
    assert len(found) == len(values) - len(set(roots))
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in found)


@pytest.mark.parametrize("crowd", [3, simhash.CROWD])
def test_links_of_clouds(spark, crowd):
    draw = random.Random(5)
    values = _clouds(draw, 400)
    roots = _roots(values)
    signed = [v - (v >> 63 << 64) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "print long")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    at = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == roots


def test_query_against_all_pairs(spark, texts):
    rows = queries.QUERIES["op11_simhash"](spark, SF).collect()
    ids = sorted(texts)
    prints = [_print(texts[i]) for i in ids]
    roots = _roots(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == [
        (i, f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots, strict=True)]


def test_odd_rows(spark, odd, nothing):
    rows = simhash.components(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {("0" * 16, 1)}
    same = [r for r in rows if r.doc_id == 4]
    assert len(same) == 3 and {r.component_id for r in same} == {4}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.components(nothing).collect() == []
    clashing = odd.selectExpr("doc_id AS key", "text AS print", "doc_id", "words AS mask", "text", "doc_id AS node", "text AS root")
    assert sorted(map(str, simhash.components(clashing).collect())) == sorted(map(str, rows))
