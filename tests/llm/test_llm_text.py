"""Operators on texts against brute force, held-out accuracy or SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from burnledger.llm import common, op1_language, op2_decontamination, op3_license, op5_substring, op7_quality
from burnledger.llm import op8_fingerprint as prints
from burnledger.llm import op9_jaccard, queries, wordhash
from tests_llm_data import ODD

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def _fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


# ---------------------------------------------------------------- classifiers

def test_language(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    model = op1_language.train(docs)
    rows = op1_language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (_fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    got = op1_language.predict(odd, model).collect()
    assert len(got) == len(ODD) and sorted(r.lang_pred for r in got if r.doc_id in (1, 2, 3)) == ["und"] * 3
    assert op1_language.predict(nothing, model).count() == 0
    empty = op1_language.identify(nothing.withColumn("lang", F.lit("en")))
    assert empty.count() == 0
    unlearned = op1_language.predict(odd, op1_language.fit([]))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_language_kernel_by_hand():
    a, b = op1_language.grams("ab"), op1_language.grams("ab!")
    # One break sign at either end: 3 signs, 3 pairs, 2 triples.
    assert len(a) == len(set(a.tolist())) == 3 + 3 + 2 and a.tolist() == b.tolist()
    model = op1_language.fit([("aa ab", "x"), ("aa ba", "x"), ("zz zy", "y"), ("zz yz", "y")])
    out, lettered = model.outputs(["aa ab", "zz zy", "12"])
    assert lettered.tolist() == [True, True, False]
    assert out[0].argmax() == model.languages.index("x") and out[1].argmax() == model.languages.index("y")


def test_quality(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    model = op7_quality.train(docs, labels)
    rows = op7_quality.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (_fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert op7_quality.scored(odd, model).count() == len(ODD) and op7_quality.scored(nothing, model).count() == 0
    kept = op7_quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in op7_quality.scored(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == wanted
    assert op7_quality.fit([]).score("x") == pytest.approx(0.5)
    assert op7_quality.fit([("good text", 1)]).score(None) > 0.9


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 10 = 0, 'rare', 'common') AS label").union(
        spark.createDataFrame([(None, "common"), (5, None)], "id long, label string"))
    first, again = (common.bounded_sample(d, "id", "label", 40) for d in (rows, rows.repartition(7)))
    assert Counter(r.label for r in first.collect()) == {"rare": 40, "common": 40}
    assert {r.id for r in first.collect()} == {r.id for r in again.collect()}


# ---------------------------------------------------------------- decontamination

def _edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    draw = np.random.default_rng(1)
    for _ in range(200):
        p, t = ("".join(draw.choice(list("abc "), n)) for n in (draw.integers(1, 80), draw.integers(0, 90)))
        assert op2_decontamination.nearest(op2_decontamination.patterns(p), len(p), t)[0] == _edits(p, t)


def test_decontamination(spark, texts, odd, nothing):
    draw = np.random.default_rng(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    normal, budget = op2_decontamination.normal, op2_decontamination.budget
    planted = []
    for k, (_, text) in enumerate(items[:12]):  # passages with as many edits as allowed, and with twice as many
        letters = list(normal(text))
        for at in draw.choice(len(letters), budget(len(letters)) * (1 + k % 2), replace=False):
            letters[at] = "#"[: int(draw.integers(0, 1))] or "q"
        planted.append((10_000 + k, "Some words before. " + "".join(letters).upper() + " and after"))
    docs = spark.createDataFrame([*texts.items(), *planted], "doc_id long, text string")
    rows = op2_decontamination.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    wanted = {}
    for doc_id, text in [*list(texts.items())[:40], *planted]:
        for item_id, item in items:
            n = normal(item)
            grams = {n[i : i + 5] for i in range(len(n))}
            if len(n) < op2_decontamination.LEAST_ITEM or not any(g in normal(text) for g in grams):
                continue
            if (d := _edits(n, normal(text)[:2500])) <= budget(len(n)):
                wanted[doc_id, item_id] = d
    shown = {k: v for k, v in got.items() if k[0] in {d for d, _ in [*list(texts.items())[:40], *planted]}}
    assert {k: v for k, v in wanted.items()}.items() <= shown.items()
    for (doc_id, item_id), d in shown.items():
        assert d == _edits(normal(dict(items)[item_id]), normal(dict([*texts.items(), *planted])[doc_id]))
    assert sum(k[0] >= 10_000 for k in got) >= 6
    left = op2_decontamination.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in [*texts.items(), *planted]} - {d for d, _ in got}
    bench = spark.createDataFrame([(1, None), (None, "x" * 40), (2, "")], "item_id long, text string")
    assert op2_decontamination.find(odd, bench).count() == 0 and op2_decontamination.clean(odd, bench).count() == len(ODD)
    assert op2_decontamination.find(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_finds_all_within_the_share(spark):
    draw = np.random.default_rng(5)
    items, docs, wanted = [], [], {}
    for k, size in enumerate([24, 30, 32, 47, 80, 110, 224, 384] * 4):
        item = op2_decontamination.normal(" ".join("".join(draw.choice(list("abcdefgh"), draw.integers(2, 9))) for _ in range(100))[:size])
        letters, allowed = list(item), int(len(item) * op2_decontamination.ERROR_SHARE)
        for at in np.linspace(len(letters) - 2, 1, allowed).astype(int):  # evenly spread, so that few long pieces are left whole
            letters[at : at + 1] = [[], ["z"], [letters[at], "z"]][int(draw.integers(0, 3))]
        items.append((k, item))
        docs.append((k, f"before it {''.join(letters)} after it"))
        wanted[k, k] = _edits(item, op2_decontamination.normal(docs[-1][1]))
        assert wanted[k, k] <= allowed
    assert any(d > max(0, len(dict(items)[k]) // 16 - 1) for (k, _), d in wanted.items())
    passages, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in op2_decontamination.find(passages, bench).collect()}
    assert got == wanted
    assert op2_decontamination.clean(passages, bench).count() == 0


def test_decontamination_finds_short_items_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "Ünder"), (3, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Q: what is 2 + 2"), (2, "what is 2+22"), (3, "somewhat is 2+2"), (4, "founder, Under"),
                                  (5, "ünder"), (6, "what is 2+22, what is 2+2!"), (7, "what is 2+3")], "doc_id long, text string")
    got = op2_decontamination.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance, r.start, r.length) for r in got} == {(1, 1, 0, 2, 11), (5, 2, 0, 0, 5), (6, 1, 0, 13, 11)}
    assert {r.doc_id for r in op2_decontamination.clean(docs, bench).collect()} == {2, 3, 4, 7}


# ---------------------------------------------------------------- licences

def test_licenses_against_sql(spark, odd, nothing):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF2}/documents.parquet'")
    got = op3_license.scan(spark.read.parquet(f"{SF2}/documents.parquet"), op3_license.known(spark))
    rows = con.sql(queries.ORACLES["op3_license"])
    assert Counter(map(tuple, got.select(*rows.columns).collect())) == Counter(rows.fetchall()) and got.count() > 0
    mit = op3_license.KNOWN[4][1].replace("sublicense", "sub-license").replace("Software", "SOFTWARE").replace(". ", ".\n")
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit + " and more"), (3, None), (4, ""),
                                  (None, "released under the  MIT Licence!")], "doc_id long, text string")
    found = {r.doc_id: (r.license_id, r.whole) for r in op3_license.scan(docs, op3_license.known(spark)).collect()}
    assert found == {1: ("MIT", True), None: ("MIT", True)}
    assert op3_license.scan(odd, op3_license.known(spark)).count() == 0
    assert op3_license.scan(nothing, op3_license.known(spark)).count() == 0


def test_licenses_at_large(spark):
    # The longest known form in other letters, as a comment.
    known = op3_license.known(spark).where("license_id = 'GPL-3.0'").select("text").collect()
    gpl = max((r.text for r in known), key=len).upper().replace("\n", "\n# ")
    header = """# Copyright 2024 Someone
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.

print("hello")
"""
    apache = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() {}"""
    texts = {1: gpl, 2: header, 3: apache, 4: "// SPDX-License-Identifier: BSD-3-Clause\nint x;", 5: "Text on the GNU General Public License.",
             6: "#!/bin/sh\n# SPDX-License-Identifier: LGPL-2.1-or-later\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.license_id, r.whole, r.n_lines) for r in op3_license.scan(docs, op3_license.known(spark)).collect()}
    assert found == {(1, "GPL-3.0", True, 0), (2, "GPL-3.0", False, 0), (3, "Apache-2.0", False, 0), (4, "BSD-3-Clause", False, 1), (6, "LGPL-2.1", False, 1)}
    wanted = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC0-1.0", "MIT", "ISC"}
    sizes = op3_license.known(spark).groupBy("license_id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("forms")).collect()
    assert {r.license_id for r in sizes if r.n > 600 and r.forms >= 3} >= wanted


# ---------------------------------------------------------------- substring deduplication

def _substring(rows, length=50):
    seen, out = {}, Counter()
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            if doc_id is not None:
                seen[key] = min(doc_id, seen.get(key, doc_id))
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if doc_id is not None and seen[tuple(words[k : k + length])] < doc_id:
                gone[k : k + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("many", [200, 2])
def test_substring(spark, texts, odd, nothing, many, monkeypatch):
    monkeypatch.setattr(op5_substring, "MANY_CONTEXTS", many)
    monkeypatch.setattr(op5_substring, "SHARD_WORDS", 5_000)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [*texts.items(), *[(1000 + i, f"own{i} a b {passage} own{i} " * (1 + i % 2)) for i in range(12)],
            (1100, " ".join(passage.split()[:49])), (1101, " ".join(passage.split()[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, op5_substring.report(docs).collect())) == _substring(rows)
    assert Counter(map(tuple, op5_substring.report(odd).collect())) == _substring([(i, t) for i, t, _ in ODD])
    assert op5_substring.report(nothing).count() == 0 and op5_substring.remove(nothing).count() == 0


def test_substring_spreads_a_template_with_a_varying_word(spark, monkeypatch):
    monkeypatch.setattr(op5_substring, "MANY_CONTEXTS", 4)
    head, tail = (" ".join(f"{side}{i}" for i in range(45)) for side in "ab")
    rows = [(n * 40 + k, f"own{n}x{k} {head} value{k} {tail} own{n}x{k}") for k in range(40) for n in range(2)]
    rows += [(1000 + k, f"{head} value{k % 3} {tail[: 20 * k]}") for k in range(6)]
    plain, seen = op5_substring._by_route, []

    def watched(*args):
        cut, spread = plain(*args)
        per = cut.where("NOT spread").select("anchor", "digest").distinct().groupBy("anchor").count()
        seen.append((per.agg(F.max("count")).first()[0] or 0, cut.where("spread").count()))
        return cut, spread

    monkeypatch.setattr(op5_substring, "_by_route", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, op5_substring.report(docs).collect())) == _substring(rows)
    assert all(most <= 4 for most, _ in seen) and any(n for _, n in seen)


def test_substring_keeps_other_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "head\n" + passage, "a"), (2, "tail\t" + passage + "  end", "b")], "doc_id long, text string, words string")
    assert sorted(map(tuple, op5_substring.remove(docs).collect())) == [(1, "head\n" + passage, "a"), (2, "tail end", "b")]


# ---------------------------------------------------------------- fingerprints

def test_fingerprints(spark, texts, odd, nothing, documents):
    rows = {r.doc_id: r for r in prints.edited_pairs(documents).collect()}
    ids = sorted(texts)
    for i, doc_id in enumerate(ids):
        text, after = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert rows[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[doc_id].n_chars == len(text)
    assert len({r.fingerprint for r in rows.values()}) == len(set(texts.values()))
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.4
    assert prints.edited_pairs(odd).count() == len(ODD) and prints.edited_pairs(nothing).count() == 0
    single = prints.edited_pairs(odd.where("doc_id = 5")).first()
    assert single.near_next == 1.0 and single.n_chars == 3


def test_fingerprints_add_and_take_away(spark):
    def of(text):
        df = spark.createDataFrame([(text,)], "t string")
        return prints.vectors(df.selectExpr("1 AS k", "t"), ["k"], "t").select(prints.vector().alias("v"))
    a, b = "first line here, with words\nsecond line", "third line of text"
    both = of(b + "\n\n" + a).first().v
    joined = of(a).withColumnRenamed("v", "x").crossJoin(of(b).withColumnRenamed("v", "y")).select(
        prints.combine(F.col("x"), F.col("y")).alias("v"), "y")
    assert joined.first().v == both
    assert joined.select(prints.remove(F.col("v"), F.col("y")).alias("v")).first().v == of("second line\nfirst line here, with words").first().v
    assert of(a).first().v != of(a + "\nsecond line").first().v


def test_fingerprints_stay_alike_after_insertions_and_without_blanks(spark):
    draw = np.random.default_rng(4)
    names = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 9))) for _ in range(2000)]
    words = draw.choice(names, 400).tolist()
    spread = list(words)
    for at in sorted(draw.choice(400, 8, replace=False).tolist(), reverse=True):
        spread.insert(at, "inserted")
    han, kana = ("".join(map(chr, draw.integers(a, b, 800))) for a, b in ((0x4E00, 0x9FA0), (0x3041, 0x30FB)))
    solid = "".join(words)
    cases = {"front": (" ".join(words), "one " + " ".join(words), 0.9, 1), "gone": (" ".join(words), " ".join(words[1:]), 0.9, 1),
             "spread": (" ".join(words), " ".join(spread), 0.8, 1), "other": (" ".join(words), " ".join(draw.choice(names, 400)), 0, 0.35),
             "han": (han, han[:600] + han[:200][::-1], 0.55, 0.95), "han front": (han, "\u4e2d" + han, 0.9, 1),
             "kana": (kana, kana[:600] + kana[:200][::-1], 0.55, 0.95), "kana front": (kana, "\u306e" + kana, 0.9, 1),
             "solid": (solid, "x" + solid, 0.8, 1)}
    rows = spark.createDataFrame([(k, side, v[side]) for k, v in cases.items() for side in (0, 1)], "k string, side int, t string")
    made = prints.vectors(rows, ["k", "side"], "t").select("k", "side", prints.vector().alias("v"))
    pairs = made.where("side = 0").select("k", F.col("v").alias("x")).join(made.where("side = 1").select("k", F.col("v").alias("y")), "k")
    got = {r.k: r.near for r in pairs.select("k", prints.likeness(F.col("x"), F.col("y")).alias("near")).collect()}
    assert not {k: near for k, near in got.items() if not cases[k][2] <= near <= cases[k][3]}


# ---------------------------------------------------------------- similarity join

def _components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("light", [None, 12])
def test_components(spark, texts, odd, nothing, light, monkeypatch):
    if light is not None:
        plain = op9_jaccard.learn_order
        monkeypatch.setattr(op9_jaccard, "learn_order", lambda *a: op9_jaccard.Order(plain(*a).classes, light))
    draw = np.random.default_rng(3)
    rows = list(texts.items())[:60]
    base = [f"b{i}" for i in range(120)]
    for k in range(40):  # a chain of copies with more and more edits
        words = list(base)
        for at in draw.choice(120, int(draw.integers(0, 6)), replace=False):
            words[at] = f"x{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, " ".join(f"s{i}" for i in draw.permutation(9)[: draw.integers(5, 10)])) for k in range(30)]
    rows += [(3000, "Short one"), (3001, "short ONE"), (3002, "t1 t2 t3 t4 t5 t6 t7 t8"), (3003, "t1 t2 t3 t4 t5 t6 t7 t8 t9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op9_jaccard.components(docs).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == _components(rows)
    if light is None:
        assert Counter(map(tuple, op9_jaccard.components(odd).collect())) == _components([(i, t) for i, t, _ in ODD])
        assert op9_jaccard.components(nothing).count() == 0


def test_parity_sketches_bound_the_difference():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(draw.integers(0, 3000, int(draw.integers(0, 900))).astype(np.uint64)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (op9_jaccard.sketch(a) ^ op9_jaccard.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and len(op9_jaccard.sketch(a)) == op9_jaccard.PARITIES // 64


def test_wide_sketches_leave_only_pairs_that_cannot_link(spark):
    draw, sets = np.random.default_rng(6), {}
    for k in range(24):  # from a common stock, so that sizes, widths and likeness vary
        sets[k] = np.sort(draw.choice(1300, int(draw.integers(400, 1250)), replace=False)).astype(np.uint64) * np.uint64(2654435761)
    wide = {k: op9_jaccard.wide_sketch(v) for k, v in sets.items()}
    nodes = spark.createDataFrame([(k, len(v), (op9_jaccard.sketch(v) if wide[k] is None else wide[k]).tolist()) for k, v in sets.items()],
                                  "node long, n long, sketch array<long>")
    assert {len(w) for w in wide.values() if w is not None} == {32, 64}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    kept = {tuple(r) for r in op9_jaccard._alike(spark.createDataFrame(pairs, "a long, b long"), nodes, 80).collect()}
    shared = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in pairs}
    linked = {(a, b) for a, b in pairs if 100 * shared[a, b] >= 80 * (len(sets[a]) + len(sets[b]) - shared[a, b])}
    assert linked and linked <= kept and len(kept) < len(pairs) / 2


def test_jaccard_forms_few_pairs_in_groups_of_near_copies(spark, monkeypatch):
    draw, base, rows = np.random.default_rng(7), [f"b{i}" for i in range(200)], []
    for k in range(400):
        words = list(base)
        for at in draw.choice(200, int(draw.integers(2, 9)), replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"o{k}_{i}" for i in range(50))) for k in range(50)]
    formed, plain = [], op9_jaccard.verified

    def counting(pairs, *rest):
        formed.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(op9_jaccard, "verified", counting)
    got = op9_jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == _components(rows)
    assert sum(formed) < 5 * len(rows)


def test_jaccard_leaves_lists_whose_pairs_have_all_met(spark, monkeypatch):
    """Lists of two are done after their leader's round; before, their rows were shuffled again with their sketches."""
    rows = [(2 * k + i, " ".join([f"p{k}_{w}" for w in range(60)] + [f"q{k}_{i}_{w}" for w in range(60)]))
            for k in range(60) for i in range(2)]
    left, plain = [], op9_jaccard._crossing

    def counting(members):
        left.append(members.count())
        return plain(members)

    monkeypatch.setattr(op9_jaccard, "_crossing", counting)
    got = op9_jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == _components(rows)
    assert left == [0]


@pytest.mark.parametrize("bits", [3, 25])
def test_jaccard_shuffles_the_texts_that_are_asked_for(spark, monkeypatch, bits):
    monkeypatch.setattr(op9_jaccard, "FILTER_BITS", bits)
    rows = spark.range(-1000, 1000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("tie"), F.lit("x").alias("text"))
    wanted = rows.where("doc_id % 50 = 0").select("doc_id", "tie")
    passed = op9_jaccard._asked_for(rows, wanted)
    assert passed.columns == rows.columns and passed.join(wanted, ["doc_id", "tie"]).count() == 40
    assert 40 <= passed.count() < (45 if bits == 25 else 2001)
    assert op9_jaccard._asked_for(rows, wanted.limit(0)).count() == 0


def test_jaccard_keeps_one_row_of_each_component(spark, nothing):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, long, "a"), (5, long, "b"), (5, long + " more", "c"), (None, long, "d"), (3, long + " and", "e"), (4, "other words", "f"),
            (None, "no id here", "g"), (None, "no id here", "g"), (7, "", "h"), (7, None, "i"), (None, None, "j"), (None, " ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("full", F.lit(1)).withColumn("tie", F.lit(2))
    got = op9_jaccard.keep_first(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(3, long + " and"), (4, "other words"), (None, "no id here"), (7, ""), (7, None), (None, None), (None, " ")])
    assert op9_jaccard.keep_first(nothing).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 300 + i) for i in range(50)]
    roots = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and roots[101] == roots[102] == 100
    assert all(roots[300 + i] == 200 for i in range(50))


def test_run_hashes_depend_on_content_only(monkeypatch):
    words = [f"w{i % 37}" for i in range(300)]
    hashes = wordhash.word_hashes(" \n".join(words))
    for length in (5, 50):
        runs = wordhash.run_hashes(hashes, length)
        assert len(runs) == 300 - length + 1
        for i in range(0, len(runs) - 37):
            assert runs[i] == runs[i + 37]
        assert len(set(runs.tolist())) == 37
    monkeypatch.setattr(wordhash, "_PART", 20)
    assert wordhash.word_hashes(" \n".join(words)).tolist() == hashes.tolist()
    assert wordhash.sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_keep_what_they_should(spark):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, SF), spark)
        assert docs.columns == columns
        text = {r.doc_id: r.text for r in before.collect()}
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(text)
        if name == "n-gram Jaccard join":
            assert set(after) == {c for _, _, c in _components(list(text.items()))}
        if name == "substring dedup":
            assert Counter((i, hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for i, t in after.items()) == \
                Counter((i, h) for i, _, _, h in _substring(list(text.items())))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "benchmark decontamination":
            items = [op2_decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in op2_decontamination.normal(x) for x in after.values() for t in items)
            assert all(any(t[:16] in op2_decontamination.normal(x) or t[-16:] in op2_decontamination.normal(x) for t in items)
                       for i, x in text.items() if i not in after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    assert docs.count() < start.count()
