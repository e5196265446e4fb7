"""Token counts, packing and token-id files against plain encoding with the library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from burnledger.llm import op4_token_counts as counts
from burnledger.llm import op6_packing as packing
from burnledger.llm import op10_binary_ids as files
from burnledger.llm.encoder import Encoder, default_vocabulary
from tests_llm_data import ODD


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain, texts):
    odd = [" a  b", "x\n\n y ", "<|endoftext|> q", "a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|>", "a\n<|endoftext|>\n b <|endoftext|><|endoftext|>", "  z", " ", "a\tb c", "a\nb", "\n", "a\n b\nc d\ne", "it's  we'll", " x   y"]
    given = [*odd, None, "", *[t for _, t, _ in ODD], *list(texts.values())[:60]]
    got = Encoder(default_vocabulary()).encode_all(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(t) for t in given]


def test_pieces_of_known_words_are_not_encoded_again(plain):
    """Marks behind a word and line breaks between words cost the library nothing once the words are known."""
    encoder = Encoder(default_vocabulary())
    encoder.encode_all(["x wort Änd", "wort", "Änd", "x ... ,"])
    seen, ids = [], encoder._ids
    encoder._ids = lambda text: seen.append(text) or ids(text)
    texts = ["x wort, Änd... wort.\nÄnd,\nwort"]
    assert encoder.encode_all(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]
    assert not any("wort" in text or "Änd" in text for text in seen)


def test_a_new_piece_is_parted_once(plain):
    """Its word and marks are found once for each line; before, up to four times."""
    encoder = Encoder(default_vocabulary())
    seen, stem = [], encoder._stem
    encoder._stem = lambda line: seen.append(line) or stem(line)
    texts = ["x wort, Änd.\nÖl wort; y! z,\nand"]
    assert encoder.encode_all(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]
    assert sorted(seen) == sorted(["x", "wort,", "Änd.", "Öl", "wort;", "y!", "z,", "and"][1:])


def test_a_full_cache_keeps_what_comes_again(plain):
    """Bounded by its two halves and a batch; a piece of every batch goes to the library once, before again after each clearing."""
    encoder, often = Encoder(default_vocabulary(), cache_words=200), []
    learn = encoder._learn_plain
    encoder._learn_plain = lambda cache, plain, lead: often.extend(p for p in plain if p == "often") or learn(cache, plain, lead)
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(3000)]
    for at in range(0, len(names), 50):
        text = " ".join(["x often", *names[at : at + 50]])
        assert encoder.encode_all([text]) == [np.array(plain(text), "<u4").tobytes()]
    assert often == ["often"]
    assert len(encoder._spaced) + len(encoder._before[" "]) <= 200 + 2 * 60


def test_words_behind_spaces_share_library_calls_without_breaks(plain):
    encoder = Encoder(default_vocabulary())
    seen, ids = [], encoder._ids
    encoder._ids = lambda text: seen.append(text) or ids(text)
    text = "x wort Änd 12a Ġ ĠĊ 中文 a.b <|endoftext|> y<|endoftext|>z q"
    assert encoder.encode_all([text]) == [np.array(plain(text), "<u4").tobytes()]
    assert not any("\n" in s for s in seen)


def test_texts_are_cut_and_joined_without_a_step_a_piece(plain, monkeypatch):
    """Python meets the distinct pieces only; before, it cut every text and looked up every piece of it."""
    monkeypatch.setattr("burnledger.llm.encoder.pieces", None)
    encoder, wanted = Encoder(default_vocabulary()), []
    found = encoder._found
    encoder._found = lambda cache, pieces, lead: wanted.extend(pieces) or found(cache, pieces, lead)
    texts = ["x wort " * 500 + "end", "x  y x wort", "x", None, "", "wort x Ünd"]
    assert encoder.encode_all(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]
    assert len(wanted) < 20


def test_slices_hold_few_bytes():
    import pyarrow as pa

    from burnledger.llm import encoder

    texts = [None, "", "é" * encoder.SLICE_BYTES, "a", *["b" * (encoder.SLICE_BYTES // 2)] * 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
    parts = [part.column(0).to_pylist() for part in encoder.slices(batch, 0)]
    assert [text for part in parts for text in part] == texts[1:]
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= encoder.SLICE_BYTES for part in parts)
    assert list(map(len, parts)) == [1, 1, 2, 2, 2] and list(encoder.slices(batch.slice(0, 0), 0)) == []


def test_cutter_parts_words_and_marks_without_the_vocabulary_pattern(plain):
    cutter = counts.Cutter(counts.Counter(default_vocabulary()))
    pattern, seen = cutter._pattern, []

    class Seen:
        def findall(self, text):
            seen.append(text)
            return pattern.findall(text)

    cutter._pattern = Seen()
    texts = ["x wort, Änd...\nÖl wort!? y\nz,\nand it's 12.\n\nq don't. a.b"]
    numbers = [np.frombuffer(raw, np.int32).reshape(-1, 2).tolist() for raw in cutter(texts)]
    assert numbers == [[[len(token), len(plain(token))] for token in pattern.findall(text)] for text in texts]
    assert sorted(seen) == sorted([" it's", " 12.\n\nq", " don't.", " a.b"])


def test_put_together_pieces_equal_the_library(plain):
    rng, encoder = random.Random(5), Encoder(default_vocabulary())
    letters = [*"abZéñ中ы²1٣'’.,#$|<>_-!\"\\", "\n", "\n", " ", " ", "  ", "\t", "<|endoftext|>", "'s", "\u0301", "\u01c5", "\U0001e900"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 25)))
        assert encoder.encode_all([text])[0] == np.array(plain(text), "<u4").tobytes(), text


def test_a_counter_keeps_few_words():
    """A worker holds at most 200,000 counts, also while it learns a batch (before: 500,000 and the batch beyond)."""
    counter = counts.Counter(default_vocabulary())
    for start in range(0, 240_000, 30_000):
        counter([f" {i}" for i in range(start, start + 30_000)])
        assert len(counter._known) <= 200_000


def test_known_pieces_are_not_cut_again(plain, monkeypatch):
    """Leaves of a text are put together from those of its pieces; before, the pattern ran over every whole text."""
    cut = counts.Cutter(counts.Counter(default_vocabulary()))
    cut(["x wort, Änd. it's wort\nÄnd", "wort"])

    class Unused:
        def findall(self, text):
            raise AssertionError(text)

    cut._pattern = Unused()
    texts = ["wort it's Änd. wort, wort\nÄnd wort,", "", "x"]
    for text, raw in zip(texts, cut(texts), strict=True):
        assert np.frombuffer(raw, np.int32).reshape(-1, 2).sum(0).tolist() == [len(text), len(plain(text))]


def test_leaves_equal_those_of_the_pattern(plain, texts, monkeypatch):
    monkeypatch.setattr(counts, "CACHE_PIECES", 500)
    rng, cut, pattern = random.Random(6), counts.Cutter(counts.Counter(default_vocabulary())), counts._pattern()
    letters = [*"abZéñ中ы²1٣'’.,#$|<>_-!\"\\ɏɐ×", "\n", "\n", " ", " ", "  ", "\t", "\x1c", "\xa0", "<|endoftext|>", "'s", "\u0301", "\u01c5", "\U0001e900"]
    odd = ["".join(rng.choices(letters, k=rng.randrange(0, 25))) for _ in range(2000)]
    given = [*[t or "" for t in list(texts.values())[:60]], *[t or "" for _, t, _ in ODD], *odd]
    for at in range(0, len(given), 200):
        some = given[at : at + 200]
        for text, raw in zip(some, cut(some), strict=True):
            tokens = pattern.findall(text)
            assert np.frombuffer(raw, np.int32).reshape(-1, 2).tolist() == [[len(t), len(plain(t))] for t in tokens], text


def test_differencing_keeps_all_items_and_the_capacity():
    draw = random.Random(4)
    for n in (0, 1, 2, 50, 300):
        lengths = [draw.randint(1, 3000) for _ in range(n)]
        covered, load = defaultdict(int), defaultdict(list)
        for doc, start, length, window, offset in packing.pack_block(lengths, 1024):
            assert start == covered[doc] or length
            covered[doc] += length
            load[window].append((offset, length))
        assert all(covered[i] == x for i, x in enumerate(lengths))
        for parts in load.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        if n == 300:
            assert sum(lengths) / (1024 * len(load)) > 0.99


def _check_pieces(rows, wanted):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(wanted)
    for doc_id, ids in wanted.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and len(part) == r.length and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing(spark, plain, documents, texts, odd, nothing):
    _check_pieces(packing.pack(documents).collect(), {i: plain(t) + [0] for i, t in texts.items()})
    single = odd.where("doc_id > 4 OR doc_id < 4")
    _check_pieces(packing.pack(single).collect(), {i: plain(t) + [0] for i, t, _ in ODD if i not in (None, 4)})
    assert packing.pack(odd).selectExpr("sum(length)").first()[0] == sum(len(plain(t)) + 1 for _, t, _ in ODD)
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_shards_round_trip(bits):
    draw = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 5000):
        ids = draw.integers(0, 50257, n).astype("<u4")
        payload = files.pack_shard(ids, [n] if n else [], block_ids=1000, bit_planes=bits)
        back, lengths = files.unpack_shard(payload)
        assert back.tolist() == ids.tolist() and lengths.tolist() == ([n] if n else [])
    with pytest.raises(ValueError):
        files.unpack_shard(payload[:-3])


def test_files(spark, plain, documents, texts, odd, nothing, tmp_path):
    start = 0
    for r in sorted(files.token_files(documents).collect(), key=lambda r: r.doc_id):
        ids = np.array(plain(texts[r.doc_id]) + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files.write_ids(odd, str(tmp_path / "odd"), bit_planes=True)
    rows = sorted(files.read_ids(spark, str(tmp_path / "odd"), keep_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in ODD), key=lambda i: -1 if i is None else i)
    assert sorted(r.ids for r in rows) == sorted(plain(t) + [0] for _, t, _ in ODD)
    assert files.export(spark, str(tmp_path / "odd"), str(tmp_path / "out")) >= 1
    assert files.token_files(nothing).count() == 0


def test_edited_counts_equal_full_counts(spark, plain, odd, nothing):
    draw, count = random.Random(3), counts.counter(default_vocabulary())
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "1", "!", "é", " x", "\t", " "]
    for _ in range(300):
        tree = counts.Tree("".join(draw.choice(parts) for _ in range(draw.randint(0, 30))), count)
        for _ in range(4):
            tree.apply(counts.Edit(draw.randint(0, len(tree.text) + 2), draw.randint(0, 6),
                                   "".join(draw.choice(parts) for _ in range(draw.randint(0, 5)))))
            assert tree.total == len(plain(tree.text)) and tree.chars[1] == len(tree.text)
    rows = counts.count_edits(odd, counts.sample_edits()).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(plain(t)) for _, t, _ in ODD)
    assert counts.count_edits(nothing, counts.sample_edits()).count() == 0
    long = "word " * 20_000
    tree = counts.Tree(long + "end", count)
    tree.apply(counts.Edit(10_001, 60_000, " of it"))
    assert tree.recoded < 40 and tree.total == len(plain(tree.text)) and tree.chars[1] == len(tree.text)
    tree = counts.Tree(long, count)
    tree.apply(counts.Edit(50_000, 3, "new"))
    assert tree.recoded < 40 and tree.total == len(plain(tree.text))


def test_steps_with_trees_run_in_small_batches(spark, documents, monkeypatch):
    """An executor and its workers hold no whole partition at a time, and the session's setting is left as it was."""
    key, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", [], counts.common.stored
    before = spark.conf.get(key)
    monkeypatch.setattr(counts.common, "stored", lambda df, spark: seen.append(int(spark.conf.get(key))) or stored(df, spark))
    rows = counts.count_edits(documents, counts.sample_edits())
    assert seen == [counts.common.BATCH_ROWS] * 2 and spark.conf.get(key) == before
    assert "MapInArrow" not in rows._jdf.queryExecution().toString() and rows.count() == documents.count()


def _edited_text(text, edits):
    for e in edits:
        a = min(max(e.start, 0), len(text))
        text = text[:a] + e.text + text[min(a + max(e.length, 0), len(text)):]
    return text


def test_kept_trees_are_edited_again(spark, plain, documents, texts, odd, tmp_path):
    edits = {r.doc_id: r.e for r in documents.select("doc_id", counts.sample_edits().alias("e")).collect()}
    counts.grow(documents).write.parquet(str(tmp_path / "trees"))
    trees = spark.read.parquet(str(tmp_path / "trees"))
    once = counts.edited(trees, counts.sample_edits())
    once.write.parquet(str(tmp_path / "once"))
    once = spark.read.parquet(str(tmp_path / "once"))
    new = {r.doc_id: r.text for r in once.collect()}
    assert new == {i: _edited_text(t or "", edits[i]) for i, t in texts.items()}
    for r in once.collect():
        assert (r.n_tokens, r.edited_tokens, r.edited_chars) == (len(plain(texts[r.doc_id])), len(plain(r.text)), len(r.text))
        assert sum(r.chars) == len(r.text) and sum(r.tokens) == r.edited_tokens
    again = {r.doc_id: r.e for r in once.select("doc_id", counts.sample_edits().alias("e")).collect()}
    for r in counts.edited(once, counts.sample_edits()).collect():
        assert r.text == _edited_text(new[r.doc_id], again[r.doc_id])
        assert r.n_tokens == len(plain(new[r.doc_id])) and r.edited_tokens == len(plain(r.text))
    rows = counts.count_edits(documents, counts.sample_edits()).collect()
    assert {r.doc_id: r.edited_tokens for r in rows} == {i: len(plain(t)) for i, t in new.items()}
    odd_trees = counts.edited(counts.grow(odd), counts.sample_edits()).collect()
    assert len(odd_trees) == len(ODD) and all(r.edited_tokens == len(plain(r.text)) for r in odd_trees)
