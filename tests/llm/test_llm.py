"""The operators for training data against brute force, with the odd rows that each must take."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmode.llm import _text
from driftmode.llm import bpe, dart_minhash, decontaminate, fm_index, html_text, near_dup, quality_model, quality_rules, suffix_dedup, token_counts, token_files, warc
from driftmode.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, node string, class_id string, ids string, kept string, tree string, features string, score string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, one long word, one long text, repeated rows and null ids."""
    a, b, passage = prose(1, 200), prose(2, 300), prose(3, 70)
    near = a.split(" ")
    near[50] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", a, a, " ".join(near), b, prose(4, 40) + " " + passage + " " + prose(5, 90), passage + " " + prose(6, 60), prose(7, 30) + " " + passage,
             "x" * 5000, "same " * 400, prose(8, 6000), "Äé ß — 中文字 日本   x", "###*** $$ | <a> &&& " * 30, "line here\n" * 40, "\x00\x1f odd \x7f controls   end"]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    return [*rows, (5, a), (8, b), (None, a), (None, prose(9, 120))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "s", "n", "c", "i", "k", "t", "f", "z") for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("public_tokenizers")


def counted(rows) -> collections.Counter:
    return collections.Counter(map(tuple, rows))


# --- text kernels ---


@pytest.mark.parametrize("kind,pattern", [("space", SPACE), ("alnum", ALNUM)])
def test_words(kind, pattern):
    texts = [t or "" for _, t in odd_texts()]
    at = 0
    seen: dict[int, bytes] = {}
    for block in _text.blocks(pa.array(texts), 3000):
        w = _text.words(block, kind)
        h = w.hashes()
        for i in range(len(block)):
            want = pattern.findall(texts[at].translate(LOWER) if kind == "alnum" else texts[at])
            own = range(w.off[i], w.off[i + 1])
            assert [w.buf[w.start[k] : w.end[k]].tobytes().decode() for k in own] == want
            for k, word in zip(own, want):
                assert seen.setdefault(int(h[k]), word.encode()) == word.encode()
            at += 1
    assert at == len(texts) and len(seen) == len(set(seen.values()))


def test_blocks_keep_every_row():
    assert [b.text(i) for b in _text.blocks(pa.chunked_array([["a", None], [], ["bcd"]]), 1) for i in range(len(b))] == [b"a", b"", b"bcd"]
    assert list(_text.blocks(pa.array([], pa.string()))) == []


# --- 1: repeated passages ---


def brute_repeats(rows, size):
    """Words of each row in repeated windows, and those that go."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    words = {k: SPACE.findall(rows[k][1] or "") for k in order}
    places = collections.defaultdict(list)
    for r, k in enumerate(order):
        for s in range(len(words[k]) - size + 1):
            places[tuple(words[k][s : s + size])].append((r, s))
    repeat, gone, own = (collections.defaultdict(set) for _ in range(3))
    for at in places.values():
        if len(at) > 1:
            first = min(at)
            for r, s in at:
                repeat[order[r]].update(range(s, s + size))
                if (r, s) != first:
                    gone[order[r]].update(range(s, s + size))
                    if r == first[0] and s - first[1] < size:
                        own[order[r]].update(range(first[1], first[1] + size))
    return {k: (repeat[k], gone[k] - own[k]) for k in order if repeat[k]}


def spans_of(spans) -> set[int]:
    return {i for s in spans for i in range(s.start, s.end)}


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        suffix_dedup.find_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeats(docs, hot):
    rows = [r for r in dict.fromkeys(odd_texts()) if r[0] is not None]  # copies of one id count once
    want = {rows[k][0]: v for k, v in brute_repeats(rows, 50).items()}
    found = suffix_dedup.find_repeats(docs.where("doc_id is not null"), hot=hot).collect()
    got = {r.id: (spans_of(r.repeats), spans_of(r.removed)) for r in found}
    repeated_rows = {5, 8}  # they stand twice with one id: the text as a whole is a repeat
    assert {k: v for k, v in got.items() if k not in repeated_rows} == {k: v for k, v in want.items() if k not in repeated_rows}
    assert got[5] == (set(range(200)), set()) and got[8] == (set(range(300)), set())
    assert {s.first_id for r in found if r.id == 6 for s in r.repeats} == {5}


def test_repeats_in_random_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = list({t: (i, t) for i, t in reversed(rows)}.values())  # the first of equal texts
    want = {rows[k][0]: v for k, v in brute_repeats(rows, 6).items()}
    for hot in (1 << 20, 3):
        got = {r.id: (spans_of(r.repeats), spans_of(r.removed)) for r in suffix_dedup.find_repeats(df.where(F.col("doc_id").isin([r[0] for r in rows])), min_words=6, anchor=3, hot=hot).collect()}
        assert got == want


def test_removal(docs, empty):
    left = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs.where("doc_id is not null")).collect()}
    texts = dict(odd_texts())
    assert 6 not in left  # a copy: no word is left
    assert left[9].text == texts[9] and left[9].n_chars == len(texts[9])
    assert prose(3, 70).split()[10] not in left[11].text.split() and left[11].text.startswith(prose(7, 30)[:50]) and left[11].n_chars == len(left[11].text)
    assert left[13].text.split() == ["same"] * 50
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns and suffix_dedup.remove_repeats(empty).count() == 0


def test_scopes_and_distinct_documents(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e g", "y"), (3, "q a b c d e", "x"), (4, "z z z z z z z z", "x")], "doc_id long, text string, s string")
    found = suffix_dedup.find_repeats(df, scope_col="s", distinct=True, min_words=5, anchor=2).collect()
    assert {r.id: spans_of(r.repeats) for r in found} == {1: set(range(5)), 3: set(range(1, 6))}


# --- 2: token counts ---


def test_counts_after_edits(tokenizers):
    c = token_counts.counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    alphabet = "abc dethe  \n\t's're1234é中ñ#$.! "
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 2500 if rng.random() < 0.1 else 200)))
        tree = token_counts.build(text, c)
        assert tree.tokens == c.count(text) and tree.chars == len(text)
        for _ in range(3):
            a = rng.randrange(0, len(text) + 1)
            b, new = min(len(text), a + rng.randrange(0, 30)), "".join(rng.choices(alphabet, k=rng.randrange(0, 12)))
            want = text[:a] + new + text[b:]
            text, tree, encoded = token_counts.edit(text, token_counts.SegmentTree.unpack(tree.pack()), a, b, new, c)
            assert text == want and tree.tokens == c.count(text) and tree.chars == len(text) and encoded <= len(text)


def test_a_small_edit_encodes_little(tokenizers):
    c = token_counts.counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    text = prose(1, 20000)
    assert token_counts.edit(text, token_counts.build(text, c), 60000, 60003, "new", c)[2] < 2000


def test_an_edit_touches_one_path_of_sums(tokenizers):
    c = token_counts.counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    text = prose(1, 20000)
    tree = token_counts.build(text, c)
    for new in ("new", "two words", "", "a few more words than before, and a comma"):  # also where the number of pieces changes
        before, tree.touched = tree.sums.copy(), 0
        text, tree, _ = token_counts.edit(text, tree, 60000, 60003, new, c)
        assert tree.width >= 256 and tree.touched <= 3 * (tree.width.bit_length() + 1) and (tree.sums != before).any(axis=0).sum() <= tree.touched
        assert tree.tokens == c.count(text)
    for _ in range(3):  # an insertion that fills its segments
        text, tree, _ = token_counts.edit(text, tree, 500, 500, prose(2, 300), c)
        assert tree.tokens == c.count(text) and tree.chars == len(text)


def test_every_character_counts_as_in_the_library(tokenizers):
    c = token_counts.counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    for k in range(0, 0x33000, 1 << 14):
        text = "".join(f"a{x} {x}{x} 1{x}" for x in map(chr, EVERY[k : k + (1 << 14) : 5]))
        tree = token_counts.build(text, c)
        assert tree.tokens == c.count(text)
        c.pieces.forget()


def test_edit_table(docs, empty, tokenizers):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    trees = token_counts.build_trees(docs, path)
    edits = trees.withColumn("edits", F.expr("if(doc_id is null, null, array(named_struct('start', 1L, 'end', 3L, 'text', 'zz '), named_struct('start', 100000L, 'end', 100009L, 'text', cast(null as string))))"))
    done = token_counts.apply_edits(edits, path).collect()
    c = token_counts.counter(path)
    assert len(done) == docs.count() and all(r.n_tokens == c.count(r.text or "") for r in done)
    assert {r.text for r in done if r.doc_id == 3} == {"ozz "}
    assert token_counts.build_trees(empty, path).count() == 0


# --- 3: byte-level BPE ---


def test_encoding_equals_the_library(docs, empty, tokenizers):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    assert bpe.PATTERN == tokenizers.PATTERN
    library = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()
    assert len(out) == docs.count()
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode_documents(empty, path).count() == 0
    v = bpe.vocabulary(path)
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choices("abthe  \n'sr19é中ñ# \U0001f600", k=rng.randrange(0, 80)))
        assert np.frombuffer(v.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    for text in ("a" * 4000, "ab" * 2000 + "\n" * 3000, "<|endoftext|>"):
        assert np.frombuffer(v.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    both = bpe.encode_documents(docs, path, decoded_col="decoded").collect()
    assert counted((bytes(r.ids), bytes(r.decoded)) for r in both) == counted((bytes(r.ids), bytes(r.decoded)) for r in out)


EVERY = [*range(0xD800), *range(0xE000, 0x110000)]


def test_every_character_is_split_as_the_library_does(tokenizers):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([b]): b for b in range(256)} | {b" a": 256, b"'s": 257, b"  ": 258, b" 1": 259}
    library = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = bpe.Vocabulary(ranks)
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    real, whole = bpe.vocabulary(path, bpe.PATTERN, bpe.library_classes()), tiktoken.Encoding("r", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for k in range(0, len(EVERY), 1 << 14):
        text = "".join(f"a{c}'s" for c in map(chr, EVERY[k : k + (1 << 14)]))  # cut otherwise for a letter, a digit, a space, another one
        assert np.frombuffer(v.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        v.forget()
    for k in range(0, 0x33000, 1 << 14):
        some = list(map(chr, EVERY[k : k + (1 << 14) : 9]))
        text = "".join(f"a{c}b {c}{c} 1{c} {c}\n{c}'s" for c in some)
        assert np.frombuffer(v.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        text = "".join(f"a{c} {c}1" for c in some)
        assert np.frombuffer(real.encode(text), "<u4").tolist() == whole.encode_ordinary(text)
        real.forget()


def test_backtracking_equals_merging_in_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate([b"ab", b"bc", b"abc", b"cd", b"abcd", b"bcd", b"aa", b"aaa"]):
        ranks[token] = 256 + k
    v = bpe.Vocabulary(ranks)
    rng = random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choices(b"abcd", k=rng.randrange(1, 20)))
        assert v.backtracked(piece) == v.merged(piece)


def test_memory_of_pieces_is_bounded():
    made = []
    memo = bpe.Remembered(lambda k: made.append(k) or k * 2, 20 * 200)
    assert [memo[i % 25] for i in range(1000)] == [2 * (i % 25) for i in range(1000)]
    assert len(memo) <= 11 and len(memo.old) <= 11
    memo.forget()
    assert not memo and not memo.old and not memo.held


# --- 4: quality model ---


def test_model_on_held_out_rows(spark, sf):
    out = QUERIES["op4_quality_model"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    known = [r for r in out if r.held_out and r.doc_id in labels]
    assert known and sum(r.predicted == labels[r.doc_id] for r in known) / len(known) >= 0.8


def test_model_takes_odd_rows(docs, empty, spark):
    features = quality_model.add_features(docs)
    assert "text" not in features.columns and features.count() == docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(18)] + [(3, None), (3, 1), (None, 1)], "doc_id long, quality int")
    model = quality_model.train(features, labels)
    assert all(0 <= r.score <= 1 for r in quality_model.score_features(features, model).collect())
    one = quality_model.train(features, labels.where("quality = 1"))
    assert len({r.score for r in quality_model.score_features(features, one).collect()}) == 1
    none = quality_model.train(quality_model.add_features(empty), labels.limit(0))
    assert quality_model.score_features(features, none).count() == docs.count()


def test_the_sample_is_that_of_the_least_hashes(spark, sf, monkeypatch):
    featured = quality_model.add_features(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(quality_model, "fit", lambda x, y: (x, y))
    known = labels.where(~quality_model.held_out("doc_id")).join(featured, "doc_id").orderBy(F.xxhash64("doc_id")).limit(20).collect()
    x, y = quality_model.train(featured, labels, max_rows=20)
    assert y.tolist() == [r.quality for r in known] and x.tolist() == [r.features for r in known]


def test_pairs_find_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(float)
    model = quality_model.fit(x, y)
    assert {0, 1} in [{i, j} for i, j, *_ in model.pairs] and ((model.score(x) > 0.5) == y).mean() > 0.9
    assert ((quality_model.fit(x, y, pairs=0).score(x) > 0.5) == y).mean() < 0.7


# --- 5: quality rules ---


def brute_base(text: str) -> tuple[int, ...]:
    w = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(SPACE.search(line)) and line in seen
        seen.add(line)
    count = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {i for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for i in range(k, k + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_rules(docs, empty):
    out = quality_rules.score_rules(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        want = brute_base(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in out if r.kept}
    assert {5, 8, 9, 14} <= kept and 13 not in kept and 12 not in kept
    assert quality_rules.keep_good(docs).columns == docs.columns and quality_rules.score_rules(empty).count() == 0


def test_bands_reject_noise_and_repetition(spark):
    rng = random.Random(3)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(8)) for _ in range(600))
    words = [f"w{i}" for i in range(30)]
    varied = " ".join(rng.choice(words[:4]) + str(k % 3) for k in range(3000))
    hidden = prose(1, 3000) + " " + "ab" * 6000
    rows = spark.createDataFrame(enumerate([noise, varied, hidden, prose(2, 3000)]), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules.score_rules(rows).collect()}
    assert not got[0][0] and not got[1][0] and got[2] == (False, False) and got[3] == (True, False)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_bands_part_the_labelled_documents(spark, sf, size):
    read = lambda t: spark.read.parquet(f"{sf}/../{size}/{t}.parquet")
    both = quality_rules.score_rules(read("documents").select("doc_id", "text")).join(read("labels"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in both.groupBy("quality", "kept").count().collect()}
    assert n[1, True] and (1, False) not in n  # no good text is lost
    assert n[0, False] >= 0.6 * (n[0, False] + n.get((0, True), 0))


def test_tails_are_judged(spark):
    body = prose(31, 8000)[: 7 * 4096 + 300]
    rows = [body + " same words again" * 80, body, prose(32, 3000)[:5000], prose(32, 3000)[:4096]]
    got = quality_rules.score_rules(spark.createDataFrame(enumerate(rows), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in got[:2]] == [(False, False), (False, True)]
    assert got[2].ratio != got[2].chunk_ratio_max and got[3].ratio == got[3].chunk_ratio_max


# --- 6: WARC ---


def test_archives(spark):
    big, other = "<p>" + "x" * 1200 + "</p>", "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a.com/1", big), (2, "http://b.a.com:8080/?q=1", big), (9, "https://A.com/1", big), (3, None, other), (4, "http://c.com/\n", other), (5, "x", "small"), (6, "x", "small"), (7, "", None),
            (8, "http://[bad", ""), (10, "http://a.com/1", "<b>second capture</b>"), (None, "http://n.com", big), (11, "http://a.com/1", big), (11, "http://a.com/1", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    segments = warc.build_index(warc.write_archives(pages, roll=500), lines=2)
    out = warc.read_archives(segments).collect()
    payload = lambda h: (h or "").encode()
    assert counted((r.page_id, bytes(r.payload), r.payload_digest, r.record_type, r.refers_to) for r in out) == counted(
        (i, payload(h), hashlib.sha1(payload(h)).hexdigest(), *(("revisit", {big: 11, other: 4}[h]) if h in (big, other) and i not in (11, 4) else ("response", None))) for i, _, h in rows
    )
    index = warc.CaptureIndex.of(segments)
    assert sorted(c[1] for c in index.captures("http://a.com/1")) == [1, 9, 10, 11, 11]  # scheme and case don't matter
    assert index.payload("http://a.com/1", 10) == b"<b>second capture</b>" and index.payload("http://nowhere.org/") is None
    assert [c[1] for c in index.captures("http://b.a.com:8080/?q=1")] == [2]
    assert warc.read_archives(warc.build_index(warc.write_archives(pages.limit(0)))).count() == 0


def test_archives_of_text_ids_and_pages_of_a_hot_key(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(f"p/{i:03}", None, big if i % 3 else f"page {i}", 1) for i in range(60)] + [("", None, "empty name", 2), (None, None, "no name", 3), ("<é>", "http://a.com", big * 2000, 4)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, kind int")
    segments = warc.build_index(warc.write_archives(pages), lines=4)
    out = warc.read_archives(segments).collect()
    assert counted((r.page_id, bytes(r.payload).decode(), r.refers_to) for r in out) == counted((i, h, "p/059" if h == big and i != "p/059" else None) for i, _, h, _ in rows)
    read, block = [], warc._block
    try:
        warc._block = lambda *a: read.append(a) or block(*a)
        assert warc.CaptureIndex.of(segments).payload(None, "p/059") == big.encode() and len(read) <= 2
    finally:
        warc._block = block


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a/b?c=d#e") == "com,example,www)/a/b?c=d"
    assert warc.url_key("https://example.com:444") == "com,example:444)/" and warc.url_key(None) == "" and warc.url_key("No Url") == "no url"


# --- 7: near duplicates ---


def brute_classes(rows):
    shingles, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return collections.Counter((name, least.get(find(i))) for i, (name, _) in enumerate(rows))


def test_classes(docs, empty):
    got = near_dup.near_duplicates(docs).select("doc_id", "class_id").collect()
    assert counted(got) == brute_classes(odd_texts())
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.select("doc_id").collect()) == sorted({-1 if c is None else c for _, c in brute_classes(odd_texts())})


def test_one_of_every_class_stays_whatever_the_ids(spark):
    a, b, c, d = (prose(s, 100) for s in (21, 22, 23, 24))
    near = a.replace(a.split()[50], "changed", 1)
    rows = [(None, a), (None, near), (None, b), (None, b), (7, c), (7, d), (7, c), (8, d)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept if r.doc_id is None) in (sorted([a, b]), sorted([near, b]))
    assert sorted(r.text for r in kept if r.doc_id is not None) == sorted([c, d]) and {r.doc_id for r in kept} == {None, 7}


@pytest.mark.parametrize("block", [1500, 20])
def test_a_group_of_near_copies_of_each_other(spark, block):
    rng = random.Random(9)
    base = prose(1, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(near_dup.near_duplicates(df, block=block).select("doc_id", "class_id").collect()) == brute_classes(rows)


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    k = 2000
    elements = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = elements[:200], elements[50:250]
    s = dart_minhash.signatures(np.concatenate((a, b)), np.array([0, 200, 400]), k)
    assert abs((s[0] == s[1]).mean() - 150 / 250) < 0.05
    wa, wb = rng.uniform(0, 4, 300), rng.uniform(0, 4, 300)
    wa[:20] = 0
    s = dart_minhash.signatures(np.concatenate((elements, elements)), np.array([0, 300, 600]), k, np.concatenate((wa, wb)))
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05
    heavy = dart_minhash.signatures(np.concatenate((elements[:9], elements[:9])), np.array([0, 9, 18]), k, np.concatenate((np.full(9, 3e8), np.full(9, 4e8))))
    assert abs((heavy[0] == heavy[1]).mean() - 3 / 4) < 0.05  # in no more time than light ones
    ones = dart_minhash.signatures(elements, np.array([0, 200, 300]), 64, np.ones(300))
    assert (ones == dart_minhash.signatures(elements, np.array([0, 200, 300]), 64)).all()
    s = dart_minhash.signatures(elements[:1], np.array([0, 0, 1]), 64)
    assert (s[0] == 0).all() and (s[1] != 0).all()


def test_texts_that_repeat_themselves_are_found_by_their_sets(spark):
    a, line = prose(71, 150), " ".join(f"line{i}" for i in range(12))
    rows = [(1, a + " " + (line + " ") * 3), (2, a + " " + (line + " ") * 200), (3, prose(72, 100)), (4, prose(72, 100) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(near_dup.near_duplicates(df).select("doc_id", "class_id").collect()) == brute_classes(rows)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, weighted=True).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_weighted_similarity(spark):
    rows = [(1, "a b c d e " * 30), (2, "a b c d e " * 10), (3, "a b c d e " * 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, weighted=True).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.class_id for r in near_dup.near_duplicates(df).collect()} == {1}


# --- 8: decontamination ---


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        off = np.concatenate(([0], np.cumsum(rng.integers(0, 30, rng.integers(1, 6)))))
        h = rng.integers(1, 4, off[-1]).astype(np.uint64)
        index = fm_index.FMIndex(h, off)
        for m in (1, 2, 5):
            phrases = rng.integers(1, 5, (20, m)).astype(np.uint64)
            lo, hi = index.search(index.symbols(phrases.ravel()).reshape(phrases.shape))
            for p, a, b in zip(phrases, lo, hi):
                want = [i for x, y in zip(off, off[1:]) for i in range(x, y - m + 1) if (h[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_contamination(docs, empty, spark, monkeypatch):
    items = [(1, prose(3, 70)[:200]), (2, "two words"), (3, None), (4, "..."), (5, prose(8, 6000)[20000:20400]), (10, prose(3, 70)[:200]), (6, "words two"), (None, "unnamed \x1f odd"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].update([str(i)] if i is not None else [])

    def brute(text):
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)

    for limit in (decontaminate.BENCH_BLOCK, 10):
        monkeypatch.setattr(decontaminate, "BENCH_BLOCK", limit)
        out = decontaminate.find_contamination(docs, bench, group=limit * 100).collect()
        assert len(out) == docs.count()
        for r in out:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(r.text)
            assert sum(len(ALNUM.findall((r.text or "").encode()[s.start : s.end].decode().translate(LOWER))) for s in r.spans) == r.n_hit
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in out)
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0


# --- 9: HTML ---


@pytest.mark.parametrize(
    "html,want",
    [
        ("<header>H</header><div class='sidebar left'>S</div><main><header><h1>T</h1></header><p>A &lt;b&gt; &nbsp;x<p>B<div class=\"ad-slot\">AD<div>in</div></div><section id=comments><article>c</article></section><ul><li>1<li>2</ul></main><footer>F</footer>", ["T", "A <b> x", "B", "1", "2"]),
        ("<nav>menu<article><p>body &am", ["body &am"]),
        ("<article><p>a<script>var t='</p>';</script>b<!-- c -->c</p><form>q</form><aside>n</aside>d</article>e", ["abc", "d"]),
        ("<article>1 < 2 &amp; 3 > 2<br>next&copy</article>", ["1 < 2 & 3 > 2", "next©"]),
        ("<div role=main>m <i>n</i></div><div role='contentinfo'>c</div>", ["m n"]),
        ("<div class='layout has-sidebar'><div id=with-nav><article><p>kept</p><div class=sidebar>no</div></article></div></div>", ["kept"]),
        ("<div class='post-social content'><main>in a wrapper</main></div><p>less</p>", ["in a wrapper"]),
        ("<div class=comments><article>a reader's</article></div><p>text", []),
        ("<article><a href=it's>x</a> <b title='a > b'>y</b> <i title=\"open>z</i></article>", ["x y z"]),
        ("<article><![CDATA[a & b]]> c <![CDATA[d<p>e</article>", ["a & b c e"]),  # what never ends is a comment up to the next ">"
        ("<article><style>p{}</style><p class=\"cookie-notice\">eat</p><p>x\n\t y</p><!-- open", ["x y"]),
    ],
)
def test_main_blocks(html, want):
    assert html_text.blocks_of(html)[0] == want


@pytest.mark.parametrize(
    "html", ["<a " * 400_000, "<a x=\"" * 150_000 + "'", "<a title='" + "<b>" * 300_000, "<![CDATA[" * 100_000 + "<p>", "</x>" * 200_000, "<nav>" * 100_000 + "</x>" * 100_000, "<svg>" * 200_000, "</script " * 100_000, "<script></script " * 60_000,
             "<header><article>" * 60_000, "<a " + "<b \">\" " * 150_000, "<!--" * 250_000, "&" * 1_000_000, "<div class=\"" * 80_000, "<section class=has-sidebar><article>" * 30_000]
)
def test_hostile_pages_take_linear_time(html):
    start = time.perf_counter()
    html_text.blocks_of(html)
    assert time.perf_counter() - start < 4


def brute_windows(texts, size):
    found = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = SPACE.findall(t)
        for k in range(len(w) - size + 1):
            found[tuple(w[k : k + size])].add(i)
    return sorted(sorted(x) for x in found.values() if len(x) > 1)


def test_the_host_array_finds_all_repeats():
    rng = random.Random(12)
    for size in (2, 3, 8):
        for _ in range(40):
            texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 9))]
            window, first, page = html_text.window_pages(pa.array(texts, pa.large_string()), size)
            assert sorted(page[a:b].tolist() for a, b in zip(first, first[1:])) == brute_windows(texts, size) and len(window) == len(first) - 1 == len(set(window.tolist()))


def test_hosts_in_parts_and_the_plan(spark):
    top = "Every page of this large host begins with these same words of welcome to all"
    rows = [(i, f"http://a.com/{i}", f"<p>{top}</p><p>{prose(200 + i, 60)}</p>") for i in range(120)] + [(500 + i, "http://a.com/copy", f"<p>{prose(1, 90)}</p>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = lambda i: " ".join(prose(200 + i, 60).split())
    for part in (html_text.PART_PAGES, 20):
        got = {r.page_id: r.text for r in html_text.extract_text(pages, part_pages=part).collect()}
        assert all(got[i] == text(i) for i in range(120)) and got[500] == " ".join(prose(1, 90).split())
    # without the array the result is another one
    off = {r.page_id: r.text for r in html_text.extract_text(pages, run_words=10**6).collect()}
    assert all(off[i] == f"{top}\n{text(i)}" for i in range(120))
    host = pages.select(html_text.host_of("url").alias("host"), "html")
    parts = html_text.streams(host, 20, 1 << 20).select("part", F.expr("octet_length(nodes) div 16").alias("n")).collect()
    assert len({r.part for r in parts}) == 8 and 121 <= sum(r.n for r in parts) <= 125  # a task sends copies once


def test_hosts(spark):
    urls = ["http://www.A.com/x", "https://u:p@b.org:8080/?q", "http://[::1]:80/", "x", "", None, "ftp://h"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(html_text.host_of("url").alias("h")).collect()
    assert [r.h for r in got] == ["www.a.com", "b.org", "[::1]", "x", "", "", "h"]


def test_boilerplate_of_a_host_goes(spark):
    top = "<div>Welcome to the great site of all the things here today</div>"
    rows = [(i, f"http://{'a' if i < 4 else 'b'}.com/{i}", f"{top}<p>story number {i} is unique w{i} x{i} y{i}</p><p>{top}</p>") for i in range(6)]
    rows += [(9, "http://c.com/1", f"{top}<p>only here</p>"), (10, None, None), (None, "x", top), (11, "http://a.com/11", f"<article>{top}</article>"), (9, "http://c.com/1", f"{top}<p>only here</p>")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    welcome = "Welcome to the great site of all the things here today"
    assert all(got[i] == f"story number {i} is unique w{i} x{i} y{i}" for i in range(6))
    assert got[10] == "" and got[None] == welcome and got[11] == welcome
    assert got[9] == f"{welcome}\nonly here" and all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_notices_inside_articles_go_and_shared_passages_stay(spark):
    notice = "Support our newsroom with a small monthly gift and read on without any limits"
    shared = "a licence line of many words that two of the articles on this host both have"
    story = lambda i: f"<p>{prose(100 + i, 40)}</p>" + (f"<p>{shared}</p>" if i < 2 else "")
    rows = [(i, f"http://a.com/{i}", f"<article>{story(i)}<p>{notice}</p></article>") for i in range(6)]
    rows += [(9, "http://a.com/9", f"<article><p>{notice}</p></article>"), (10, "http://b.com/1", f"<article>{story(0)}</article>"), (11, "http://b.com/2", f"<article>{story(1)}</article>")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(notice not in got[i] and " ".join(prose(100 + i, 40).split()) in got[i] for i in range(6))
    assert all(shared in got[i] for i in (0, 1, 10, 11)) and got[9] == notice


def test_near_copies_without_markup_keep_their_text(spark):
    text, quote = prose(50, 200), "a quote of ten words that a few of the pages have in common"
    rows = [(i, f"http://a.com/?ref={i}", f"<p>Printed on day {i} of May</p><p>{text}</p>") for i in range(2)]
    rows += [(10 + i, f"http://b.com/{i}", f"<p>{prose(60 + i, 80)}</p>" + (f"<p>{quote}</p>" if i < 3 else "")) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Printed on day {i} of May\n{' '.join(text.split())}" for i in range(2))
    assert all(quote in got[10 + i] for i in range(3))


# --- 10: token files ---


@pytest.mark.parametrize("mode", [token_files.BYTE, token_files.BIT])
def test_files_by_range(tmp_path, mode):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1 << (17 if i % 2 else 32), n).astype("<u4") for i, n in enumerate([0, 5, 100, 0, 999, 64, 1, 3000])]
    path = f"file://{tmp_path}/a.pln"
    with open(f"{tmp_path}/a.pln", "wb") as f:
        w = token_files.Writer(f, mode, 64)
        for t in texts:
            w.add(t)
        w.close()
    r = token_files.Reader(path)
    assert all(np.array_equal(a, b) for a, b in zip(r.texts(), texts, strict=True))
    flat = np.concatenate(texts)
    for a, n in [(0, len(flat)), (63, 2), (64, 64), (700, 0), (1000, 500)]:
        assert np.array_equal(r.ids(a, n), flat[a : a + n])


def test_token_files(docs, empty, tokenizers):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    manifest = token_files.write_ids(docs.where("doc_id is not null"), tokenizer_file("byte_bpe_50k.json"), block=256)
    out = sorted(token_files.read_ids(manifest).collect(), key=lambda r: r.start)
    rows = [r for r in odd_texts() if r[0] is not None]
    assert [r.id for r in out] == sorted(i for i, _ in rows)
    at, texts = 0, dict(rows)
    for r in out:
        want = library.encode(texts[r.id] or "", add_special_tokens=False).ids + [2]
        assert r.start == at and r.n_tokens == len(want) and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)
    assert token_files.read_ids(token_files.write_ids(empty, tokenizer_file("byte_bpe_50k.json"))).count() == 0
    assert token_files.read_ids(token_files.write_ids(docs, tokenizer_file("byte_bpe_50k.json"))).count() == docs.count()


def test_memo_equals_the_library(tokenizers):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    encoder = token_files.LibraryEncoder(tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ["".join(rng.choices("abthe  \n'sr19é中ñ# \U0001f600՘\x1c", k=rng.randrange(0, 90))) for _ in range(800)] + ["a<|endoftext|>b", "z" * 3000, None, ""]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_plain_pieces_go_to_the_library_together(tokenizers):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    encoder = token_files.LibraryEncoder(tokenizer_file("byte_bpe_50k.json"))
    alone = []

    class Watched:
        def encode_batch_fast(self, given, **options):
            alone.extend(given[0] if options.get("is_pretokenized") else [])
            return library.encode_batch_fast(given, **options)

    encoder.tokenizer, encoder.pieces.half = Watched(), 4000  # a memo of some twenty pieces
    rng = random.Random(8)
    texts = [" ".join(rng.choices([*map("".join, zip("abcdefgh" * 40, rng.choices("éßzaø×1", k=320), rng.choices("nrst'", k=320))), "the", "é"], k=60)) for _ in range(30)]
    for batch in (texts[:10], texts[10:], texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]
    assert alone and not any(p[0] == " " and p[1:].isascii() and p[1:].isalpha() for p in alone)
    the = np.frombuffer(encoder._ids(["the"])[0], "<u4")
    assert len(the) == 1 and encoder._cut(["th", "e"], the) is None and encoder._cut(["the"], the) == {"the": the.tobytes()}


def test_pieces_are_taken_up_without_calls_and_never_stay_without_ids(tokenizers):
    assert "__missing__" not in vars(token_files._Pieces)  # a call for each piece that is lacked
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    encoder = token_files.LibraryEncoder(tokenizer_file("byte_bpe_50k.json"))
    texts = [prose(1, 60), prose(2, 60) + " " + "z" * 300 + " end", "z" * 300]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]

    class Broken:
        def encode_batch_fast(self, given, **options):
            raise ValueError("broken")

    whole, encoder.tokenizer = encoder.tokenizer, Broken()
    with pytest.raises(ValueError, match="broken"):
        encoder.encode(texts)
    encoder.tokenizer = whole
    for half in (encoder.pieces.half, 2000, 0):  # the last ones turn the generations at each call
        encoder.pieces.half = half
        for batch in ([0, 1, 2], [2, 0], [1]):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([texts[k] for k in batch])] == [want[k] for k in batch]
            assert all(encoder.pieces.values()) and max(map(len, encoder.pieces)) <= bpe.LONG_PIECE
            assert encoder.pieces.held == sum(bpe._ENTRY + len(k) + len(v) for k, v in encoder.pieces.items())


# --- queries and pipeline ---


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracles(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert counted(df.select(*columns).collect()) == counted(cur.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, docs, empty, sf):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    step = plain
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == plain.columns
        step = out
    left = {r.doc_id: r for r in step.collect()}
    assert 6 not in left and 7 not in left and 13 not in left and {5, 8, 9, 14} <= set(left)
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in left.values())
    step = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf)
    assert step.count() == 0
