"""Token files and packing against plain encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import packing, queries, token_files, tokens

from odd import ODD


def plain(name, special_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = special_text
    return lambda text, end: t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab .,!:\n\t'sé́<|>Σ日\x1c\xa0\x0012İक़ড়ਖ਼שׁÀßǅ", max_size=30), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(name, spaced, texts):
    encode, coder = plain(name), tokens.encoder(public_tokenizers.path(name), spaced)
    ids, bounds = coder.encode(texts, 9)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(t, 9) for t in texts]


@pytest.mark.parametrize("special_text", [False, True])
@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_strings(name, spaced, special_text):
    texts = ["<|endoftext|>", "a<|endoftext|>. b <|startoftext|> <|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "I'm <|endoftext|>'s.  <|endoftext|>  x"]
    encode, coder = plain(name, special_text), tokens.Encoder(public_tokenizers.path(name), spaced, special_text=special_text)
    ids, bounds = coder.encode(texts, 9)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(t, 9) for t in texts]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_character_before_and_behind_punctuation_and_white_space(name, spaced):
    encode, coder = plain(name), tokens.Encoder(public_tokenizers.path(name), spaced)
    chars = [chr(i) for i in [*range(0x3400), *range(0xA000, 0xA980), *range(0xAB00, 0xAC10), *range(0xD7A0, 0xD7FF), *range(0xF900, 0x10C00), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F700)] if not 0xD800 <= i < 0xE000]
    for i in range(0, len(chars), 500):
        texts = [f"a{c}. {c}, {c}a; B{c}: {c}! {c}? .{c} ,a{c}\n{c}\t{c} {c}" for c in chars[i : i + 500]]
        ids, bounds = coder.encode(texts, 9)
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == encode(text, 9), ascii(text)


def test_forgetting_changes_no_ids():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" if x % 3 else f"Word{x}." for x in rng.integers(0, 400, 40)) for _ in range(60)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encode, coder = plain(name), tokens.Encoder(public_tokenizers.path(name), spaced, 150)
        for i in range(0, 60, 5):
            ids, bounds = coder.encode(texts[i : i + 5], 9)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(t, 9) for t in texts[i : i + 5]]


def test_a_word_is_encoded_once_whatever_its_letters_and_punctuation():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, encode = tokens.Encoder(path, False), plain("word_bpe_49k.json")
    texts = ["Quill quill, QUILL. quill?!", "quill; spark.", "Spark! \u00c9t\u00e9. \u00e9t\u00e9", "\x1cquill \x1dSpark,"]
    ids, bounds = coder.encode(texts, 9)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(t, 9) for t in texts]
    assert [c for c in coder.codes if c.lower() == "quill"] == ["quill"] and "quill," not in coder.codes


def test_words_met_most_are_remembered():
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False, 40)
    often = " ".join(f"often{chr(97 + i)}" for i in range(8))
    for i in range(6):
        coder.encode([f"{often} {often}", " ".join(f"new{chr(97 + i)}{chr(97 + j)} " * 2 for j in range(20))], 9)
    assert set(often.split()) <= set(coder.codes)
    assert len(coder.codes) < 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=1500))
def test_words_round_trip(ids):
    words, per_block, at, escapes = token_files.pack(ids)
    assert token_files.unpack(words, per_block, len(ids), at, escapes).tolist() == ids


def test_best_fit_is_the_plain_rule():
    lengths = sorted(np.random.default_rng(1).integers(1, 64, 300).tolist(), reverse=True)
    windows, offsets = packing.best_fit(lengths, 64)
    room = []
    for length, offset in zip(lengths, offsets):
        fit = min((c for c in room if c >= length), default=None)
        if fit is None:
            room.append(64)
            fit = 64
        assert 64 - fit == offset
        room[room.index(fit)] -= length
    assert max(windows) + 1 == len(room)


def expect_files(rows, out):
    encode, start = plain("word_bpe_49k.json"), 0
    got = sorted(out.collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, text) in zip(got, rows):
        ids = encode(text, 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_files_of_the_documents(spark, documents):
    expect_files([(r.doc_id, r.text) for r in documents], queries.op10_token_files(spark, "/root/testdata/sf0.001"))


def test_files_of_odd_rows(table):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(ODD)]
    expect_files(rows, token_files.token_table(table([(i, t, "x") for i, t in rows], "doc_id bigint, text string, words string"), path, 1))
    twice = token_files.token_table(table([(None, "b"), (3, "a"), (3, "a"), (None, "b")]), path, 1, with_ids=True).collect()
    assert sorted(r.start for r in twice) == [0, 2, 4, 6] and all(r.ids[-1] == 1 for r in twice)
    assert token_files.token_table(table([]), path, 1).count() == 0


def expect_packed(rows, out):
    encode = plain("byte_bpe_50k.json")
    docs, sequences = {}, {}
    for p in out.collect():
        docs.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(docs) == {r[0] for r in rows}
    for doc_id, text in rows:
        ids, at = encode(text, 0), 0
        for p in sorted(docs[doc_id], key=lambda p: p.start):
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, crc(ids[at : at + p.length]), len(ids))
            at += p.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(n for s in sequences.values() for _, n in s) / 1024 / len(sequences)


def test_packing_the_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents]
    assert expect_packed(rows, queries.op6_packing(spark, "/root/testdata/sf0.001")) > 0.97


def test_packing_odd_rows(table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate(ODD))
    out = packing.pack(table([(i, t, 5) for i, t in rows], "doc_id bigint, text string, place bigint"), path, 0)
    expect_packed(rows, out)
    assert packing.pack(table([(None, "b"), (3, "a"), (3, "a"), (None, None)]), path, 0).count() == 4
    assert packing.pack(table([]), path, 0).count() == 0
