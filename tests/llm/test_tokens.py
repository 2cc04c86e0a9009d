"""Token counts, piece encoding and packing against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tidemark.llm.packing import encoder, pack, pack_documents, plan
from tidemark.llm.piece_codec import codec, encode_texts
from tidemark.llm.token_counts import count_tokens, counter

BYTES, WORDS, PIECES = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
bytes_lib, words_lib, pieces_lib = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
ANY = st.text(st.sampled_from("abcdeAB  \n\t.,'s't123éñß中あ̈😀▁ \x1c\x85\r\x00ΣσıİŉŁ-_|<>") | st.characters(exclude_categories=["Cs"]), max_size=60)
FIXED = [" " * k + "ab" + " " * k for k in range(20)] + ["▁" * k for k in range(20)] + ["a" * 3000, "the<|endoftext|> and <|startoftext|>x<|endoftext|><|endoftext|>", "", "\n", "\n\n a", "x\n\ny", " \n x", "it's I'LL don't", "T̈ ẗ", "﻿a"]


def same(text):
    assert counter(BYTES)(text) == len(bytes_lib.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(encoder(WORDS)(text), "<u4").tolist() == words_lib.encode(text, add_special_tokens=False).ids
    ids = pieces_lib.encode(text, add_eos=True)
    assert codec(PIECES)(text) == (len(ids), " ".join(map(str, ids)), pieces_lib.decode(ids))


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(text):
    same(text)


@given(ANY)
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    same(text)


def test_whole_tokens_are_proved():
    c = counter(BYTES)
    assert len(c.whole) > 40_000 and all(len(bytes_lib.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(c.whole), 500))


def test_backtracking_agrees_with_merging():
    c, r = codec(PIECES), random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice("aeinrst▁hlo") for _ in range(r.randint(1, 30)))
        if "▁▁" not in text:
            assert [c.order[x] for x in c._backtrack(text)] == c._merge(text)
        blank = "▁" * r.randint(1, 40) + text.replace("▁", "")
        assert [c.text[x] for x in c._encode(blank)] == c._merge(blank)


SCRIPTS = ["Καλημέρα κόσμε, τι κάνεις;", "Привет, мир! Это — проверка.", "日本語のテキストと漢字、中文测试。", "한국어 문장입니다", "“quoted” – dash … ellipsis’s", "שלום עולם مرحبا", "नमस्ते दुनिया 😀👍🏽", "x   y    z" + " " * 70 + "end", "  \t  αβγ   \n   δ", "₯ ℤ ⁿ ½ ① Ⅻ \U0003fc00"]


def test_methods_hold_for_every_script(monkeypatch):
    """No text is handed to a library's encoder as a whole, and no run of blanks to merging."""
    count, encode = counter(BYTES), codec(PIECES)
    wanted = [(len(bytes_lib.encode(t, add_special_tokens=False).ids), pieces_lib.encode(t, add_eos=True), pieces_lib.decode(pieces_lib.encode(t, add_eos=True))) for t in SCRIPTS]

    class Refuses:
        def encode(self, *a, **k):
            raise AssertionError("encoded by the library")

    def refuses(*a, **k):
        raise AssertionError("merged")

    monkeypatch.setattr(count, "library", Refuses())
    monkeypatch.setattr(encode, "_merge", refuses)
    for table in (count.first, count.inner, encode.stretch, encode.stable):
        table.clear()
    for t, (n, ids, decoded) in zip(SCRIPTS, wanted, strict=True):
        assert count(t) == n and encode(t) == (len(ids), " ".join(map(str, ids)), decoded)


def test_queries_on_odd_texts(odd, none):
    counts = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(odd, BYTES).collect())
    lengths = [(i or 0, len((t or "").encode()), n := len(bytes_lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ODD]
    assert counts == sorted(lengths)
    pieces = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], len(r["ids"])) for r in encode_texts(odd, PIECES, with_ids=True).collect())
    want = []
    for i, t in ODD:
        ids = pieces_lib.encode(t or "", add_eos=True)
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces_lib.decode(ids).encode()).hexdigest(), len(ids)))
    assert pieces == sorted(want)
    assert count_tokens(none, BYTES).count() == encode_texts(none, PIECES).count() == pack_documents(none, WORDS).count() == 0


def packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_texts(odd):
    rows = pack_documents(odd, WORDS).collect()
    n = packed(rows, 4096)
    assert n == -(-sum(r["length"] for r in rows) // 4096)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    ids = words_lib.encode("long " * 20000, add_special_tokens=False).ids + [1]
    parts = sorted(by[6], key=lambda r: r["piece"])
    assert [r["start"] for r in parts] == list(range(0, len(ids), 4096)) and [r["length"] for r in parts] == [len(ids[i : i + 4096]) for i in range(0, len(ids), 4096)]
    assert [r["ids_crc32"] for r in parts] == [zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()) for i in range(0, len(ids), 4096)]
    assert len(by[4]) == 2 and by[1][0]["length"] == 1 and len(by[None]) == 1


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts):
    rows = plan(counts, 50)
    room, ranks = defaultdict(list), defaultdict(int)
    for length, first, uses, sequence, offset, repeats in sorted(rows, key=lambda r: (r[0], r[1])):
        assert first == ranks[length]
        ranks[length] += uses * repeats
        for s in range(repeats):
            room[sequence + s].append((offset, length * uses))
    assert dict(ranks) == counts
    for parts in room.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 50
    least = max(-(-sum(k * n for k, n in counts.items()) // 50), sum(n for k, n in counts.items() if k > 25))
    assert len(room) <= 1.6 * least + 2


def test_pair_replaces_the_smallest():
    """9 + 2 leaves a gap of 1; instead of 2, the pair 1 + 2 fills it."""
    rows = plan({9: 1, 2: 2, 1: 1}, 12)
    assert {r[3] for r in rows if r[0] == 9} == {r[3] for r in rows if r[0] == 1}
    assert sum(r[0] * r[2] for r in rows if r[3] == 0) == 12


def test_hot_length(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CASE WHEN id % 3 = 0 THEN 7L ELSE id % 16 + 1 END AS length", "'x' AS extra")
    rows = pack(df, 16).collect()
    assert len(rows) == 3000 and packed(rows, 16) <= 1.05 * sum(r["length"] for r in rows) / 16 + 1 and rows[0]["extra"] == "x"
