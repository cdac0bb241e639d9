"""Byte-level BPE, token counts and packing against the tokenizer libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import bpe, packing, token_counts
from tests.llm import helpers

BPE_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FLAT_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_is_what_the_library_gives(spark):
    want_of = token_counts._encoding(BPE_PATH, public_tokenizers.PATTERN).encode_ordinary
    got = bpe.encode(helpers.odd(spark), BPE_PATH, public_tokenizers.PATTERN)
    want = []
    for i, t, *_ in helpers.odd_rows():
        ids = np.array(want_of(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, bytes(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256)) for r in got.collect())
    back = bpe.decoded(got, BPE_PATH).collect()
    assert sorted((r.body or b"") for r in back) == sorted((t or "").encode() for _, t, *_ in helpers.odd_rows())
    assert bpe.encode(helpers.empty(spark), BPE_PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c'\n\té中1 　\x1c", max_size=60), min_size=1, max_size=8))
def test_replay_on_any_text(texts):
    want_of = token_counts._encoding(BPE_PATH, public_tokenizers.PATTERN).encode_ordinary
    model = bpe.ranks(BPE_PATH)
    got = bpe.encode_block([t.encode() for t in texts], model, bpe.splitter(public_tokenizers.PATTERN))
    assert [g.tolist() for g in got] == [want_of(t) for t in texts]
    assert [bpe.decode(g, model) for g in got] == [t.encode() for t in texts]


def test_token_counts_round_trip(spark):
    docs = helpers.odd(spark)
    files = token_counts.token_blocks(docs, FLAT_PATH, public_tokenizers.PATTERN, size=64).cache()
    got = token_counts.token_counts(files.select("file", "block", "data")).orderBy("file", "ordinal").collect()
    assert all(r.closed for r in got) and [r.n_tokens for r in got if r.n_tokens < 0] == []
    count = token_counts._encoding(FLAT_PATH, public_tokenizers.PATTERN).encode_ordinary
    assert sorted(r.n_tokens for r in got) == sorted(len(count(t or "")) for _, t, *_ in helpers.odd_rows())
    assert token_counts.token_counts(files.where("false").select("file", "block", "data")).count() == 0


def test_token_counts_of_any_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, want = [], []
    for f in range(4):
        ids = rng.choice([7, 8, 9], size=300 + f, p=[0.1, 0.45, 0.45]) if f < 3 else np.array([8] * 50)
        data = ids.astype("<u2").tobytes()
        (tmp_path / f"{f}.bin").write_bytes(data)
        rows += [(f, 3 * (i // 16), data[i : i + 16]) for i in range(0, len(data), 16)]
        start = n = 0
        for i, x in enumerate(ids):
            if x == 7:
                want.append((f, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((f, n, start, len(ids) - start, False))
    table = spark.createDataFrame([*rows, (9, 0, None), (9, 1, b"")], "file bigint, block bigint, data binary")
    assert sorted(tuple(r) for r in token_counts.token_counts(table, separator=7).collect()) == want
    read = token_counts.token_counts(token_counts.read_token_files(spark, str(tmp_path), 32), separator=7).collect()
    assert sorted((int(r.file[-5]), *tuple(r)[1:]) for r in read) == want


def test_tree_places_first_fit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 200):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, free in enumerate(room) if free >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - room[at])
            room[at] -= sizes[i]


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    encode = Tokenizer.from_file(path).encode
    cuts = packing.cut(helpers.odd(spark), path, length=64, keep_ids=True).cache()
    rows = packing.pack(cuts, length=64, group_docs=4).collect()
    whole = sorted([*encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in helpers.odd_rows())
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length <= 64
        by_doc[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
    got = []
    for pieces in by_doc.values():
        open_ = defaultdict(list)
        for start, ids, total in sorted(pieces):
            open_[start, total].append(ids)
        while any(open_.values()):
            total = next(t for s, t in open_ if s == 0 and open_[s, t])
            ids = open_[0, total].pop()
            while len(ids) < total:
                ids = ids + open_[len(ids), total].pop()
            got.append(ids)
    assert sorted(got) == whole
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(packing.cut(helpers.empty(spark), path)).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> x<|startoftext|>y", "ΑΣ ΟΔΥΣΣΕΥΣ", "é ́a", "İI don't WE'RE", "€*** 12ab", "a\x1cb\x85c"])
def test_words_encode_as_whole_texts(text):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    enc = packing.WordEncoder(path, most=3)
    for _ in range(2):
        assert np.frombuffer(next(enc.encode([text.encode()])), "<u4").tolist() == want


@pytest.mark.parametrize("text", ["TAR\u0130H\u0130: \u0130.", "\u091c\u0921\u093c, \u091c\u095c,", "\ufb2a. \u05e9\ufb2a!", "x\u0130...y a\u0344; e\u0301, \u0958\u095f-"])
def test_letters_that_fall_into_letter_and_mark_keep_their_tail(text):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    enc = packing.WordEncoder(path)
    assert np.frombuffer(next(enc.encode([text.encode()])), "<u4").tolist() == want
