import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ROWS
from trainloom.llm import byte_bpe, packing, tokens

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")
BPE, WORDS = public.path("byte_bpe_50k.tiktoken"), public.path("word_bpe_49k.json")
VOCABULARY = byte_bpe.Vocabulary.of(BPE)
LIBRARY = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
TEXT = st.text(st.sampled_from("abth 'sllreé\n.,!1²日🙂 "), max_size=30)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_is_the_library_s(text):
    assert ids(byte_bpe.Encoder.of(BPE, public.PATTERN).ids(text)) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 30), st.integers(0, 30), TEXT)
def test_edits_and_appends(text, a, b, new):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    own = byte_bpe.Text(VOCABULARY, public.PATTERN, text)
    own.edit(a, b, new)
    assert own.ids() == LIBRARY.encode_ordinary(text[:a] + new + text[b:])
    own.append(new)
    assert own.ids() == LIBRARY.encode_ordinary(text[:a] + new + text[b:] + new)


def test_tables_of_a_piece_are_prefixes():
    piece = byte_bpe.Piece(VOCABULARY, b" unbelievable")
    for n in range(1, len(piece.data)):
        assert byte_bpe.Piece(VOCABULARY, piece.data[:n]).last == piece.last[:n]


def test_round_trip(docs):
    found = byte_bpe.round_trip(docs, BPE, public.PATTERN).collect()
    assert len(found) == len(ROWS)
    import hashlib

    by = {r["doc_id"]: r for r in found}
    for doc, text, *_ in ROWS:
        assert by[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert by[doc]["n_tokens"] == len(LIBRARY.encode_ordinary(text or ""))
    encoded = byte_bpe.encode(docs, BPE, public.PATTERN)
    decoded = byte_bpe.decode(encoded, BPE, public.PATTERN).collect()
    assert {bytes(r["text_bytes"]).decode() for r in decoded} == {r[1] or "" for r in ROWS}


def test_pieces_rebuild_documents(docs):
    library = tokenizers.Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    pieces = packing.pack(docs, WORDS).collect()
    want = sorted((r[0] is not None, r[0] or 0, [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ROWS)
    assert sum(p["length"] for p in pieces) == sum(len(w[2]) for w in want)
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    for p in pieces:
        assert p["length"] <= packing.MOST and p["length"] & (p["length"] - 1) == 0 and p["offset"] == 0
        assert len(p["ids"]) == 4 * p["length"] and p["bucket"] == p["length"].bit_length() - 1
    for one in (9, 10, 6):
        own = sorted((p for p in pieces if p["doc_id"] == one), key=lambda p: p["start"])
        text = next(r[1] for r in ROWS if r[0] == one)
        assert ids(b"".join(bytes(p["ids"]) for p in own)) == [*library.encode(text, add_special_tokens=False).ids, 2]
        assert own[0]["doc_tokens"] == sum(p["length"] for p in own)
    report = {r["sequence_id"]: r["ids_crc32"] for r in packing.report(docs, WORDS).collect()}
    assert all(report[p["sequence_id"]] == zlib.crc32(bytes(p["ids"])) for p in pieces)


def test_memory_of_pieces_is_bounded():
    """By bytes, within one text too; long pieces are never kept. Ids do not change."""
    kept = tokens.Remembered(lambda x: x * 4, most=20_000)
    for k in range(3):
        pieces = [b"%d" % (i % 700) for i in range(5_000)] + [b"y" * 1_000_000, b"%d" % k]
        assert kept.ids(pieces) == b"".join(x * 4 for x in pieces)
        held = [*kept.items(), *kept.old.items()]
        assert sum(tokens.ENTRY + len(a) + len(b) for a, b in held) <= 2 * 20_000 + 1000 and max(len(a) for a, _ in held) <= tokens.LONGEST


def test_very_long_pieces():
    """A text that nothing splits: unspaced script, and one long word."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    for text in ("日本語" * 20_000, "abcdefghij" * 10_000, "ab" * 10 + " " * 50_000 + "x"):
        assert ids(byte_bpe.Encoder.of(BPE, public.PATTERN).ids(text)) == LIBRARY.encode_ordinary(text)
        assert ids(packing.Encoder.of(WORDS).ids(text.encode())) == library.encode(text, add_special_tokens=False).ids


def test_clashing_columns(docs, odd):
    same = lambda f: sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(odd).collect()))
    assert same(lambda d: byte_bpe.round_trip(d, BPE, public.PATTERN))
    assert same(lambda d: packing.report(d, WORDS).drop("sequence_id"))


@given(st.integers(0, 20000))
def test_cuts(n):
    own = packing.cuts(n)
    assert sum(own) == n and all(x & (x - 1) == 0 for x in own) and own == sorted(own, reverse=True)


def test_empty(empty):
    assert packing.report(empty, WORDS).count() == 0 and byte_bpe.round_trip(empty, BPE, public.PATTERN).count() == 0
