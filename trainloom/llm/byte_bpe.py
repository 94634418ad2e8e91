"""Byte-level BPE by prefix dynamic programming.

For a piece (one match of the split pattern) the table holds, for each byte prefix, the one token with which
the encoding of that prefix ends. Of the tokens that end at a byte, the valid one is that which stays apart
from the last token of the prefix before it: encoding the two tokens' bytes alone gives just these two. The
ids are read off backwards. An append adds entries and touches none; an edit keeps all entries before it.

`Text` holds a whole text as pieces and re-splits only around an append or edit. The DataFrame operator
encodes each distinct piece once in a while in a worker and joins ids.

Null is an empty text with no ids. A very long text is encoded whole, in one task; of a very long piece the table is
in memory, and what a worker remembers of short ones is bounded by bytes. Rows with equal or null doc_ids are encoded as they stand; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.llm.tokens import Remembered

#: Pairs of tokens whose verdict a vocabulary remembers; beyond it, it starts anew.
PAIRS = 500_000
#: Bytes of a piece's head, and how many heads a vocabulary remembers with the last tokens of their prefixes.
HEAD, HEADS = 6, 100_000


class Vocabulary:
    """Ranks of a tiktoken file, and whether two tokens may stand side by side."""

    kept: dict[str, Vocabulary] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.heads: dict[bytes, list[int]] = {}
        self.split: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls.kept:
            with open(path, "rb") as lines:
                cls.kept[path] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        return cls.kept[path]

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """The definition: join the neighbours whose joint bytes have the lowest rank, leftmost first, until none have one or so few are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, len(self.bytes)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.bytes):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def reachable(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        if token not in self.alone:
            self.alone[token] = self.merged(self.bytes[token]) == [token]
        return self.alone[token]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.split:
            data = self.bytes[token]
            self.split[token] = tuple(self.merged(data, 2)) if len(data) > 1 else None
        return self.split[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives the two.

        The merges are undone, last one first. Each time, the tokens that then meet at the border must not make
        one of a lower rank than the merge just undone (or an equal rank, where the border comes first): that
        would have been merged before it.
        """
        found = self.pairs.get((left, right))
        if found is not None:
            return found
        a, b, bound = left, right, len(self.bytes)
        while True:
            across = self.ranks.get(self.bytes[a] + self.bytes[b])
            if across is not None and across < bound:
                found = False
                break
            one, two = len(self.bytes[a]) > 1, len(self.bytes[b]) > 1
            if one and (a > b or not two):
                bound, a = a, self.halves(a)[1]
            elif two:
                bound, b = b + 1, self.halves(b)[0]
            else:
                found = True
                break
        if len(self.pairs) > PAIRS:
            self.pairs = {}
        self.pairs[left, right] = found
        return found


class Piece:
    """The bytes of a piece and, for each prefix but the empty one, the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Entries for more bytes; those of a head that another piece began with are taken over."""
        if not self.last and len(data) > HEAD:
            heads, head = self.vocabulary.heads, data[:HEAD]
            if head not in heads:
                if len(heads) > HEADS:
                    heads.clear()
                heads[head] = Piece(self.vocabulary, head).last
            self.data, self.last, data = head, list(heads[head]), data[HEAD:]
        ranks, apart, last = self.vocabulary.ranks, self.vocabulary.apart, self.last
        self.data += data
        for end in range(len(last) + 1, len(self.data) + 1):
            for start in range(max(0, end - self.vocabulary.longest), end):
                token = ranks.get(self.data[start:end])
                if token is not None and (apart(last[start - 1], token) if start else self.vocabulary.reachable(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace bytes start to end; what stands before start is not encoded again."""
        rest = data + self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(rest)

    def ids(self) -> list[int]:
        if self.data in self.vocabulary.ranks:  # as the library does, before any merging
            return [self.vocabulary.ranks[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Text:
    """A text as pieces of the pattern, for exact appends and edits.

    Matching goes on from the start of the piece before the one that holds the change, since the pattern looks
    one character ahead at most beyond a piece; after it, pieces that begin where an old one began are kept.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern, self.text = vocabulary, regex.compile(pattern), ""
        self.starts: list[int] = []
        self.pieces: list[Piece] = []
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters start to end."""
        moved, old_end = len(text) - (end - start), end
        self.text = self.text[:start] + text + self.text[end:]
        first = max(0, int(np.searchsorted(self.starts, start, side="left")) - 2)
        begin = self.starts[first] if first < len(self.starts) and first else 0
        first = first if begin else 0
        later = {s + moved: i for i, s in enumerate(self.starts) if s > old_end}
        starts, pieces = self.starts[:first], self.pieces[:first]
        for match in self.pattern.finditer(self.text, begin):
            if match.start() in later:
                i = later[match.start()]
                starts += [s + moved for s in self.starts[i:]]
                pieces += self.pieces[i:]
                break
            data = match.group().encode()
            old = self.pieces[len(pieces)] if len(pieces) < len(self.pieces) and self.starts[len(pieces)] == match.start() < start else None
            if old is not None and data.startswith(old.data):
                old.append(data[len(old.data) :])
                pieces.append(old)
            else:
                pieces.append(Piece(self.vocabulary, data))
            starts.append(match.start())
        self.starts, self.pieces = starts, pieces

    def ids(self) -> list[int]:
        return [x for piece in self.pieces for x in piece.ids()]


class Encoder:
    kept: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = Vocabulary.of(path), regex.compile(pattern)
        self.pieces = Remembered(self.encode)

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def encode(self, piece: str) -> bytes:
        ids = Piece(self.vocabulary, piece.encode()).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        return self.pieces.ids(self.pattern.findall(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def by_text(docs: DataFrame, column: str, schema: str, of) -> DataFrame:
    """doc_id and what of gives for the column, a few hundred rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), *of(b.column(1).to_pylist())], [x.split()[0] for x in f"doc_id long, {schema}".split(", ")])

    return docs.select(F.col("doc_id").cast("long"), column).mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers)."""
    return by_text(docs.withColumn("text", F.col("text").cast("string")), "text", "ids binary", lambda texts: [pa.array([Encoder.of(path, pattern).ids(x or "") for x in texts], pa.binary())])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text_bytes of what encode gave."""
    return by_text(encoded, "ids", "text_bytes binary", lambda rows: [pa.array([Encoder.of(path, pattern).decode(x or b"") for x in rows], pa.binary())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoding and decoding in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def both(texts: list) -> list[pa.Array]:
        coder = Encoder.of(path, pattern)
        ids = [coder.ids(x or "") for x in texts]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array([digest(coder.decode(x)) for x in ids], pa.string())]

    return by_text(docs.withColumn("text", F.col("text").cast("string")), "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", both)
