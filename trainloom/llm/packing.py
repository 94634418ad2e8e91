"""Packing by power-of-two decomposition: a document's ids are cut into pieces whose lengths are powers of two.

Every piece is a sequence of its own, so no sequence crosses documents, none is padded, and pieces of one
length form a bucket from which batches of one shape are drawn (`write_buckets`). The largest pieces come
first: as many of MOST ids as fit, then the binary digits of what is left.

A null text is an empty one: its ids are the end id alone. Rows with equal or null doc_ids are packed as they
stand; other columns are ignored, and an empty table gives no pieces. A very long text is encoded a document
at a time, in one task.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.llm.tokens import Remembered

MOST, END = 4096, 2
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cuts(n: int, most: int = MOST) -> list[int]:
    """Lengths of the pieces of n ids."""
    return [most] * (n // most) + [1 << k for k in reversed(range(most.bit_length() - 1)) if n % most >> k & 1]


#: Marks that end a word of ASCII letters and digits.
LAST_MARKS = re.compile(rb"(?<=[a-z0-9])([.,;:!?]+)(?=[ \t-\r]|\Z)")


class Encoder:
    """Ids of whole texts by a lower-casing tokenizer that never joins what white space divides."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = Remembered(self.encode)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode(self, piece: bytes) -> bytes:
        ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> bytes:
        """The tokenizer lower-cases and never joins letters or digits with marks, so pieces repeat more often so."""
        return self.pieces.ids(LAST_MARKS.sub(rb" \1", text.lower()).split())


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset, bucket.

    most is a power of two. sequence_id is the partition and row of the piece: as the plan from the scan on
    has no shuffle, a task that runs again gives the same ones.
    """
    last = np.array([end], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                out = ([], [], [], [], [])
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    ids, start = encoder.ids(text or b"") + last, 0
                    for n in cuts(len(ids) // 4, most):
                        for column, x in zip(out, (doc, start, n, len(ids) // 4, ids[4 * start : 4 * (start + n)]), strict=True):
                            column.append(x)
                        start += n
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, PIECE)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet, a folder a bucket, for a loader that draws batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a piece, with the CRC-32 of its ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
