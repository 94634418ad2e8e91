"""Exact dedup by a minimal perfect hash over the distinct digests of a history.

The history is sharded by digest; each shard is one row: displacements, full 32-byte digests and winner
locators, in slot order. A row finds its one possible slot by hashing and is a repeat only if all 32 bytes
agree; what agrees with no slot is grouped separately. Shards hold about SHARD_KEYS digests whatever the
input's size, so a task needs one shard in memory at a time. A shard with many rows (a hot digest) is sent to
several tasks, each with a share of the rows.

Null and empty texts are the same text. Very long texts are hashed whole, in one task each. Of rows that are equal in length and doc_id the one first read
stays; null doc_ids lose to others. Other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.llm.common import BLANK_BYTES, Scratch, boxed, numbered, partitions, salts, unboxed

SHARD_KEYS, BUCKET_KEYS = 65_536, 4
ROW = "_uid long, doc_id long, n_points long, digest binary, head long"
SHARD = "shard int, n_keys long, n_rows long, shifts binary, digests binary, keep_ids binary, keep_null binary, keep_uids binary, sizes binary"
U = np.uint64


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def digests(rows: DataFrame) -> DataFrame:
    """Of each row of (_uid, doc_id, text): code points of the text, SHA-256 of the text without blanks, its first 8 bytes as a number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256((x or b"").translate(None, BLANK_BYTES)).digest() for x in as_bytes(b.column("text"))]
            head = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 4)[:, 0]
            points = pc.fill_null(pc.utf8_length(b.column("text")).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column("_uid"), b.column("doc_id"), points, pa.array(found, pa.binary()), pa.array(head)], ["_uid", "doc_id", "n_points", "digest", "head"])

    return rows.select("_uid", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, ROW)


def mix(x: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser (of the splitmix64 generator) of x moved by the seed."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15) * (np.asarray(seed, dtype=U) + U(1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def parts_of(digest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and hash of digests (rows of 32 bytes); the first 8 bytes choose the shard, so others serve here."""
    words = np.ascontiguousarray(digest).view("<u8")
    return (words[:, 1] % U(max(1, math.ceil(n / BUCKET_KEYS)))).astype(np.int64), words[:, 2]


def slots_of(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """A shift below 0 names its slot, another one seeds the hash."""
    return np.where(shift < 0, -shift - 1, (mix(hashes, np.maximum(shift, 0)) % U(n)).astype(np.int64))


def build(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shift of each bucket and slot of each key, such that n distinct keys fill n slots.

    Buckets go by falling size, each to the first shift that puts all its keys in free slots; single keys are
    put in what is left, directly. Keys that share all of bucket and hash differ in no other way that a shift
    could use, so two of those (never seen: 128 equal bits of SHA-256) raise an error.
    """
    n = len(digest)
    bucket, hashes = parts_of(digest, n)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(math.ceil(n / BUCKET_KEYS) + 1))
    sizes = np.diff(starts)
    shifts, slot, taken = np.zeros(len(sizes), np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    for k in np.argsort(-sizes, kind="stable"):
        keys = order[starts[k] : starts[k + 1]]
        if len(keys) < 2:
            break
        if len(np.unique(hashes[keys])) < len(keys):
            raise ValueError("two distinct digests agree in 128 bits")
        first, step = 0, 16
        while True:
            tried = (mix(hashes[keys][None, :], np.arange(first, first + step)[:, None]) % U(n)).astype(np.int64)
            good = ~taken[tried].any(axis=1)
            if good.any():
                alike = np.sort(tried, axis=1)
                good &= (alike[:, 1:] != alike[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                shifts[k], slot[keys] = first + at, tried[at]
                taken[tried[at]] = True
                break
            first, step = first + step, min(4096, step * 4)
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    shifts[single], slot[order[starts[single]]] = -free - 1, free
    return shifts, slot


def index(history: DataFrame, n_rows: int, parts: int) -> tuple[DataFrame, int]:
    """The shards over the distinct digests of history (rows as `digests` gives), and how many there are."""
    n_shards = max(1, math.ceil(n_rows / SHARD_KEYS), min(2 * parts, math.ceil(n_rows / 512)))
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("rev"), F.bitwise_not("_uid").alias("uid")))
    winners = history.groupBy("digest", "head").agg(best.alias("w"), F.count("*").alias("size")).select(F.pmod("head", F.lit(n_shards)).cast("int").alias("shard"), "digest", F.bitwise_not("w.rev").alias("keep_id"), F.bitwise_not("w.uid").alias("keep_uid"), "size")

    def shard(keys: pd.DataFrame) -> pd.DataFrame:
        digest = np.frombuffer(b"".join(keys["digest"]), np.uint8).reshape(-1, 32)
        shifts, slot = build(digest)
        at = np.empty_like(slot)
        at[slot] = np.arange(len(slot))
        ids = [None if x is None else int(x) for x in keys["keep_id"]]
        out = {"digests": digest, "keep_ids": np.array([x or 0 for x in ids], np.int64), "keep_null": np.array([x is None for x in ids], bool), "keep_uids": keys["keep_uid"].to_numpy(np.int64), "sizes": keys["size"].to_numpy(np.int64)}
        return pd.DataFrame([{"shard": keys["shard"].iloc[0], "n_keys": len(keys), "n_rows": keys["size"].sum(), "shifts": shifts.tobytes()} | {k: v[at].tobytes() for k, v in out.items()}])

    # As text, since pandas makes floats of longs with nulls.
    return winners.withColumn("keep_id", F.col("keep_id").cast("string")).groupBy("shard").applyInPandas(shard, SHARD), n_shards


def lookup(rows: DataFrame, shards: DataFrame, n_shards: int, total: int, parts: int) -> DataFrame:
    """Each row with what its slot holds, if all 32 bytes agree; else with nulls (member is false)."""
    rows = rows.withColumn("shard", F.pmod("head", F.lit(n_shards)).cast("int"))
    # One count a shard, SHARD_KEYS distinct digests each: only the shards that are dealt to several tasks are
    # kept, which are no more than `parts` by the size of a share.
    hot = rows.groupBy("shard").count().select("shard", salts(F.col("count"), total, parts).alias("n")).where("n > 1")
    cut = {r["shard"]: r["n"] for r in hot.collect()}
    assert len(cut) <= max(parts, total // 256 + 1)
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]), F.col("shard")), F.lit(1)) if cut and len(cut) <= 2000 else F.lit(1)
    if len(cut) > 2000:
        sizes = F.broadcast(rows.sparkSession.createDataFrame(list(cut.items()), "shard int, n int"))
        rows, shards = (x.join(sizes, "shard", "left").withColumn("n", F.coalesce("n", F.lit(1))) for x in (rows, shards))
        many = F.col("n")
    none = [F.lit(None).cast("binary").alias(x) for x in ("shifts", "digests", "keep_ids", "keep_null", "keep_uids", "sizes")]
    asked = rows.select("shard", F.pmod(F.xxhash64("_uid"), many).cast("int").alias("salt"), F.lit(1).alias("asks"), "_uid", "doc_id", "digest", F.lit(0).cast("long").alias("n_keys"), *none)
    held = shards.select("shard", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("_uid"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "n_keys", "shifts", "digests", "keep_ids", "keep_null", "keep_uids", "sizes")
    met = asked.unionByName(held).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "asks")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for b in batches:
            shard, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy()
            for cut in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard) | np.diff(asks) | (asks[1:] == 0)) + 1):
                if not len(cut):
                    continue
                part = b.slice(cut[0], len(cut))
                if not asks[cut[0]]:
                    read = lambda name, kind, part=part: np.frombuffer(part.column(name)[0].as_py(), kind)
                    now, table = shard[cut[0]], {"digests": read("digests", np.uint8).reshape(-1, 32)} | {k: read(k, np.int64) for k in ("shifts", "keep_ids", "keep_uids", "sizes")} | {"keep_null": read("keep_null", bool)}
                    continue
                digest = np.frombuffer(b"".join(part.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
                if now != shard[cut[0]]:
                    table = None  # no key of this shard is in the history
                if table is None:
                    at, member = np.zeros(len(digest), np.int64), np.zeros(len(digest), bool)
                    keep, uid, size, unknown = at, at, at, member
                else:
                    n = len(table["sizes"])
                    bucket, hashes = parts_of(digest, n)
                    at = slots_of(hashes, table["shifts"][bucket], n)
                    member = (table["digests"][at] == digest).all(axis=1)
                    keep, uid, size, unknown = (table[k][at] for k in ("keep_ids", "keep_uids", "sizes", "keep_null"))
                yield pa.RecordBatch.from_arrays([part.column("_uid"), part.column("doc_id"), part.column("digest"), pa.array(member), pa.array(keep, mask=unknown | ~member), pa.array(uid, mask=~member), pa.array(size, mask=~member)], ["_uid", "doc_id", "digest", "member", "keep_id", "keep_uid", "group_size"])

    return met.mapInArrow(answer, "_uid long, doc_id long, digest binary, member boolean, keep_id long, keep_uid long, group_size long")


def numbered_rows(docs: DataFrame) -> DataFrame:
    return numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "_uid")


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """_uid, doc_id, digest, member, keep_id, keep_uid, group_size, kept for each row of docs.

    Without a history, docs are their own: the winner of each digest stays. With one (documents of an
    earlier run), rows whose text is in it go, as repeats of its winner (keep_uid is then null); of the rest,
    grouped separately, each group's winner stays. `_uid` numbers the rows of docs as read here.
    """
    scratch, parts = Scratch(docs.sparkSession, "exact"), partitions(docs.sparkSession)
    rows = scratch.save(digests(numbered_rows(docs)), "rows")
    n = rows.count()
    own = history is None
    past = rows if own else scratch.save(digests(numbered_rows(history)), "past")
    shards, n_shards = index(past, n if own else past.count(), parts)
    found = lookup(rows, scratch.save(shards, "shards"), n_shards, n, parts)
    if own:
        return found.withColumn("kept", F.col("_uid") == F.col("keep_uid"))
    found = scratch.save(found, "found")
    repeats = found.where("member").withColumn("keep_uid", F.lit(None).cast("long")).withColumn("kept", F.lit(False))
    fresh = scratch.save(rows.join(found.where("not member").select("_uid"), "_uid", "left_semi"), "fresh")
    more, n_more = index(fresh, fresh.count(), parts)
    rest = lookup(fresh, scratch.save(more, "more"), n_more, n, parts).withColumn("member", F.lit(False))
    return repeats.unionByName(rest.withColumn("kept", F.col("_uid") == F.col("keep_uid")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    scratch, parts = Scratch(docs.sparkSession, "kept"), partitions(docs.sparkSession)
    held = scratch.save(numbered(boxed(docs), "_uid"), "docs")
    rows = scratch.save(digests(held.select("_uid", "_doc.doc_id", "_doc.text")), "rows")
    n = rows.count()
    shards, n_shards = index(rows, n, parts)
    found = lookup(rows, scratch.save(shards, "shards"), n_shards, n, parts)
    return unboxed(held.join(found.where(F.col("_uid") == F.col("keep_uid")).select("_uid"), "_uid", "left_semi"))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
