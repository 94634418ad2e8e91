"""N-gram Jaccard join by prefix filtering: every two documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.

Shingles are 64-bit hashes; sets that are equal form one class, and all that follows is between classes. A global
order puts rare shingles first: shingles that stand out in counts over all documents come last, by count, the
rest by hash. (Any one order is exact; HEAVY bounds only how many shingles have a count of their own.) Two sets
that meet the threshold share a shingle among their first n - ceil(0.75 n) + 1 (prefix filter), the smaller among
fewer still; their sizes are within 3:4 (length filter), and what follows the shared places must suffice
(positional filter). Pairs that pass are taken once. Before their texts meet, a bound on how far the sets are apart,
by the parity of each part of the hashes' range (suffix filter), takes out most that do not link; the intersection decides.

Prefixes are dealt out by shingle. A shingle of few sets gives its pairs as it passes by; those of crowded ones
and of those that stand out go through the rounds of `rounds.connect`, so that a large group of near copies costs
about its size and no link between components is lost. A set is taken once a task however often it occurs there,
so a hot copy adds a row a task; hubs with many partners are dealt to several tasks.

Null and empty texts have no shingles and link with nothing; the set of a very long text is in memory whole, one at a
time. Repeated rows are one class. Null doc_ids stay null unless linked with others;
rows with equal doc_ids are separate documents. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.llm.common import Scratch, boxed, numbered, partitions, unboxed
from trainloom.llm.rounds import FEW, connect, small
from trainloom.llm.shingles import U, sets_of

PERCENT = 75
#: Shingles with a count of their own in the order; shingles counted at once, and the least count that stands out among them.
HEAVY, BLOCK, STANDS_OUT = 200_000, 2_000_000, 4
#: Partners of a hub that one task verifies.
HUB_ROWS = 2_000


def sliced(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), n):
            yield b.slice(at, n)


READ = "_uid long, doc_id long, n int, digest binary, token long, df long"
#: Bits of the hash that split shingles in parts for the suffix filter, at least and at most.
FEWEST_BITS, MOST_BITS = 6, 16


def sketch(own: np.ndarray) -> bytes:
    """Whether an odd number of shingles is in each part of the hashes' range, a bit each; up to two parts a shingle."""
    bits = min(MOST_BITS, max(FEWEST_BITS, len(own).bit_length()))
    return np.packbits(np.bincount((own >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


#: Longs of a parity sketch, and shingles of a set from which on it says too little, so that a sketch as long as the set serves besides.
LANES, WIDE = 8, 512


def parity(own: np.ndarray) -> list[int]:
    """For each of 64 * LANES parts of the hashes, whether an odd number of shingles is in it. Two sets' sketches differ in no more bits than there are shingles in one set only."""
    odd = np.bincount((own % U(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def least_apart(a: bytes, b: bytes) -> int:
    """The fewest shingles that only one of the sets of two sketches has: the parts whose parity differs, each of which takes one."""
    x, y = (np.unpackbits(np.frombuffer(k, np.uint8)) for k in (a, b))
    x, y = (k if len(k) == n else k.reshape(n, -1).sum(axis=1, dtype=np.uint8) & 1 for n in [min(len(x), len(y))] for k in (x, y))
    return int(np.count_nonzero(x != y))


class New:
    """Whether a set is new to this task, by its digest; a task has no more of them than rows."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def __call__(self, own: np.ndarray) -> bytes | None:
        """The digest of a set that is new, else None."""
        digest = digest_of(own)
        if digest is None or digest in self.seen:
            return None
        self.seen.add(digest)
        return digest


def digest_of(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own, digest_size=16).digest() if len(own) else None


def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set's size and digest; and rows of shingles that stand out, with counts."""
    names = [x.split()[0] for x in READ.split(", ")]
    new = New()
    block: list[np.ndarray] = []

    def standing() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([*block, np.zeros(0, U)]), return_counts=True)
        block.clear()
        out = counts >= STANDS_OUT
        none = lambda kind: pa.nulls(int(out.sum()), kind)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.binary()), pa.array(tokens[out].view(np.int64)), pa.array(counts[out])], names)

    for b in sliced(batches):
        sizes, digests = [], []
        for x in sets_of(b.column("text")):
            sizes.append(len(x))
            digests.append(digest_of(x))
            if new(x):
                block.append(x)
        nulls = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("_uid"), b.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), nulls, nulls], names)
        if sum(map(len, block)) > BLOCK:
            yield standing()
    yield standing()


def least_shared(n: int) -> int:
    """What sets must share at least with a set of n: ceil(0.75 n)."""
    return -(-PERCENT * n // 100)


#: Prefix shingles that a task gathers before it deals them out, and parts of the hashes' range for each partition.
GATHER, SPLITS = 2_000_000, 4
PLACE = np.dtype([("token", "<u8"), ("uid", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def packed(rows: np.ndarray) -> bytes:
    """Places as bytes, column by column and the same byte of all rows together, tokens as steps: most of those bytes are alike, so shuffles compress them well."""
    columns = [np.diff(rows[k], prepend=PLACE[k].type(0)) if k == "token" else np.ascontiguousarray(rows[k]) for k in PLACE.names]
    return b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns)


def unpacked(data: bytes) -> np.ndarray:
    n, at = len(data) // PLACE.itemsize, 0
    out = np.empty(n, PLACE)
    for k in PLACE.names:
        size = PLACE[k].itemsize
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(PLACE[k]).ravel()
        out[k] = np.cumsum(x, dtype=U) if k == "token" else x
        at += n * size
    return out


def prefixes(texts: DataFrame, heavy: list[tuple[int, int]], parts: int) -> DataFrame:
    """part, known, places: the prefixes of the sets that are new to their task, rarest first, packed by part of the hashes' range; known ones, whose shingle stands out, apart."""
    order = sorted(heavy)
    shared = texts.sparkSession.sparkContext.broadcast((np.array([t for t, _ in order], np.int64), np.array([c for _, c in order], np.int64)))  # HEAVY pairs of numbers at most

    def first_of(own: np.ndarray, uid: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of one set's prefix, and which of them stand out."""
        tokens, counts = shared.value
        n, known = len(own), None
        p = n - least_shared(n) + 1
        if len(tokens):
            signed = own.view(np.int64)
            at = np.minimum(np.searchsorted(tokens, signed), len(tokens) - 1)
            count = np.where(tokens[at] == signed, counts[at], 0)
            first = np.argsort(count, kind="stable")[:p]  # by hash where counts are equal
            own, known = own[first], count[first] > 0
        out = np.empty(p, PLACE)
        out["token"], out["uid"], out["n"], out["pos"] = own[:p], uid, n, np.arange(p)
        return out, np.zeros(p, bool) if known is None else known

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows, known = (np.concatenate(x) for x in zip(*held, strict=True))
        out: list[tuple[int, bool, bytes]] = []
        plain = rows[~known]
        plain = plain[np.argsort(plain["token"])]
        part = ((plain["token"] >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True) if len(part) else ():
            out.append((int(part[a]), False, packed(plain[a:b])))
        if known.any():
            out.append((int(rows["uid"][0]) % parts, True, packed(rows[known])))  # of any part, as they do not meet there
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], ["part", "known", "places"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, held, size = New(), [], 0
        for b in sliced(batches):
            for uid, own in zip(b.column("_uid").to_pylist(), sets_of(b.column("text")), strict=True):
                if new(own):
                    held.append(first_of(own, uid))
                    size += len(held[-1][0])
                    if size > GATHER:
                        yield dealt(held)
                        held, size = [], 0
        if held:
            yield dealt(held)

    return texts.select("_uid", "text").mapInArrow(of, "part long, known boolean, places binary")


def fits(small: np.ndarray, small_pos: np.ndarray, large: np.ndarray, large_pos: np.ndarray) -> np.ndarray:
    """Length, prefix and positional filters for a shared shingle at these places of sets of these sizes, the smaller first."""
    least = lambda n: -(-PERCENT * n // (100 + PERCENT))
    room = 1 + np.minimum(small - small_pos, large - large_pos) - 1
    return (100 * small >= PERCENT * large) & (small_pos <= small - least(2 * small)) & (room >= least(small + large))


def shared_at_least(n: str) -> str:
    """SQL: what sets of n shingles together must share to link."""
    return f"cast(ceil({PERCENT} * ({n}) / {100 + PERCENT}) as int)"


def may_star(s: str, t: str) -> str:
    """SQL: length filter."""
    return f"100 * least({s}.n, {t}.n) >= {PERCENT} * greatest({s}.n, {t}.n)"


def may_meet(s: str, t: str) -> str:
    """SQL: besides, suffix filter by the bits in which two parity sketches differ: each takes a shingle that only one set has."""
    differ = " + ".join(f"bit_count({s}.bits[{i}] ^ {t}.bits[{i}])" for i in range(LANES))
    return f"{may_star(s, t)} and {differ} <= {s}.n + {t}.n - 2 * {shared_at_least(f'{s}.n + {t}.n')}"


def may_link(s: str, t: str) -> str:
    """SQL: prefix and positional filters besides."""
    smaller = f"least(if({s}.n <= {t}.n, {s}.pos - {s}.n, {t}.pos - {t}.n), if({t}.n <= {s}.n, {t}.pos - {t}.n, {s}.pos - {s}.n))"
    return f"least({s}.n - {s}.pos, {t}.n - {t}.pos) >= {shared_at_least(f'{s}.n + {t}.n')} and {smaller} <= -{shared_at_least(f'2 * least({s}.n, {t}.n)')} and {may_meet(s, t)}"


MET = "token long, _uid long, n int, pos int, hub long, other long"


def crowds(rows: np.ndarray) -> pa.RecordBatch:
    """Places as rows of MET."""
    none = pa.nulls(len(rows), pa.int64())
    columns = [pa.array(np.ascontiguousarray(rows[k]).view(kind)) for k, kind in (("token", np.int64), ("uid", np.int64), ("n", np.int32), ("pos", np.int32))]
    return pa.RecordBatch.from_arrays([*columns, none, none], MET_NAMES)


MET_NAMES = [x.split()[0] for x in MET.split(", ")]


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed places sorted by part: pairs (hub, other) that pass the filters, of tokens of up to FEW places, and the places of tokens of more and of known ones."""
    held: list[np.ndarray] = []
    last = None

    def out() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["token"], kind="stable")]
        t = rows["token"]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(t)]]))
        size = np.repeat(lengths, lengths)
        if (size > FEW).any():
            yield crowds(rows[size > FEW])
        rows = rows[(size > 1) & (size <= FEW)]
        t, u, n, p = rows["token"], rows["uid"], rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
        found = []
        for d in range(1, min(FEW, len(t))):
            a = np.flatnonzero(t[d:] == t[:-d])
            b = a + d
            swap = (n[a] > n[b]) | ((n[a] == n[b]) & (u[a] > u[b]))
            s, l = np.where(swap, b, a), np.where(swap, a, b)
            ok = fits(n[s], p[s], n[l], p[l])
            found.append(np.sort(np.stack([u[s[ok]], u[l[ok]]], axis=1), axis=1))
        if found and sum(map(len, found)):
            pairs = np.unique(np.concatenate(found), axis=0)
            none, less = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())
            yield pa.RecordBatch.from_arrays([none, none, less, less, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], MET_NAMES)

    for b in batches:
        for part, known, data in zip(b.column("part").to_pylist(), b.column("known").to_pylist(), b.column("places").to_pylist(), strict=True):
            if known:
                yield crowds(unpacked(data))
                continue
            if part != last and held:
                yield from out()
                held = []
            last = part
            held.append(unpacked(data))
    if held:
        yield from out()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets meet the threshold."""
    need = -(-PERCENT * (len(a) + len(b)) // (100 + PERCENT))
    if min(len(a), len(b)) < need:
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum()) >= need


def suffix_filter(pairs: DataFrame, sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """Of pairs (hub, other) those whose sketches allow a link; sketches: _uid, n, bits, sketch. Parity sketches come first, and long ones move for what is left of large sets only."""
    side = lambda own, id_, name, *columns: own.select(F.col("_uid").alias(id_), F.struct("n", *columns).alias(name))
    both = pairs.join(side(sketches, "hub", "x", "bits"), "hub").join(side(sketches, "other", "y", "bits"), "other").where(may_meet("x", "y"))
    both = scratch.save(both.select("hub", "other", F.least("x.n", "y.n").alias("n")), "met")
    large = both.where(F.col("n") > WIDE).select("hub", "other")
    asked = large.select(F.col("hub").alias("_uid")).union(large.select("other")).distinct()
    wide = sketches.where(F.col("n") > WIDE).join(small(asked), "_uid", "left_semi")
    rows = large.join(side(wide, "hub", "x", "sketch"), "hub").join(side(wide, "other", "y", "sketch"), "other")
    rows = rows.select("hub", "other", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.sketch").alias("ka"), F.col("y.sketch").alias("kb"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            both = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
            apart = [least_apart(x, y) for x, y in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), strict=True)]
            yield b.select(["hub", "other"]).filter(pa.array(np.array(apart, np.int64) <= both - 2 * -(-PERCENT * both // (100 + PERCENT)), pa.bool_()))

    return both.where(F.col("n") <= WIDE).select("hub", "other").unionByName(rows.mapInArrow(of, "hub long, other long"))


def verified(pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Of pairs (hub, other), which are written, those that link. Each other's text goes to its hub, whose text comes first there; hubs with many are dealt out."""
    deals = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("deals"))
    nothing = F.lit(None).cast("long")
    hubs = deals.select(F.col("hub").alias("_uid"), "hub", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), nothing.alias("other"))
    others = pairs.join(small(deals.where("deals > 1")), "hub", "left").select(F.col("other").alias("_uid"), "hub", F.pmod(F.xxhash64("other"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"), "other")
    rows = texts.join(small(hubs.unionByName(others)), "_uid").select("hub", "deal", "other", "text")
    dealt = rows.repartition(parts, "hub", "deal").sortWithinPartitions("hub", "deal", F.col("other").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U)
        for b in sliced(batches):
            out: tuple[list, list] = ([], [])
            for hub, other, x in zip(b.column("hub").to_pylist(), b.column("other").to_pylist(), sets_of(b.column("text")), strict=True):
                if other is None:
                    own = x
                elif linked(own, x):
                    out[0].append(hub)
                    out[1].append(other)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["hub", "other"])

    return dealt.mapInArrow(check, "hub long, other long")


def met_tokens(texts: DataFrame, heavy: list, parts: int) -> DataFrame:
    """What `met` gives for the prefixes dealt out by shingle."""
    places = prefixes(texts, [(r["token"], r["df"]) for r in heavy], SPLITS * parts)
    return places.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(met, MET)


SKETCHED = "_uid long, n int, bits array<long>, sketch binary, text string"


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = list(sets_of(b.column("text")))
        bits = pa.array([parity(x) for x in sets], pa.list_(pa.int64()))
        wide = pa.array([sketch(x) if len(x) > WIDE else b"" for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("_uid"), pa.array(map(len, sets), pa.int32()), bits, wide, b.column("text")], [x.split()[0] for x in SKETCHED.split(", ")])


def joined(rows: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """_uid, doc_id, n_shingles, component (the least _uid reachable by links) for rows of _uid, doc_id, text, which are written already."""
    read = scratch.save(rows.select("_uid", "doc_id", "text").mapInArrow(read_sets, READ), "read")
    sets = read.where("_uid is not null")
    heavy = read.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(HEAVY).collect()

    # Classes of equal sets, named by their least row.
    classes = sets.where("digest is not null").groupBy("digest").agg(F.min("_uid").alias("cid"))
    members = scratch.save(sets.join(classes, "digest", "left").select("_uid", "doc_id", "n", F.coalesce("cid", "_uid").alias("cid")), "members")

    common = scratch.save(met_tokens(rows, heavy, parts), "common")
    scratch.drop("read")
    few = scratch.save(common.where("token is null").select("hub", "other").distinct(), "few")
    places = common.where("token is not null").select("token", F.col("_uid").alias("cid"), "n", "pos")
    wanted = scratch.save(few.select(F.col("hub").alias("_uid")).union(few.select("other")).union(places.select("cid")).distinct(), "wanted")
    texts = scratch.save(rows.select("_uid", "text").join(small(wanted), "_uid", "left_semi").mapInArrow(sketched, SKETCHED), "texts")

    scratch.drop("rows")  # the text of what may link is in texts

    # A class that several tasks took has a link from each one's row to its name.
    copies = members.join(small(wanted), "_uid", "left_semi").where("cid <> _uid").select(F.col("_uid").alias("hub"), F.col("cid").alias("other"))

    bits = texts.select(F.col("_uid").alias("cid"), "bits")
    crowded = places.select("token", F.struct("cid", "n", "pos").alias("m"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = scratch.save(suffix_filter(pairs, texts.select("_uid", "n", "bits", "sketch"), scratch), "left")
        return verified(left, texts.select("_uid", "text"), parts)

    labels = connect(crowded, few, "m.pos", may_link, may_star, verify, scratch, copies, bits)
    labels = scratch.save(labels, "components")
    scratch.keep("docs", "members", "components")  # what the result is read from
    return members.join(labels, members.cid == labels.id, "left").select("_uid", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "cid").alias("component"))


def join(docs: DataFrame) -> DataFrame:
    """`joined` for the rows of docs as read here."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = scratch.save(numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "_uid"), "rows")
    return joined(rows, scratch, partitions(spark))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id of its component)."""
    found = join(docs)
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(names, "component").select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one of each component: the one with the least doc_id, then the first read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    held = scratch.save(numbered(boxed(docs), "_uid"), "docs")
    found = joined(held.select("_uid", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").cast("string").alias("text")), scratch, partitions(spark))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_uid")).alias("f")).select("f._uid")
    return unboxed(held.join(first, "_uid", "left_semi"))
