import hashlib
import re

import numpy as np

from tests.llm.conftest import ROWS
from trainloom.llm import exact_dedup as ex


def brute(rows):
    groups = {}
    for i, (doc, text, *_) in enumerate(rows):
        h = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()
        groups.setdefault(h, []).append((-len(text or ""), doc is None, doc or 0, i))
    return groups


def test_report_against_brute_force(docs):
    groups = brute(ROWS)
    found = ex.report(docs).collect()
    assert len(found) == len(ROWS)
    for h, members in groups.items():
        own = [r for r in found if r["text_sha256"] == h]
        assert len(own) == len(members) == own[0]["group_size"]
        best = min(members)
        assert {r["keep_id"] for r in own} == {ROWS[best[3]][0]}
        assert sum(r["kept"] for r in own) == 1


def test_slots_are_a_bijection():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        digest = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        shifts, slot = ex.build(digest)
        assert sorted(slot) == list(range(n))
        bucket, hashes = ex.parts_of(digest, n)
        assert (ex.slots_of(hashes, shifts[bucket], n) == slot).all()


def test_history(spark, docs):
    past = spark.createDataFrame([(100, "abcdefgh"), (101, "other")], "doc_id long, text string")
    found = {(r["doc_id"], r["member"], r["keep_id"], r["kept"]) for r in ex.dedup(docs, past).collect()}
    assert (1, True, 100, False) in found and (2, True, 100, False) in found
    assert (7, False, 7, True) in found and (8, False, 8, True) in found


def test_keep_first_keeps_columns_and_names(odd):
    kept = ex.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(ROWS[min(m)[3]][0] for m in brute(ROWS).values())


def test_empty(empty):
    assert ex.report(empty).count() == 0 and ex.keep_first(empty).count() == 0
