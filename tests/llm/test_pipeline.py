import os
import re
import struct

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    ids = {r["doc_id"] for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == ids
    assert sorted((p["doc_id"], p["start"]) for p in pieces) == sorted({(p["doc_id"], p["start"]) for p in corpus_pipeline.run(spark, SF).collect()})


def plain_words(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text)) if x]


def brute_exact(rows):
    """Rows that stay of equal texts: the longest, then the least doc_id, then the first."""
    best = {}
    for i, r in enumerate(rows):
        key = re.sub("[\x20\x09-\x0d]", "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, i)
        best[key] = min(best.get(key, rank), rank)
    return [rows[x[3]] for x in best.values()]


def brute_near(rows):
    """Rows that stay of components of sets of 5-word shingles that share 75 of 100: the least doc_id, then the first."""
    sets, comp = [], list(range(len(rows)))
    for r in rows:
        w = plain_words(r["text"] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and comp[i] != comp[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    best = {}
    for i, r in enumerate(rows):
        rank = (r["doc_id"] is None, r["doc_id"] or 0, i)
        best[comp[i]] = min(best.get(comp[i], rank), rank)
    return [rows[x[2]] for x in best.values()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_against_brute_force(spark):
    """All of sf0.001, stage by stage: the scores and verdicts are those of op1 and op9, which have tests of their own."""
    queries, library = pytest.importorskip("trainloom.llm.queries"), pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in queries.op1_quality_model(spark, SF).where("predicted = 1").collect()}
    docs = docs.where(docs.doc_id.isin(*good))
    kept = {r["doc_id"] for r in queries.quality_rules.judge(docs).where("kept").collect()}
    rows = brute_near(brute_exact([r.asDict() for r in docs.orderBy("doc_id").collect() if r["doc_id"] in kept]))
    tokenizer = library.Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}
    found = {}
    for p in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == len(found.setdefault(p["doc_id"], []))
        found[p["doc_id"]] += struct.unpack(f"<{p['length']}I", p["ids"])
    assert found == want


def test_stages_of_edge_rows(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, ties, repeats, clashing columns, no rows: each stage gives the columns it got, and the rows that are due."""
    labels = [(1, 1), (2, 0), (5, 0), (9, 0), (None, 1), (77, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    rows = [r.asDict() for r in odd.collect()]
    assert ids(stages["exact dedup"](spark, odd, str(tmp_path))) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in brute_exact(rows))
    assert ids(stages["n-gram Jaccard join"](spark, odd, str(tmp_path))) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in brute_near(rows))
    assert ids(stages["quality rules"](spark, odd, str(tmp_path))) == []  # all have under 50 words, or repeat one
    pieces = stages["packing"](spark, odd, str(tmp_path)).collect()
    assert sorted(p["doc_id"] or 0 for p in pieces if p["start"] == 0) == sorted(r["doc_id"] or 0 for r in rows)
    assert stages["packing"](spark, empty, str(tmp_path)).count() == 0
