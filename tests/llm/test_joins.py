import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from trainloom.llm import line_dedup, ngram_join, rounds


def brute(rows):
    """Sizes, and components by links of equal or similar sets, by row number."""
    sets = []
    for _, text, *_ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return [len(s) for s in sets], comp


def check(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in ngram_join.report(docs).collect()}
    sizes, comp = brute(rows)
    assert [found[i]["n_shingles"] for i in range(len(rows))] == sizes
    assert [found[i]["component_id"] for i in range(len(rows))] == comp


def test_edge_rows(spark, docs):
    check(spark, ROWS)
    found = ngram_join.report(docs).collect()
    assert len(found) == len(ROWS) and {r["component_id"] for r in found if r["doc_id"] in (None, 1, 2)} == {1}


def texts(seed, groups, size, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            out.append((None, " ".join(own)))
    shared = [word() for _ in range(40)]
    out += [(None, " ".join([word() for _ in range(rng.randint(5, 30))] + shared)) for _ in range(20)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, texts(seed, 12, 8, 3))


@pytest.mark.parametrize("stars", [0, 2])
def test_crowded_tokens(spark, monkeypatch, stars):
    """Star rounds and crowded tokens, which small tables do not reach by themselves; without star rounds too."""
    for module in (ngram_join, rounds):
        monkeypatch.setattr(module, "FEW", 2)
    monkeypatch.setattr(rounds, "STARS", stars)
    monkeypatch.setattr(ngram_join, "HUB_ROWS", 3)
    check(spark, texts(3, 3, 25, 4))


def test_keep_one(odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and None not in ids and {3, 4, 5, 7, 10} <= set(ids)


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn at dawn"
    rows = [(1, f"{base}\nshort\n\nshort"), (2, f"{base.replace('barn', 'barns')}\nSHORT!\nanother line of text that stands quite alone here"), (3, None), (4, base.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    assert found[1]["text"] == f"{base}\nshort\n" and found[1]["n_dropped"] == 1
    assert found[2]["text"].endswith("another line of text that stands quite alone here") and "short" not in found[2]["text"].lower()
    assert found[3]["text"] == "" and found[3]["n_lines"] == 1
    assert found[4]["text"] == "" and found[4]["n_dropped"] == 1


def test_lines_of_edge_rows(docs, odd):
    assert line_dedup.dedup(docs).count() == len(ROWS) == line_dedup.dedup(odd).count()


def test_giant_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LANE", 4)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "x y z")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_empty(empty):
    assert ngram_join.report(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0 and line_dedup.dedup(empty).count() == 0


def near(a, b):
    """Whether the edit similarity is 0.9 or more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 10 * row[-1] <= max(len(a), len(b))


def recall(spark, sets):
    """For each set of pairs of lines, of those that are near the share of which one line goes; no pair is like another one."""
    sets = [[(a, b) for a, b in pairs if a != b and near(a, b)] for pairs in sets]
    docs = spark.createDataFrame([(1000 * k + i, f"{a}\n{b}") for k, pairs in enumerate(sets) for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(docs).collect()}
    assert min(map(len, sets)) > 20 and set(found.values()) <= {0, 1}
    return [sum(found[1000 * k + i] for i in range(len(pairs))) / len(pairs) for k, pairs in enumerate(sets)]


@pytest.mark.parametrize("seed", [5, 6])
def test_lines_recall(spark, seed):
    """Against brute-force edit similarity: a word replaced, a letter changed, characters replaced anywhere, short lines, lines of one long word."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    line = lambda k: [word(rng.randint(3, 7)) for _ in range(k)]

    def replaced(words):
        own, i = list(words), rng.randrange(len(words))
        own[i] = word(len(own[i]))
        return " ".join(words), " ".join(own)

    def scattered(text, edits):
        own = list(text)
        for _ in range(edits):
            i, kind = rng.randrange(len(own)), rng.randrange(3)
            own[i : i + (kind > 0)] = [word(1)] if kind < 2 else []
        return text, "".join(own)

    words = [replaced(line(k)) for k in (12, 20, 40, 100, 200) for _ in range(20)]
    letters = [scattered(" ".join(line(k)), 1) for k in (5, 8, 20, 50, 200) for _ in range(20)]
    short = [scattered(x := " ".join(line(rng.randint(2, 6)))[:39].strip(), max(1, len(x) // 10)) for _ in range(150)]
    long = [scattered(x := " ".join(line(rng.randint(9, 30))), len(x) // 10) for _ in range(100)]
    runs = [scattered(word(80), 5) for _ in range(40)]
    found = recall(spark, [words, letters, short, long, runs])
    assert found[:3] == [1, 1, 1] and found[3] > 0.9 and found[4] > 0.95


def test_edits_of_lines(spark):
    """Leaving out words that both lines begin or end with changes no distance."""
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["a", "ab", "b", "cab"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    pairs = [(a, b) for a, b in zip(lines, lines[1:], strict=False) if a != b]
    for _ in range(60):  # long ones, with edits at random places, and unlike ones
        own = list(" ".join(rng.choice(["ab", "bcd", "cab", "dddd"]) for _ in range(rng.randint(15, 30))))
        other = list(own)
        for _ in range(rng.randint(1, 9)):
            i, kind = rng.randrange(len(other)), rng.randrange(3)
            other[i : i + (kind > 0)] = [rng.choice("abcd ")] if kind < 2 else []
        pairs.append((" ".join("".join(own).split()), " ".join("".join(other).split())))
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.edits("x", "y", "5").alias("d")).collect()
    for r in rows:
        row = list(range(len(r["y"]) + 1))
        for i, u in enumerate(r["x"], 1):
            row, last = [i], row
            for j, v in enumerate(r["y"], 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (u != v)))
        assert r["d"] == (row[-1] if row[-1] <= 5 else -1), r


def brute_lines(rows):
    """Texts after line dedup by edit similarity of all pairs of lines."""
    norm = lambda x: " ".join(w for w in re.split(line_dedup.APART, x.lower()) if w)
    place = lambda r, i: (r[0] is None, r[0] or 0, i)
    own = sorted((*place(r, i), k, norm(x)) for i, r in enumerate(rows) for k, x in enumerate((r[1] or "").split("\n")))
    own = [x for x in own if x[4]]
    comp = list(range(len(own)))
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if comp[i] != comp[j] and (a[4] == b[4] or near(a[4], b[4])):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    gone = {(x[2], x[3]) for i, x in enumerate(own) if comp[i] != i}
    return ["\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if (i, k) not in gone) for i, r in enumerate(rows)]


def test_lines_against_brute_force(spark, odd):
    """Edge rows with their ties and repeats, and short lines with edits, which are all found."""
    rng = random.Random(9)
    base = ["call me at ten", "the red fox ran over it", "all rights are reserved", "page 12 of 40", "x", ""]
    texts = ["\n".join("".join(c if rng.random() > 0.04 else rng.choice("ab1 ") for c in rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + i, x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted(map(repr, ((r["doc_id"], r["text"]) for r in line_dedup.dedup(docs).collect())))
    assert found == sorted(map(repr, zip((r[0] for r in rows), brute_lines(rows), strict=True)))
    own = line_dedup.dedup(odd.coalesce(1)).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in own) == sorted(map(repr, zip((r[0] for r in ROWS), brute_lines(ROWS), strict=True)))
    assert line_dedup.dedup(odd).columns == ["doc_id", "n_lines", "n_dropped", "text"]


def test_short_lines_are_fuzzy(spark):
    docs = spark.createDataFrame([(1, "Copyright 2023 Example Inc\nall others"), (2, "Copyright 2024 Example Inc")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()} == {1: "Copyright 2023 Example Inc\nall others", 2: ""}


def test_packed_places_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.zeros(500, ngram_join.PLACE)
    rows["token"], rows["uid"], rows["n"], rows["pos"] = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 2**60, 500), rng.integers(0, 9999, 500), rng.integers(0, 99, 500)
    for n in (0, 1, 500):
        assert (ngram_join.unpacked(ngram_join.packed(rows[:n])) == rows[:n]).all()


def test_sketches_bound_what_is_apart():
    """Sketches of sets of any sizes differ in no more parts than there are shingles in one set only; they take a bit a part."""
    rng = np.random.default_rng(2)
    for n, m, shared in ((600, 600, 600), (600, 800, 550), (1000, 1030, 990), (5000, 5200, 100), (40_000, 31_000, 30_500)):
        both = rng.integers(0, 1 << 63, n + m - shared).astype(np.uint64) * np.uint64(2)
        a, b = np.sort(both[:n]), np.sort(both[n - shared :])
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        apart = n + m - 2 * shared
        assert ngram_join.least_apart(x, y) == ngram_join.least_apart(y, x) <= apart and len(x) <= n // 4 + 8
        assert ngram_join.least_apart(x, y) >= apart // 2 if apart <= 300 else True


def test_common_keys_are_counted_over_all_lines(spark):
    """A key that many lines share is common also if none of them is in one eighth by hash, which was all that was counted."""
    lines = spark.range(400).select(F.concat(F.lit("these same four words stand here before the number "), F.col("id").cast("string")).alias("norm"))
    lines = lines.where("pmod(xxhash64(norm), 8) <> 0").select(F.monotonically_increasing_id().alias("cid"), "norm", F.length("norm").alias("n"))
    found = line_dedup.common_hashes(lines)
    shared = lines.limit(1).transform(line_dedup.with_hashes).select(F.explode(F.slice("hashes", 1, 6)).alias("h")).select(F.expr(line_dedup.COUNTER.format("h")).alias("h"))
    assert {r["h"] for r in shared.collect()} <= set(found) and len(found) < 20


def test_word_by_word_edits_are_no_fewer_than_the_distance(spark):
    """Lines with words put in, left out and changed far apart: the count is a bound, and near enough to spare the edit distance."""
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        words = ["".join(rng.choices("abcd", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 60))]
        other = list(words)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 1)] = rng.choice([[], ["ab"], ["".join(rng.choices("abcd", k=4))]])
        rows.append((" ".join(words), " ".join(other)))
    rows += [("", ""), ("a", ""), ("", "a b"), ("a b c", "c"), ("a", "b c a"), ("x y", "x")]
    found = spark.createDataFrame(rows, "x string, y string").select(F.expr("levenshtein(x, y)").alias("d"), line_dedup.edited("x", "y", "100000").alias("most")).collect()
    assert all(r["d"] <= r["most"] for r in found) and sum(r["most"] <= r["d"] + 4 for r in found) > 250


def test_pairs_of_lines_are_verified_in_slices(spark, monkeypatch):
    """However few pairs are brought together at once, the same lines stay."""
    rng = random.Random(4)
    bases = [" ".join("".join(rng.choices("abcdef", k=rng.randint(2, 7))) for _ in range(rng.choice([4, 15, 40]))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(bases) + rng.choice("xyz") * rng.randint(0, 2) for _ in range(4))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(map(tuple, line_dedup.dedup(docs).collect()))
    monkeypatch.setattr(line_dedup, "SLICE", 15)
    names = []
    save = line_dedup.Scratch.save
    monkeypatch.setattr(line_dedup.Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    assert sorted(map(tuple, line_dedup.dedup(docs).collect())) == wanted and "verified1" in names


def test_keys_by_compiled_code(spark):
    """Counted keys are those that lines take: of one-letter words, of repeated ones, of runs, of other scripts."""
    rng = random.Random(12)
    rows = [" ".join("".join(rng.choices("abcé", k=rng.choice([1, 1, 2, 5, 9]))) for _ in range(rng.randint(10, 40))) for _ in range(60)]
    rows += ["x" * 90, "ab" * 40 + " c", "a b c d e f g h i j k l m n o p q r s t u v w", "short"]
    lines = spark.createDataFrame(list(enumerate(rows)), "cid long, norm string").withColumn("n", F.length("norm"))
    wanted = sorted(r["h"] for r in line_dedup.with_hashes(lines).select(F.explode("hashes").alias("h")).collect())
    assert sorted(r["h"] for r in line_dedup.hashed(lines).collect()) == wanted


def test_letters_part_lines_that_are_apart_only(spark):
    """No pair within the edits allowed is lost by letters; of pairs apart most go before their texts are brought together."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("etaoinshrdlucmwféß0", k=rng.randint(2, 8)))
    rows = []
    for _ in range(300):
        x = " ".join(word() for _ in range(rng.randint(1, 60)))
        own = list(x)
        for _ in range(rng.randint(0, len(x) // 8)):
            i, kind = rng.randrange(len(own) or 1), rng.randrange(3)
            own[i : i + (kind > 0)] = [rng.choice("eéz ")] if kind < 2 else []
        rows += [(x, "".join(own)), (x, "".join(reversed(" ".join(word() for _ in range(x.count(" ") + 1))))[: len(x)])]
    own = lambda c: F.struct(F.length(c).alias("n"), line_dedup.letters(c).alias("letters"))
    frame = spark.createDataFrame(rows, "a string, b string").withColumn("x", own("a")).withColumn("y", own("b"))
    found = frame.select(F.expr("10 * levenshtein(a, b) <= greatest(length(a), length(b))").alias("near"), F.expr(line_dedup.may_edit("x", "y")).alias("may")).collect()
    assert all(r["may"] for r in found if r["near"]) and sum(r["near"] for r in found) > 100
    assert sum(not r["may"] for r in found if not r["near"]) > 150


@pytest.mark.parametrize("few", [1, 8])
def test_crowded_keys_by_length(spark, monkeypatch, few):
    """A phrase that lines of many lengths share: its lines meet by length, also across the bounds of bins, and letters are asked first."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 0)
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("bcdfgklmpw", k=5))
    rows = []
    for k in range(8, 48):
        x = "these same words stand first " + " ".join(word() for _ in range(k))
        rows += [x, x + "a" * ((len(x) - 1) // 10)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = []
    save = line_dedup.Scratch.save
    monkeypatch.setattr(line_dedup.Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(docs).collect()}
    assert found == {i: i % 2 for i in range(len(rows))} and {"bins", "alike"} <= set(names)
