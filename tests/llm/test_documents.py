import math
import os
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ROWS
from trainloom.llm import html_text, license_scan, quality_model, quality_rules, url_filter


def base(text):
    text = text or ""
    words = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [r[1] for r in ROWS] + ["x y z x y z w # $|<\nq\nq\n q", " ".join(str(i % 97) for i in range(4000)), " ".join(str(i * i) for i in range(500))]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    for r in quality_rules.judge(docs).collect():
        want = base(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_reject_what_diverges(spark):
    rng = np.random.default_rng(1)
    words = [*quality_rules.COMMON["en"], *("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))]
    clean = [" ".join(rng.choice(words, 120)) for _ in range(60)]
    junk = [x.upper().replace(" ", "!! ") for x in clean[:3]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.keep(docs).collect()}
    assert kept == set(range(60))


def shannon(p, q):
    """Jensen-Shannon distance, base 2."""
    part = lambda x, m: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (part(p, m) + part(q, m)) / 2))


def brute_shares(text):
    """Shares of the character classes, and counts of the common words."""
    text = text or ""
    counts = [len(re.findall(x, text)) for x in quality_rules.CLASSES.values()]
    counts.append(len(text) - sum(counts))
    words = [re.sub(r"[.,;:!?#*$%&|]+$", "", w).lower() for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return counts, len(words), Counter(w for w in words if w in quality_rules.ALL_COMMON)


def test_distances_against_brute_force(spark):
    rng = random.Random(2)
    some = {x: [*c, *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(80))] for x, c in quality_rules.COMMON.items()}
    rows = []
    for i in range(80):
        lang = rng.choice([*some, "xx"])
        words = rng.choices(some.get(lang, some["en"]), k=rng.randint(10, 300))
        text = " ".join(w.upper() + "!?" if rng.random() < (i % 8) / 8 else w for w in words)
        rows.append((i, text, lang))
    rows += [(100 + i, t, "en") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = [(t, x) for _, t, x in rows if x in quality_rules.COMMON and base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0]]
    known = {}
    for lang, common in quality_rules.COMMON.items():
        own = [brute_shares(t) for t, x in good if x == lang]
        if own:
            chars, n = [sum(c) for c in zip(*[o[0] for o in own], strict=True)], sum(o[1] for o in own)
            shares = [sum(o[2][w] for o in own) / n for w in common]
            known[lang] = [c / sum(chars) for c in chars], [*shares, 1 - sum(shares)]
    for r in quality_rules.judge(docs).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        (chars, n, count), size = brute_shares(text), max(1, len(text or ""))
        far = min(shannon([c / size for c in chars], known[x][0]) for x in known)
        words = [[count[w] / max(1, n) for w in quality_rules.COMMON[x]] for x in known]
        apart = min(shannon([*o, max(0.0, 1 - sum(o))], known[x][1]) for x, o in zip(known, words, strict=True))
        assert (r["char_distance"], r["word_distance"]) == pytest.approx((far, apart), abs=1e-9)
        noise = 1 / math.sqrt(max(1, n))
        rejected = far > quality_rules.CHAR_LIMIT + quality_rules.CHAR_NOISE * noise or apart > quality_rules.WORD_LIMIT + quality_rules.WORD_NOISE * noise
        assert r["kept"] == (not r["base_failed"] and not rejected)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_classifier_on_held_out_rows(spark):
    from trainloom.llm import queries

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in queries.op1_quality_model(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(held) > 40 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_rules_edges(docs, odd, empty):
    assert quality_rules.judge(docs).count() == len(ROWS) and quality_rules.judge(empty).count() == 0
    assert quality_rules.keep(odd).columns == odd.columns and quality_rules.keep(empty).count() == 0


def test_classifier_learns(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(rng.integers(20, 200))) + "." for _ in range(120)]
    bad = [" ".join([word()] * int(rng.integers(20, 200))) for _ in range(60)] + [" ".join(word() + "$$$" for _ in range(50)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    found = quality_model.judge(docs, labels).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == 240 and held and all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 120) for r in held]) > 0.95


def test_scores_match_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(200, quality_model.N_FEATURES)) * (1 + k) + k for k in (0, 1)]
    model = quality_model.solve({k: (200.0, v.sum(axis=0), v.T @ v) for k, v in enumerate(x)})
    z = (x[0][:5] - model.centre) / model.scale
    logs = []
    for mean, inverse, _, prior in model.classes:
        cov = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
        logs.append((-0.5 * np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean) - 0.5 * np.linalg.slogdet(cov)[1], prior))
    odds = (logs[1][0] - logs[0][0]) / quality_model.TEMPERATURE + logs[1][1] - logs[0][1]
    assert np.allclose(model.scores(x[0][:5]), 1 / (1 + np.exp(-odds)))


def test_classifier_edges(spark, docs, odd, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (77, None), (99, 1)], "doc_id long, quality int")
    found = quality_model.judge(docs, labels).collect()
    assert len(found) == len(ROWS) and len({r["score"] for r in found}) == 1
    assert quality_model.judge(empty, labels).count() == 0
    assert quality_model.keep(odd, labels).columns == odd.columns


PAGES = [
    ("<html><nav>menu</nav><article><h1>T &amp; x</h1><p>one<b>two</b>  three\n four<br><p>Te.</article><footer>f</footer>", "T & x onetwo three four Te."),
    ('<body><div class="ad">buy</div><div><h1>Head</h1><p>A long enough paragraph of text stands here.</p><p>And one more that is long enough too.</p></div><div id="comments"><p>I like it, a long comment indeed.</p></div>', "Head A long enough paragraph of text stands here. And one more that is long enough too."),
    ("<article><p>text</p><script>var t='</p>';</script><style>p{}</style><form><button>go</button></form></article>", "text"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
    ("plain words", "plain words"),
    ("<p>a<p>b</div></span>c", "a bc"),
    ("<article><p>x</p><!-- c --><![if y]>z<p>w&nbsp;v</p>", "x z w v"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


PROSE = "A sentence of ordinary length that stands here as content of the page."


def test_index_of_equal_articles():
    texts = [f"{PROSE} Number {i}." for i in range(10, 22)]
    assert html_text.main_text("<body>" + "".join(f"<article><p>{x}</p></article>" for x in texts) + "</body>") == " ".join(texts)


def test_index_of_unequal_articles():
    texts = [PROSE * 6] + [f"{PROSE} {PROSE} Number {i}." for i in range(10, 22)]
    text = html_text.main_text("<body>" + "".join(f"<article><p>{x}</p></article>" for x in texts) + "</body>")
    assert all(x in text for x in texts)


def test_article_beside_longer_text():
    rest = " ".join(f"{PROSE} Part {i}." for i in range(20))
    text = html_text.main_text(f"<body><div><p>{rest}</p><p>{rest}</p></div><article><p>{PROSE}</p></article></body>")
    assert f"{rest} {rest}" in text and text.endswith(PROSE)


@pytest.mark.parametrize("broken", ["<![foo[b]]>", "<![ x]>", "<![]>", "<![foo"])
def test_reading_goes_on_after_a_broken_declaration(broken):
    text = html_text.main_text(f"a{broken}<p>{PROSE}</p><p>d")
    assert text.startswith("a") and text.endswith(f"{PROSE} d" if broken.endswith(">") else "d")


@pytest.mark.parametrize("broken", ["<!--", "<!-- x <b>y</b>", "<?", "</div", "<div class='x", "<!doctype", "<![if", "</", "<a<b<c "])
def test_no_markup_of_what_never_ends(broken):
    text = html_text.main_text(f"<article><p>real text here</p>{broken * 3}")
    assert text.startswith("real text here") and "!--" not in text and "div" not in text and "<a" not in text and "doctype" not in text


@pytest.mark.parametrize("page", ["<div>some text " * 50_000, "<!--" * 250_000, "<div class=x " * 80_000, "<p>a</div>" * 60_000, "<div><span>" * 30_000 + "</i></b></span>" * 30_000, "<?" * 300_000, "</x" * 300_000, "<div>" * 30_000 + "</table>" * 30_000])
def test_time_grows_with_the_page(page):
    """Deep, broken and long pages of up to 1 MB in seconds."""
    start = time.process_time()
    html_text.main_text(f"<article><p>{PROSE}</p></article>{page}")
    assert time.process_time() - start < 20


def brute_region(sizes, tags, sigma=1.0):
    """Ratio, Gaussian smoothing over two standard deviations and threshold, as loops: which lines are content."""
    ratio = [a / b for a, b in zip(sizes, tags, strict=True)]
    kernel = {k: math.exp(-k * k / (2 * sigma**2)) for k in range(-2, 3)}
    smooth = [sum(w * (ratio[i + k] if 0 <= i + k < len(ratio) else 0) for k, w in kernel.items()) / sum(kernel.values()) for i in range(len(ratio))]
    mean = sum(smooth) / len(smooth)
    limit = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return [x > limit for x in smooth]


@pytest.mark.parametrize("seed", range(5))
def test_regions_against_brute_force(seed):
    """Of flat pages without articles, what stands between the first and last content line is text: each line is an element of its own block."""
    rng = random.Random(seed)
    short = [rng.randint(1, 8) for _ in range(rng.randint(0, 12))], [rng.randint(1, 8) for _ in range(rng.randint(0, 12))]
    sizes = [*short[0], *[rng.randint(120, 300) for _ in range(rng.randint(2, 6))], *short[1]]
    lines = [("w" * 6 + " ") * (n // 7) + "x" * (n % 7 or 1) for n in sizes]
    lines = [" ".join(x.split()) for x in lines]
    region = brute_region([len(x) for x in lines], [2] * len(lines))
    reader = html_text.Reader()
    reader.feed("".join(f"<p>{x}</p>" for x in lines))
    reader.close()
    got = [(x, t) for x in reader.lines if (t := " ".join("".join(x.parts).split()))]
    assert [t for _, t in got] == lines
    ratios = html_text.smooth([len(t) / x.tags for x, t in got])
    found = [r > html_text.pstdev(ratios) for r in ratios]
    want = brute_region([len(t) for _, t in got], [x.tags for x, _ in got])
    assert found == want and any(region)
    inner = len(short[0]), len(lines) - len(short[1])
    page = "".join(f"<p>{x}</p>" for x in lines[: inner[0]]) + "<div>" + "".join(f"<p>{x}</p>" for x in lines[inner[0] : inner[1]]) + "</div>" + "".join(f"<p>{x}</p>" for x in lines[inner[1] :])
    content = [i for i, x in enumerate(want) if x]
    text = html_text.main_text(page)
    assert all(lines[i] in text for i in content)


def test_pages(spark):
    rows = [(i, None if i else "u", h) for i, (h, _) in enumerate(PAGES)] + [(None, "u", "<" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract(pages).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_licenses(spark):
    texts = ["MIT License.\nReleased under the MIT License.", "the general  public\nlicense; mit-license MIT License MIT License", None, "", "Licensed under the Apache License, Version 2.0.", "this is Licensed under terms", "all x rights y reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.report(docs).collect()}
    assert (found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["base_labels"]) == (2, 0, 5, "mit")
    assert (found[1]["n_words"], found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (10, 4, 1, 8, "gpl,mit")
    for i in (2, 3):
        assert (found[i]["n_words"], found[i]["n_base"], found[i]["first_word"], found[i]["labels"], found[i]["score"]) == (0, 0, None, "", 0.0)
    assert "apache" in found[4]["labels"] and found[5]["labels"] == "" and found[6]["labels"] == "reserved"


def brute_containment(text, template, span):
    """The largest share of the template's distinct words in any run of span times as many words."""
    own, want, length = [x for x in re.split(license_scan.APART, "".join(c.lower() if c.isascii() else c for c in text)) if x], set(template.split()), span * len(template.split())
    return max((len(want & set(own[i : i + length])) for i in range(len(own))), default=0) / len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_against_brute_force(spark, seed):
    """Random templates over few words, so that blocks hold any share of them; lines are cut at random places."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    templates = tuple((f"t{i}", " ".join(rng.choices(words, k=rng.randint(2, 12)))) for i in range(6))
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", ", "]) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    texts += [" ".join(x for x in t.split() if rng.random() > 0.1) for _, t in templates]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(docs, templates).collect():
        shares = {label: brute_containment(texts[r["doc_id"]], t, license_scan.SPAN) for label, t in templates}
        want = {k: x for k, x in shares.items() if x >= license_scan.THRESHOLD}
        assert {m["label"]: m["containment"] for m in r["matches"]} == want and r["score"] == max(want.values(), default=0)


def test_scattered_words_are_no_license(spark):
    rng = random.Random(1)
    line = [*(f"x{i}" for i in range(3000)), *"licensed under cc by nc all rights reserved released the mit".split()]
    rng.shuffle(line)
    found = license_scan.report(spark.createDataFrame([(1, " ".join(line))], "doc_id long, text string")).first()
    assert (found["labels"], found["score"]) == ("", 0.0)


def test_wrapped_licenses(spark):
    """Every template, wrapped at 30 columns with comment marks, has its label; so has the usual BSD header; scattered words have none."""
    wrapped = [(label, "x y\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 30)) + "\nz") for label, t in license_scan.TEMPLATES]
    bsd = "Copyright\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    apart = "\n".join(w + " filler" * 30 for w in license_scan.TEMPLATES[7][1].split())
    texts = [t for _, t in wrapped] + [bsd, apart]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, (label, _) in enumerate(wrapped):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1
    n = len(wrapped)
    assert (found[n]["labels"], found[n]["score"], found[n]["matches"][0]["line"]) == ("bsd", 1.0, 2)
    assert (found[n + 1]["labels"], found[n + 1]["score"]) == ("", 0.0)


def test_license_edges(docs, odd, empty):
    assert license_scan.report(docs).count() == len(ROWS) == license_scan.report(odd).count() and license_scan.report(empty).count() == 0


def test_urls(spark):
    urls = ["http://a.Example.com/en/7x?q", "http://example.com/en/8", "https://NET/de/", "ftp://x.example.net/de/88#t", "http://b.org/es/", "http://casino-win.example.org/x", "http://fine.example.org/x", None, "no scheme", "http://", "x://h?p=/en/", "a://com/en"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert found[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert found[1] == ("example.com", "/en/8", "com/en/", "block")
    assert found[2] == ("net", "/de/", "net/de/", "allow")
    assert found[3] == ("x.example.net", "/de/88", "example.net/de/8", "block")
    assert found[4] == ("b.org", "/es/", "org/es/", "block")
    assert found[5][2:] == (None, "block") and found[6][2:] == (None, "allow")
    for i in (7, 8, 9):
        assert found[i] == ("", "", None, "allow")
    assert found[10] == ("h", "", None, "allow") and found[11] == ("com", "/en", None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_long_list(spark):
    """20,000 listed keys of 60,000: exact, and the filters' words stand in the plan once."""
    from pyspark.sql import functions as F

    universe = spark.range(60_000).select(F.concat(F.lit("host"), "id", F.lit(".example/")).alias("key"), "id")
    cascade = url_filter.Cascade.build(universe.where("id % 3 = 0").select("key"), universe.select("key"))
    assert universe.where(cascade.has(F.col("key")) != (F.col("id") % 3 == 0)).count() == 0
    assert sum(len(x.words) for x in cascade.levels) * 64 < 20_000 * (1.5 * np.log2(3) + 12)


def test_odd_pages(spark):
    """Repeated rows, null ids, a very long url, clashing columns."""
    long = "http://a.example.com/en/" + "x" * 200_000
    rows = [(1, "http://com/en/", 1), (1, "http://com/en/", 1), (None, "http://b.com/en/7", None), (2, long, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host long").withColumn("rule", spark_null()).withColumn("keys", spark_null())
    found = sorted(repr((r["page_id"], r["host"], len(r["path"]), r["rule"], r["verdict"])) for r in url_filter.judge(pages).collect())
    assert found == sorted(map(repr, [(1, "com", 4, "com/en/", "block"), (1, "com", 4, "com/en/", "block"), (None, "b.com", 5, "com/en/", "block"), (2, "a.example.com", 200_004, "com/en/", "block")]))


def spark_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(200)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "key string")
    from pyspark.sql import functions as F

    cascade = url_filter.Cascade.build(listed, universe)
    found = {r["key"] for r in universe.where(cascade.has(F.col("key"))).collect()}
    assert found == {f"k{i}" for i in range(200)} and len(cascade.levels) > 1
    assert sum(len(x.words) for x in cascade.levels) * 64 < 200 * (1.5 * np.log2(25) + 12)
