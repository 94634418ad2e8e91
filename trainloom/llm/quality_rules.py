"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes, and that of the common words of its language, are compared with
references: the same histograms summed over all documents of the language that pass the base rules. It is
rejected if its Jensen-Shannon distance (base 2, so 0 to 1) to the nearest language's reference is above a
limit. Histograms of short texts are noise: the limit rises with 1 / sqrt(words), and texts of under MIN_WORDS
words are left to the base rule.

Null and empty texts have no words and fail; very long ones are judged whole, in one task each. The declared language only sorts documents into references; a
null or unknown one adds to none and is judged by all. Rows with equal or null doc_ids are judged as they
stand; other columns are ignored, or kept by `keep`, whatever their names. An empty table gives no rows; with no
references, nothing is rejected for its distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainloom.llm.common import BLANK, Scratch, boxed, unboxed

MIN_WORDS = 50
#: Limits of the distances: the first, and what is added times 1 / sqrt(words).
CHAR_LIMIT, CHAR_NOISE, WORD_LIMIT, WORD_NOISE = 0.16, 0.9, 0.18, 2.0
#: Character classes; what is in none counts as "other". Each is a regular expression for a run.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": BLANK, "stop": r"[.,;:'()\x22\x2D]", "symbol": r"[#*$%&|<>!?=+/\\@^_~{}\[\]`]", "foreign": r"[^\x00-\x7F]"}
#: Common words of each language (fixed values).
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "he", "are", "this", "from"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec", "pas"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo"),
}
ALL_COMMON = sorted({w for words in COMMON.values() for w in words})


def barrier(x: Column) -> Column:
    """x, never copied into the expressions that use it: inside a lambda, a copy would run for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def features(docs: DataFrame) -> DataFrame:
    """docs with the base counts, `_classes` (array of counts) and `_common` (array of word and count)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", barrier(F.array_remove(F.split("_text", BLANK + "+"), "")))
    out = out.withColumn("_lines", barrier(F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit(BLANK.replace("[", "[^", 1))))))
    run = lambda kind: F.length("_text") - F.length(F.regexp_replace("_text", kind + "+", ""))
    counts = [run(x) for x in CLASSES.values()]
    out = out.withColumn("_some", barrier(F.array(*counts).cast("array<long>")))
    out = out.withColumn("_classes", barrier(F.concat("_some", F.array(F.length("_text").cast("long") - F.aggregate("_some", F.lit(0).cast("long"), lambda a, x: a + x)))))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length("_text").cast("long") - F.get("_some", 3))
    out = out.withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Hashes of the 3-word windows, those that occur twice, and the windows that have one of those.
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    none = F.array().cast("array<long>")
    out = out.withColumn("_windows", barrier(F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(none)))
    out = out.withColumn("_sorted", barrier(F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array("_windows")).otherwise(none)))
    out = out.withColumn("_twice", barrier(F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", i - 1))))))
    # The repeated hashes in buckets, so that a long text takes far less than windows times repeated hashes.
    out = out.withColumn("_n", barrier(F.greatest(F.lit(1), F.least(F.size("_twice") / 8, F.sqrt(F.size("_windows") / 20))).cast("int")))
    out = out.withColumn("_buckets", barrier(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda b: F.filter("_twice", lambda x: F.pmod(x, F.col("_n")) == b))))
    hit = lambda i: F.array_contains(F.get("_buckets", F.pmod(F.get("_windows", i), F.col("_n")).cast("int")), F.get("_windows", i))
    out = out.withColumn("_at", barrier(F.when(F.size("_twice") > 0, F.filter(F.sequence(F.lit(0), F.size("_windows") - 1), hit)).otherwise(F.array().cast("array<int>"))))
    covered = F.aggregate("_at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    out = out.withColumn("n_repeat_words", covered)
    plain = F.transform("_words", lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?#*$%&|]+$", "")))
    out = out.withColumn("_hits", barrier(F.filter(plain, lambda w: w.isin(ALL_COMMON))))
    out = out.withColumn("_kinds", barrier(F.array_distinct("_hits")))
    out = out.withColumn("_common", barrier(F.transform("_kinds", lambda w: F.struct(w.alias("word"), (F.size("_hits") - F.size(F.array_remove("_hits", w))).cast("long").alias("n")))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_text", "_words", "_lines", "_some", "_windows", "_sorted", "_twice", "_n", "_buckets", "_at", "_hits", "_kinds")


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def references(counted: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """For each language of COMMON, shares of the character classes and of its common words, over all documents that pass the base rules.

    One row a language comes to the driver, as COMMON fixes.
    """
    good = counted.where(~F.col("base_failed")).where(F.col("lang").isin(*COMMON))
    classes = good.groupBy("lang").agg(F.sum("n_words").alias("words"), *[F.sum(F.get("_classes", i)).alias(f"c{i}") for i in range(len(CLASSES) + 1)])
    words = good.select("lang", F.explode("_common").alias("w")).groupBy("lang", "w.word").agg(F.sum("w.n").alias("n"))
    found = {r["lang"]: (r["words"], [r[f"c{i}"] for i in range(len(CLASSES) + 1)], {}) for r in classes.collect()}
    for r in words.collect():
        if r["word"] in COMMON[r["lang"]]:
            found[r["lang"]][2][r["word"]] = r["n"] / found[r["lang"]][0]
    return {lang: ([x / max(1, sum(c)) for x in c], w) for lang, (_, c, w) in sorted(found.items())}


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a document's shares and reference shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def judged(counted: DataFrame, known: dict) -> DataFrame:
    """counted with char_distance and word_distance to the nearest reference, and kept."""
    if not known:
        return counted.withColumns({"char_distance": F.lit(0.0), "word_distance": F.lit(0.0)}).withColumn("kept", ~F.col("base_failed"))
    total = F.greatest(F.lit(1.0), F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x))
    n = F.greatest(F.lit(1.0), F.col("n_words").cast("double"))
    out = counted.withColumn("_total", barrier(total)).withColumn("_count", barrier(F.map_from_entries("_common")))
    out = out.withColumn("_chars", barrier(F.transform("_classes", lambda x: x / F.col("_total"))))
    chars, words = [], []
    for lang, (reference, shares) in known.items():
        own = F.transform(F.array(*map(F.lit, COMMON[lang])), lambda w: F.coalesce(F.element_at("_count", w), F.lit(0)) / n)
        out = out.withColumn(f"_own_{lang}", barrier(own))
        rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(f"_own_{lang}", F.lit(0.0), lambda a, x: a + x))
        found = [shares.get(w, 0.0) for w in COMMON[lang]]
        chars.append(distance(F.col("_chars"), reference))
        words.append(distance(F.concat(f"_own_{lang}", F.array(rest)), [*found, max(0.0, 1 - sum(found))]))
    nearest = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    out = out.withColumn("char_distance", barrier(nearest(chars))).withColumn("word_distance", barrier(nearest(words)))
    noise = 1 / F.sqrt(n)
    far = (F.col("char_distance") > CHAR_LIMIT + CHAR_NOISE * noise) | (F.col("word_distance") > WORD_LIMIT + WORD_NOISE * noise)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("_total", "_count", "_chars", *[f"_own_{x}" for x in known])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance, kept for each row; texts are read once."""
    scratch = Scratch(docs.sparkSession, "rules")
    counted = scratch.save(features(docs.select("doc_id", "text", "lang")).drop("text"), "counted")
    return judged(counted, references(counted)).drop("lang", "_classes", "_common")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; texts are read twice, but move nowhere."""
    known = references(features(docs.select("text", "lang")))
    return unboxed(judged(features(boxed(docs).select("_doc", "_doc.text", "_doc.lang")), known).where("kept"))
