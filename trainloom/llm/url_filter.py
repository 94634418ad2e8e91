"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

Level 1 encodes the listed keys. Over the corpus's complete universe of keys it has false positives, which
level 2 encodes; of the listed keys some are false positives of level 2, which level 3 encodes; and so on until
none are left. A key of the universe is listed if the first level that lacks it has an even number. So
membership is exact for every key of the universe, and testing a key needs the levels' bits only, no join.

Level 1 takes a false positive rate of about listed / universe, further levels a half, so all levels together
take some 1.5 * log2(universe / listed) + 6 bits a listed key: the size is bound by the list, which may have
MOST_LISTED keys, and not by the corpus. A longer list raises an error; it is to be cut by host then.

Keys of a url are its host and each parent domain, alone and with each prefix of the path that is as long as
some listed path. Null urls, and those without "://", have an empty host and path, match no rule and get the
default verdict. Repeated urls and page_ids are judged as they stand, very long urls whole; of rules of equal length that
fit, one host's is the other's, so there is no tie. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainloom.llm.common import Scratch

MOST_LISTED, MOST_LEVELS = 1_000_000, 64
#: The rules of the contract: verdict, then host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Host words (between dots and hyphens) that the method blocks, where no rule decides: gambling, pills, adverts and the like.
BAD_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "jackpot", "pills", "poker", "porn", "spam", "torrent", "viagra", "warez", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?" or "#"."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


@dataclass(frozen=True)
class Level:
    """A Bloom filter: n bits in words of 64, tested at k places that depend on the level's number."""

    number: int
    k: int
    words: tuple[int, ...]

    @staticmethod
    def places(key: Column, number: int, k: int, n: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(n)) for j in range(k)]

    @classmethod
    def of(cls, keys: DataFrame, count: int, number: int, rate: float) -> Level:
        k = max(1, round(-math.log2(rate)))
        n = 64 * math.ceil(max(1, count) * k / math.log(2) / 64)
        spots = keys.select(F.explode(F.array(*cls.places(F.col("key"), number, k, n))).alias("p"))
        # Its rows are the filter's words, whose number the list bounds.
        set_bits = spots.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()
        found = {r["w"]: r["bits"] for r in set_bits}
        return cls(number, k, tuple(found.get(i, 0) for i in range(n // 64)))

    def has(self, key: Column) -> Column:
        """Whether all the key's bits are set; the words stand in the plan once."""
        words = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        return F.forall(F.array(*self.places(key, self.number, self.k, 64 * len(self.words))), lambda p: F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """Both are frames of one column, key; the universe may repeat keys and have listed ones."""
        scratch = Scratch(listed.sparkSession, "cascade")
        ours = scratch.save(listed.select(F.col("key").cast("string")).where("key is not null").distinct(), "listed")
        n = ours.count()
        if n > MOST_LISTED:
            raise ValueError(f"{n} listed keys; a cascade holds {MOST_LISTED}")
        keys = universe.select("key").where("key is not null")
        everything = keys.agg(F.approx_count_distinct("key")).first()[0]
        levels = [Level.of(ours, n, 1, min(0.5, max(n, 1) / max(1, everything)))]
        theirs = scratch.save(keys.where(levels[0].has(F.col("key"))).distinct().join(ours, "key", "left_anti"), "false1")
        while left := theirs.count():
            if len(levels) >= MOST_LEVELS:
                raise ValueError("two keys agree in all hashes")
            number = len(levels) + 1
            levels.append(Level.of(theirs, left, number, 0.5))
            ours, theirs = theirs, scratch.save(ours.where(levels[-1].has(F.col("key"))), f"false{number}")
        scratch.drop()
        return cls(tuple(levels))

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def rule_key(start: Column, end: Column) -> Column:
    return F.concat(F.lit("rule|"), end, start)


def keys_of(host: Column, path: Column, hosts: int, lengths: list[int]) -> Column:
    """Keys of a url: "rule|" with up to so many last labels of the host and a prefix of the path, "word|" with each word of the host."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (hosts - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(hosts)), "."))
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    rules = [F.when(start.isNotNull(), F.transform(ends, partial(rule_key, start))).otherwise(F.array().cast("array<string>")) for start in starts]
    words = F.transform(F.array_distinct(F.split(host, "[.-]")), lambda w: F.concat(F.lit("word|"), w))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(*rules, words))


def judge(pages: DataFrame, rules: tuple = RULES, words: tuple = BAD_WORDS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict: the rule's, else block if a word of the host is listed, else default."""
    spark = pages.sparkSession
    split = {rule: (rule.partition("/")[0], "/" + rule.partition("/")[2]) for _, rule in rules}
    hosts, lengths = max(h.count(".") + 1 for h, _ in split.values()), sorted({len(p) for _, p in split.values()})
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), hosts, lengths))
    universe = urls.select(F.explode("keys").alias("key"))
    blocked = {rule for verdict, rule in rules if verdict == "block"}
    listed = spark.createDataFrame([(f"rule|{rule}",) for _, rule in rules] + [(f"word|{w}",) for w in words], "key string")
    blocks = spark.createDataFrame([(f"rule|{rule}",) for rule in sorted(blocked)] or [(None,)], "key string")
    known, bad = Cascade.build(listed, universe), Cascade.build(blocks, listed)
    hits = F.filter("keys", lambda k: known.has(k))
    fits = F.array_sort(F.transform(F.filter("hits", lambda k: F.startswith(k, F.lit("rule|"))), lambda k: F.struct(-F.length(k), F.substring(k, 6, 1 << 30).alias("rule"))))
    rule = F.get(fits, 0)["rule"]
    verdict = F.when(F.col("rule").isNotNull(), F.when(bad.has(F.concat(F.lit("rule|"), F.col("rule"))), "block").otherwise("allow")).when(F.exists("hits", lambda k: F.startswith(k, F.lit("word|"))), "block").otherwise(default)
    return urls.withColumn("hits", hits).withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
