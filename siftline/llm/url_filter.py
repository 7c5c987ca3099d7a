"""URL rules as Bloom filter cascades: exact membership without joins.

A rule is a host and a path prefix. Every url has a few candidate keys: its host's
suffixes of as many labels as some rule has, with its path's prefixes of as many
characters as some rule has. The distinct candidates of all urls, with the rules' own
keys, are the complete key universe. Level 1 of a cascade encodes the listed keys, level 2
the other keys of the universe that level 1 lets through, level 3 the listed keys that
level 2 lets through, and so on until nothing gets through: then the parity of the levels
that a key of the universe passes is its exact membership. Level 1's rate is set from the
ratio of listed keys to universe, so later levels are about as small as the list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bloom_hit, bloom_words, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the largest filter: 2**24 bits are 2 MB for each executor; a level that needs more is
#: split into several by a hash of the key, so no number of rules is too many
MOST_BITS = 24


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Level:
    """One level: as many filters of at most MOST_BITS bits as its keys need. A key is in
    the filter that its hash names; the bit positions come from other hashes."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        need = max(6, math.ceil(math.log2(max(1.0, 1.44 * n * math.log2(1 / rate)))))
        self.bits, self.parts = min(need, MOST_BITS), 1 << max(0, need - MOST_BITS)
        self.hashes, self.seed = max(1, min(16, round(0.69 * (self.parts << self.bits) / n))), seed
        self.words = [
            bloom_words(keys.where(self._part(F.col("key")) == i) if self.parts > 1 else keys, F.col("key"), self.bits, self.hashes, seed)
            for i in range(self.parts)
        ]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed * 64 + 63), key), F.lit(self.parts))

    def hit(self, key: Column) -> Column:
        hits = [bloom_hit(words, key, self.bits, self.hashes, self.seed) for words in self.words]
        out = hits[-1]
        for i, hit in enumerate(hits[:-1]):
            out = F.when(self._part(key) == i, hit).otherwise(out)
        return out


class Cascade:
    """Levels of filters over a key column; contains() is exact on the universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """listed, universe: one column ``key`` of distinct strings; listed is in universe."""
        self.levels: list[Level] = []
        n, u = listed.count(), max(universe.count(), 2)
        others = universe.join(listed, "key", "left_anti")
        ins, rate = (listed, others), max(min(0.5, math.sqrt(0.5) * n / u), 1e-9)
        while n:
            level = Level(ins[0], n, rate, len(self.levels) + 1)
            self.levels.append(level)
            wrong = cut(ins[1].where(level.hit(F.col("key"))), "cascade")
            ins, rate, n = (wrong, ins[0]), 0.5, wrong.count()

    def contains(self, key: Column) -> Column:
        """Odd numbers of passed levels are members."""
        member = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels))):
            # a key that stops at level k (from 0) passed k levels
            member = F.when(~level.hit(key), F.lit(k % 2 == 1)).otherwise(member)
        return member


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys that a rule for this url could have; the longer first is not needed."""
    keys = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in labels
        for n in lengths
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    rules: host, path, action (block or allow), any number. A rule fits its
    host and all subdomains where the url's path starts with the rule's; the longest rule
    wins, and of the same rule listed both ways block wins. A url of null or without
    ``://`` has an empty host and path. Urls that no rule fits get ``default`` and a null
    rule. Rows that repeat a page_id each give a row; an empty table gives none. Columns
    other than page_id and url are not read.
    """
    spark = pages.sparkSession
    rules = cut(
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("path"), "action").where("host is not null and path is not null"),
        "rules",
    )
    labels = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    own = rules.select(F.concat("host", "path").alias("key"), "action").distinct()
    universe = cut(urls.select(F.explode("keys").alias("key")).union(own.select("key")).distinct(), "universe")
    block = Cascade(own.where("action = 'block'").select("key").distinct(), universe)
    allow = Cascade(own.where("action = 'allow'").select("key").distinct(), universe)
    rated = F.transform(
        "keys",
        lambda k: F.struct(
            F.length(k).alias("length"), k.alias("key"), F.when(block.contains(k), "block").when(allow.contains(k), "allow").alias("action")
        ),
    )
    best = F.array_max(F.filter(rated, lambda r: r["action"].isNotNull()))
    return urls.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
