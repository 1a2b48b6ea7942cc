"""URL filtering with a Bloom filter cascade, in DataFrame functions only.

Level 1 encodes the listed keys; level 2 the keys of the corpus that pass level 1 without being
listed; level 3 the listed keys that pass level 2; and so on until a level has nothing left to
encode. For every key of the universe the first level that rejects it tells whether it is listed,
exactly, with no join at lookup time. The universe is complete: every candidate key of every URL.

Sizes: level 1 takes about log2(universe / listed) * 1.44 bits per listed key, every later level
about 1.44 bits per listed key, so a cascade is bounded by the listed keys, not by the corpus; only
keys that pass level 1 are ever de-duplicated.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict; repeated rows are judged alike; an empty rule list gives the default everywhere;
a rule listed as both allow and block counts as block; extra columns of the input are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwise.llm.common import ascii_lower

#: Largest number of listed keys: a cascade then stays below about 10 MB, safe as a plan constant.
MAX_LISTED = 1_000_000
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    action: str   # "allow" or "block"
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    seed: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        """True where all probed bits are set."""
        arr = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = [F.getbit(F.element_at(arr, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
                for p in _probes(key, self.bits, self.probes, self.seed)]
        return reduce(lambda a, b: a & b, test)


def _probes(key: Column, bits: int, probes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 1000 + i)), F.lit(bits).cast("long")) for i in range(probes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Bloom filter of the distinct ``key`` column: bits are set and OR-ed by an aggregation."""
    bits = max(64, math.ceil(max(1, n) * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    probes = max(1, round(-math.log2(rate)))
    pos = keys.select(F.explode(F.array(*_probes(F.col("key"), bits, probes, seed))).alias("p"))
    rows = (pos.groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).collect())
    words = [0] * (bits // 64)
    for r in rows:                                  # at most bits / 64 rows: bounded by the listed keys
        words[r["w"]] = r["v"]
    return Level(bits, probes, seed, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact membership for every key of the universe the cascade was built over."""
        found: Column = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            found = F.when(~level.passes(key), F.lit(i % 2 == 1)).otherwise(found)
        return found


def build_cascade(listed: DataFrame, universe: DataFrame, max_listed: int = MAX_LISTED) -> Cascade:
    """Cascade of the ``key`` column of ``listed`` over the ``key`` column of ``universe``.

    Two passes over the universe: one estimates its distinct keys (it only sizes level 1), one
    gathers the distinct keys that pass level 1. Membership is told apart by an aggregation over
    the union, not by a join.
    """
    listed = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    n_listed = listed.count()
    if n_listed == 0:
        return Cascade(())
    if n_listed > max_listed:
        raise ValueError(f"{n_listed} listed keys; a cascade takes at most {max_listed}")
    n_all = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, math.sqrt(0.5) * n_listed / max(1, n_all - n_listed))
    levels = [_level(listed, n_listed, rate, 1)]
    passed = universe.select("key").filter(F.col("key").isNotNull() & levels[0].passes(F.col("key")))
    told = (listed.withColumn("is_listed", F.lit(1)).unionByName(passed.withColumn("is_listed", F.lit(0)))
            .groupBy("key").agg(F.max("is_listed").alias("is_listed")).checkpoint())
    side = 0                                        # next: the unlisted keys that pass so far
    while len(levels) < MAX_LEVELS:
        left = told.filter(F.col("is_listed") == side)
        for level in levels[1:]:                    # ``told`` already holds only keys that pass level 1
            left = left.filter(level.passes(F.col("key")))
        n = left.count()
        if n == 0:
            return Cascade(tuple(levels))
        levels.append(_level(left, n, 0.5, len(levels) + 1))
        side = 1 - side
    raise RuntimeError("the cascade did not close; the key hashes must be broken")


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased) and path (then up to
    ``?`` or ``#``); both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.greatest(F.char_length(url), F.lit(1)))
    known = F.coalesce(at > 0, F.lit(False))
    host = F.when(known, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every (host suffix, path prefix) of a URL that could be a rule: array of (key, length, host length).

    Suffixes end at label borders and have the label counts of some rule; prefixes have the length
    of some rule's path. So any rule that fits is among them, and their number depends on the rules only.
    """
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    n_labels = F.size(F.split(host, r"\."))
    out = []
    for k in labels:
        suffix = F.substring_index(host, ".", -k)
        for n in lengths:
            fits = (n_labels >= k) & (F.char_length(path) >= n) & (host != "")
            key = F.concat(suffix, F.substring(path, 1, n) if n else F.lit(""))
            out.append(F.when(fits, F.struct(key.alias("key"), F.char_length(key).alias("n"), F.char_length(suffix).alias("h"))))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row: the longest fitting rule wins (equal
    lengths: the longer host), else ``default``."""
    host, path = url_host_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    blocked = {r.key for r in rules if r.action == "block"}
    allowed = {r.key for r in rules if r.action == "allow"} - blocked
    if not blocked | allowed:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parsed.withColumn("__cand", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("__cand.key").alias("key"))
    spark = pages.sparkSession

    def keys_of(keys: set[str]) -> DataFrame:
        return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in sorted(keys)])).alias("key"))

    block = build_cascade(keys_of(blocked), universe) if blocked else Cascade(())
    allow = build_cascade(keys_of(allowed), universe) if allowed else Cascade(())
    # one row per (page, candidate) inside an array: judged in place, no join and no shuffle
    judged = F.transform("__cand", lambda c: F.struct(
        c["n"].alias("n"), c["h"].alias("h"), c["key"].alias("key"),
        F.when(block.contains(c["key"]), "block").when(allow.contains(c["key"]), "allow").alias("verdict")))
    best = F.array_max(F.filter(judged, lambda c: c["verdict"].isNotNull()))
    return (keyed.withColumn("__best", best)
            .select("page_id", "url", "host", "path", F.col("__best.key").alias("rule"),
                    F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict")))
