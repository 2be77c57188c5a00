"""URL filter: rules first, then a blocklist held in a Bloom filter cascade.

The first level of the cascade encodes the listed keys. Keys of the corpus that it
takes for listed by mistake are encoded in the second level, listed keys that the
second level takes for mistakes in the third, and so on until no key of the corpus
is judged wrongly. Over that key universe the answer is exact, and a page is judged
by looking at bits of a literal, without a join.

A level has at most ``MAX_BITS`` bits; a longer list is split by the hash of the key
into segments with a cascade each, and pages are judged segment by segment.

Everything is made of Spark expressions.

Defined results: a null url, or one without ``://``, has an empty host and path and
fits no rule. An empty list blocks nothing. Repeated pages are judged row by row;
other columns are not read.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut

MAX_BITS = 1 << 23
#: Bits of one row of ``bitmap_construct_agg``.
BITMAP = 4096 * 8
LATER_RATE = 0.5

#: verdict, host, path
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labels of a host that put it on the blocklist.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """Between the first ``://`` and the next slash, question mark or hash."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def fitting(rules: tuple[Rule, ...], of_host: Column, of_path: Column, wanted) -> Column:
    """``wanted(rule)`` of the longest rule that fits, null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in reversed(_longest_first(rules)):
        fits = ((of_host == rule[1]) | of_host.endswith("." + rule[1])) & of_path.startswith(rule[2])
        chosen = F.when(fits, F.lit(wanted(rule))).otherwise(chosen)
    return chosen


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    probes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether all probed bits are set."""
        return functools.reduce(lambda a, b: a & b, [self._bit(p) for p in _places(key, self.size, self.probes, self.seed)])

    def _bit(self, place: Column) -> Column:
        byte = F.substring(F.lit(self.bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.getbit(value, (place % 8).cast("int")) == 1


def _places(key: Column, size: int, probes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(size)) for i in range(probes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the n keys with about this rate of mistakes."""
    size = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    probes = max(1, round(math.log2(1 / rate)))
    place = F.explode(F.array(*_places(F.col("key"), size, probes, seed))).alias("place")
    maps = (
        keys.select(place)
        .groupBy(F.floor(F.col("place") / BITMAP).alias("number"))
        .agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits"))
        .collect()  # one row per 32,768 bits of a filter whose size is bounded
    )
    bits = bytearray(BITMAP // 8 * math.ceil(size / BITMAP))
    for row in maps:
        bits[row["number"] * (BITMAP // 8) : (row["number"] + 1) * (BITMAP // 8)] = row["bits"]
    return Level(bytes(bits[: size // 8 + 1]), size, probes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built from."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[number].holds(key), F.lit(number % 2 == 1)).otherwise(answer)
        return answer


def build(universe: DataFrame) -> Cascade:
    """``universe``: different keys, each with ``listed`` true or false."""
    n_listed, n_other = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    if n_listed == 0:
        return Cascade([])
    sides = [universe.filter("listed"), universe.filter(~F.col("listed"))]
    rate = min(LATER_RATE, max(2.0**-20, math.sqrt(0.5) * n_listed / max(n_other, 1)))
    levels: list[Level] = []
    n = n_listed
    while n:
        level = _level(sides[0], n, rate, len(levels) + 1)
        levels.append(level)
        # those of the other side that this level takes for its own
        sides = [sides[1].filter(level.holds(F.col("key"))), sides[0]]
        n, rate = sides[0].count(), LATER_RATE
    return Cascade(levels)


def segments(n_listed: int, n_other: int, max_bits: int = MAX_BITS) -> int:
    rate = min(LATER_RATE, max(2.0**-20, math.sqrt(0.5) * n_listed / max(n_other, 1)))
    return max(1, math.ceil(n_listed * math.log2(1 / rate) / math.log(2) / max_bits))


def judge(pages: DataFrame, universe: DataFrame, rules: tuple[Rule, ...] = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict. ``universe`` holds every host of the
    pages as ``key``, once, with whether it is ``listed``."""
    universe = cut(universe)
    n = segments(*universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first(), max_bits)
    read = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = []
    for number in range(n):
        within = lambda key, number=number: F.pmod(F.xxhash64(F.lit(0), key), F.lit(n)) == number
        cascade = build(universe if n == 1 else universe.filter(within(F.col("key"))))
        part = read if n == 1 else read.filter(within(F.col("host")))
        parts.append(
            part.withColumns(
                {
                    "rule": fitting(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]),
                    "ruled": fitting(rules, F.col("host"), F.col("path"), lambda r: r[0]),
                    "listed": cascade.listed(F.col("host")),
                }
            )
        )
    found = functools.reduce(DataFrame.unionByName, parts)
    verdict = F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def labelled_hosts(pages: DataFrame, labels: tuple[str, ...] = BLOCKED_LABELS) -> DataFrame:
    """All different hosts of the pages; those with a blocked label are listed."""
    hosts = pages.select(host(F.col("url")).alias("key")).distinct()
    return hosts.withColumn("listed", F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels))))
