"""URL rules held in cascades of Bloom filters.

A rule is a host and a path prefix (``example.net/en/``). It fits its host and all
subdomains when the url's path starts with the rule's path; the longest fitting
rule wins. A url can only be matched by keys cut from it: a host suffix of as many
labels as some rule has, joined with a path prefix as long as some rule's path.
All such keys of the corpus are the key universe.

The first filter holds the listed keys, sized so that about as many unlisted keys
of the universe pass it as there are listed keys. The second holds those that
wrongly passed, the third the listed keys that pass the second, and so on until
no key is wrong. Over that universe membership is exact, and a url is judged by a
column expression, without a join. Filters hold about 1.44 x log2(universe /
listed) bits per listed key at the first level and 1.44 at the others, so what is
sent to tasks is bounded by the list, not by the corpus.

Defined results: a null url, or one without ``://``, has empty host and path, and
no rule; a path shorter than the rule's never fits it; repeated urls are judged
alike; an empty table or an empty list gives no rule. Urls of any length are cut
only at the listed lengths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import UPPER, stored, whole

MAX_LEVELS = 64


def _bits(key: Column, size: int, hashes: int, level: int) -> list[Column]:
    """The bits of a key in a filter of ``size`` bytes; every level hashes anew."""
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(8 * size)) for i in range(hashes)]


@dataclass(frozen=True)
class Filter:
    """A Bloom filter; its bytes are one literal of the expressions that use it."""

    table: bytes
    hashes: int
    level: int

    def holds(self, key: Column) -> Column:
        table = F.lit(bytearray(self.table))
        out = F.lit(True)
        for bit in _bits(key, len(self.table), self.hashes, self.level):
            place = (F.shiftright(bit, 3) + 1).cast("int")
            byte = F.conv(F.hex(F.substring(table, place, F.lit(1))), 16, 10).cast("bigint")
            out = out & (F.getbit(byte, (bit % 8).cast("int")) == 1)
        return out


def build_filter(keys: DataFrame, n: int, universe: int, level: int) -> Filter:
    """A filter over ``n`` keys. Its bytes are collected: their number follows ``n``, the length of the list."""
    rate = min(0.5, n / universe) if level == 1 else 0.5
    hashes = max(1, round(-math.log2(rate)))
    size = max(1, math.ceil(n * -math.log2(rate) / math.log(2) / 8))
    bits = keys.select(F.explode(F.array(*_bits(F.col("key"), size, hashes, level))).alias("bit"))
    set_bits = bits.groupBy(F.shiftright("bit", 3).alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("byte")
    )
    table = bytearray(size)
    for row in set_bits.collect():
        table[row["place"]] = row["byte"]
    return Filter(bytes(table), hashes, level)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Filter, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: decided by the first filter that lacks it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, size: int) -> Cascade:
    """Exact membership of ``listed`` (key) among ``universe`` (key, repeats allowed; about ``size`` distinct ones).

    The universe is only scanned through the first filter; all further levels
    work on sets about as long as the list.
    """
    inside = listed.select("key").distinct()
    count = inside.count()
    if not count:
        return Cascade(())
    levels = [build_filter(inside, count, max(size, 2 * count), 1)]
    passed = universe.select("key").filter(levels[0].holds(F.col("key"))).distinct()
    held, other = stored(passed.join(inside, "key", "left_anti"), "cascade-passed"), inside
    n = held.count()
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"{n} keys that {MAX_LEVELS} filters do not separate")
        level = build_filter(held, n, n, len(levels) + 1)
        levels.append(level)
        held, other = stored(other.filter(level.holds(F.col("key"))), "cascade-passed"), held
        n = held.count()
    return Cascade(tuple(levels))


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url."""
    text = whole(url)
    start = F.instr(text, "://")
    rest = F.when(start > 0, F.substring(text, start + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The (host labels, path length) pairs that occur in the list; there are few, whatever its length."""
    host = F.regexp_extract("rule", "^[^/]*", 0)
    shape = F.struct(F.size(F.split(host, "[.]")), F.char_length("rule") - F.char_length(host))
    return sorted(tuple(r[0]) for r in rules.select(shape.alias("shape")).distinct().collect())


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All keys of a url that a rule of the given shapes could equal."""
    table = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
    fits = F.filter(
        table, lambda s: (s["labels"] <= F.size(F.split(host, "[.]"))) & (s["chars"] <= F.char_length(path))
    )
    return F.transform(
        fits,
        lambda s: F.concat(
            F.array_join(F.slice(F.split(host, "[.]"), -s["labels"], s["labels"]), "."),
            F.substring(path, F.lit(1), s["chars"]),
        ),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every page: page_id, host, path, rule and verdict.

    ``rules`` has ``rule`` and ``verdict`` (``block`` or ``allow``); a rule listed
    as both blocks. Pages without a rule get ``default``.
    """
    host, path = host_and_path("url")
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = rule_shapes(rules)
    if not shapes:
        return split.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keyed = split.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    listed = rules.withColumnRenamed("rule", "key")
    block = build_cascade(listed.filter("verdict = 'block'"), universe, size)
    allow = build_cascade(listed.filter("verdict = 'allow'"), universe, size)
    fitting = F.filter("keys", lambda k: block.holds(k) | allow.holds(k))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"))))
    return keyed.withColumn("rule", longest["key"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNull(), F.lit(default))
        .when(block.holds(F.col("rule")), F.lit("block"))
        .otherwise(F.lit("allow"))
        .alias("verdict"),
    )
