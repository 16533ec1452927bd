"""URL filters: host and path rules, and a Bloom filter cascade for long host lists.

The cascade answers "is this key listed?" exactly for every key of a known universe, without
joining the list: level 0 is a Bloom filter of the listed keys, level 1 one of the unlisted keys
that pass level 0, level 2 one of the listed keys that pass level 1, and so on until no key is
answered wrongly.  A key is listed when the first level it fails has an odd number, or when it
passes all of an odd number of levels.

Keys are dealt into slices by hash; each slice has a small cascade of its own, so no filter
grows with the list.  While all slices fit in ``INLINE_BITS`` they enter the plan as one scalar
value; beyond that, rows meet the cascade of their slice by an equi-join on the slice number.

Everything is DataFrame expressions.  Edge cases: null and malformed URLs have an empty host and
path, match no rule and are allowed; an empty key is never listed; an empty list allows all;
repeated rows are judged one by one; columns of the input that clash with the results are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of one slice, on average; bounds the size of one cascade.
KEYS_PER_SLICE = 1 << 18
#: Bits of filters that may travel inside the plan (1 MB).
INLINE_BITS = 1 << 23
MAX_LEVELS = 64

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (the longer host on a tie) as ``struct(rule, verdict)``, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bit(key: Column, level: Column, i: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(key, level.cast("int"), i.cast("int")), bits)


def _passes(key: Column, level: Column) -> Column:
    """Whether ``key`` passes one level: ``struct(level, bits, hashes, words)``."""
    def hit(i):
        at = _bit(key, level["level"], i, level["bits"])
        word = F.get(level["words"], F.floor(at / 64).cast("int"))
        return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1
    return F.forall(F.sequence(F.lit(0), level["hashes"] - 1), hit)


def is_listed(key: Column, levels: Column) -> Column:
    """Membership of ``key`` by the cascade of its slice; ``levels`` null or empty: not listed."""
    def ask(levels: Column) -> Column:
        failed = F.filter(levels, lambda level: ~_passes(key, level))
        first = F.array_min(F.transform(failed, lambda level: level["level"]))
        return F.pmod(F.coalesce(first, F.size(levels)), F.lit(2)) == 1
    # the levels are named once, so that no row carries a copy of them
    return F.coalesce(F.get(F.transform(F.array(levels), ask), F.lit(0)), F.lit(False))


def _level(keys: DataFrame, number: int, hashes: Column, bits: Column) -> DataFrame:
    """One Bloom filter per slice: ``slice, level, bits, hashes, words``."""
    sizes = (
        keys.groupBy("slice").agg(F.count("*").alias("n"), F.max("pass_rate").alias("pass_rate"))
        .select("slice", hashes.cast("int").alias("hashes"), bits.cast("bigint").alias("bits")))
    marked = (
        keys.join(sizes, "slice")
        .select("slice", "bits", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("hashes") - 1),
            lambda i: _bit(F.col("key"), F.lit(number), i, F.col("bits")))).alias("at"))
        .select("slice", F.floor(F.col("at") / 64).cast("int").alias("word"),
                F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mask")))
    blank = sizes.select(
        "slice", F.explode(F.sequence(F.lit(0), F.ceil(F.col("bits") / 64).cast("int") - 1)).alias("word"),
        F.lit(0).cast("bigint").alias("mask"))
    words = (
        marked.union(blank).groupBy("slice", "word").agg(F.bit_or("mask").alias("mask"))
        .groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words")))
    return words.join(sizes, "slice").select(
        "slice", F.lit(number).alias("level"), "bits", "hashes",
        F.transform("words", lambda w: w["mask"]).alias("words"))


def build_cascade(universe: DataFrame, keys_per_slice: int = KEYS_PER_SLICE) -> tuple[DataFrame, int, int]:
    """``universe``: distinct ``(key, listed)``.  Returns the levels by slice, the slices and all bits.

    The first level lets about as many unlisted keys pass as there are listed ones; all later
    ones halve what is left, so the number of levels grows with the logarithm of the keys.
    """
    slices = max(1, math.ceil(universe.count() / keys_per_slice))
    keys = universe.select("key", "listed", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"))
    share = keys.groupBy("slice").agg(
        F.sum(F.col("listed").cast("int")).alias("yes"), F.sum((~F.col("listed")).cast("int")).alias("no"))
    share = share.select("slice", F.least(F.lit(0.5), F.col("yes") / F.greatest(F.col("no"), F.lit(1))).alias("pass_rate"))
    keys = materialise(keys.join(share, "slice"))
    levels, left, other, number = [], keys.where("listed"), keys.where("not listed"), 0
    while number < MAX_LEVELS and not left.isEmpty():
        hashes = F.greatest(F.lit(1), F.ceil(-F.log2("pass_rate"))) if number == 0 else F.lit(1)
        bits = F.ceil(F.col("n") * hashes / math.log(2)) + 64
        level = materialise(_level(left, number, hashes, bits))
        levels.append(level)
        struct = F.struct(F.lit(number).alias("level"), "bits", "hashes", "words")
        wrong = other.join(level, "slice").where(_passes(F.col("key"), struct)).select(other.columns)
        left, other, number = materialise(wrong), left, number + 1
    if not left.isEmpty():
        raise RuntimeError("the cascade has not ended: are keys repeated as listed and unlisted?")
    empty = keys.where(F.lit(False)).select(
        "slice", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("hashes"),
        F.array().cast("array<bigint>").alias("words"))
    table = materialise(
        reduce(DataFrame.union, levels, empty)
        .groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("level", "bits", "hashes", "words"))).alias("levels"),
                              F.sum("bits").alias("bits")))
    return table, slices, table.agg(F.coalesce(F.sum("bits"), F.lit(0))).first()[0]


def add_listed(rows: DataFrame, key: str, cascade: tuple[DataFrame, int, int], name: str = "listed",
               inline_bits: int = INLINE_BITS) -> DataFrame:
    """Add whether ``key`` is listed; no join while the filters are small."""
    table, slices, bits = cascade
    if slices == 1 and bits <= inline_bits:
        met = rows.withColumn("_levels", table.select("levels").scalar())
        return met.withColumn(name, is_listed(F.col(key), F.col("_levels"))).drop("_levels")
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(slices)).cast("int")
    met = rows.withColumn("_slice", at).join(
        table.select(F.col("slice").alias("_slice"), F.col("levels").alias("_levels")), "_slice", "left")
    return met.withColumn(name, is_listed(F.col(key), F.col("_levels"))).drop("_slice", "_levels")


def _universe(hosts: DataFrame, listed: Column | DataFrame) -> DataFrame:
    """``(key, listed)`` of every distinct host; each stands for itself alone, not for its subdomains."""
    keys = hosts.where("host <> ''").select(F.col("host").alias("key")).distinct()
    if isinstance(listed, Column):
        return keys.withColumn("host", F.col("key")).select("key", F.coalesce(listed, F.lit(False)).alias("listed"))
    names = listed.select(F.translate(F.col("host"), UPPER, LOWER).alias("key")).where("key is not null").distinct()
    return keys.join(names.withColumn("listed", F.lit(True)), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed"))


def judge_urls(pages: DataFrame, rules: list[Rule], listed: Column | DataFrame, key: str = "page_id", url: str = "url",
               keys_per_slice: int = KEYS_PER_SLICE, inline_bits: int = INLINE_BITS) -> DataFrame:
    """``(key, host, path, rule, verdict, listed)`` of every URL.

    The longest fitting rule decides; where none fits, listed hosts are blocked.  ``listed`` is an
    expression over ``host``, or a table of any length with a column ``host``; its A-Z are lower-cased, and nulls,
    repeated rows, other columns and hosts without pages have no effect.  The list is asked through the cascade, whose
    universe is every host of ``pages``; a table meets the distinct hosts once, when the cascade is built.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    universe = _universe(rows, listed)
    cascade = build_cascade(materialise(universe), keys_per_slice)
    found = add_listed(rows, "host", cascade, inline_bits=inline_bits)
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed") & (F.col("host") != ""), "block").otherwise("allow")
    return found.select(
        key, "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], by_list).alias("verdict"),
        (F.col("listed") & (F.col("host") != "")).alias("listed"))
