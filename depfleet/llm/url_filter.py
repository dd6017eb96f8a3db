"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join.

Listed are rules, a host with a path prefix that hold for the host and all its subdomains, and canonical URLs to block.
Each distinct URL asks for its canonical form and for the host suffixes and path prefixes that rules can have; what the
filter lets pass is joined exactly, which removes false positives.  The longest fitting rule decides; without one a
listed canonical URL is blocked and any other allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; equal rows
give equal rows; of two rules with the same host and path the one that blocks wins; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depfleet.staging import stage

from . import bloom
from .common import ascii_lower

PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without trailing slashes or ``.html``; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)+$", ""))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, col: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules``: host, path, verdict.  ``listed``: canonical, one column of blocked canonical URLs.
    """
    keys = stage(rules.select(F.concat(F.lit("r:"), F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"),
                              "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"))
                 .unionByName(listed.select(F.concat(F.lit("c:"), F.col("canonical")).alias("key"), F.lit(None).cast("string").alias("rule"),
                                            F.lit("block").alias("verdict"), F.lit(0).alias("labels"), F.lit(0).alias("size")))
                 .where("key IS NOT NULL").groupBy("key", "rule", "labels", "size").agg(F.max("verdict").alias("verdict")))
    # shapes of rules: at most one per number of labels and length of path, both bounded by what a URL can be
    shapes = [(r[0], r[1]) for r in keys.df.where("rule IS NOT NULL").select("labels", "size").distinct().sort("labels", "size").collect()]

    url = F.col("__url")
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("__row"),
                       F.col(f"`{col}`").alias("__url")).select("__row", host_of(url).alias("__host"), path_of(url).alias("__path"))
    urls = out.select("__host", "__path").distinct()  # a URL on very many rows asks once
    asks = [F.concat(F.lit("c:"), canonical(F.col("__host"), F.col("__path")))]
    for labels, size in shapes:
        asks.append(F.when(F.length("__path") >= size, F.concat(
            F.lit("r:"), F.substring_index("__host", ".", -labels), F.substring(F.col("__path"), 1, size))))
    asked = urls.where("__host <> ''").select("__host", "__path", F.explode(F.array_compact(F.array_distinct(F.array(*asks)))).alias("key"))

    blocks = bloom.block_count(keys.rows)
    possible = bloom.may_hold(asked, F.col("key"), bloom.build(keys.df, F.col("key"), blocks), blocks)
    best = (possible.join(keys.df.hint("shuffle_hash"), "key").groupBy("__host", "__path")
            .agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("__best"), F.count(F.lit(1)).alias("__hits")))
    judged = out.join(best, ["__host", "__path"], "left")
    fits = F.col("__best.rule").isNotNull()
    return judged.select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"),
                         F.when(fits, F.col("__best.verdict")).when(F.col("__hits") > 0, "block").otherwise("allow").alias("verdict"))


def on_labels(host: Column, labels: tuple[str, ...]) -> Column:
    """Whether a host has one of these labels."""
    return reduce(Column.__or__, [F.array_contains(F.split(host, r"\."), x) for x in labels])
