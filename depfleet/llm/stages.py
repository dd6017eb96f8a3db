"""Stages of the pipeline: each takes (spark, docs, sf_dir) and gives the documents that go on."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depfleet.staging import bounded_batches

from . import bpe, decontaminate, jaccard, quality, secret_scan
from .common import table


def apart(docs: DataFrame) -> DataFrame:
    """(__doc, text): the text once, and all other columns in a struct, whatever their names."""
    return docs.select(F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc"), "text")


def with_text(docs: DataFrame, new: Column, columns: list[str]) -> DataFrame:
    """The rows of ``apart`` as ``columns`` with the text ``new``, its length renewed where it changed."""
    changed = ~F.col("text").eqNullSafe(new)
    named = {c: F.col(f"__doc.`{c}`") for c in columns if c != "text"} | {"text": F.when(changed, new).otherwise(F.col("text"))}
    if "n_chars" in columns:
        named["n_chars"] = F.when(changed, F.length(new).cast("long")).otherwise(F.col("__doc.n_chars"))
    return docs.select(*[named[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents and, in the others, failing lines."""
    return with_text(quality.judge_quality(apart(docs)).where("kept"), F.col("cleaned"), docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.Rule(5, 80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a sign; the documents stay."""
    new = F.when(F.size("found") > 0, F.col("redacted")).otherwise(F.col("text"))
    return with_text(secret_scan.scan_secrets(apart(docs)), new, docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): packed identifiers, and whether decoding gives the text again."""
    coded = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def _bounded(apply):
    """A stage whose texts reach Python workers in batches of bounded size."""

    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return apply(spark, docs, sf_dir)

    return run


STAGES = [(name, _bounded(apply)) for name, apply in (
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", bpe_encoding),
)]
