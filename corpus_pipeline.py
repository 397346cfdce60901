"""Corpus pipeline: language identification, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir).  ``run`` writes what a stage keeps as Parquet in
the folder that ``spark.checkpoint.dir`` names, and the next stage reads it again.  All stages but the
last return the columns of ``documents``; the last returns the pieces of packed sequences.

Defined results: the first stage drops null texts and texts without a letter, so later stages see none
of them; rows with a null doc_id are learned from by language (as fold of the empty text) but not by
toxicity; repeated rows are treated alike until the near-duplicates, where one of them stays; columns of any
other name pass through unchanged, also those named as a result of an operator (names that begin
with two underscores are the stages' own); an empty table passes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, language_id, near_duplicates, packing, toxicity
from claimlens.llm.common import by_ids, fold, materialise
from claimlens.session import small
from claimlens.sources.tables import table

#: SQL cannot express the trained stages; tests compare what ``run`` keeps and packs with brute-force versions of the others.
ORACLE_SQL = None


#: Deviations below its language's training mean at which a text's evidence a byte is no longer that language.
FAR = 20.0


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts of a learned language.  Learns from the texts and languages of three quarters of the rows.

    Rejected are null and letterless texts, texts whose best language has a posterior under one half, and texts whose
    log-probability a byte (words with digits left out) under their best language lies more than ``FAR`` deviations under the mean of the
    training rows of that language (letter noise, languages never learned).
    """
    held = fold(F.col("doc_id"), 4) == 2
    scored = language_id.identify(docs, docs.filter(~held), public_tokenizers.path("piece_bpe_32k.model"), carry=tuple(F.col(c) for c in docs.columns),
                                  language_column="__lang_pred", score_column="__lang_score", evidence_column="__lang_evidence")
    scored = materialise(scored, "pipeline-languages")
    usual = scored.filter(~held & (F.col("lang") == F.col("__lang_pred"))).groupBy("__lang_pred").agg(
        (F.avg("__lang_evidence") - FAR * F.coalesce(F.stddev_pop("__lang_evidence"), F.lit(0.0))).alias("__least"))
    kept = scored.filter("__lang_pred <> 'und' and __lang_score >= 0.5").join(small(usual), "__lang_pred", "left")
    return kept.filter("__least is null or __lang_evidence is null or __lang_evidence >= __least").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts predicted toxic.  Labels outside the held-out third are learned from."""
    held = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score(docs, model, score_column="__toxic_score", predicted_column="__toxic")
    return scored.filter("__toxic = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep one row: that of the smallest doc_id, null ids last.  Rows are told apart by a key of their own, so
    repeated rows, and rows without an id, count as copies like any other."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    found = near_duplicates.near_duplicates(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id")
    named = materialise(found.join(rows.select("__row", "doc_id"), "__row"), "pipeline-groups")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"].alias("__row"))
    gone = materialise(named.select("__row").join(first.select("__row"), "__row", "left_anti"), "pipeline-duplicates")
    return by_ids(rows, gone, "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages make up a twentieth of the words or more."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), result="__contamination")
    r = F.col("__contamination")
    return found.filter(~decontaminate.is_contaminated(r.n_words, r.n_hit)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", identify_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
