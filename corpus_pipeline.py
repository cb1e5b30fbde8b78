"""A corpus from raw documents: five stages, each over all that the one before has kept.

Rows without an identifier can't be named by a filter and stay; rows that share one stay or go
together. Columns beyond those of `documents` are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, repeats, sentencepiece_codec, toxicity
from tessera.llm.common import Stash, ship, small_or_plain
from tessera.llm.queries import PIECE_MODEL, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, ids: DataFrame, stash: Stash, name: str) -> DataFrame:
    """docs but the rows of these ids, which are sent along only while they are few."""
    ids = stash.keep(ids.where("doc_id is not null").distinct(), name)
    return docs.select(*COLUMNS).join(small_or_plain(ids, ids.count()), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, as they are; the model learns from all labels."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id."""
    found = ngram_join.join(docs)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"), Stash(spark, "near"), "dropped")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that start earlier; a character cut in half becomes U+FFFD."""
    done = repeats.remove(docs, carry=("lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontaminate.matches(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id"), Stash(spark, "leaks"), "dropped")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    coded = sentencepiece_codec.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(PIECE_MODEL))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("same").alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None  # trees, suffix arrays and tiles aren't SQL: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents` of a folder."""
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
