"""A corpus pipeline over ``documents``: keep texts in a known language and of good quality,
one text of each group of near copies, without passages that repeat, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the ``docs`` of the next one. All but the last return the columns of
documents; columns beyond those are not carried on. Decisions are made row by row, under a number that each
stage gives the rows of the table it reads: rows without a doc_id and different texts of one doc_id stay or go
by their own texts. Null and blank texts go at the first stage.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.durable import scratch_path
from wattspan.llm.langid import UNDETERMINED, identify_languages
from wattspan.llm.neardup import near_duplicates
from wattspan.llm.packing import pack, token_pieces
from wattspan.llm.quality import grade_documents, graded
from wattspan.llm.registered import table, tokenizer
from wattspan.llm.repeats import remove_repeats

ROW = "_row"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each. ``docs`` is a table that was written, which every scan reads in the same order."""
    return docs.select(COLUMNS).withColumn(ROW, F.monotonically_increasing_id())


def kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(rows.select(ROW), ROW, "left_semi").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is undetermined, as they have no letter, go; ``lang`` of the others is the language
    that was identified from their words, whatever the given one, which is only learned from."""
    docs = numbered(docs)
    found = identify_languages(docs, docs, key=ROW).where(F.col("lang_pred") != UNDETERMINED)
    return docs.drop("lang").join(found.select(ROW, F.col("lang_pred").alias("lang")), ROW).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are more likely of the lowest grade than not go."""
    docs = numbered(docs)
    rated = graded(docs, table(spark, sf_dir, "labels")).withColumnRenamed("doc_id", ROW)
    found = grade_documents(docs, rated, grades=3, key=ROW)
    return kept(docs, found.where(F.get("tail", F.lit(0)) >= 0.5))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the row with the smallest
    doc_id stays, the first one of several; rows without an id give way to those with one."""
    docs = numbered(docs)
    groups = near_duplicates(docs, width=5, percent=80, key=ROW).select(ROW, "component_id")
    named = docs.select(ROW, "doc_id").join(groups, ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    return kept(docs, named.groupBy("component_id").agg(first).select(f"first.{ROW}"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a run of 35 words that also starts elsewhere go; n_chars is that of the new text."""
    done = remove_repeats(docs.select(COLUMNS), window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    done = done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences of at most 2048 tokens."""
    return pack(token_pieces(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
