"""The registered queries of the training-data operators and their comparison SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm import oracle
from wattspan.llm.bpe import round_trip_digests
from wattspan.llm.fingerprint import edit_fingerprints
from wattspan.llm.langid import identify_languages
from wattspan.llm.mixing import mixing_scores
from wattspan.llm.neardup import near_duplicates
from wattspan.llm.packing import pack, token_pieces
from wattspan.llm.private import span_report
from wattspan.llm.quality import grade_documents, graded
from wattspan.llm.repair import repair_report
from wattspan.llm.repeats import remove_repeats
from wattspan.llm.topk import top_k
from wattspan.llm.toxicity import score_toxicity
from wattspan.llm.variants import group_variants, runs, word_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(divisor: int, value: int, key: str = "doc_id") -> Column:
    """Whether crc32(key as text) has this remainder; a null key counts as having it, so it is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor == value, F.lit(True))


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    packed = pack(pieces).withColumnRenamed("crc", "ids_crc32")
    return packed.withColumn("length", F.col("length").cast("long"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = graded(docs, table(spark, sf_dir, "labels")).where(~remainder(3, 1))
    found = grade_documents(docs, rated, grades=3).withColumn("p_good", F.get("tail", F.lit(0)))
    selected = (F.col("p_good") >= 0.5).alias("selected")
    return found.select("doc_id", remainder(3, 1).alias("held_out"), "expected_grade", "p_good", selected)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=35, with_text=False)


def op5_sketch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labelled = docs.select("doc_id", "text").join(labels, "doc_id").where(~remainder(3, 1))
    found = score_toxicity(docs, labelled)
    return found.select("doc_id", remainder(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, docs.where(~remainder(3, 1)))
    return found.select("doc_id", remainder(3, 1).alias("held_out"), "lang_pred", "score")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", ~remainder(7, 2))
    found = mixing_scores(docs, "train")
    return found.withColumn("held_out", ~F.col("train")).drop("train")


def misspelt(docs: DataFrame) -> DataFrame:
    """Every run of at least five letters of all texts, one row each; about one in 97, by document and
    run, has lost a code point. A null doc_id counts as an empty one."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col("text"))).alias("run"))
    found = found.where(F.char_length("run") >= 5)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(misspelt(table(spark, sf_dir, "documents"))))


def op12_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one turn in four dropped, emptied, without its sentence ends, repeated or given to
    the user, by conversation and turn; nulls count as one space."""
    space = F.lit(" ")
    told = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(told[3], ".!?", "")).otherwise(told[3])
    role = F.when(kind == 4, "user").otherwise(told[2])
    copies = F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
