"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.oracles import ORACLES  # noqa: F401
from quire.llm.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """The byte-level vocabulary of the queries; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), ("doc_id",), bpe.digests, bpe.DIGEST_FIELDS)


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import leaks

    return leaks.report(leaks.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import token_files

    folder = shared_folder(spark) + "/ids"
    token_files.write(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return token_files.checksums(token_files.read(spark, folder))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the lines of every document: how many in all, in the largest line, and crossing a line's end."""
    from quire.llm import token_counts

    rows = token_counts.attribute(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id", "n_tokens", "n_outside", F.size("sections").cast("bigint").alias("n_sections"),
        F.aggregate("sections", F.lit(0.0), lambda n, s: n + s["tokens"]).cast("bigint").alias("n_allocated"),
        F.coalesce(F.array_max(F.transform("sections", lambda s: s["tokens"])), F.lit(0.0)).cast("bigint").alias("largest"),
        F.size(F.filter("sections", lambda s: s["crossing"] > 0)).cast("bigint").alias("n_crossed"),
    )


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import merkle

    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import licenses

    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import pages

    return pages.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import jaccard

    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import repeats

    return repeats.report(repeats.dedupe(table(spark, sf_dir, "documents")))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import periodic

    docs = table(spark, sf_dir, "documents")
    return periodic.report(periodic.scan(docs.select("doc_id", periodic.planted(docs["doc_id"], docs["text"]).alias("text"))))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("id") % 50 == 0)


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import chat

    said = chat.END + chat.START + "assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    folder = shared_folder(spark) + "/chat"
    chat.write(table(spark, sf_dir, "conversations").select(*more.columns).union(more), tokenizer_path(), folder)
    return chat.digests(chat.read(spark, folder))
