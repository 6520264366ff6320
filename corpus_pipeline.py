"""A corpus pipeline of five stages over ``documents``.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
``documents``.  Each stage's rows are written as Parquet to the shared folder and read back as the next one's
input, so lineage is short and a lost executor costs its tasks alone.

1. toxicity: documents that the compression-distance classifier rejects go; the model is fitted to labelled
   rows of the stage's input.
2. near_duplicates: of each component of near-duplicates (Jaccard of five-word shingles from 0.8 on) the row
   with the smallest doc_id stays.  Texts without words are linked with nothing and stay.
3. repeats: strings of 100 bytes that also start earlier are cut, by whole characters.
4. decontamination: documents that hold a benchmark window go.
5. bpe: token count and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, jaccard, leaks, repeats, toxicity
from quire.llm.queries import table, tokenizer_path
from quire.llm.session import drop, materialised, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score under 0.5; columns as they are."""
    rows = docs.select(*COLUMNS)
    model = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component."""
    return jaccard.representatives(docs.select(*COLUMNS), shingle=5, percent=80)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of the texts; ``n_chars`` follows."""
    keep = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    text = F.col("kept").cast("string")
    return repeats.dedupe(docs, keep, characters=True).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with benchmark windows."""
    return leaks.scan(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where(F.size("spans") == 0).select(*COLUMNS)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return bpe.round_trip(docs, tokenizer_path(), ("doc_id", "lang", "source", "n_chars"), bpe.digests, bpe.DIGEST_FIELDS)


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("repeats", _repeats),
    ("decontamination", _decontamination),
    ("bpe", _bpe),
]

#: SQL can express neither the classifier nor the encoder; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialised(docs, folder, name)
            if n:  # the stage before has been read for the last time
                drop(spark, f"{folder}/{STAGES[n - 1][0]}")
    return docs
