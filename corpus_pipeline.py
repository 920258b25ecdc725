"""A training-data pipeline over `documents`: quality, line dedup, near-duplicate documents, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagrid.llm.decontamination import remove_contaminated
from lineagrid.llm.lines import dedup_lines
from lineagrid.llm.near_dups import drop_near_duplicates
from lineagrid.llm.packing import pack_documents
from lineagrid.llm.quality import filter_quality
from lineagrid.storage import staged


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out.

    A score of one half stays. Null and empty texts are scored like others; repeated rows get one score each. Without
    labels of both kinds the score is label 1's share (one half without any, so all stay). An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return filter_quality(docs, labels, least=0.5, train_on=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; n_chars follows the text. A document that is left empty stays.

    A null text stays null, with its n_chars. Repeated rows of one doc_id count as one document. An empty table gives an
    empty one; without a column n_chars none is added.
    """
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Near copies share four fifths of their five-word shingles. Null and empty texts and null doc_ids are copies of nothing
    and stay; all rows of the doc_id that stays remain, repeats among them. An empty table gives an empty one.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark windows go.

    Null and empty texts have no words and stay; an empty benchmark contaminates nothing; repeated rows go or stay alike.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece.

    Null and empty texts are the end id alone; repeated rows are packed each; no documents give no rows.
    """
    return pack_documents(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: Token ids of a trained vocabulary and the classifier cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
