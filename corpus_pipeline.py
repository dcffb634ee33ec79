"""From raw documents to packed training sequences, in stages that are each stored.

Quality rules, one document of each group of near copies, removal of repeated passages,
masking of secrets, packing. Each stage reads all that the one before kept, as documents
(doc_id, text, lang, source, n_chars); the last returns pieces and their places.

In every stage a null text counts as empty, rows with null or repeated ids are rows of
their own, columns beside those named stay as they are (the last stage reads doc_id and
text alone), a long text is taken whole, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions.shipping import ship
from cytoframe.llm.jaccard import keep_one
from cytoframe.llm.packing import pack, token_pieces
from cytoframe.llm.quality import clean_documents
from cytoframe.llm.queries import tokenizer_path
from cytoframe.llm.recompress import rewrite_documents
from cytoframe.llm.scratch import cut
from cytoframe.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from texts; rejected documents go as a whole, those without text among them."""
    ship(spark)
    return clean_documents(docs, chars="n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one with the least id stays, whether ids are null or repeated."""
    ship(spark)
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go; documents of which nothing is left go."""
    ship(spark)
    return rewrite_documents(docs, chars="n_chars")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return redact_secrets(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenized, in as few sequences as best-fit packing finds."""
    ship(spark)
    return pack(token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: SQL has no form of the line rules, the randomness battery or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
