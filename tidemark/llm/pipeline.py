"""A corpus from documents to packed sequences, each stage written and read again as the next one's docs.

Every stage takes any number of rows, none too; null and empty texts go through all of them (they
have no lines, words or secrets to lose; the near-dedup stage keeps one text without words). A stage's
operator states the result of every other odd case. All but the last return the columns of docs,
whatever these are beside doc_id and text; n_chars, where there is one, is the text's as it is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, secret_scan, simhash, toxicity
from tidemark.llm._shared import written
from tidemark.llm.encoding import tokenizer_path


#: Units that a worker's encoder keeps here, where other stages have filled the executors' memory.
UNITS = 500_000


def _resized(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; the model is learned as that of the query is."""
    model = toxicity.learned_from(spark, docs, sf_dir)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand earlier in another or in themselves."""
    return _resized(line_dedup.dedup_lines(docs, runs=True, counts=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts link at a similarity of 0.8 or more of five-word shingles."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return _resized(secret_scan.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), cache=UNITS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]
#: Models, chunk hashes and a tokenizer: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
