"""The corpus pipeline: documents in, cleaned and encoded documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from shelfmark.llm.common import Store
from shelfmark.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; documents without an id stay.

    Rows that share an id are told apart by their texts, and of fully equal ones one stays.
    """
    kept = minhash.link(docs, text_hash="_hash").filter("kept").groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.count(F.lit(1)).alias("_rows"))
    found = docs.join(kept, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    single, repeated = found.filter("_rows = 1"), found.filter("_rows > 1").dropDuplicates(["_id", "_hash"])
    return single.union(repeated).select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; a row is known by its id, null or not, and its text."""
    rows = docs.select("text", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("row"))
    found = decontaminate.passages(rows, table(spark, sf_dir, "benchmark"), key="row").select("row.*").distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret of their texts replaced by a mark."""
    found = secret_scan.redact(docs, secret_scan.train(docs))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_secrets") > 0, length).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the text decoded from them."""
    return bpe.encode(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]

#: Trained models decide in it, so not all stages can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
