"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), where docs are all rows that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
as docs of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.common import dealt, materialize, read
from crosstide.llm.decontaminate import contaminated
from crosstide.llm.jaccard_join import similar_documents
from crosstide.llm.mixing import mix_sources
from crosstide.llm.quality import score_quality
from crosstide.llm.queries import vocabulary
from crosstide.llm.token_files import token_documents
from crosstide.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows without an id go by a number made from their text, above all ids."""
    made = F.xxhash64("text").bitwiseAND((1 << 61) - 1) + F.lit(1 << 62)
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), made))


def _by_key(docs: DataFrame) -> DataFrame:
    return _keyed(docs).drop("doc_id").withColumnRenamed("key", "doc_id")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return _keyed(docs).join(dealt(ids.select(F.col("doc_id").alias("key")).distinct()), "key", "left_anti").select(*COLUMNS)


def _by_row(docs: DataFrame) -> DataFrame:
    """Rows go by a number made from id and text: alike for repeated rows only."""
    return docs.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), "text"))


def _as_ids(rows: DataFrame) -> DataFrame:
    return rows.drop("doc_id").withColumnRenamed("key", "doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be of low quality."""
    return _without(docs, score_quality(_by_key(docs), read(spark, sf_dir, "labels")).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents, once.

    Of rows that repeat id and text one is kept; rows without an id come after
    all others of their group, and those with the same text are such rows too.
    """
    rows = _by_row(docs)
    groups = similar_documents(_as_ids(rows)).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.groupBy("key").agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    kept = ids.join(dealt(groups), "key").groupBy("component_id").agg(F.min(place).alias("first")).select("first.key")
    once = rows.groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.join(dealt(materialize(kept, "kept")), "key").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    rows = _by_row(docs)
    found = materialize(contaminated(_as_ids(rows), read(spark, sf_dir, "benchmark")), "contaminated")
    return rows.join(dealt(found.select(F.col("doc_id").alias("key")).distinct()), "key", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mix_sources(_by_key(docs)).groupBy(F.col("doc_id").alias("key")).agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    joined = _keyed(docs).join(dealt(taken), "key")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents; one row a document, as read back from them."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    return token_documents(docs, vocabulary(), end_id=0, folder=folder)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token files", token_files),
]
# Forest, lasso, latent search and tokenizer cannot be said in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
