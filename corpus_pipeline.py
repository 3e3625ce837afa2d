"""A corpus from raw documents to token ids: five stages, each a table that the next one reads.

quality drops documents that the classifier rejects; line_dedup takes repeated and nearly repeated lines out and drops
documents of which nothing is left; near_dup keeps one document of each class; mixing repeats or leaves out documents so
that sources meet their target weights; bpe encodes, and decodes what it encoded.  Every stage reads COLUMNS alone, so other columns cannot clash; texts of any
length pass as the operators say; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import bpe, line_dedup, mixing, near_dup, quality
from gridloom.llm.common import new_path, table, text_or_empty
from gridloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored like others; repeated rows and ties are kept or dropped alike."""
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text stays; rows with a null doc_id are kept whole; of repeated rows neither removes the other's lines."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return left.where(~blank | (F.col("n_removed") == 0)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows repeating a doc_id and text the first by source, lang and n_chars stays; null doc_ids are in no class and all stay."""
    docs = docs.select(*COLUMNS)
    stays = near_dup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id", "text_md5").distinct()
    rows = docs.where("doc_id is not null").withColumn("text_md5", F.md5(text_or_empty("text"))).join(stays, ["doc_id", "text_md5"])
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_md5").orderBy("source", "lang", "n_chars"))
    rows = rows.withColumn("copy", copy).where("copy = 1")
    return rows.select(*COLUMNS).union(docs.where("doc_id is null"))


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeating a doc_id, text and source are counted one by one and written from the first by lang and n_chars."""
    keyed = docs.select(*COLUMNS).withColumn("version", F.xxhash64("text"))
    taken = mixing.mixed(keyed, keep=("version",))[0].where("taken > 0")
    counts = taken.groupBy("doc_id", "version", F.col("source").alias("of")).agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"))
    same = keyed["doc_id"].eqNullSafe(counts["doc_id"]) & (keyed["version"] == counts["version"]) & keyed["source"].eqNullSafe(counts["of"])
    rows = keyed.join(counts, same).drop(counts["doc_id"]).drop(counts["version"])
    first = F.row_number().over(Window.partitionBy("doc_id", "version", "source").orderBy("lang", "n_chars"))
    return rows.withColumn("first", first).where("first = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix; a null text has no ids."""
    coded = bpe.bpe_encode(docs.select("doc_id", "source", text_or_empty("text").alias("text")), tokenizer_path(), decoded="decoded")
    return coded.select("doc_id", "source", bpe.token_counts().alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("line_dedup", keep_lines), ("near_dup", keep_one_of_each), ("mixing", keep_mix), ("bpe", encode)]

#: SQL cannot express a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
