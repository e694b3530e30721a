"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, encoding.

Every stage works on all that the one before kept, and every stage but the last returns the columns
of documents, whatever their names and values; doc_id, text and source are needed. Quality: documents that the rules reject go. Near-dedup: of each group of
near-duplicates the smallest doc_id stays. Substring dedup: repeated words leave the texts, and with
them texts of which nothing is left; n_chars follows where it is there. Mixing: documents come as often as the mix
takes them, those it doesn't take go. Encoding: one row of ids for each row.

No SQL gives these rows (EM and the tokenizer have none); tests hold each stage against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, near_dedup, piece_codec, quality_rules, substring_dedup
from brindle.llm.queries import vocabulary
from brindle.llm.shared import ensure_checkpoint_dir

SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, percent=SIMILAR_PERCENT)


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all of them in _given, so that an operator's columns replace none."""
    return docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_given"))


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of docs from _given, but for the new ones."""
    return [(new[c] if c in new else F.col(f"_given.`{c}`")).alias(c) for c in docs.columns]


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(_apart(docs, "doc_id", "text")).filter("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*_columns(docs, **new))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(mixing.mix(_apart(docs, "doc_id", "text", "source"))).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(docs, vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("pareto_mix", mix),
    ("sentencepiece_encode", encode),
]

ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's are written to the shared folder and read again, and the folder of
    the stage before is deleted; the last one's stays, since the result is read from it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            _delete(spark, f"{folder}/{done}")
        done = name
    return docs
