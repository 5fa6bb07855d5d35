"""The training-data pipeline: documents to token ids, one Parquet table a stage.

Each stage reads the table that its predecessor wrote.  All but the last keep the
columns of documents; the last gives a row of token ids for each document left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm.common import keep_tables, spread, table
from windrose.llm.decontamination import without_contaminated
from windrose.llm.line_dedup import line_dedup
from windrose.llm.near_copies import one_of_each
from windrose.llm.queries import tokenizer
from windrose.llm.sentencepiece_codec import encode_decode
from windrose.llm.toxicity import learn, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3; learned from the labelled ones outside the fold.  Null
    and empty texts score as texts without a match; without labels all documents stay."""
    return without_toxic(spread(docs), learn(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later three-line windows; earlier are smaller
    ids, then earlier rows.  A null text stays null; n_chars follows the text."""
    kept = line_dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8: that with
    the smallest id, of repeated rows one.  Null and empty texts are one group."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows; those
    without words stay, and so do all if the benchmark is empty."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the decoded text; a null
    text is encoded as an empty one."""
    return encode_decode(spread(docs), tokenizer("piece_bpe_32k.model")).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Toxicity, SimHash components and SentencePiece go beyond SQL; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, each written and read again."""
    folder = f"{keep_tables(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
