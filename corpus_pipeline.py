"""Corpus pipeline: quality classifier, near-dedup, benchmark decontamination, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read as the next one's docs.
All but the last return the columns of docs. A row with a null doc_id passes the near-dedup stage; of rows that share a
doc_id and a text one stays there, the first by the other columns in their order (nulls first; columns that have no order, as maps, by a digest of the row, last). An empty table passes every stage as an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mixing, near_dedup, quality, token_files
from tallyspark.llm.common import fresh_path, table, written

SHINGLE_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler takes."""
    return quality.taken(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    gone = (near_dedup.groups(docs.select("doc_id", "text"), SHINGLE_WORDS).where("doc_id <> component_id")
            .select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids of several rows are few, as a rule none: the others' texts aren't grouped
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("doc_id"), "repeated")
    several = kept.join(repeated, "doc_id", "left_semi").withColumns({
        "__text": F.sha2("text", 256), "__row": F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])), 256)})
    order = [c for c in docs.columns if c not in ("doc_id", "text") and not re.search("map<|variant|geo", docs.schema[c].dataType.simpleString())]
    one = several.groupBy("doc_id", "__text").agg(F.min_by(F.struct(*docs.columns), F.struct(*order, "__row")).alias("__first")).select("__first.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.emitted(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, folder, token_files.tokenizer_path())
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID / binary output", token_stage),
]
#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
