"""The corpus pipeline: quality, near duplicates, contamination, personal data, tokens.

Each stage takes what the one before kept. run() writes the stages' results to the shared
folder in between, as a run by stages does.

Defined cases, in every stage: null and empty texts pass as they are (null stays null up to
the last stage); very long texts are handled whole; rows with equal or null ids are rows of
their own, told apart by all their columns, and of wholly equal rows near_duplicates leaves
one; of a group's rows with the same smallest id the one with the smallest hash stays; an
empty table gives an empty result; columns other than those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, minhash_dedup, pii, quality_fm, sentencepiece_scan
from tracewright.llm.common import bloom, column, lean, may_hold, small_batches, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs.select(*COLUMNS), model, tuple(COLUMNS)).where("score >= 0.3").select(*COLUMNS)


def _tagged(filt):
    """Rows with whether their hash may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = may_hold(filt.value, column(b, "row_hash").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.record_batch([*b.columns, pa.array(maybe)], names=[*b.schema.names, "maybe"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that with the smallest id, of several such rows the one with the smallest hash of its columns, of identical rows one. Texts without words are linked with nothing and stay.

    Only rows that may go (or may be one of several identical ones) are shuffled with their texts.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    # a row is known by its id and the hash of all columns; nulls are told from absent values
    key = ["id_key", "row_hash"]
    keyed = docs.withColumns({"id_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "row_hash": F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))])})
    rows = written(minhash_dedup.linked(keyed, tuple(key)).where("n_shingles > 0").groupBy("component", F.col("doc_id").isNull().alias("no_id"), *key).agg(F.count("*").alias("times")))
    first = rows.groupBy("component").agg(F.min(F.struct("no_id", *key)).alias("first"), F.sum("times").alias("all")).where("all > 1")
    stays = F.struct("no_id", *key) == F.col("first")
    marked = written(rows.join(first, "component").withColumn("stays", stays).where("not stays or times > 1").select(*key, "stays"))
    kinds = dict(keyed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keyed.columns) + ", maybe boolean"
    tagged = keyed.mapInArrow(lean(_tagged(bloom(marked.select(F.col("row_hash").alias("id"))))), schema)
    held = tagged.where("maybe").join(marked.hint("shuffle_hash"), key, "left")
    once = held.where("stays").dropDuplicates(key)
    return tagged.where("not maybe").select(*COLUMNS).unionByName(held.where("stays is null").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that benchmark windows cover are cut out of the texts."""
    return _sized(decontaminate.remove_spans(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), tuple(COLUMNS)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    small_batches(spark)
    return _sized(pii.redact(docs.select(*COLUMNS), tuple(COLUMNS)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its number of tokens, the digest of its ids, and whether they decode to the text."""
    small_batches(spark)
    return sentencepiece_scan.digest(docs.select(*COLUMNS), keep=("doc_id", "lang", "source", "n_chars"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: No SQL: the classifier, the learned patterns and the tokenizer have none.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
