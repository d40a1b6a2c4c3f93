"""A pipeline that prepares a corpus: classify, deduplicate, decontaminate, redact, encode. Part of the training-data operators.

Defined results: a stage decides on rows, not on ids: rows that repeat an id with other texts, and rows without an id, are documents
of their own; repeated rows (same id, same text) become one; null and empty texts are kept unless the classifier rejects their source;
an empty table gives an empty table; columns other than those of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.base import few_rows, spool, table
from quillspark.llm.bpe import digest_documents
from quillspark.llm.decontaminate import coverage
from quillspark.llm.jaccard import near_components
from quillspark.llm.quality import classify
from quillspark.llm.secrets import redact, scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


#: Bytes of texts that go to an encoder at once (a longer text goes alone): by default it is up to 64 MB, beside all that earlier stages left.
TEXT_BYTES = 4_000_000

#: Keys from here on are hashes.
HASHED = 2**62


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each document: its id or, where that is null or comes again, a hash of id and text above all usual ids."""
    docs = _documents(docs)
    again = few_rows(spool(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"), "again"))
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))
    own = F.when(F.col("doc_id").isNull() | F.col("again").isNotNull(), hashed).otherwise(F.col("doc_id"))
    return docs.join(again, docs.doc_id == again["again"], "left").select(*COLUMNS, own.alias("key"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs of _keyed() without those whose key is in `keys`, one column: written, and broadcast if it is small."""
    gone = few_rows(spool(keys.toDF("gone").distinct(), "gone"))
    return docs.join(gone, docs.key == gone.gone, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    rows = _keyed(docs)
    found = classify(rows, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), id_col="key")
    return _documents(_without(rows, found.where("not keep").select("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest key stays (one with an id of its own, if there is any); repeated
    rows become one."""
    rows = _keyed(docs)
    found = near_components(rows, id_col="key")
    kept = _without(rows, found.where("key <> component_id").select("key"))
    hashed = F.col("key") >= HASHED
    return _documents(kept.where(~hashed).union(kept.where(hashed).dropDuplicates(["key"])))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item, in whatever order, go."""
    rows = _keyed(docs)
    return _documents(_without(rows, coverage(rows, table(spark, sf_dir, "benchmark"), id_col="key").select("key")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is replaced by a mark; documents stay."""
    found = scan(docs, keep=("lang", "source"))
    text = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to: written here, so that texts come in small batches."""
    return spool(digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "encoded", TEXT_BYTES)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("encode", encode),
]

#: No SQL does what the first two stages do; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
