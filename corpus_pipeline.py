"""The corpus pipeline: language ID, near duplicates, decontamination, secrets and packing, each over all that is left.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of ``documents``, whatever else they hold.

Every stage takes null texts, empty tables and texts of any length. A decision is one about a row: rows that repeat an id, or have none, are told apart by a hash of id and text, and
of equal rows near duplicates keep one. Columns beside those of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import common
from ledgermill.llm.decontam import find_leaks
from ledgermill.llm.jaccard_join import join_similar
from ledgermill.llm.langid import identify_languages
from ledgermill.llm.packing import pack_documents
from ledgermill.llm.secrets import redact_secrets


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """Adds ``_pipeline_key``: the id, or for rows that repeat one or have none a negative hash of id and text, the same for equal rows."""
    work = common.Work(docs.sparkSession, name)
    odd = work.save(docs.groupBy(F.col("doc_id").cast("long").alias("_pipeline_id")).agg(F.count("*").alias("n")).filter("n > 1 or _pipeline_id is null"), "odd")
    n = odd.count()
    if not n:
        return docs.withColumn("_pipeline_key", F.col("doc_id").cast("long"))
    text_key = -1 - F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("\0"))).bitwiseAND(F.lit((1 << 62) - 1))
    odd = odd.filter("_pipeline_id is not null").select("_pipeline_id", F.lit(True).alias("_pipeline_odd"))
    marked = docs.withColumn("_pipeline_id", F.col("doc_id").cast("long"))
    marked = marked.join(F.broadcast(odd) if n <= common.MAX_BROADCAST_IDS else odd.hint("merge"), "_pipeline_id", "left")
    return marked.withColumn("_pipeline_key", F.when(F.col("_pipeline_odd") | F.col("_pipeline_id").isNull(), text_key).otherwise(F.col("_pipeline_id"))).drop("_pipeline_id", "_pipeline_odd")


def _input(keyed: DataFrame, *columns: str) -> DataFrame:
    return keyed.select(F.col("_pipeline_key").alias("doc_id"), *columns)


def _without(keyed: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Documents whose key isn't among the keys (doc_id); these are written first, and broadcast only if there are few."""
    gone = common.Work(keyed.sparkSession, name).save(keys.select(F.col("doc_id").alias("_pipeline_key")).distinct(), "ids")
    return common.with_ids(keyed, gone, ["_pipeline_key"], "left_anti", gone.count()).select([c for c in keyed.columns if c != "_pipeline_key"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, or no letters) go; the others stay as they are."""
    keyed = _keyed(docs, "language")
    found = identify_languages(_input(keyed, "text", "lang"), ~common.held_out(4))
    return _without(keyed, found.filter("lang_pred = 'und'"), "language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of five-word shingles, the one with the smallest id (else text hash) stays, and of equal rows one. Texts without words link with nothing."""
    work = common.Work(spark, "duplicates")
    keyed = _keyed(docs, "duplicates")
    found = work.save(join_similar(_input(keyed, "text"), size=5, percent=80).select("doc_id", "component_id"), "found")
    linked = found.filter("component_id <> doc_id")
    # keys of rows with ids of their own are the ids; a group with others is led by its smallest id
    ids = keyed.filter("_pipeline_key < 0").select("_pipeline_key", F.col("doc_id").cast("long").alias("_pipeline_id"))
    if not ids.limit(1).count():
        return _without(keyed, linked, "duplicates")
    ids = work.save(ids.distinct(), "ids")
    mixed = found.join(ids, F.col("doc_id") == F.col("_pipeline_key"), "left").withColumn("_pipeline_id", F.when(F.col("_pipeline_key").isNull(), F.col("doc_id")).otherwise(F.col("_pipeline_id"))).drop("_pipeline_key")
    first = F.min(F.struct(F.col("_pipeline_id").isNull().alias("none"), "_pipeline_id", "doc_id")).alias("first")
    leaders = mixed.groupBy("component_id").agg(first).select("component_id", F.col("first.doc_id").alias("leader"))
    kept = _without(keyed.withColumn("_pipeline_again", F.col("_pipeline_key")), found.join(leaders, "component_id").filter("doc_id <> leader"), "duplicates")
    # equal rows share a key
    one = kept.filter("_pipeline_again < 0").dropDuplicates(["_pipeline_again"])
    return kept.filter("_pipeline_again >= 0 or _pipeline_again is null").unionByName(one).drop("_pipeline_again")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    keyed = _keyed(docs, "leaks")
    return _without(keyed, find_leaks(_input(keyed, "text"), common.table(spark, sf_dir, "benchmark")), "leaks")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows; every document stays, a null text as null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full windows; a null or empty text is its end alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL can express neither the language nor the leak stage; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    work, docs = common.Work(spark, "pipeline"), common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
