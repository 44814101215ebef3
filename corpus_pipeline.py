"""From raw documents to token ids: the stages of a training corpus, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver, and run(),
write it as Parquet and read it again as the docs of the next. All but the last return
the columns of documents. doc_id is the key of a document.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.bpe import encode_documents
from brindle.llm.common import maybe_broadcast, release, stage, staged, table
from brindle.llm.jaccard import join_documents
from brindle.llm.language import keep_identified, sample, train
from brindle.llm.mixing import in_shard_order, mix
from brindle.llm.pii import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the model rejects (no text,
    no letter, or a score under its calibrated threshold) go."""
    return keep_identified(docs, train(*sample(docs)))


def row_key(docs: DataFrame, secret: int) -> Column:
    """A 64-bit number of a row, from all its columns. Texts and other strings go in as
    digests of 256 bits under a secret of the run, so that no two rows can be written to
    get one number."""
    digest = lambda c: F.sha2(F.concat(F.lit(f"{secret} "), F.col(c)).cast("binary"), 256)
    return F.xxhash64(F.lit(secret), *[x for c, kind in docs.dtypes for x in (digest(c) if kind == "string" else F.col(c), F.col(c).isNull())])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word n-gram similarity of 0.75 links: the one of
    the smallest doc_id, nulls last, and of equal ones the one of the smallest row number.
    Rows are told apart by all their columns, not by doc_id: repeated and null doc_ids are
    rows like others, and of rows equal in all columns one stays. A row without words is
    linked with nothing and stays, repeated or not.

    A row's number is a hash; rows of the same number are compared column by column, and
    those that differ get numbers of their own."""
    secret = secrets.randbits(63)
    keyed = docs.withColumn("_row", row_key(docs, secret))
    twice = stage(keyed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("_row").count().where("count > 1").select("_row"), "twice", few=True)
    if not twice.isEmpty():
        some = maybe_broadcast(twice)
        # Rows without words stay as they are; of the others one of each value.
        same = keyed.join(some, "_row", "left_semi")
        once = stage(same.dropDuplicates([*docs.columns, "_row"]), "values")
        order = Window.partitionBy("_row").orderBy(*[F.col(c).asc_nulls_first() for c in docs.columns])
        number = F.row_number().over(order)  # a few different rows that share a hash
        once = once.withColumn("_k", number).withColumn("_row", F.when(F.col("_k") > 1, F.xxhash64(F.lit(secret), "_row", "_k")).otherwise(F.col("_row"))).drop("_k")
        keyed = stage(keyed.join(some, "_row", "left_anti").unionByName(once), "once")
    linked = join_documents(keyed.select(F.col("_row").alias("doc_id"), "text")).where("n_shingles > 0 AND doc_id != component_id")
    linked = stage(linked.select(F.col("doc_id").alias("_row"), "component_id"), "linked", few=True)
    members = stage(linked.unionByName(linked.select(F.col("component_id").alias("_row"), "component_id").distinct()), "members", few=True)
    ids = keyed.select("_row", F.col("doc_id").alias("_id")).join(maybe_broadcast(members), "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
    gone = stage(members.select("_row").join(first.select("first._row"), "_row", "left_anti"), "gone", few=True)
    return keyed.join(maybe_broadcast(gone), "_row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, each block of a shard
    in order."""
    return in_shard_order(mix(docs)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every document of the mix."""
    return encode_documents(docs, emit="training")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("token_ids", token_ids)]
#: Trained models and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself, and its input, go
    when its result is written."""
    docs = table(spark, sf_dir, "documents")
    since = len(staged())
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        release(spark, since, keep=1)
    return docs
