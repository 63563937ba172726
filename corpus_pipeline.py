"""A corpus from documents to token ids: five stages, each by one operator.

Every stage takes all rows its predecessor kept, as written to Parquet, and returns the
columns of documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwatch.llm import byte_bpe, containment, pii_crf, simhash_ring, toxicity_gru
from ledgerwatch.llm.common import table
from ledgerwatch.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the network learns from the given labels and documents.

    Null and empty texts score as empty ones; null ids and repeated rows stay or go by their
    text; an empty table stays empty.
    """
    net = toxicity_gru.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_gru.clean_rows(docs, "text", net)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A document is its id and text, so an id that comes with two texts is two documents, and each
    counts in the group of its own text. Null ids come last; of equal ids the smaller hash of id and
    text is first. Rows repeated with id and text stay once, with the smallest of their other columns.
    Empty and null texts are one group. Two documents with one 64-bit hash would both stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = simhash_ring.groups(keyed, "_key", "text", shingle=3, max_bits=2).select(F.col("id").alias("_key"), "component").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    chosen = keyed.select("_key", "doc_id").distinct().join(found, "_key").groupBy("component").agg(first.alias("first"))
    kept = keyed.join(chosen.select(F.col("first._key").alias("_key")), "_key", "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.groupBy("_key", "doc_id", "text").agg(F.min(F.struct(*(rest or [F.lit(0).alias("none")]))).alias("_rest"))
    return once.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty and null texts hold none, repeated rows go or stay alike."""
    return containment.clean_rows(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; every row stays, also without id or text."""
    return pii_crf.mask(docs, "text", pii_crf.standard_field(), chars_col="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) and the digests of ids and decoded bytes.

    Null texts are empty and have no tokens; null ids and repeated rows each give a row.
    """
    import public_tokenizers

    coded = byte_bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("personal data", masked),
    ("byte-level BPE", token_ids),
]

#: No stage but the third can be put in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result but the last written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
