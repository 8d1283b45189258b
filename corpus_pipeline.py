"""Corpus preparation: five stages over ``documents``, each written as Parquet and reread.

Stage functions take (spark, docs, sf_dir) and return the columns of documents (the last
one: ids instead of text).  Each works on all rows that its predecessor kept.  Rows are
matched with decisions by document id and content hash, null-safe, so repeated rows,
null ids and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import op2_decontamination as op2
from shelfwise.llm import op4_pii as op4
from shelfwise.llm import op5_simhash as op5
from shelfwise.llm import op7_bpe as op7
from shelfwise.llm import op9_langid as op9
from shelfwise.llm.common import fresh, stored, table, text_key
from shelfwise.llm.queries import pattern, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; null and letterless texts go.

    The model learns from this stage's own rows that are labelled and not held out.
    """
    model = op9.train(docs.where(~op9.held_out(F.col("doc_id"))))
    found = fresh(docs, "language")
    return op9.predict(docs, model, out=found).where(op9.accepted(found)).drop(found)


def _matched(docs: DataFrame, ids: DataFrame, how: str) -> tuple[DataFrame, str]:
    """``docs`` semi- or anti-joined with (doc_id, th) rows, null-safe, and the name of the added content hash."""
    key = fresh(docs, "key")
    left = docs.withColumn(key, text_key(F.col("text")))
    id_, th = fresh(left, "id"), fresh(left, "th")
    right = ids.select(F.col("doc_id").alias(id_), F.col("th").alias(th))
    return left.join(right, (F.col(key) == F.col(th)) & F.col("doc_id").eqNullSafe(F.col(id_)), how), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group (3-word shingles, 3 bits): the least id."""
    keep = stored(op5.survivors(op5.groups(docs, shingle=3, bits=3)), "kept")
    rows, key = _matched(docs, keep, "left_semi")
    # a repeated row (same id, same text) is a copy too: one of each stays
    return rows.dropDuplicates(["doc_id", key]).drop(key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a 10-word window of a benchmark item."""
    hit = op2.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    drop = stored(hit.select("doc_id", "th").distinct(), "contaminated")
    rows, key = _matched(docs, drop, "left_anti")
    return rows.drop(key)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span of personal data; ``n_chars`` follows the masked text."""
    pii = fresh(docs, "pii")
    masked = F.col(f"{pii}.masked")
    found = op4.find(docs, op4.fit(docs), out=pii)
    return found.withColumns({"text": masked, "n_chars": F.length(masked).cast(docs.schema["n_chars"].dataType)}).drop(pii)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document: doc_id, n_tokens, ids (little-endian uint32), digest of the bytes that they decode to."""
    coded = op7.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), decoded=True)
    return coded.select(F.col("row").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii", private_data),
    ("bpe_encoding", token_ids),
]

#: The stages are not expressible in SQL; tests run them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
