"""Registered queries of the training-data operators, each over its whole table, and their SQL.

Every query binds an operator to a table with production parameters and derives the
digest columns from the operator's own output.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import op1_sharding as op1
from shelfwise.llm import op2_decontamination as op2
from shelfwise.llm import op3_tokencount as op3
from shelfwise.llm import op4_pii as op4
from shelfwise.llm import op5_simhash as op5
from shelfwise.llm import op6_embeddings as op6
from shelfwise.llm import op7_bpe as op7
from shelfwise.llm import op8_passages as op8
from shelfwise.llm import op9_langid as op9
from shelfwise.llm import op10_licences as op10
from shelfwise.llm import op11_fingerprint as op11
from shelfwise.llm import op12_runs as op12
from shelfwise.llm import op13_negatives as op13
from shelfwise.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file (installed on driver and executors)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    s = op1.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in documents."""
    d = op2.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document by the word-end vocabulary."""
    d = op3.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return d.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data per document: base counts and digest, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = op4.find(docs, op4.fit(docs)).select("doc_id", "pii.base", "pii.spans")
    parts = F.split("base", ",")
    count = lambda k: F.size(F.filter(parts, lambda s: s.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in op4.KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of documents, 3-word shingles, at most 3 bits."""
    g = op5.groups(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return g.select("doc_id", op5.hex16("fp").alias("fingerprint"), "component_id")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at cosine 0.9."""
    return op6.near_dedup(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to, as digests."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    coded = op7.encode(docs, path, pattern(), decoded=True)
    return coded.select(F.col("row").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of 50 words and more, as word ranges per document, and document classes."""
    d = op8.find(table(spark, sf_dir, "documents"))
    return d.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", op9.held_out(F.col("doc_id")))
    model = op9.train(docs.where(~F.col("held_out")))
    return op9.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences recognised in every document."""
    d = op10.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join("licence.findings", ",").alias("licences"), F.array_join("licence.sentence_ids", ",").alias("sentence_ids"),
                    F.size("licence.findings").cast("long").alias("n_licences"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document, its likeness to an edited form and to the next document."""
    d = op11.with_neighbours(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def repeated_tail(key: str | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten (by the crc32 of its id) the words from some place on repeat the first few of them; null ids: none."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words (four periods and six words or more) in every document, and the text without the repeats."""
    d = op12.find(table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=6, exponent=4, edit=repeated_tail)
    runs = F.col("periodic.runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("most"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    d = d.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), digest(F.array_join(lines, "")).alias("runs_sha256"),
                 digest(F.col("periodic.collapsed")).alias("collapsed_sha256"))
    length = -F.col("best.most")
    return d.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                    F.expr("(-1000 * best.most) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return op13.mine(rows, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, low=30, high=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_decontamination, op3_token_counts, op4_pii, op5_simhash, op6_embeddings, op7_bpe,
                            op8_passages, op9_language, op10_licences, op11_fingerprints, op12_runs, op13_hard_negatives, pipeline)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL where SQL can express the operator (others are tested against brute force).
ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, dwin.n, i, item FROM dwin JOIN win ON win.s = dwin.s AND win.n = dwin.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN its USING (r)""",
    "op6_embeddings": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT r, vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(r, t) AS (SELECT r, r FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.t),
comp AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r),
deg AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN deg USING (r)""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON b.vec_id IS DISTINCT FROM a.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id NULLS LAST) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id NULLS LAST)
QUALIFY row_number() OVER w <= 10""",
}
