import hashlib
import os
import subprocess
import sys

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as C
from conftest import ROOT
from shelfwise.llm import op4_pii as op4
from shelfwise.llm.op9_langid import held_out, train

from .test_decontamination import brute as brute_hits
from .test_simhash import brute_groups
from .test_tokens import tiktoken_ids  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tiktoken_ids):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = [r for r in docs.collect() if (p := model.predict([r["text"]])[0])[0] != "und" and p[2] <= 0.6]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in C.language(spark, docs, SF).collect())
    least = {k: c for k, _, c in brute_groups([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {k for k, _, n, _ in brute_hits([(r["doc_id"], r["text"]) for r in rows], items) if n}
    rows = [r for r in rows if r["doc_id"] not in hit]
    pii = op4.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"))
    want = {}
    for r in rows:
        masked = op4.mask(r["text"], pii.spans(r["text"])[1])
        want[r["doc_id"]] = tiktoken_ids(masked)
    got = {r["doc_id"]: r for r in C.run(spark, SF).collect()}
    assert set(got) == set(want)
    for k, ids in want.items():
        assert bytes(got[k]["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[k]["n_tokens"] == len(ids)


def test_edge_rows_pass_every_stage(spark, edge, nothing):
    docs = edge.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    n = docs.count()
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
    empty = nothing.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(5, t), (5, t), (9, t), (None, t), (7, "other words entirely here now")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, SF).collect()) == [5, 7]


def test_the_rest_imports_without_the_subpackage(tmp_path):
    for p in os.listdir(ROOT):
        if p not in (".git", "corpus_pipeline.py", "shelfwise"):
            (tmp_path / p).symlink_to(os.path.join(ROOT, p))
    (tmp_path / "shelfwise").mkdir()
    for p in os.listdir(os.path.join(ROOT, "shelfwise")):
        if p != "llm":
            (tmp_path / "shelfwise" / p).symlink_to(os.path.join(ROOT, "shelfwise", p))
    code = "import __spark_entry__ as E; assert 'pipeline' not in E.queries() and len(E.queries()) >= 180 and 'op2_decontamination' not in E.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_the_last_stage_decodes(spark):
    texts = {1: "one two  three", 2: "Grüße, 日本語 \n", 3: "", 4: "one two  three"}
    got = C.token_ids(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_columns_named_like_inner_ones_survive(spark):
    names = ["id", "_id", "th", "_th", "key", "_key", "language", "_language", "pii", "_pii", "fp", "doc", "t"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumns({n: F.col("doc_id") for n in names})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert rows and all(r[n] == r["doc_id"] for r in rows for n in names), name
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()), name
