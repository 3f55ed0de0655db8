"""Every registered query and the whole pipeline, as the driver calls them."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from swarmframe.llm import registry

#: Query: its table, the key of a row of it, and the columns that its contract names.
CONTRACT = {
    "op1_html_extraction": ("pages", "page_id", "page_id bigint,url string,text string,n_chars bigint"),
    "op2_mixing": ("documents", "doc_id", "doc_id bigint,size bigint,source_size bigint,target double,taken bigint"),
    "op3_lm_scoring": ("documents", "doc_id", "doc_id bigint,held_out boolean,n_tokens bigint,n_known bigint,train_tokens bigint,base_score double,score double"),
    "op4_toxicity": ("documents", "doc_id", "doc_id bigint,held_out boolean,score double,predicted int"),
    "op5_quality_rules": ("documents", "doc_id", "doc_id bigint,n_words bigint,word_chars bigint,n_symbols bigint,n_dup_lines bigint,n_repeat_words bigint,base_failed boolean,kept boolean"),
    "op6_token_ids": ("documents", "doc_id", "doc_id bigint,start bigint,n_tokens bigint,ids_crc32 bigint"),
    "op7_ngram_jaccard_join": ("documents", "doc_id", "doc_id bigint,n_shingles bigint,component_id bigint"),
    "op8_quality_classifier": ("documents", "doc_id", "doc_id bigint,held_out boolean,score double,predicted int"),
    "op10_bpe": ("documents", "doc_id", "doc_id bigint,n_tokens bigint,ids_sha256 string,decoded_sha256 string"),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_query_answers_for_every_row(spark, sf, name):
    table, key, columns = CONTRACT[name]
    out = registry.QUERIES[name](spark, sf)
    assert set(columns.split(",")) <= {f"{c} {t}" for c, t in out.dtypes}
    given = spark.read.parquet(f"{sf}/{table}.parquet").select(key)
    got = out.select(key)
    assert got.count() == given.count() and got.exceptAll(given).count() == 0


def test_nearest_neighbours_query(spark, sf):
    out = registry.QUERIES["op9_nearest_neighbours"](spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = rows.count()
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    counts = out.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert len(counts) == rows.where("vec_id % 20 = 0").count() and all(r["n"] == r["last"] == min(20, n - 1) for r in counts)


def test_pipeline_runs(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    rows = out.select("doc_id")
    assert 0 < rows.distinct().count() <= given.count() and rows.join(given, "doc_id", "left_anti").count() == 0
    # the last stage answers for what the one before it kept
    assert out.count() >= rows.distinct().count()


def test_entry_without_these_folders(tmp_path):
    """The rest of the repository imports and lists its queries when the training-data operators are deleted."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rdf' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()))
    assert got == want
