"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.llm import (
    bpe_automaton,
    html_text,
    language_model,
    mixing,
    neighbours,
    ngram_join,
    pu_quality,
    quality_rules,
    toxicity,
    wavelet,
)
from swarmframe.llm.store import fold_is, labelled_sample, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null or broken page gives what text it holds, at least an empty one."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; null texts have no words, null is a source of its own."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text; a null text is its end alone, a null id is never held out."""
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text; a null or empty text gets that of a text without hits."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", 3, 1, toxicity.LABELLED_BOUND))
    return toxicity.apply(docs, model).select("doc_id", fold_is("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every whole text; a null text has no words and is not kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rules.fit(docs, labelled_sample(docs, labels, "quality", 0, 0, quality_rules.LABELLED_BOUND))
    return quality_rules.apply(docs, model)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of every document's ids, read back from the shards; null ids come first."""
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; texts without words are linked with nothing, equal sets are one class."""
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), 3, 90)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text; a null or empty text gets that of a text without n-grams."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = labelled_sample(docs, labels, "quality", 4, 2, pu_quality.LABELLED_BOUND)
    model = pu_quality.fit(labelled, docs)
    return pu_quality.apply(docs, model).select("doc_id", fold_is("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; null, zero and non-finite vectors take no part, ties go to the smaller id."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's ids and of their decoding; a null text has none."""
    return bpe_automaton.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_mixing, op3_lm_scoring, op4_toxicity, op5_quality_rules, op6_token_ids, op7_ngram_jaccard_join, op8_quality_classifier, op9_nearest_neighbours, op10_bpe, pipeline)}

#: Brute force over all pairs, in double precision; without lambdas, whose syntax differs between DuckDB's releases.
OP9_SQL = """
WITH sound AS (
  SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL)
  GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x)) AND bool_or(x <> 0)),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN sound USING (vec_id)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: All pairs of documents that share a shingle, and what each one reaches over links.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN n < 3 THEN array_to_string(w, ' ') ELSE w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] END AS t FROM g),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * p.n >= 90 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""

ORACLE_SQL = {"op7_ngram_jaccard_join": OP7_SQL, "op9_nearest_neighbours": OP9_SQL}
