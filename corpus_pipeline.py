"""A corpus from raw documents to token ids, in five stages over shared storage.

Each stage works on all that the stage before it kept, and its output is written
as Parquet and read again.  The first four return the columns of documents, whatever
else these are named.  A null text counts as an empty one, rows that share an id or
are equal are documents of their own unless a stage says otherwise, and an empty
table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.llm import bpe_automaton, mixing, ngram_join, quality_rules, toxicity
from swarmframe.llm.store import labelled_sample, materialize, table


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names that clash with no operator's, and the own name of each."""
    names = {c if c == "text" else f"_in{k}": c for k, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for n, c in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic.

    A null or empty text has no hits and stays; equal texts have equal scores, so
    repeated rows stay or go together.  Without labels nothing is dropped.
    """
    model = toxicity.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, toxicity.LABELLED_BOUND))
    plain, names = _plain(docs)
    return _named(toxicity.apply(plain, model, tuple(names)).where("predicted = 0"), names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio.

    A null or empty text has fewer words than the base rules ask for and goes; equal
    texts stay or go together, a score on the threshold stays.  Without trusted rows
    the base rules alone decide.
    """
    model = quality_rules.fit(docs, labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 0, 0, quality_rules.LABELLED_BOUND))
    plain, names = _plain(docs)
    return _named(quality_rules.apply(plain, model, tuple(names)).where("kept"), names)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links by five-word shingles at 0.8: one with the least doc_id.

    A row without an id is taken only where the group has no other.  A document
    without words is linked with nothing and stays.
    """
    table(spark, sf_dir, "labels")  # ships the package where only documents were read so far
    groups = ngram_join.set_groups(docs, materialize(ngram_join.signatures(docs, 5)), 5, 80)
    # a set's key is in one group only, so id and key name a row of the group, or equal ones
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("label").isNull(), "label", "key")).alias("c")).select(F.col("c.label").alias("label"), F.col("c.key").alias("chosen"))
    plain, names = _plain(docs)
    doc_id = next(n for n, c in names.items() if c == "doc_id")
    rows = ngram_join.signatures(plain, 5, tuple(names))
    rows = rows.join(chosen, rows["key"].eqNullSafe(chosen["chosen"]) & rows[doc_id].eqNullSafe(chosen["label"]), "left").where("chosen IS NOT NULL OR key IS NULL")
    alone = F.when(F.col("key").isNull(), F.monotonically_increasing_id())
    return _named(rows.withColumn("alone", alone).dropDuplicates(["key", "alone"]), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at most one of each source is cut at its budget.

    A text without words is in no copy.  A null source is one of its own.  Ties of the
    key go by id, size and text; rows equal in all of these are interchangeable.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text has no ids, as an empty one."""
    return bpe_automaton.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned models and a join by hashes have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
