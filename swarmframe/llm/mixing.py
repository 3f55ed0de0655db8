"""Mixing sources to target weights, with DataFrame functions only.

Efraimidis-Spirakis sampling: a document of weight w gets the key -ln(u) / w,
where u in (0, 1] comes from a hash of its id and text, so reruns agree and rows
that share an id have keys of their own.  A source whose
target is above its size takes complete epochs first; the rest of the target is
filled in ascending order of the keys, and the document on the border gives
just the words that are missing.

Prefix sums do not need a source in one task.  Keys fall into bins of relative
width 1/256, which hold at most 0.15 % of a source's rows whatever the weights
are (ln of an exponential key has a density of at most 1/e).  Sums by bin find the
bin on the border, sums by 65,536 parts of that bin find the part, and only its rows
are put in order: one in 40 million of a source, and rows equal in id and text.
Sizes and keys are computed once and written as a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bins for each unit of the key's natural logarithm.
BINS = 256
#: Parts of the bin on the border.
BIN_PARTS = 1 << 16
#: A target never exceeds so many times its source's size.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "\u0001"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A document's weight, 0.1 to 1: the share of its characters that are not symbols of clutter."""
    n = F.length(text)
    clean = F.length(F.regexp_replace(text, r"[#*$%&|<>!]+", ""))
    return F.when(n > 0, 0.1 + 0.9 * clean / F.greatest(n, F.lit(1))).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, weigh 1, 2, 3 and again.  A target is
    least(3 * source_size, level * weight) where the level makes all targets sum
    to all sizes: what a full source can't take is shared by weight among the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    full = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (
        weighed.withColumn("most", (MOST_EPOCHS * F.col("source_size")).cast("double"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("most_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # the first source, by the level that fills it, which the common level doesn't fill
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(every)["level"]
    return levels.withColumn("common", level).select("source", "source_size", F.least("most", F.coalesce("common", F.col("full_at")) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and ``keep``) of every row of docs.

    docs: doc_id, text, source.  taken is 0 to 3 times size.  A null text has no
    words; null is a source of its own.  Rows with equal ids are documents of
    their own; rows equal in id, text and source are interchangeable.  An empty table
    gives an empty one.
    """
    weight = quality_weight(F.col("text")) if weight is None else weight
    u = (F.pmod(F.xxhash64("doc_id", "text", F.lit(2006)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    w = F.when(weight > 0, weight).otherwise(F.lit(1e-9))
    keyed = docs.select("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], word_count(F.col("text")).alias("size"), (-F.ln(u) / w).alias("_key"), F.xxhash64("text").alias("_tie"))
    place = F.ln(F.greatest("_key", F.lit(1e-300))) * BINS
    keyed = materialize(keyed.withColumn("_bin", F.floor(place)).withColumn("_part", F.floor((place - F.floor(place)) * BIN_PARTS)))
    bins = keyed.groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("_words").alias("source_size")))
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(MOST_EPOCHS))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("_rest", F.least("source_size", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long")))
    targets = targets.withColumn("_before", F.lit(0).cast("long")).withColumnRenamed("source", "_source")
    border = _border(targets, bins, "_bin")
    parts = keyed.join(border, F.expr("source <=> _source AND _bin = _bin_border")).groupBy("source", "_part").agg(F.sum("size").alias("_words"))
    border = _border(border, parts, "_part")
    rows = keyed.join(border, F.expr("source <=> _source"))
    on = (F.col("_bin") == F.col("_bin_border")) & (F.col("_part") == F.col("_part_border"))
    order = Window.partitionBy("source", "_bin", "_part").orderBy("_key", "doc_id", "size", "_tie")
    inside = rows.where(on).withColumn("_before", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inside = inside.withColumn("_taken", F.greatest(F.lit(0), F.least("size", F.col("_rest") - F.col("_before"))))
    ahead = (F.col("_bin") < F.col("_bin_border")) | ((F.col("_bin") == F.col("_bin_border")) & (F.col("_part") < F.col("_part_border")))
    outside = rows.where(~on).withColumn("_taken", F.when(ahead, F.col("size")).otherwise(F.lit(0)))
    done = inside.unionByName(outside).withColumn("taken", (F.col("_epochs") * F.col("size") + F.col("_taken")).cast("long"))
    return done.select("doc_id", *[c for c in keep if c != "doc_id"], "size", "source_size", "target", "taken")


def _border(targets: DataFrame, bins: DataFrame, bin_: str) -> DataFrame:
    """targets with the last bin that begins within the rest (``<bin>_border``) and the words before it.

    targets: _source, _rest, _before (words before all of these bins) and more;
    bins: source, the bin, _words.
    """
    upto = Window.partitionBy("source").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    sums = bins.withColumn("_sum", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    columns = [c for c in targets.columns if c != "_before"]
    found = targets.join(sums, F.expr("_source <=> source")).withColumn("_sum", F.col("_before") + F.col("_sum")).where("_sum <= _rest")
    found = found.groupBy(*columns).agg(F.max(F.struct(bin_, "_sum")).alias("b"))
    return found.select(*columns, F.col(f"b.{bin_}").alias(f"{bin_}_border"), F.col("b._sum").alias("_before"))


def repeated(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs as the mix takes them: a row for each complete copy, and the border's document cut to its words.

    Columns of docs stay as they are; a document that the mix leaves out has no row.
    """
    columns = docs.columns
    # the row is one column, so its names can't clash with the mix's own; its text is joined back by number
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_id"), F.struct(*[F.col(c) for c in columns]).alias("_row")))
    mixed = mix(rows.select("_id", "_row.doc_id", "_row.text", "_row.source"), weight, ("_id",))
    mixed = rows.join(mixed.select("_id", "size", "taken").where("taken > 0"), "_id")
    whole = F.floor(F.col("taken") / F.greatest("size", F.lit(1)))
    rest = F.col("taken") - whole * F.col("size")
    cut = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), cut)
    rows = mixed.withColumn("_words", F.explode(copies))
    # one part for each word with the white space after it; the limit leaves all further words in the last part
    pieces = F.split(F.regexp_replace(F.col("_row")["text"], r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", (F.col("_words") + 1).cast("int"))
    first = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("_words"), F.lit(0)).cast("int")), "")
    text = F.when(F.col("_words") < 0, F.col("_row")["text"]).otherwise(first)
    return rows.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in columns])
