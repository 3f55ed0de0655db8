"""N-gram Jaccard join by a token-group matrix, exact at any threshold.

A document's set holds the distinct n-word shingles of its text.  Two documents
link when 100 * intersection >= percent * union.  Documents with equal sets form
one class; classes, not copies, are joined:

1. Candidates. Sizes are cut into levels so that linked sets lie in one level or
   in neighbouring ones.  The universe of a level is cut by hash into more parts
   than linked sets can differ in (and a few in reserve for empty parts), so
   linked sets agree on several whole parts that are not empty: on ``need`` of
   them at least.  Each class emits a key for each part.  A class leaves a level
   where fewer of its keys than needed are shared with any other class, as those
   do that have a passage in common and little else.  No frequency is needed
   and nothing is lost: this is the pigeonhole principle, not a sketch.
2. Groups. Classes with too many tokens that no other candidate has link with
   nothing and leave.  In every bucket of equal keys each class is compared with
   the one that has the fewest such tokens (the middle of a group of near
   copies), and linked classes form groups.  A bucket of k classes costs k - 1
   comparisons, however large the group is.
3. Token-group matrix. Where a bucket still holds several groups, each class is
   a query against the other groups.  The matrix stores the union of the
   group's tokens; only a group that covers percent of the query's own tokens
   can hold a partner, and only such groups are opened and compared.

Everything is a table; no group, bucket or component is collected in one task.
Sets are identified by a 64-bit sum of token hashes.

Nulls and texts without words: n_shingles 0, linked with nothing,
component_id is their own doc_id.  A text with fewer than n words is one
shingle.  Rows that share a doc_id are documents of their own; a null doc_id
takes part and gets the least doc_id of its component, if there is one.
"""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.llm.annotate import annotate
from swarmframe.llm.graph import components
from swarmframe.llm.store import materialize, release
from swarmframe.llm.textbuf import Words, mix, sets_by_doc, slices

_U = np.uint64
#: Classes with more copies than one in so many rows emit their keys once; at most as many such classes exist.
HEAVY_SHARE = 10_000
HEAVY_LEAST = 64
#: Linked sets agree on one in so many of the parts that they can differ in.
AGREE_SHARE = 6
#: Parts that a group's rows are joined in.
PARTS = 16
#: Bits of a group's row of the matrix, as many as Spark's bitmap has.
BITMAP = 8 * 4_096


class Levels:
    """Size levels of a threshold and the parts that each level's universe is cut into."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        low = [1]
        while low[-1] <= largest:
            low.append(100 * low[-1] // percent + 1)
        self.low = np.array(low)
        parts, spare, need = [], [], []
        for k in range(len(low) - 1):
            high = low[k + 1] - 1
            differ = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
            agree = max(1, differ // AGREE_SHARE)
            reserve = 0 if differ < 4 else 2 + ceil(3 * differ * exp(-low[k] / (differ + agree)))
            parts.append(differ + agree + reserve if differ else 0)
            spare.append(reserve)
            need.append(agree)
        self.parts, self.spare, self.need = np.array(parts), np.array(spare), np.array(need)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct lower-case n-word shingles, and the offsets by text."""
    hashes = words.hashes(lower=True)
    first, grams = words.ngrams(n, hashes)
    doc = words.doc[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = np.zeros(len(short), _U)
        for k in range(n - 1):
            has = words.counts[short] > k
            whole[has] = mix(whole[has] + hashes[words.offsets[short[has]] + k] + _U(k + 1))
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    return sets_by_doc(doc, grams, len(words.counts))


def set_keys(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(tokens) + 1, _U)
    np.cumsum(mix(tokens), out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(_U)).view(np.int64)


def part_keys(tokens: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all texts' parts at their own level and the level below, the text and the level of each."""
    size = np.diff(offsets)
    levels = Levels(percent, int(size.max(initial=1)) + 1)
    own = levels.of(np.maximum(size, 1))
    doc = np.repeat(np.arange(len(size)), size)
    keys, owners, at_level = [], [], []
    for level in (own, own - 1):
        parts = np.where((level >= 0) & (size > 0), levels.parts[np.maximum(level, 0)], 0)
        spare = levels.spare[np.maximum(level, 0)]
        base = np.concatenate([[0], np.cumsum(parts)])
        use = parts[doc] > 0
        d, t = doc[use], tokens[use]
        part = ((t >> _U(32)) * parts[d].astype(_U)) >> _U(32)
        at = base[d] + part.astype(np.int64)
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, at, mix(t + _U(7)))
        filled = np.bincount(at, minlength=base[-1])
        owner = np.repeat(np.arange(len(size)), parts)
        empties = np.bincount(owner[filled == 0], minlength=len(size))
        keep = (filled > 0) | (empties > spare)[owner]
        number = np.arange(base[-1]) - base[owner]
        tag = (level[owner].astype(_U) << _U(40)) + number.astype(_U)
        keys.append(mix(sums + mix(tag) + filled.astype(_U))[keep])
        owners.append(owner[keep])
        at_level.append(level[owners[-1]])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(at_level)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))


def signatures(docs: DataFrame, n: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_shingles and key of the set (null if empty)."""

    def run(part):
        tokens, offsets = shingle_sets(Words.of(part.column("text")), n)
        size = np.diff(offsets)
        return {"n_shingles": size, "key": pa.array(set_keys(tokens, offsets), mask=size == 0)}

    return annotate(docs, run, "n_shingles long, key long", keep)


def _parts(docs: DataFrame, n: int, percent: int, heavy: dict[int, int | None]) -> DataFrame:
    """sig (key of a part) and ref of the set: its level and the low 32 bits of its key, to keep the shuffle small.

    heavy: key and label of the classes whose keys only the row named by the label emits.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                tokens, offsets = shingle_sets(Words.of(part.column("text")), n)
                keys = set_keys(tokens, offsets)
                ids = part.column("doc_id").to_pylist()
                emits = np.array([heavy.get(k) is None or heavy[k] == i for k, i in zip(keys.tolist(), ids, strict=True)], dtype=bool)
                sigs, owner, level = part_keys(tokens, offsets, percent)
                use = emits[owner]
                refs = _ref(keys)[owner[use]] | level[use].astype(np.int64) << np.int64(32)
                yield pa.RecordBatch.from_arrays([pa.array(sigs[use]), pa.array(refs)], ["sig", "ref"])

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, ref long")


def _ref(keys: np.ndarray) -> np.ndarray:
    return keys & np.int64(0xFFFFFFFF)


def _token_sets(docs: DataFrame, n: int) -> DataFrame:
    def run(part):
        words = Words.of(part.column("text"))
        tokens, offsets = shingle_sets(words, n)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return {"key": set_keys(tokens, offsets), "tokens": _lists(tokens.view(np.int64), owner, len(offsets) - 1)}

    return annotate(docs, run, "key long, tokens array<long>", keep=())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of set keys whose sets link."""
    a = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(b, "b").join(a, "a").where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def set_groups(docs: DataFrame, signed: DataFrame, n: int, percent: int) -> DataFrame:
    """key, label (least doc_id, if any), copies and root of every class of equal sets; signed: signatures of docs."""
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"))
    classes = materialize(classes)
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # at most HEAVY_SHARE rows
    heavy = classes.where(F.col("copies") > max(HEAVY_LEAST, total // HEAVY_SHARE)).select("key", "label").collect()
    # one exchange serves both the search for shared keys and the rows that have them
    parts = _parts(docs, n, percent, {r.key: r.label for r in heavy}).repartition("sig")
    shared = parts.groupBy("sig").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo < hi").select("sig")
    found = materialize(parts.join(shared.hint("shuffle_hash"), "sig").select("sig", "ref").distinct())
    enough = materialize(_sharing(found, percent).select("sig", F.col("ref").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ref")).distinct())
    release(found)
    # sets whose keys agree in 32 bits share a ref: all of them are candidates, also of each other
    refs = classes.select(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ref"), "key")
    twice = refs.groupBy("ref").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select(F.xxhash64("ref").alias("sig"), "ref")
    members = materialize(enough.unionByName(twice).join(refs, "ref").select("sig", "key").distinct())
    release(enough)
    nodes = members.select("key").distinct()
    wanted = nodes.join(classes, "key").select(F.col("label").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    sets = materialize(_token_sets(texts, n).join(nodes, "key", "left_semi").groupBy("key").agg(F.first("tokens").alias("tokens")))
    able = _feasible(members.withColumn("root", F.col("key")), sets, percent)
    release(members)
    members = able
    hubs = members.groupBy("sig").agg(F.min(F.struct("alone", "key")).alias("hub")).select("sig", F.col("hub.key").alias("a"))
    pairs = members.join(hubs, "sig").where("a <> key").select("a", F.col("key").alias("b")).distinct()
    links = materialize(_verified(pairs, sets, percent))
    groups = components(links)
    links = links.unionByName(_across_groups(members, groups, sets, percent))
    groups = components(links)
    return classes.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _sharing(found: DataFrame, percent: int) -> DataFrame:
    """The rows (sig, ref) of sets that share as many keys of a level as a linked set needs."""
    need = F.array(*[F.lit(int(n)) for n in Levels(percent, 1 << 31).need])
    enough = found.groupBy("ref").agg(F.count("*").alias("n")).where(F.col("n") >= F.get(need, F.shiftright("ref", 32).cast("int"))).select("ref")
    left = found.join(enough, "ref")
    shared = left.groupBy("sig").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo < hi").select("sig")
    return left.join(shared, "sig").select("sig", "ref")


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep (with doc_id), n_shingles, key, component_id of every row of docs."""
    signed = materialize(signatures(docs, n, keep))
    labelled = set_groups(docs, signed, n, percent)
    least = labelled.groupBy("root").agg(F.min("label").alias("component_id"))
    ids = labelled.select("key", "root").join(least, "root").select("key", "component_id")
    out = signed.join(ids, "key", "left")
    return out.select(*keep, "n_shingles", "key", F.coalesce("component_id", "doc_id").alias("component_id"))


def _feasible(rows: DataFrame, sets: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """sig, key, root, size, alone and slack of the rows (sig, key, root) that can link with another group in their bucket.

    alone counts the tokens that no other group has.  Two sets differ at least in
    the tokens that each has alone, so sets of different groups link only if

        (100 + percent) * (alone + alone') <= (100 - percent) * (size + size')

    that is, if their slacks sum to zero or more; and the tokens that a set has
    not alone must do for a link with the least set of its bucket.  A row that
    reaches neither with the best of the other groups leaves.  Tokens that only
    such rows shared are alone in the next round.
    """
    made: list[DataFrame] = []
    for _ in range(rounds):
        known = rows.select("key", "root").distinct()
        tokens = sets.join(known, "key").select("key", "root", F.explode("tokens").alias("token"))
        single = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo = hi").select("token")
        own = tokens.join(single, "token").groupBy("key").agg(F.count("*").alias("alone"))
        scored = known.join(sets.select("key", F.size("tokens").alias("size")), "key").join(own, "key", "left").na.fill(0, ["alone"])
        scored = materialize(rows.select("sig", "key").join(scored.withColumn("slack", (100 - percent) * F.col("size") - (100 + percent) * F.col("alone")), "key"))
        made.append(scored)
        best = scored.groupBy("sig", "root").agg(F.max("slack").alias("m"), F.min("size").alias("low"))
        first = best.groupBy("sig").agg(F.max(F.struct("m", "root")).alias("t"), F.min("low").alias("low"))
        second = best.drop("low").join(first, "sig").where("root <> t.root").groupBy("sig", "t", "low").agg(F.max("m").alias("s"))
        other = F.when(F.col("root") == F.col("t.root"), F.col("s")).otherwise(F.col("t.m"))
        partner = F.greatest(F.col("low"), F.ceil(percent * F.col("size") / 100))
        enough = (100 + percent) * (F.col("size") - F.col("alone")) >= percent * (F.col("size") + partner)
        rows = scored.join(second, "sig").where(enough & (F.col("slack") + other >= 0)).select("sig", "key", "root", "size", "alone", "slack")
    rows = materialize(rows)
    release(*made)
    return rows


def _across_groups(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between groups that share a bucket, by the token-group matrix.

    A group's row of the matrix is the union of its tokens, hashed to a bitmap of
    a fixed size: a query's tokens that meet set bits are at least as many as its
    tokens in the union, so the bound holds however large the group is.  The
    smaller group asks the larger one.  A query opens a group only if it has there
    as many common tokens as its size and the least size in the group demand of
    a linked pair.
    """
    rows = members.select("sig", "key").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    rows = _feasible(rows.join(mixed, "sig"), sets, percent, 2)
    nodes = rows.select("key", "root", "size", "slack").distinct()
    order = nodes.groupBy("root").agg(F.struct(F.count("*").alias("classes"), F.col("root")).alias("order"))
    # a group may hold most rows, so it is met in parts
    order = order.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = rows.withColumn("part", F.pmod("key", F.lit(PARTS)).cast("int")).join(order, ["root", "part"]).drop("part")
    present = placed.groupBy("sig", "root", "order").agg(F.max("slack").alias("best"), F.min("size").alias("low"), F.max("size").alias("high"))
    present = present.select("sig", F.col("root").alias("group"), F.col("order").alias("above"), "best", "low", "high")
    near = F.expr(f"100 * size >= {percent} * low AND 100 * high >= {percent} * size")
    queries = placed.join(present, (placed["sig"] == present["sig"]) & (F.col("order") < F.col("above")) & (F.col("slack") + F.col("best") >= 0) & near)
    queries = materialize(queries.select("key", "group").distinct())
    asked = queries.select("group").distinct()
    matrix = nodes.withColumnRenamed("root", "group").join(asked, "group", "left_semi").join(sets, "key").select("group", "size", F.explode("tokens").alias("token"))
    matrix = matrix.groupBy("group").agg(F.min("size").alias("least"), F.bitmap_construct_agg(F.pmod("token", F.lit(BITMAP))).alias("bits"))
    opened = queries.join(matrix, "group").join(sets, "key").select("key", "group", "least", "tokens", "bits").mapInArrow(_opened(percent), "key long, group long")
    x = opened.join(nodes.select("key", "size", "slack"), "key")
    y = nodes.select(F.col("root").alias("group"), F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("slack").alias("slack_b"))
    pairs = x.join(y, ["group"]).where(f"slack + slack_b >= 0 AND 100 * least(size, size_b) >= {percent} * greatest(size, size_b)")
    return materialize(_verified(pairs.select(F.col("key").alias("a"), "b").distinct(), sets, percent))


def _opened(percent: int):
    """The (key, group) whose bound allows a link, of rows key, group, least, tokens, bits."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            size = tokens.value_lengths().to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])
            place = tokens.flatten().to_numpy() % BITMAP
            bits = [np.frombuffer(b, np.uint8) for b in batch.column("bits").to_pylist()]
            shared = np.array([int((bits[k][p >> 3] >> (p & 7) & 1).sum()) for k, p in enumerate(place[a:b] for a, b in zip(at[:-1], at[1:], strict=True))], np.int64)
            partner = np.maximum(batch.column("least").to_numpy(), -(-percent * size // 100))
            allowed = pa.array((100 + percent) * shared >= percent * (size + partner))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(allowed) for k in (0, 1)], ["key", "group"])

    return run
