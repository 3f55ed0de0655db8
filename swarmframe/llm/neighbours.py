"""Nearest neighbours by inner product with randomly rotated one-bit codes.

As in RaBitQ (Gao and Long 2024): a vector's difference from its cell's centre is
scaled to length one, padded to the code's width and rotated at random; the signs
of its coordinates are its code, and the correction scalar is the inner product of
the code with the rotated vector.  A query is rotated once and rounded to a few
bits, so an inner product is estimated from counts of common bits (AND and
popcount of packed words).  The estimate errs by a multiple of
sqrt((1 - c^2) / c^2 / (bits - 1)) and of the rounding; vectors whose upper bound
stays below the k-th best known product are left out, the rest is reranked exactly.

1. Cells: k-means over a bounded sample; every vector belongs to the cell of its
   nearest centre.  Cells are cut into blocks of a bounded size, and a block keeps
   ids, vectors, codes, scalars and lengths, once.
2. Bars: a query meets one block of its own cell; the k-th best product there is a
   lower bound for its k-th best of all.
3. Probes: an inner product in a cell is at most that with the centre plus the
   query's length times the cell's radius.  A query goes to the cells whose bound
   reaches its bar, and to all blocks of them.

So nothing is missed but by the codes' error bound (SPAN standard deviations).  On
vectors without clusters every cell is probed and all codes are scanned.

Rows without an id, null or zero vectors, vectors with null or non-finite
components take no part.  A vector's neighbours are those of its own length, rows
with the query's id are no candidates.  Equal scores go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.llm.store import materialize

BLOCK = 4_096
QUERY_BLOCK = 1_024
#: Standard deviations of the estimate that the bound spans.
SPAN = 3.5
#: Least bits of a code (a bit for each component beyond that); bits that a query's coordinates are rounded to.
CODE_BITS, QUERY_BITS = 256, 4
SEED = 64
#: Vectors for each cell and most cells; only lengths with so many vectors get cells, and at most CELLED of them.
CELL_ROWS, MOST_CELLS, CELLED = 4_096, 1_024, 16
#: Bytes of vectors that the cells of one length are fitted on, and rounds.
SAMPLE_BYTES, ROUNDS = 1 << 23, 8


def width(d: int) -> int:
    """Bits of a code: whole words of 64."""
    return -(-max(CODE_BITS, d) // 64) * 64


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """d orthonormal columns of the code's width."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width(d), d)))
    return q * np.sign(np.diag(r))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, so that no square leaves the range of doubles."""
    most = np.abs(vectors).max(axis=1, initial=0)
    scale = np.where(most > 0, most, 1)
    return most * np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (a row of words for each 64 bits), correction scalars and lengths."""
    length = lengths(vectors)
    unit = vectors / np.where(length > 0, length, 1)[:, None]
    turned = unit @ rotation(vectors.shape[1]).T
    scalar = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    return np.ascontiguousarray(codes.T), np.where(length > 0, scalar, 1), length


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added from the first to the last."""
    products = vectors.T * query[:, None]
    # sums of one after the other, unlike those of sum(); 0.0 for the sign of a zero
    return np.add.accumulate(products, axis=0, out=products)[-1] + 0.0 if len(query) else np.zeros(len(vectors))


def estimates(codes: np.ndarray, ones: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of all codes with a rotated query, by popcounts, and the standard deviation of its rounding.

    ones: the number of set bits of each code.
    """
    low, high = turned.min(), turned.max()
    step = (high - low) / ((1 << QUERY_BITS) - 1) or 1.0
    rounded = np.rint((turned - low) / step).astype(np.uint8)
    planes = np.packbits(rounded >> np.arange(QUERY_BITS, dtype=np.uint8)[:, None] & 1, axis=1, bitorder="little").view("<u8")
    # sums of three words' counts fit a byte, those of a plane's 64 bits and more two
    kind = np.uint16 if len(turned) < 1 << 16 - QUERY_BITS else np.int32
    met, both = np.zeros(codes.shape[1], kind), np.empty(codes.shape[1], codes.dtype)
    count, more = np.empty((2, codes.shape[1]), np.uint8)
    for plane in planes[::-1]:
        met += met
        for w in range(0, len(codes), 3):
            np.bitwise_count(np.bitwise_and(codes[w], plane[w], out=both), out=count)
            for v in range(w + 1, min(w + 3, len(codes))):
                count += np.bitwise_count(np.bitwise_and(codes[v], plane[v], out=both), out=more)
            met += count
    # the code is 2 * bits - 1: twice the query's sum over set bits, less the sum over all
    total = step * rounded.sum(dtype=np.int64) + low * len(turned)
    found = met * (2 * step)
    found += ones * (2 * low)
    found -= total
    found /= np.sqrt(len(turned))
    return found, step / np.sqrt(12)


class Block:
    """Vectors of a cell with their codes."""

    def __init__(self, row: dict):
        d = row["d"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, d)
        self.center = np.frombuffer(row["center"], "<f8")
        self.codes = np.frombuffer(row["codes"], "<u8").reshape(-1, len(self.ids))
        self.scalar, self.length = np.frombuffer(row["scalar"], "<f8"), np.frombuffer(row["length"], "<f8")
        self.ones = np.bitwise_count(self.codes).sum(axis=0, dtype=np.int64).astype(float)
        self.spread2 = np.maximum(1 - self.scalar**2, 0) / max(width(d) - 1, 1)
        with np.errstate(over="ignore", invalid="ignore"):
            self.reach, self.slack = self.length / self.scalar, 1e-6 * (self.length + np.linalg.norm(self.center))

    def search(self, query_id: int, query: np.ndarray, size: float, turned: np.ndarray, bar: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best that are not below bar."""
        with np.errstate(over="ignore", invalid="ignore"):
            found, rounding = estimates(self.codes, self.ones, turned)
            reach = self.reach * size
            estimate = found * reach
            estimate += float(self.center @ query)
            bound = np.sqrt(self.spread2 + rounding**2)
            bound *= SPAN
            bound *= reach
            bound += estimate
            bound += self.slack * size
            other = self.ids != query_id
            if bar == -np.inf and k < len(self.ids):
                likely = np.argpartition(-estimate, k)[: k + 1]
                likely = likely[other[likely]]
                if len(likely) >= k:
                    bar = max(bar, np.sort(exact(self.vectors[likely].astype(float), query))[-k])
            chosen = np.flatnonzero(~(bound < bar) & other)
            vectors = self.vectors[chosen].astype(float)
            if len(chosen) > 2 * k:  # those whose product, up to its rounding, can't be among the k best need not be exact
                near, margin = vectors @ query, self.slack[chosen] * size
                low = near - margin
                if np.isfinite(low).all():
                    likely = np.flatnonzero(near + margin >= max(bar, np.partition(low, -k)[-k]))
                    chosen, vectors = chosen[likely], vectors[likely]
            score = exact(vectors, query)
        best = np.lexsort((self.ids[chosen], -score))[:k]
        best = best[score[best] >= bar]
        return self.ids[chosen][best], score[best]


def _pack(rows: DataFrame, n: int, size: int, coded: bool) -> DataFrame:
    """Blocks of at most ``size`` of rows (row, vec_id, d, cell, sub, embedding), with codes if asked for."""
    names = ["d", "cell", "sub", "part", "kind", "rows", "ids", "vectors", "center", "codes", "scalar", "length"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int, int], list] = {}
        numbers: dict[tuple[int, int, int], int] = {}

        def block(key: tuple[int, int, int], found: list) -> pa.RecordBatch:
            row, ids, vectors = (np.concatenate([f[c] for f in found]) for c in range(3))
            kind = "<f4" if (vectors.astype("<f4") == vectors).all() else "<f8"
            with np.errstate(over="ignore"):
                center = vectors.mean(axis=0) if coded else np.zeros(0)
            if not np.isfinite(center).all():
                center = np.zeros(len(center))
            codes, scalar, length = encode(vectors - center) if coded else (np.zeros(0),) * 3
            numbers[key] = numbers.get(key, -1) + 1
            values = [*key, numbers[key], kind, row.tobytes(), ids.tobytes(), vectors.astype(kind).tobytes(), center.tobytes(), codes.tobytes(), scalar.tobytes(), length.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] * 4 + [pa.string()] + [pa.binary()] * 7, strict=True)], names)

        for batch in batches:
            row, ids, sizes, cell, sub = (batch.column(c).to_numpy() for c in range(5))
            flat, ends = batch.column(5).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            order = np.lexsort((sub, cell, sizes))
            keys = np.column_stack([sizes, cell, sub])[order]
            for at in np.split(order, np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1) if len(order) else ():
                d = int(sizes[at[0]])
                key = (d, int(cell[at[0]]), int(sub[at[0]]))
                vectors = flat[(ends[at] - d)[:, None] + np.arange(d)]
                held = parts.setdefault(key, [])
                for a in range(0, len(at), size):
                    piece = at[a : a + size]
                    held.append((row[piece], ids[piece], vectors[a : a + size]))
                    if sum(len(h[0]) for h in held) >= size:
                        yield block(key, held)
                        held.clear()
        for key, held in parts.items():
            if held:
                yield block(key, held)

    columns = ["row", "vec_id", "d", "cell", "sub", "embedding"]
    kinds = "d int, cell int, sub int, part int, kind string, " + ", ".join(f"{c} binary" for c in names[5:])
    return rows.repartition(n, "d", "cell", "sub").select(*columns).mapInArrow(pack, kinds)


def fit_cells(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of n cells by k-means; cells that become empty stay where they are."""
    rng = np.random.default_rng(SEED)
    centers = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest_center(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=n)
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
    return centers


def nearest_center(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (vectors @ centers.T - 0.5 * (centers * centers).sum(axis=1)).argmax(axis=1)


def _centers(sound: DataFrame) -> dict[int, np.ndarray]:
    """Centres for the lengths with many vectors, each fitted on a bounded sample."""
    many = sound.groupBy("d").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count"), "d").limit(CELLED).collect()
    found = {}
    for r in many:
        rows = max(1, SAMPLE_BYTES // (8 * r["d"]))
        sample = sound.where(F.col("d") == r["d"]).orderBy(F.xxhash64("vec_id", "embedding")).limit(rows).select("embedding").toArrow()
        vectors = sample["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, r["d"])
        n = min(MOST_CELLS, -(-r["count"] // CELL_ROWS), max(1, len(vectors) // 16))
        with np.errstate(all="ignore"):
            centers = fit_cells(vectors, n)
        if np.isfinite(centers).all():
            found[r["d"]] = centers
    return found


def _assigned(sound: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """row, vec_id, d, cell, far (distance from the cell's centre), embedding."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cell, far = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            flat, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d, of in centers.items():
                own = np.flatnonzero(sizes == d)
                for a in range(0, len(own), BLOCK):
                    at = own[a : a + BLOCK]
                    vectors = flat[(ends[at] - d)[:, None] + np.arange(d)]
                    with np.errstate(all="ignore"):
                        cell[at] = nearest_center(vectors, of)
                        far[at] = lengths(vectors - of[cell[at]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(far), batch.column(3)], ["row", "vec_id", "d", "cell", "far", "embedding"])

    rows = sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", "d", "embedding")
    return materialize(rows.mapInArrow(run, "row long, vec_id long, d int, cell int, far double, embedding array<double>"))


PROBE = ["d", "cell", "kind", "rows", "ids", "vectors", "bars"]
PROBE_TYPES = "d int, cell int, kind string, rows binary, ids binary, vectors binary, bars binary"


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, lengths and rotated unit vectors of a block of queries."""
    vectors = np.frombuffer(row["q_vectors"], row["q_kind"]).reshape(-1, row["d"]).astype(float)
    size = lengths(vectors)
    return np.frombuffer(row["q_ids"], np.int64), vectors, size, (vectors / size[:, None]) @ rotation(row["d"]).T


def _probes(pairs: DataFrame, centers: dict[int, np.ndarray], radius: dict[tuple[int, int], float], k: int) -> DataFrame:
    """The cells that each block of queries goes to, with the queries that go there and their bars."""

    def run(batches):
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                ids, vectors, size, turned = _queries(row)
                block, bars = Block(row), np.full(len(ids), -np.inf)
                for i in range(len(ids)):
                    _, score = block.search(ids[i], vectors[i], size[i], turned[i], -np.inf, k)
                    if len(score) == k:
                        bars[i] = score[-1]
                d, of = row["d"], centers.get(row["d"])
                with np.errstate(all="ignore"):
                    bound = np.full((len(ids), 1), np.inf) if of is None else vectors @ of.T + size[:, None] * np.array([radius.get((d, c), -np.inf) for c in range(len(of))])
                    goes = ~(bound + 1e-9 * (np.abs(bound) + size[:, None]) < bars[:, None]) & (bound > -np.inf)
                rows = np.frombuffer(row["q_rows"], np.int64)
                for c in np.flatnonzero(goes.any(axis=0)):
                    use = goes[:, c]
                    values = [d, c, row["q_kind"], rows[use].tobytes(), ids[use].tobytes(), vectors[use].astype(row["q_kind"]).tobytes(), bars[use].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] * 2 + [pa.string()] + [pa.binary()] * 4, strict=True)], PROBE)

    return pairs.mapInArrow(run, PROBE_TYPES)


def nearest(vectors: DataFrame, queries_where, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row of vectors that ``queries_where`` picks.

    vectors: vec_id, embedding.  Queries that share an id get their results each.
    """
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    sound = sound.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    sound = sound.withColumn("d", F.size("embedding"))
    centers = _centers(sound)
    assigned = _assigned(sound, centers)
    cells = assigned.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    # at most MOST_CELLS for each of CELLED lengths
    celled = cells.where(F.col("d").isin(list(centers))).collect() if centers else []
    radius = {(r["d"], r["cell"]): r["far"] if np.isfinite(r["far"]) else np.inf for r in celled}
    n = assigned.count()
    subs = cells.select("d", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("subs"))
    placed = assigned.join(subs, ["d", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    asked = assigned.where(queries_where).withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(max(1, n // (64 * CELL_ROWS)))).cast("int"))
    blocks = materialize(_pack(placed, max(1, -(-n // BLOCK)), BLOCK, True)).drop("rows")
    queries = _pack(asked, max(1, -(-n // (20 * QUERY_BLOCK))), QUERY_BLOCK, False)
    named = queries.select("d", "cell", *[F.col(c).alias(f"q_{c}") for c in ("kind", "rows", "ids", "vectors")])
    home = blocks.where("sub = 0 AND part = 0").join(named, ["d", "cell"])
    probes = materialize(_probes(home, centers, radius, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                ids, asked, size, turned = _queries(row)
                block, rows, bars = Block(row), np.frombuffer(row["q_rows"], np.int64), np.frombuffer(row["q_bars"], "<f8")
                found = [block.search(ids[i], asked[i], size[i], turned[i], bars[i], k) for i in range(len(ids))]
                times = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, times)), pa.array(np.repeat(ids, times)), *[pa.array(np.concatenate([f[c] for f in found])) for c in (0, 1)]], ["query_row", "query_id", "vec_id", "score"])

    named = probes.select("d", "cell", *[F.col(c).alias(f"q_{c}") for c in PROBE[2:]])
    found = blocks.join(named, ["d", "cell"]).mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
