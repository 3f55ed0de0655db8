"""Bonds by tiles of points: sums over very many bonds, none of which is ever a row, and bonds with little to shuffle.

Frames are cut into blocks; a task has a block's points and those within reach of it,
puts them in order of small cells and meets them cell by cell in arrays.  Each point
is shuffled once for each block that it is near to, not once for each cell around it.
Boxes are rectangular and periodic; coordinates and distances are those of ``ball``.
"""

from __future__ import annotations

from itertools import product
from math import atan2, ceil, cos, floor, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators.neighbors import _frame

TAU = 2 * pi
#: Points that a cell holds on average in the plane; four times as many in space, where rows of cells are short.
CELL = 24
#: Pairs that are worked on at once: their arrays stay in the cache.
TILE = 1 << 14
#: Values in units of a bin that lie nearer to an edge are reckoned again; products of matrices are off by less.
NEAR = 1e-9
#: Most points of a block, without those around it, and fewest that are worth a block of their own.
MOST, FEWEST = 1_000_000, 2_000


def fits(box: Box) -> bool:
    return not (box.xy or box.xz or box.yz) and all(box.periodic[: box.dims])


class Grid:
    """Cells of a box, blocks of cells, and the cells around a cell that a bond below r can reach."""

    def __init__(self, box: Box, r: float, count: int, frames: int, cores: int, half: bool):
        self.r, self.dims, self.lengths, self.half = r, box.dims, box.lengths, half
        side = min(r, (CELL * (4 if self.dims == 3 else 1) * box.volume / max(count, 1)) ** (1 / self.dims))
        cells = [min(1_024, max(1, floor(d / side))) for d in self.lengths]
        blocks = [1] * self.dims
        while True:
            made = frames * int(np.prod(blocks))
            if count <= MOST * np.prod(blocks) and (made >= 4 * cores or count * frames < FEWEST * 2 * made):
                break
            axis = min((k for k in range(self.dims) if 4 * blocks[k] <= cells[k]), key=lambda k: blocks[k] / self.lengths[k], default=None)
            if axis is None:
                break
            blocks[axis] *= 2
        self.blocks = blocks
        self.cells = [n // b * b for n, b in zip(cells, blocks, strict=True)]
        self.sides = [d / n for d, n in zip(self.lengths, self.cells, strict=True)]
        self.reach = [floor(r / s) + 1 for s in self.sides]
        # by offset along all axes but the last: the farthest offset along the last one
        self.around = []
        for o in product(*[range(-n, n + 1) for n in self.reach[:-1]]):
            left = r * r * (1 + 1e-9) - sum((max(abs(v) - 1, 0) * s) ** 2 for v, s in zip(o, self.sides, strict=False))
            if left > 0 and (not half or o >= (0,) * len(o)):
                self.around.append((*o, min(self.reach[-1], floor(left**0.5 / self.sides[-1]) + 1)))

    def widest(self) -> float:
        """No vector between points that are met is longer along an axis."""
        return max((n + 1) * s for n, s in zip(self.reach, self.sides, strict=True))

    def runs(self, at: tuple[int, ...]):
        """First and last cell (numbered over the grid), images of the cell ``at``'s surroundings, and whether it is the cell itself."""
        n, low, high, images = self.cells, [], [], []
        for *o, far in self.around:
            base, image = 0, []
            for c, v, m in zip(at, o, n, strict=False):
                base, image = base * m + (c + v) % m, [*image, (c + v) // m]
            start = at[-1] + 1 if self.half and not any(o) else at[-1] - far
            stop = at[-1] + far
            while start <= stop:
                k = start // n[-1]
                end = min(stop, k * n[-1] + n[-1] - 1)
                low.append(base * n[-1] + start - k * n[-1])
                high.append(base * n[-1] + end - k * n[-1])
                images.append((*image, k))
                start = end + 1
        if self.half:
            own = int(np.ravel_multi_index(at, n))
            low, high, images = [*low, own], [*high, own], [*images, (0,) * self.dims]
        return low, high, images


def _placed(points: DataFrame, box: Box, r: float, half: bool, carry: tuple[str, ...]) -> tuple[Grid, DataFrame]:
    """The grid, and points (by, _b, _c, id, x, y(, z), carried) beside each other in order of blocks; _b: the block that a row serves."""
    if not fits(box):
        raise ValueError("tiles need a rectangular periodic box")
    if r <= 0 or any(d <= 2 * r for d in box.lengths):
        raise ValueError("r is too large for the box")
    by = _frame(points)
    some = points.where(" AND ".join(f"{c} IS NOT NULL" for c in ("point_id", "x", "y", "z", *by)))
    counts = some.groupBy(*by).count().agg(F.max("count"), F.count("*")).first() if by else (some.count(), 1)
    cores = max(points.sparkSession.sparkContext.defaultParallelism, 1)
    grid = Grid(box, r, counts[0] or 0, max(counts[1], 1), cores, half)
    axes = list(zip("xyz", grid.lengths, grid.cells, grid.blocks, grid.reach, strict=False))
    inside = {c: F.col(c) - length * F.floor(F.col(c) / length + 0.5) for c, length, *_ in axes}
    rows = some.withColumns(inside).withColumns({f"_c{c}": F.least(F.floor((F.col(c) / length + 0.5) * n), F.lit(n - 1)).cast("int") for c, length, n, *_ in axes})
    cell, block = F.lit(0).cast("long"), F.lit(0)
    for k, (c, _, n, b, reach) in enumerate(axes):
        cell = cell * n + F.col(f"_c{c}")
        if b > 1:
            w = n // b
            first = F.floor((F.col(f"_c{c}") - reach) / w).cast("int")
            last = F.floor((F.col(f"_c{c}") + (0 if half and k == 0 else reach)) / w).cast("int")
            rows = rows.withColumn(f"_b{c}", F.explode(F.sequence(first, F.least(last, first + b - 1))))
            block = block * b + F.pmod(F.col(f"_b{c}"), F.lit(b))
    rows = rows.select(*by, block.cast("int").alias("_b"), cell.alias("_c"), F.col("point_id").alias("_id"), *[c for c, *_ in axes], *carry)
    many = int(np.prod(grid.blocks))
    parts = max(1, min(many * max(counts[1], 1), 4_096))
    if by and dict(points.dtypes)["frame"] in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.repartitionById(parts, F.pmod(F.col("frame").cast("long") * many + F.col("_b"), F.lit(parts)).cast("int"))
    elif by:
        rows = rows.repartition(parts, *by, "_b")
    else:
        rows = rows.repartitionById(parts, F.col("_b"))
    return grid, rows.sortWithinPartitions(*by, "_b")


def _groups(batches, keys: list[str]):
    """(key, table) of rows that have one key and follow each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


class Tiles:
    """A block's points in order of cells, and the pairs of slices that hold its bonds."""

    def __init__(self, grid: Grid, table: pa.Table, block: int):
        self.grid = grid
        cell = table.column("_c").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.cell = cell[order]
        self.order = order
        self.table = table
        self.id = self.column("_id")
        self.at = [self.column(c) for c in "xyz"[: grid.dims]]
        self.block = block
        self.repeated = len(np.unique(self.id)) < len(self.id)
        self.buffers: list[np.ndarray] = []
        self.keys = np.empty(TILE, np.intp)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()[self.order]

    def room(self, many: int, n: int, m: int) -> list[np.ndarray]:
        while len(self.buffers) < many:
            self.buffers.append(np.empty(TILE))
        return [b[: n * m].reshape(n, m) for b in self.buffers[:many]]

    def __iter__(self):
        """(slice of queries, slice of points, shift of these or None for each axis, whether i = j may be among them)."""
        grid = self.grid
        found, first = np.unique(self.cell, return_index=True)
        ends = np.append(first[1:], len(self.cell))
        place = np.unravel_index(found, grid.cells)
        block = np.zeros(len(found), np.int64)
        for p, n, b in zip(place, grid.cells, grid.blocks, strict=True):
            block = block * b + p // (n // b)
        for k in np.flatnonzero(block == self.block):
            low, high, images = grid.runs(tuple(int(p[k]) for p in place))
            starts = np.searchsorted(self.cell, low, "left").tolist()
            stops = np.searchsorted(self.cell, high, "right").tolist()
            own = int(found[k])
            for a, b, c, d, image in zip(starts, stops, low, high, images, strict=True):
                if a == b:
                    continue
                shift = [v * length if v else None for v, length in zip(image, grid.lengths, strict=True)]
                same = self.repeated or (c <= own <= d and not any(image))
                rows = min(128, max(8, TILE // (b - a)))  # long rows: arrays are worked on row by row
                for q in range(int(first[k]), int(ends[k]), rows):
                    qs = slice(q, min(q + rows, int(ends[k])))
                    step = TILE // (qs.stop - qs.start)
                    for p in range(a, b, step):
                        yield qs, slice(p, min(p + step, b)), shift, same

    def whole(self, key: np.ndarray) -> np.ndarray:
        """The keys as whole numbers, in a row."""
        out = self.keys[: key.size].reshape(key.shape)
        np.copyto(out, key, casting="unsafe")
        return out.ravel()

    def count(self, key: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.whole(key), minlength=n)

    def start(self, q: slice, shift) -> list[np.ndarray]:
        """Places of queries, moved against the points' shift."""
        return [at[q] if s is None else at[q] - s for at, s in zip(self.at, shift, strict=True)]

    def exact(self, q: np.ndarray, p: np.ndarray, shift) -> list[np.ndarray]:
        """Vectors from queries to points, pair by pair, as ``ball`` has them."""
        return [at[p] - at[q] if s is None else (at[p] - at[q]) + s for at, s in zip(self.at, shift, strict=True)]

    def squares(self) -> np.ndarray:
        """Points as the right side of ``square``."""
        return np.array([*self.at, sum(at * at for at in self.at), np.ones(len(self.cell))])

    def square(self, start: list[np.ndarray], points: np.ndarray, scale: float, out: np.ndarray) -> None:
        """Squared distances times scale, to about 1e-12."""
        left = np.empty((len(start[0]), len(start) + 2))
        for k, v in enumerate(start):
            left[:, k] = -2 * scale * v
        left[:, -2], left[:, -1] = scale, scale * sum(v * v for v in start)
        np.matmul(left, points, out=out)
        np.abs(out, out=out)

    def equal(self, q: slice, p: slice) -> np.ndarray:
        return self.id[q, None] == self.id[p]


def _tally(points: DataFrame, box: Box, r: float, half: bool, carry: tuple[str, ...], work, schema: str) -> DataFrame:
    """(frame,) and the columns of schema: what ``work`` makes of each block's tiles, a dict of arrays."""
    by = _frame(points)
    grid, rows = _placed(points, box, r, half, carry)
    kinds = {c: t for c, t in points.dtypes if c in by}
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for key, table in _groups(batches, [*by, "_b"]):
            made = work(grid, Tiles(grid, table, key[-1]))
            frame = [table.column(c).combine_chunks().take(pa.array(np.zeros(len(made[names[0]]), np.int64))) for c in by]
            yield pa.RecordBatch.from_arrays([*frame, *[pa.array(made[n]) for n in names]], [*by, *names])

    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], schema]))


def _turns(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cos and sin of each angle, as C has them; NaN for no angle."""
    safe = np.nan_to_num(theta).tolist()
    c, s = (np.fromiter(map(f, safe), float, len(safe)) for f in (cos, sin))
    c[np.isnan(theta)] = s[np.isnan(theta)] = np.nan
    return c, s


def _bins(u: np.ndarray, out: np.ndarray) -> np.ndarray | None:
    """The whole part of u into out, the rest into u; True where rounding may have moved a value over an edge."""
    np.floor(u, out=out)
    u -= out
    return u < 2 * NEAR


def _exact_turn(angle: float) -> float:
    return angle - TAU * floor(angle / TAU)


def pmft_xy_counts(points: DataFrame, box: Box, r: float, x_max: float, y_max: float, bins: tuple[int, int]) -> DataFrame:
    """(frame,) bin_x, bin_y, bin_count of all bonds below r, seen from points that are turned by theta.

    Values near a bin's edge are reckoned again as they are from a bond.
    """
    limits, width = (x_max, y_max), (2 * x_max / bins[0], 2 * y_max / bins[1])
    all_near = x_max * x_max + y_max * y_max < r * r * (1 - 1e-9)

    def work(grid, tiles):
        c, s = _turns(tiles.column("theta"))
        lost = np.isnan(c)
        c[lost] = s[lost] = 0.0
        pad = [ceil((2 * grid.widest() + m) / w) + 2 for m, w in zip(limits, width, strict=True)]
        total = [2 * p + n for p, n in zip(pad, bins, strict=True)]
        counts = np.zeros(total[0] * total[1], np.int64)
        right = np.array([*tiles.at, np.ones(len(c))])
        for q, p, shift, same in tiles:
            x, y, f = tiles.room(3, q.stop - q.start, p.stop - p.start)
            a, b = tiles.start(q, shift)
            for v, (g, h), m, w, k in zip((x, y), ((c[q], s[q]), (-s[q], c[q])), limits, width, pad, strict=True):
                left = np.array([g / w, h / w, (m - (g * a + h * b)) / w + k + NEAR]).T
                left[lost[q]] = 0.0, 0.0, 0.5  # no angle: outside
                np.matmul(left, right[:, p], out=v)
            doubt = _bins(x, f)
            f *= total[1]
            np.floor(y, out=x)
            f += x
            y -= x
            doubt |= y < 2 * NEAR
            if same:
                equal = tiles.equal(q, p)
                f[equal] = 0
                doubt &= ~equal
            if not all_near:
                tiles.square((a, b), np.vstack([right[:2, p], (right[:2, p] ** 2).sum(axis=0), right[2:, p]]), 1.0, y)
                f[y >= r * r * (1 + 1e-9)] = 0
                doubt |= np.abs(y - r * r) < r * r * 1e-9
            if doubt.any():
                qs, ps = np.nonzero(doubt & ~lost[q, None])
                dx, dy = tiles.exact(qs + q.start, ps + p.start, shift)
                g, h = c[qs + q.start], s[qs + q.start]
                u, v = (dx * g + dy * h + limits[0]) / width[0], (dy * g - dx * h + limits[1]) / width[1]
                key = (np.floor(u) + pad[0]) * total[1] + np.floor(v) + pad[1]
                f[qs, ps] = np.where(dx * dx + dy * dy < r * r, key, 0)
            counts += tiles.count(f, len(counts))
        counts = counts.reshape(total)[pad[0] : pad[0] + bins[0], pad[1] : pad[1] + bins[1]]
        a, b = np.indices(bins, np.int32)
        return {"bin_x": a.ravel(), "bin_y": b.ravel(), "n": counts.ravel()}

    by = _frame(points)
    return _tally(points, box, r, False, ("theta",), work, "bin_x int, bin_y int, n long").groupBy(*by, "bin_x", "bin_y").agg(F.sum("n").alias("bin_count"))


def pmft_r12_counts(points: DataFrame, box: Box, r: float, bins: int) -> DataFrame:
    """(frame,) bin_r, bin_t1, bin_t2, bin_count of all bonds below r between points that are turned by theta; angles in quarter turns.

    The quarter of an angle shows in the signs of a turned bond.  Each pair is met
    once: from its other end the two angles change places.
    """
    width = r / bins

    def work(grid, tiles):
        theta = tiles.column("theta")
        c, s = _turns(theta)
        lost = np.isnan(c)
        c[lost] = s[lost] = 0.0
        right = tiles.squares()
        x, y = tiles.at
        own = [np.array([c * x + s * y, -c, -s]), np.array([s * x - c * y, -s, c])]  # of points, for the first angle
        other = np.array([x, y, np.ones(len(c))])
        size = bins + ceil(2 * grid.widest() / width) + 2
        counts, twice = np.zeros(16 * size, np.int64), np.zeros(16 * size, np.int64)
        slow = np.zeros((bins, 4, 4), np.int64)

        def turn(a, dx, dy):
            return min(floor(_exact_turn(a - atan2(dy, dx)) / (TAU / 4)), 3)

        for q, p, shift, same in tiles:
            a, b, d, e, f, u = tiles.room(6, q.stop - q.start, p.stop - p.start)
            g, h = tiles.start(q, shift)
            left = np.array([np.ones(len(g)), g, h]).T
            np.matmul(left, own[0][:, p], out=a)
            np.matmul(left, own[1][:, p], out=b)
            # seen from the query the bond comes back: minus (dx, dy)
            np.matmul(np.array([-c[q], -s[q], c[q] * g + s[q] * h]).T, other[:, p], out=d)
            np.matmul(np.array([-s[q], c[q], s[q] * g - c[q] * h]).T, other[:, p], out=e)
            tiles.square((g, h), right[:, p], 1 / (width * width), u)
            np.sqrt(u, out=u)
            u += NEAR
            bits = np.signbit(a).view(np.uint8)
            for v in (b, d, e):
                bits *= 2
                bits += np.signbit(v).view(np.uint8)
            doubt = _bins(u, f)
            a *= b
            d *= e
            a *= d
            np.abs(a, out=a)
            doubt |= a < 1e-10
            f *= 16
            f += bits
            out = (size - 1) * 16
            if lost.any():
                gone = lost[q, None] | lost[p]
                f[gone] = out
                doubt &= ~gone
            itself = False
            if same:
                equal = tiles.equal(q, p)
                f[equal] = out
                doubt &= ~equal
                itself = bool((tiles.cell[q, None] == tiles.cell[p]).any()) and all(v is None for v in shift)
            if doubt.any():
                f[doubt] = out
                qs, ps = (k + o.start for k, o in zip(np.nonzero(doubt), (q, p), strict=True))
                dx, dy = tiles.exact(qs, ps, shift)
                length = np.sqrt(dx * dx + dy * dy)
                k = np.floor(length / width)
                for n in np.flatnonzero((length < r) & (dx * dx + dy * dy < r * r)).tolist():
                    k1, vx, vy = min(int(k[n]), bins - 1), float(dx[n]), float(dy[n])
                    ti, tj = float(theta[qs[n]]), float(theta[ps[n]])
                    slow[k1, turn(tj, vx, vy), turn(ti, -vx, -vy)] += 1
                    if not (itself and tiles.cell[qs[n]] == tiles.cell[ps[n]]):
                        slow[k1, turn(ti, 0.0 - vx, 0.0 - vy), turn(tj, -(0.0 - vx), -(0.0 - vy))] += 1
            if itself:  # the query's own cell: both bonds of a pair are met
                mine = tiles.cell[q, None] == tiles.cell[p]
                counts += tiles.count(np.where(mine, f, out), len(counts))
                f[mine] = out
            twice += tiles.count(f, len(twice))
        quarter = np.array([0, 3, 1, 2])  # by signs of cosine and sine
        grids = [v.reshape(size, 2, 2, 2, 2)[:bins].reshape(bins, 4, 4) for v in (counts, twice)]
        made = [np.zeros((bins, 4, 4), np.int64) for _ in grids]
        for source, into in zip(grids, made, strict=True):
            into[:, quarter[:, None], quarter] = source
        all_ = made[0] + made[1] + made[1].transpose(0, 2, 1) + slow
        k, t1, t2 = np.indices(all_.shape, np.int32)
        return {"bin_r": k.ravel(), "bin_t1": t1.ravel(), "bin_t2": t2.ravel(), "n": all_.ravel()}

    by = _frame(points)
    rows = _tally(points, box, r, True, ("theta",), work, "bin_r int, bin_t1 int, bin_t2 int, n long")
    return rows.groupBy(*by, "bin_r", "bin_t1", "bin_t2").agg(F.sum("n").alias("bin_count"))


def correlation_sums(points: DataFrame, box: Box, r: float, bins: int) -> DataFrame:
    """(frame,) bin, n, re: number of all bonds below r by distance, and the sum of re * re + im * im of their ends.

    Each pair is met once and counts twice; the imaginary parts of its two bonds add up to 0.
    """
    width = r / bins

    def work(grid, tiles):
        right = tiles.squares()
        values = np.array([tiles.column("re"), tiles.column("im")])
        size = bins + ceil(2 * grid.widest() / width) + 2
        counts, sums = np.zeros(size, np.int64), np.zeros(size)
        for q, p, shift, same in tiles:
            u, f, w = tiles.room(3, q.stop - q.start, p.stop - p.start)
            tiles.square(tiles.start(q, shift), right[:, p], 1 / (width * width), u)
            np.sqrt(u, out=u)
            u += NEAR
            doubt = _bins(u, f)
            if same:
                f[tiles.equal(q, p)] = size - 1
                doubt &= f < size - 1
            if doubt.any():
                qs, ps = np.nonzero(doubt)
                d = tiles.exact(qs + q.start, ps + p.start, shift)
                d2 = sum((v * v for v in d[1:]), d[0] * d[0])
                f[qs, ps] = np.where(d2 < r * r, np.minimum(np.floor(np.sqrt(d2) / width), np.where(np.sqrt(d2) < r, bins - 1, size - 1)), size - 1)
            np.matmul(values[:, q].T, values[:, p], out=w)
            share = 2
            if same and all(v is None for v in shift):  # the query's own cell: both bonds of a pair are met
                mine = tiles.cell[q, None] == tiles.cell[p]
                key = tiles.whole(np.where(mine, f, size - 1))
                counts += np.bincount(key, minlength=size)
                sums += np.bincount(key, weights=w.ravel(), minlength=size)
                f[mine] = size - 1
            key = tiles.whole(f)
            counts += share * np.bincount(key, minlength=size)
            sums += share * np.bincount(key, weights=w.ravel(), minlength=size)
        return {"bin": np.arange(bins, dtype=np.int32), "n": counts[:bins], "re": sums[:bins]}

    by = _frame(points)
    rows = _tally(points, box, r, True, ("re", "im"), work, "bin int, n long, re double")
    return rows.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("re").alias("re"))
