"""Tables of points (frame, point_id, x, y, z) from data tables, lattices, random systems and text files."""

from __future__ import annotations

import re
from itertools import product
from math import cos, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.functions.box import Box

#: Prime moduli and multipliers that spread integer keys over a cube of side 16.
HASHES = ((7919, 40503, 11, 65521), (104729, 30011, 12345, 65519), (1299709, 52361, 777, 65497))
SIDE = 16.0


def hashed_points(table: DataFrame, key: str, dims: int = 3) -> DataFrame:
    """point_id = key, and x, y, z as exact dyadic fractions of a quadratic hash of the key.

    Keys outside a modulus are reduced by it first, which leaves the remainder as it is
    and keeps the square of any 64-bit key inside 64 bits.
    """
    k = F.col(key).cast("long")
    small = lambda m: F.when((k > -m) & (k < m), k).otherwise(F.pmod(k, F.lit(m)))
    at = [((r * r * a + r * b + c) % m).cast("double") / 4096 - 8 for a, b, c, m in HASHES for r in [small(m)]]
    if dims == 2:
        at[2] = F.lit(0.0)
    return table.select(k.alias("point_id"), *[v.alias(n) for v, n in zip(at, "xyz", strict=True)])


def hashed_sql(table: str, key: str, dims: int = 3) -> str:
    """The same in SQL."""
    at = [f"CAST(({key}*{key}*{a} + {key}*{b} + {c}) % {m} AS DOUBLE) / 4096 - 8" for a, b, c, m in HASHES]
    if dims == 2:
        at[2] = "CAST(0 AS DOUBLE)"
    return f"SELECT CAST({key} AS BIGINT) AS id, {at[0]} AS x, {at[1]} AS y, {at[2]} AS z FROM {table}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fractional bases of the common lattices, with the edge lengths of their cells: fixed values.
LATTICES = {
    "sc": ((1, 1, 1), ((0, 0, 0),)),
    "bcc": ((1, 1, 1), ((0, 0, 0), (0.5, 0.5, 0.5))),
    "fcc": ((1, 1, 1), ((0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5), (0, 0, 0))),
    "hcp": ((1, 3**0.5, 8**0.5 / 3**0.5), ((0, 0, 0), (0.5, 0.5, 0), (0.5, 5 / 6, 0.5), (0, 1 / 3, 0.5))),
    "square": ((1, 1, 0), ((0, 0, 0),)),
    "hex": ((1, 3**0.5, 0), ((0, 0, 0), (0.5, 0.5, 0))),
    "graphene": ((1, 3**0.5, 0), ((0, 0, 0), (0, 1 / 3, 0), (1 / 2, 5 / 6, 0), (1 / 2, 1 / 2, 0))),
}


def rectangular_cell(aspect: float, centered: bool = False) -> tuple[Box, tuple]:
    """A cell of sides 1 and ``aspect``, with a second point in its middle if centred."""
    return Box(1.0, float(aspect)), ((0, 0, 0), (0.5, 0.5, 0)) if centered else ((0, 0, 0),)


def oblique_cell(aspect: float, degrees: float) -> tuple[Box, tuple]:
    """A cell of sides 1 and ``aspect`` at an angle."""
    if not 0 < degrees < 180:
        raise ValueError("the angle lies between 0 and 180 degrees")
    high = aspect * sin(radians(degrees))
    return Box(1.0, high, 0.0, aspect * cos(radians(degrees)) / high), ((0, 0, 0),)


def lattice(spark: SparkSession, name, replicas: int | tuple[int, ...] = 1, scale: float = 1.0, noise: float = 0.0, seed: int = 0) -> tuple[Box, DataFrame]:
    """The box and points of a replicated lattice; Gaussian noise on request.

    name: of a common lattice, or a (cell, basis) pair such as ``oblique_cell`` makes.
    """
    cell, basis = (Box(*LATTICES[name][0]), LATTICES[name][1]) if isinstance(name, str) else name
    n = (replicas,) * 3 if isinstance(replicas, int) else (*replicas, 1)[:3]
    n = (*n[:2], 1 if cell.is2d else n[2])
    a, b, c = cell.Lx * n[0] * scale, cell.Ly * n[1] * scale, cell.Lz * n[2] * scale
    # tilts are ratios to the second and third side, which grow by other numbers than the first
    box = Box(a, b, c, cell.xy, cell.xz, cell.yz)
    cells = spark.range(n[0] * n[1] * n[2]).select("id", (F.col("id") % n[0]).alias("i"), (F.floor(F.col("id") / n[0]) % n[1]).alias("j"), F.floor(F.col("id") / (n[0] * n[1])).alias("k"))
    places = F.array(*[F.struct(F.lit(b).alias("b"), *[F.lit(float(v)).alias(f"f{c}") for c, v in enumerate(f)]) for b, f in enumerate(basis)])
    rows = cells.select("id", "i", "j", "k", F.explode(places).alias("p"))
    fractions = [(F.col(a) + F.col(f"p.f{c}")) / n[c] for c, a in enumerate("ijk")]
    at = list(box.absolute(fractions))
    if noise:
        at = [v + noise * F.randn(seed + c) if c < box.dims else v for c, v in enumerate(at)]
    at = box.wrap(tuple(at))
    return box, rows.select((F.col("id") * len(basis) + F.col("p.b")).alias("point_id"), *[v.alias(c) for v, c in zip(at, "xyz", strict=True)])


def random_system(spark: SparkSession, side: float, n: int, is2d: bool = False, seed: int = 0) -> tuple[Box, DataFrame]:
    """n points uniform in a square or cube, the same for the same seed."""
    box = Box.square(side) if is2d else Box.cube(side)
    f = np.random.RandomState(seed).random_sample((n, 3))
    f[:, 2] *= not is2d
    at = (f - 0.5) * side
    if is2d:
        at[:, 2] = 0
    return box, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "point_id long, x double, y double, z double")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, point_id, element, x, y, z of XYZ trajectories (a count, a comment, then atoms, and again).

    Each file is parsed in one task, files side by side.
    """
    schema = "file string, frame long, point_id long, element string, x double, y double, z double"

    def run(batches):
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines, at, frame, rows = value.split("\n"), 0, 0, []
                while at < len(lines) and lines[at].strip():
                    count = int(lines[at])
                    for i, line in enumerate(lines[at + 2 : at + 2 + count]):
                        name, x, y, z = line.split()[:4]
                        rows.append((file, frame, i, name, float(x), float(y), float(z)))
                    at, frame = at + 2 + count, frame + 1
                names = [c.split()[0] for c in schema.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInArrow(run, schema)


def _box_and_points(system):
    """The box and places of a frame object of a simulation package, by the attributes that it has."""
    if isinstance(system, tuple):
        return system
    if hasattr(system, "triclinic_dimensions") and hasattr(system, "positions"):  # time steps of trajectories
        a, b, c, alpha, beta, gamma = map(float, system.triclinic_dimensions.ravel()) if np.shape(system.triclinic_dimensions) == (6,) else (0.0,) * 6
        box = Box.from_lengths_and_angles(a, b, c, alpha, beta, gamma) if a else Box.from_matrix(np.asarray(system.triclinic_dimensions).T.tolist())
        return box, system.positions
    if hasattr(system, "configuration") and hasattr(system, "particles"):  # snapshots with a configuration
        lx, ly, lz, xy, xz, yz = map(float, system.configuration.box)
        flat = system.configuration.dimensions == 2  # whose third side is 1, not 0
        return Box(lx, ly, 0.0, xy) if flat else Box(lx, ly, lz, xy, xz, yz), system.particles.position
    if hasattr(system, "cell") and hasattr(system, "particles"):  # data collections
        box = Box.from_matrix(np.asarray(system.cell.matrix)[:, :3].tolist())
        return Box(box.Lx, box.Ly, 0.0, box.xy) if system.cell.is2D else box, system.particles.positions
    if hasattr(system, "box") and hasattr(system, "particles"):  # snapshots with a box
        b = system.box
        flat = getattr(b, "dimensions", 3) == 2
        return Box(b.Lx, b.Ly, 0.0, b.xy) if flat else Box(*[float(getattr(b, k)) for k in ("Lx", "Ly", "Lz", "xy", "xz", "yz")]), system.particles.position
    for name in ("points", "position", "positions"):
        if hasattr(system, "box") and hasattr(system, name):
            return system.box, getattr(system, name)
    raise TypeError(f"no box and points in a {type(system).__name__}")


def from_system(spark: SparkSession, system) -> tuple[Box, DataFrame]:
    """(box, points) from a (box, rows or DataFrame) pair or a frame object of a simulation package.

    Frame objects are told by their attributes, so no package needs to be installed.
    """
    box, points = _box_and_points(system)
    if not isinstance(points, DataFrame):
        rows = [(i, *[float(c) for c in p], *[0.0] * (3 - len(p))) for i, p in enumerate(points)]
        points = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    if not isinstance(box, (Box, dict)) and not hasattr(box, "__len__"):
        box = {k: getattr(box, k, 0.0) for k in ("Lx", "Ly", "Lz", "xy", "xz", "yz")}
    return Box.from_box(box), points


def periodic_buffer(points: DataFrame, box: Box, buffer, images: bool = False, include_input: bool = False) -> tuple[Box, DataFrame]:
    """The enlarged box, and replicas of the points around it (with the input, if asked).

    images: buffer counts whole replicas to each axis; otherwise it is a distance.
    """
    sizes = (buffer,) * 3 if np.isscalar(buffer) else tuple(buffer)
    reach = [int(s) if images else int(np.ceil(s / length)) for s, length in zip(sizes, box.lengths, strict=False)]
    ranges = [range(r + 1) if images else range(-r, r + 1) for r in reach] + ([range(1)] if box.is2d else [])
    shifts = F.array(*[F.struct(*[F.lit(v).alias(f"n{k}") for k, v in enumerate(s)]) for s in product(*ranges) if include_input or any(s)])
    rows = points.withColumn("_s", F.explode(shifts))
    at = box.unwrap(tuple(F.col(c) for c in "xyz"), [F.col(f"_s.n{k}") for k in range(box.dims)])
    rows = rows.select("point_id", *[v.alias(c) for v, c in zip(at, "xyz", strict=True)], F.col("_s.n0").alias("ix"), F.col("_s.n1").alias("iy"), F.col("_s.n2").alias("iz"))
    if images:
        wide = Box(box.Lx * (1 + reach[0]), box.Ly * (1 + reach[1]), 0.0 if box.is2d else box.Lz * (1 + reach[2]), box.xy, box.xz, box.yz)
        moved = wide.wrap(tuple(F.col(c) for c in "xyz"))
        return wide, rows.select("point_id", *[v.alias(c) for v, c in zip(moved, "xyz", strict=True)], "ix", "iy", "iz")
    wide = Box(box.Lx + 2 * sizes[0], box.Ly + 2 * sizes[1], 0.0 if box.is2d else box.Lz + 2 * sizes[2], box.xy, box.xz, box.yz)
    return wide, rows.where(wide.contains(tuple(F.col(c) for c in "xyz")))


#: Data names of a cell and of atoms' places in a crystallographic file: fixed values.
CIF_CELL = ("_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_angle_alpha", "_cell_angle_beta", "_cell_angle_gamma")
CIF_PLACE = ("_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z")
CIF_SYMMETRY = ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz")


def _cif_number(text: str) -> float:
    """A number without its uncertainty in brackets."""
    return float(text.partition("(")[0])


def _cif_loops(lines: list[str]):
    """Names and rows of each loop of a crystallographic file."""
    at = 0
    while at < len(lines):
        at += 1
        if lines[at - 1].strip().lower() != "loop_":
            continue
        names, rows = [], []
        while at < len(lines) and lines[at].strip().startswith("_"):
            names.append(lines[at].split()[0].lower())
            at += 1
        while at < len(lines) and (row := lines[at].strip()) and not row.startswith(("_", "#")) and row.lower() != "loop_" and not row.lower().startswith("data_"):
            rows.append([a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", row)])
            at += 1
        yield names, rows


def _symmetry(operation: str) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and shift of an operation like ``-x, y+1/2, z``."""
    turn, shift = np.zeros((3, 3)), np.zeros(3)
    for row, part in enumerate(operation.lower().replace(" ", "").split(",")):
        for sign, number, axis in re.findall(r"([+-]?)(\d+(?:\.\d+)?(?:/\d+)?)?\*?([xyz])?", part):
            if not number and not axis:
                continue
            top, _, below = number.partition("/")
            value = (float(top) / float(below or 1) if number else 1.0) * (-1 if sign == "-" else 1)
            if axis:
                turn[row, "xyz".index(axis)] += value
            else:
                shift[row] += value
    return turn, shift


def read_cif(spark: SparkSession, path: str) -> tuple[Box, DataFrame]:
    """The cell and all points in it of a crystallographic file: atoms' places under every symmetry, each place once.

    The file is one cell and read on the driver, through Spark's readers.
    """
    lines = [r["value"] for r in spark.read.text(path).collect()]
    cell = {w[0].lower(): _cif_number(w[1]) for w in (x.split() for x in lines) if len(w) == 2 and w[0].lower() in CIF_CELL}
    box = Box.from_lengths_and_angles(*[cell[k] for k in CIF_CELL])
    places, operations = [], ["x,y,z"]
    for names, rows in _cif_loops(lines):
        if CIF_PLACE[0] in names:
            places += [[_cif_number(r[names.index(k)]) for k in CIF_PLACE] for r in rows]
        for k in CIF_SYMMETRY:
            if k in names:
                operations = [r[names.index(k)] for r in rows]
    found: list[np.ndarray] = []
    for f in np.array(places).reshape(-1, 3):
        for turn, shift in map(_symmetry, operations):
            g = (turn @ f + shift) % 1
            if not any((np.abs((g - h + 0.5) % 1 - 0.5) < 1e-3).all() for h in found):
                found.append(g)
    f = (np.array(found).reshape(-1, 3) + 0.5) % 1 - 0.5
    at = f @ np.array(box.lattice_vectors)
    return box, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)], "point_id long, x double, y double, z double")
