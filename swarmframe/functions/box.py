"""Periodic boxes and their geometry as Column expressions (no UDF, so all of it stays in codegen)."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """A triclinic cell centred at the origin; tilt factors as in lattice vectors (Lx,0,0), (xy*Ly,Ly,0), (xz*Lz,yz*Lz,Lz)."""

    Lx: float
    Ly: float
    Lz: float = 0.0
    xy: float = 0.0
    xz: float = 0.0
    yz: float = 0.0
    periodic: tuple[bool, bool, bool] = (True, True, True)

    @classmethod
    def cube(cls, side: float) -> Box:
        return cls(side, side, side)

    @classmethod
    def square(cls, side: float) -> Box:
        return cls(side, side)

    @classmethod
    def from_matrix(cls, m) -> Box:
        """From three lattice vectors as columns."""
        lx, ly, lz = m[0][0], m[1][1], m[2][2]
        return cls(lx, ly, lz, m[0][1] / ly, m[0][2] / lz if lz else 0.0, m[1][2] / lz if lz else 0.0)

    @classmethod
    def from_lengths_and_angles(cls, a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> Box:
        """Edge lengths and angles in degrees."""
        ca, cb, cg = (cos(radians(t)) for t in (alpha, beta, gamma))
        lx = a
        a2x = b * cg
        ly = sqrt(b * b - a2x * a2x)
        a3x = c * cb
        a3y = (b * c * ca - a2x * a3x) / ly
        lz = sqrt(c * c - a3x * a3x - a3y * a3y)
        return cls(lx, ly, lz, a2x / ly, a3x / lz, a3y / lz)

    @classmethod
    def from_box(cls, box) -> Box:
        """From a Box, a mapping of its fields, a 3x3 matrix, or 2, 3 or 6 numbers."""
        if isinstance(box, Box):
            return box
        if isinstance(box, dict):
            return cls(**{k: float(box[k]) for k in ("Lx", "Ly", "Lz", "xy", "xz", "yz") if k in box})
        if len(box) == 3 and hasattr(box[0], "__len__"):
            return cls.from_matrix(box)
        if len(box) in (2, 3, 6):
            return cls(*map(float, box))
        raise ValueError("a box has 2, 3 or 6 numbers")

    @property
    def is2d(self) -> bool:
        return self.Lz == 0

    @property
    def dims(self) -> int:
        return 2 if self.is2d else 3

    @property
    def lengths(self) -> tuple[float, ...]:
        return (self.Lx, self.Ly, self.Lz)[: self.dims]

    @property
    def volume(self) -> float:
        return self.Lx * self.Ly * (1 if self.is2d else self.Lz)

    @property
    def plane_distances(self) -> tuple[float, ...]:
        d = (self.Lx / sqrt(1 + self.xy**2 + (self.xy * self.yz - self.xz) ** 2), self.Ly / sqrt(1 + self.yz**2), self.Lz)
        return d[: self.dims]

    @property
    def lattice_vectors(self) -> tuple[tuple[float, float, float], ...]:
        return ((self.Lx, 0.0, 0.0), (self.Ly * self.xy, self.Ly, 0.0), (self.Lz * self.xz, self.Lz * self.yz, self.Lz))

    def to_dict(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in ("Lx", "Ly", "Lz", "xy", "xz", "yz")}

    def to_matrix(self) -> list[list[float]]:
        return [[self.Lx, self.xy * self.Ly, self.xz * self.Lz], [0.0, self.Ly, self.yz * self.Lz], [0.0, 0.0, self.Lz]]

    def __mul__(self, scale: float) -> Box:
        return Box(self.Lx * scale, self.Ly * scale, self.Lz * scale, self.xy, self.xz, self.yz, self.periodic)

    # ---------------------------------------------------- expressions

    def _linear(self, v: tuple[Column, Column, Column]) -> list[Column]:
        """A difference vector in units of the lattice vectors."""
        x, y, z = v
        if self.is2d:
            return [((x - self.xy * y) if self.xy else x) / self.Lx, y / self.Ly]
        a = x
        if self.xz - self.yz * self.xy:
            a = a - (self.xz - self.yz * self.xy) * z
        if self.xy:
            a = a - self.xy * y
        b = y - self.yz * z if self.yz else y
        return [a / self.Lx, b / self.Ly, z / self.Lz]

    def fractional(self, v) -> list[Column]:
        """Fractional coordinates of a position: 0 to 1 inside the box."""
        return [f + 0.5 for f in self._linear(v)]

    def absolute(self, f) -> tuple[Column, ...]:
        """The position of fractional coordinates."""
        x, y = (f[0] - 0.5) * self.Lx, (f[1] - 0.5) * self.Ly
        z = F.lit(0.0) if self.is2d else (f[2] - 0.5) * self.Lz
        if self.xy:
            x = x + self.xy * y
        if self.xz:
            x = x + self.xz * z
        if self.yz:
            y = y + self.yz * z
        return x, y, z

    def images(self, v) -> list[Column]:
        """The cell that a position lies in, for each axis; 0 along axes without a period."""
        found = [F.floor(f + 0.5).cast("int") if p else F.lit(0) for f, p in zip(self._linear(v), self.periodic, strict=False)]
        return found + [F.lit(0)] * (3 - len(found))

    def _shift(self, v, n, sign: int) -> tuple[Column, Column, Column]:
        out = list(v)
        for k, vector in enumerate(self.lattice_vectors[: self.dims]):
            if n[k] is None:
                continue
            for c in range(3):
                if vector[c]:
                    out[c] = out[c] + n[k] * (sign * vector[c])
        return tuple(out)

    def wrap(self, v) -> tuple[Column, Column, Column]:
        """The image of a vector nearest to the origin in fractional coordinates."""
        n = [F.floor(f + 0.5) if p else None for f, p in zip(self._linear(v), self.periodic, strict=False)]
        return self._shift(v, n, -1)

    def unwrap(self, v, images) -> tuple[Column, Column, Column]:
        return self._shift(v, images, 1)

    def contains(self, v) -> Column:
        inside = F.lit(True)
        for f in self._linear(v):
            inside = inside & (f >= -0.5) & (f < 0.5)
        return inside

    def distance(self, a, b) -> Column:
        d = self.wrap(tuple(q - p for p, q in zip(a, b, strict=True)))
        return F.sqrt(sum((c * c for c in d[1:]), d[0] * d[0]))

    def center_of_mass(self, points: DataFrame, by: list[str], mass: str | None = None) -> DataFrame:
        """by, x, y, z: the circular mean of each group's positions."""
        m = F.col(mass) if mass else F.lit(1.0)
        angles = [f * 6.283185307179586 for f in self.fractional(tuple(F.col(c) for c in XYZ))]
        sums = [a for k, t in enumerate(angles) for a in (F.sum(m * F.cos(t)).alias(f"_c{k}"), F.sum(m * F.sin(t)).alias(f"_s{k}"))]
        fractions = [F.atan2(f"_s{k}", f"_c{k}") / 6.283185307179586 for k in range(self.dims)]
        at = self.wrap(self.absolute(fractions))
        return points.groupBy(*by).agg(*sums).select(*by, *[c.alias(n) for c, n in zip(at, XYZ, strict=True)])
