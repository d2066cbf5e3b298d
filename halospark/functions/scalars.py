"""Column functions on particles, halos and cosmology."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

G_DENSITY = 2.7755e11  # critical density in h^2 Msun / Mpc^3 (a fixed value)


def decode_axis(offset: Column, lattice: Column, n) -> Column:
    """Position in [0, n) from a lattice coordinate and an offset."""
    return F.pmod(F.pmod(offset + lattice, F.lit(n)) + F.lit(n), F.lit(n))


def decode_position(dx: Column, dy: Column, dz: Column, indx: Column, mx: int, mxmy: int, n: int) -> list[Column]:
    """Absolute x, y, z from the lattice index and the offsets."""
    i, j, k = indx % mx, F.floor((indx % mxmy) / mx), F.floor(indx / mxmy)
    return [decode_axis(d, c, n) for d, c in ((dx, i), (dy, j), (dz, k))]


def lattice_index(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    """The index of a lattice point."""
    return (k * ny + j) * nx + i


def min_image(d: Column, box: int) -> Column:
    """Periodic distance along an axis."""
    return F.least(F.abs(d), F.lit(box) - F.abs(d))


def min_image_signed(d: Column, box: int) -> Column:
    """The signed nearest image of a difference of positions in the box."""
    return F.when(d * 2 > box, d - box).when(d * 2 < -box, d + box).otherwise(d)


def to_physical(r: Column, box_size: float, nx: int) -> Column:
    """Mesh units to Mpc/h."""
    return r * (box_size / nx)


def velocity_to_physical(v: Column, box_size: float, amax: float, a: Column, hubble: Column) -> Column:
    """Program velocity to km/s; hubble: E(a)."""
    return v * (box_size / amax) * a * a * 100.0 * hubble


def scale_de(a: Column, w0: float, wa: float) -> Column:
    """Dark-energy density over today's for w = w0 + wa (1 - a)."""
    return F.pow(a, F.lit(-3 * (1 + w0 + wa))) * F.exp(-3 * wa * (1 - a))


def hubble_e(a: Column, om: float, ol: float, w0: float = -1.0, wa: float = 0.0) -> Column:
    """P5: E at scale factor a (today: 1)."""
    z1 = 1 / a
    return F.sqrt(om * z1 * z1 * z1 + (1 - om - ol) * z1 * z1 + ol * scale_de(a, w0, wa))


def w_de(z: Column, w0: float, wa: float) -> Column:
    """Equation of state."""
    return w0 + wa * z / (1 + z)


def omega_m(a: Column, om: float, ol: float, w0: float = -1.0, wa: float = 0.0) -> Column:
    """P6."""
    e = hubble_e(a, om, ol, w0, wa)
    return om / (a * a * a) / (e * e)


def omega_de(a: Column, om: float, ol: float, w0: float = -1.0, wa: float = 0.0) -> Column:
    """P6."""
    e = hubble_e(a, om, ol, w0, wa)
    return ol * scale_de(a, w0, wa) / (e * e)


def redshift(a: Column, amax: float) -> Column:
    """P7."""
    return amax / a - 1


def redshift_of_step(step: Column, amax: float, astep: float) -> Column:
    """P7."""
    return amax / (1 + astep * (step - 1)) - 1


def particle_mass(om: float, box_size: float, nx: int, nspace: int) -> float:
    """Msun/h."""
    return G_DENSITY * om * (box_size / nx * nspace) ** 3


def set_flag(flags: Column, bit: int) -> Column:
    """P9."""
    return flags.bitwiseOR(F.lit(bit))


def unset_flag(flags: Column, bit: int) -> Column:
    """P9."""
    return flags.bitwiseAND(F.lit(~bit))


def toggle_flag(flags: Column, bit: int) -> Column:
    """P9."""
    return flags.bitwiseXOR(F.lit(bit))


def is_flag(flags: Column, bit: int) -> Column:
    """P9."""
    return flags.bitwiseAND(F.lit(bit)) != 0


#: Status bits and line bits of a halo link.
NEW_BORN, ALONE, ONE_OF_MULTI, MISSING = 1, 2, 4, 8
MAJOR_LINE, MINOR_LINE = 1, 2


def status_code(flags: Column) -> Column:
    """P10: one letter for a status: A alone, N new, J one of several, I missing, U unknown; the first that holds."""
    return F.when(is_flag(flags, ALONE), "A").when(is_flag(flags, NEW_BORN), "N").when(is_flag(flags, ONE_OF_MULTI), "J").when(is_flag(flags, MISSING), "I").otherwise("U")


def w4_kernel(r: Column, h: Column) -> Column:
    """The cubic spline of radius 2h, with unit integral over space."""
    q = r / h
    shape = F.when(q < 1, 1 - 1.5 * q * q + 0.75 * q * q * q).when(q < 2, 0.25 * (2 - q) * (2 - q) * (2 - q)).otherwise(0.0)
    return shape / (math.pi * h * h * h)


#: The disk survey's plane: turns about x and then y.
DISK_X, DISK_Y = math.atan(0.1), math.atan(0.23333)


def rotate_disk(x: Column, y: Column, z: Column) -> list[Column]:
    """P12."""
    cx, sx, cy, sy = math.cos(DISK_X), math.sin(DISK_X), math.cos(DISK_Y), math.sin(DISK_Y)
    y1, z1 = y * cx - z * sx, y * sx + z * cx
    return [x * cy + z1 * sy, y1, z1 * cy - x * sy]


def kinetic_term(v: Column, mean_v: Column, r: Column, hubble: float) -> Column:
    """Velocity about a halo's mean with the Hubble flow of the distance r from its centre."""
    return v - mean_v + hubble * r


def fisheye_pixel(dx: Column, dy: Column, dz: Column, size: int) -> tuple[Column, Column, Column]:
    """(angle from the z axis, column, row) of a direction in an equidistant image of the front hemisphere."""
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    angle = F.acos(dz / r)
    turn, scale = F.atan2(dy, dx), angle / (math.pi / 2) * (size / 2)
    return angle, F.floor(size / 2 + scale * F.cos(turn)).cast("long"), F.floor(size / 2 + scale * F.sin(turn)).cast("long")


def view_pixel(d: list[Column], ahead: list[Column], right: list[Column], up: list[Column], size: int) -> tuple[Column, Column, Column]:
    """(angle, column, row) of a direction for a camera that looks ahead, with unit vectors to its right and up."""
    along = lambda v: d[0] * v[0] + d[1] * v[1] + d[2] * v[2]
    return fisheye_pixel(along(right), along(up), along(ahead), size)


def sphericity(q: Column, s: Column) -> Column:
    """P17."""
    return F.sqrt(q * s)


def sphericity_residual(sph: Column, mass: Column) -> Column:
    """About the mean relation with mass."""
    return sph - (-0.07 * (F.log10(mass) - 12) + 0.68)
