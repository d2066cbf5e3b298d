"""Power spectra and correlation functions of grids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODE = "kx long, ky long, kz long, re double, im double"


def fourier_modes(grid: DataFrame, n: int) -> DataFrame:
    """(kx, ky, kz, re, im), kx from 0 to n/2 and ky, kz from 0 to n - 1, of a sparse n^3 grid.

    The transform is taken axis by axis: lines of n cells are grouped, transformed and dealt out again for the next axis, so a task
    holds lines, never the mesh."""

    def along(rows: DataFrame, place: str) -> DataFrame:
        """Transforms along an axis, many lines at a time; rows come sorted by line."""
        line = [c for c in ("kx", "ky", "kz") if c != place]

        def run(batches):
            held = None
            for b in batches:
                now = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                key = now[line[0]].to_numpy() * n + now[line[1]].to_numpy()
                new = np.flatnonzero(key[1:] != key[:-1])
                upto = int(new[-1]) + 1 if len(new) else 0
                if upto:
                    yield from whole(now.slice(0, upto))
                held = now.slice(upto)
            if held is not None and held.num_rows:
                yield from whole(held)

        def whole(part):
            u, v = (part[c].to_numpy() for c in line)
            first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
            for lo in range(0, len(first), 4096):
                rows = slice(int(first[lo]), int(first[lo + 4096]) if lo + 4096 < len(first) else len(u))
                many = min(4096, len(first) - lo)
                lines = np.zeros((many, n), complex)
                lines[of[rows] - lo, part[place].to_numpy()[rows]] = part["re"].to_numpy()[rows] + 1j * part["im"].to_numpy()[rows]
                f = np.fft.fft(lines, axis=1)[:, : n // 2 + 1 if place == "kx" else n]
                m = f.shape[1]
                cols = {line[0]: np.repeat(u[first[lo : lo + many]], m), line[1]: np.repeat(v[first[lo : lo + many]], m), place: np.tile(np.arange(m), many), "re": f.real.ravel(), "im": f.imag.ravel()}
                yield from pa.table({c: cols[c] for c in ("kx", "ky", "kz", "re", "im")}).to_batches()

        return rows.repartition(*line).sortWithinPartitions(*line).mapInArrow(run, MODE)

    rows = grid.select(F.col("ix").cast("long").alias("kx"), F.col("iy").cast("long").alias("ky"), F.col("iz").cast("long").alias("kz"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return along(along(along(rows, "kx"), "ky"), "kz")


def power_spectrum(modes: DataFrame, n: int, window: int = 3, hermitian: bool = False) -> DataFrame:
    """(k, weight, pk): the mean squared modulus over n^6 of the modes at wave number k, each split between the two nearest whole numbers.

    window: the power of sinc that the deposit has per axis (tsc 3, cic 2, none 0), divided out. hermitian: modes off the planes
    kx = 0 and n/2 count twice, as their conjugates aren't listed."""
    signed = lambda k: F.when(F.col(k) > n // 2, F.col(k) - n).otherwise(F.col(k)).cast("double")
    rows = modes.select(F.col("kx").cast("double").alias("a"), signed("ky").alias("b"), signed("kz").alias("c"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / float(n) ** 6).alias("p"))
    for k in "abc":
        x = F.lit(math.pi / n) * F.col(k)
        rows = rows.withColumn(f"w{k}", F.when((F.col(k) == 0) | F.lit(window == 0), 1.0).otherwise(F.pow(F.sin(x) / x, F.lit(float(window)))))
    rows = rows.withColumn("p", F.col("p") / F.pow(F.col("wa") * F.col("wb") * F.col("wc"), F.lit(2.0))).withColumn("wave", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")))
    times = F.when(F.lit(hermitian) & (F.col("a") > 0) & (F.col("a") < n // 2), 2.0).otherwise(1.0)
    near = F.floor(F.col("wave") + 0.5)
    off = F.col("wave") - near
    split = F.array(F.struct(near.alias("k"), (times * (1 - F.abs(off))).alias("w")), F.struct((near + F.when(off < 0, -1).otherwise(1)).alias("k"), (times * F.abs(off)).alias("w")))
    parts = rows.select("p", F.explode(split).alias("s")).select(F.col("s.k").cast("long").alias("k"), F.col("s.w").alias("w"), "p").filter(F.col("k").between(1, n) & (F.col("w") > 0))
    return parts.groupBy("k").agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("pk"))


def sigma_r(spectrum: DataFrame, radius: float, n: int) -> DataFrame:
    """The deviation in top-hat spheres of the given radius in cells."""
    t = F.col("k") * (2 * math.pi * radius / n)
    window = (F.sin(t) - t * F.cos(t)) * (F.sin(t) - t * F.cos(t)) / F.pow(t, F.lit(6.0))
    return spectrum.agg(F.sqrt(36 * math.pi * F.sum(F.col("pk") * F.col("k") * F.col("k") * window)).alias("sigma"))


def correlation(spectrum: DataFrame, n: int) -> DataFrame:
    """(r, xi) for separations of 1 to n cells, by the sine transform of the spectrum (a row for each k)."""
    bins = spectrum.select(F.col("k").alias("r"))
    both = bins.crossJoin(F.broadcast(spectrum.select("k", "pk")))  # n rows by n rows
    return both.groupBy("r").agg((2.0 * n * F.sum(F.sin(F.col("k") * F.col("r") * (2 * math.pi / n)) * F.col("k") * F.col("pk")) / F.first("r")).alias("xi"))


def slope(corr: DataFrame, r1: int = 2, r2: int = 3) -> DataFrame:
    """The logarithmic slope between two separations; null unless both are positive."""
    v = corr.agg(F.max(F.when(F.col("r") == r1, F.col("xi"))).alias("a"), F.max(F.when(F.col("r") == r2, F.col("xi"))).alias("b"))
    return v.select(F.when((F.col("a") > 0) & (F.col("b") > 0), (F.log("b") - F.log("a")) / (math.log(r2) - math.log(r1))).alias("slope"))
