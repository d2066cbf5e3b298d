"""Groups inside tasks: many small ones one after the other, each whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task of by_group() has on average; pairs of rows that a task looks at together.
SHARE, PAIRS_TOGETHER = 30_000, 1_000_000


def by_group(rows: DataFrame, group: str, whole: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(small, large, tasks): the rows of groups of up to `whole` rows, dealt by group alone to so many tasks, and those of larger ones, as they
    are, or None if there are none.

    What is aggregated or joined by the group and more columns is not shuffled again from there on, and a task's rows stay few, whatever
    a group's rows are expanded to."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    most, total = (n or 0 for n in sizes.agg(F.max("_n"), F.sum("_n")).first())
    tasks = max(1, -(-total // SHARE))
    if most <= whole:
        return rows.repartition(tasks, group), None, tasks
    over = F.col("_n") > whole
    return rows.join(sizes.filter(~over), group, "left_semi").repartition(tasks, group), rows.join(sizes.filter(over), group, "left_semi"), tasks


def runs_of(batches, key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, ends): batches of rows that are sorted by `key`, put together so that no key's rows are in two of them; ends: where each
    key's rows end. What is held is a batch and a key's rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))  # where the last key's rows begin
        if held and (cut or k[0] != last):
            whole = pa.Table.from_batches([*held, b.slice(0, cut)])
            yield whole, _ends(whole[key].to_numpy())
            held = []
        elif cut:
            whole = pa.Table.from_batches([b.slice(0, cut)])
            yield whole, _ends(whole[key].to_numpy())
        held.append(b.slice(cut))
        last = k[-1]
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _ends(whole[key].to_numpy())


def _ends(k: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))


def stacks(starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The places of runs' rows, a line for each run: runs of one size together, but no more than have PAIRS_TOGETHER pairs."""
    for n in np.unique(sizes[sizes > 0]).tolist():
        these, step = starts[sizes == n], max(1, PAIRS_TOGETHER // (n * n))
        for s in range(0, len(these), step):
            yield these[s : s + step, None] + np.arange(n)


def pulls(place: np.ndarray, eps: float) -> np.ndarray:
    """The sums of 1/sqrt(r^2 + eps^2) over a run's other rows, for runs of one size; place: (runs, rows, 3)."""
    r2 = np.zeros((*place.shape[:2], place.shape[1]))
    for k in range(3):
        d = place[:, :, None, k] - place[:, None, :, k]
        r2 += d * d
    f = 1 / np.sqrt(r2 + eps * eps)
    n = np.arange(place.shape[1])
    f[:, n, n] = 0
    return f.sum(axis=2)
