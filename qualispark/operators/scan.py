"""Recursions z = A z + u over ordered rows, without a single-task pass.

Such a map composes: a chunk of k rows takes its start s to A^k s + e, where e
is where it ends from zero. One pass gives e and k of every chunk (a few rows
for the driver), which sets all starts; a second pass runs every chunk from its
own start. Inside a task rows go by blocks: the block's states from zero are one
matrix product, and only block starts follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.operators.ordered import _CHUNK, chunked

_BLOCK = 32


class System:
    """z = step z + gain u, and the weights of z (before the row) that forecast the row."""

    def __init__(self, step, gain, start, view=None):
        self.step = np.array(step, float)
        self.gain = np.array(gain, float).reshape(len(self.step), -1)
        self.start = np.array(start, float)
        self.view = None if view is None else np.array(view, float)

    def run(self, inputs: np.ndarray, z: np.ndarray) -> np.ndarray:
        """States after each row of ``inputs``, from state z."""
        m, n = len(self.step), len(inputs)
        pad = -n % _BLOCK
        u = np.concatenate((inputs @ self.gain.T, np.zeros((pad, m)))).reshape(-1, _BLOCK * m)
        powers = [np.eye(m)]
        for _ in range(_BLOCK):
            powers.append(self.step @ powers[-1])
        lower = np.zeros((_BLOCK, m, _BLOCK, m))
        for i in range(_BLOCK):
            for j in range(i + 1):
                lower[i, :, j, :] = powers[i - j]
        local = (u @ lower.reshape(_BLOCK * m, _BLOCK * m).T).reshape(-1, _BLOCK, m)
        starts = np.empty((len(local), m))
        for b in range(len(local)):
            starts[b] = z
            z = powers[_BLOCK] @ z + local[b, -1]
        rise = np.array(powers[1:])
        return (local + np.einsum("imk,bk->bim", rise, starts)).reshape(-1, m)[:n]


def _dealt(df: DataFrame, order: list[str], inputs: dict[str, Column]) -> DataFrame:
    cut = chunked(df.withColumns({f"__in_{k}": v.cast("double") for k, v in inputs.items()}), order)
    return cut.repartition(_CHUNK).sortWithinPartitions(_CHUNK, *(F.col(c).asc_nulls_last() for c in order))


def _parts(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[float, pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for chunk, part in batch.groupby(_CHUNK, sort=False):
            yield chunk, part, part[names].to_numpy(float)


def _starts(dealt: DataFrame, names: list[str], systems: list[System]) -> list[dict[float, np.ndarray]]:
    """For each system the state before the first row of each chunk."""

    def ends(batches):
        held: dict = {}
        for chunk, _, u in _parts(batches, names):
            n, z = held.get(chunk, (0, [np.zeros(len(s.step)) for s in systems]))
            held[chunk] = (n + len(u), [s.run(u, a)[-1] for s, a in zip(systems, z, strict=True)])
        yield pd.DataFrame({"chunk": list(held), "n": [n for n, _ in held.values()], "z": [np.concatenate(z).tolist() for _, z in held.values()]})

    found = dealt.select(_CHUNK, *names).mapInPandas(ends, "chunk double, n long, z array<double>").collect()  # a row a chunk
    states = [s.start for s in systems]
    out: list[dict[float, np.ndarray]] = [{} for _ in systems]
    for r in sorted(found, key=lambda r: r["chunk"]):
        at = 0
        for i, s in enumerate(systems):
            m = len(s.step)
            out[i][r["chunk"]] = states[i]
            states[i] = np.linalg.matrix_power(s.step, r["n"]) @ states[i] + np.array(r["z"][at : at + m])
            at += m
    for i, z in enumerate(states):
        out[i]["end"] = z
    return out


def affine(df: DataFrame, order: list[str], inputs: dict[str, Column], system: System, states: list[str]) -> DataFrame:
    """``df`` with the state after each row, in the order given. Inputs must not be null."""
    names = [f"__in_{k}" for k in inputs]
    dealt = _dealt(df, order, inputs)
    starts = _starts(dealt, names, [system])[0]
    kept = [f.name for f in df.schema]

    def states_of(batches):
        now = dict(starts)
        for chunk, part, u in _parts(batches, names):
            z = system.run(u, now[chunk])
            now[chunk] = z[-1]
            yield part[kept].assign(**{s: z[:, i] for i, s in enumerate(states)})

    schema = df.schema
    for s in states:
        schema = schema.add(s, "double")
    return dealt.mapInPandas(states_of, schema)


def squared_errors(df: DataFrame, order: list[str], inputs: dict[str, Column], target: str, systems: list[System]) -> tuple[list[float], list[np.ndarray], int]:
    """For each system the sum of squared errors of its forecasts of ``target`` (an input), its last state; the rows."""
    names = [f"__in_{k}" for k in inputs]
    dealt = _dealt(df, order, inputs).select(_CHUNK, *order, *names)
    starts = _starts(dealt, names, systems)
    aim = names.index(f"__in_{target}")

    def errors(batches):
        now = [dict(s) for s in starts]
        sums, n = np.zeros(len(systems)), 0
        for chunk, _, u in _parts(batches, names):
            n += len(u)
            for i, s in enumerate(systems):
                z = s.run(u, now[i][chunk])
                before = np.concatenate((now[i][chunk][None], z[:-1]))
                sums[i] += ((u[:, aim] - before @ s.view) ** 2).sum()
                now[i][chunk] = z[-1]
        yield pd.DataFrame({"system": range(len(systems)), "sse": sums, "n": n})

    rows = dealt.mapInPandas(errors, "system int, sse double, n long").groupBy("system").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).orderBy("system").collect()
    return [r["sse"] for r in rows], [s["end"] for s in starts], rows[0]["n"] if rows else 0
