"""Hands between their frames: rotations by six numbers, places, bone directions and bone lengths, joints rebuilt along their tree.

Rows hold a window of a hand as arrays (kept, r, t, fingers, joints). Runs of kept slots are interpolated each for itself; new
times up to the slot after a run count to it and are extrapolated. All else takes the values of the first slot
that isn't kept, and isn't kept either. Windows that share their kept slots are computed together, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.operators.episodes import pchip

#: Fixed value: 21 joints in five chains of four from the wrist.
PARENTS = [-1] + [0 if i % 4 == 1 else i - 1 for i in range(1, 21)]
STATE = "struct<kept:array<boolean>,r:array<array<double>>,t:array<array<double>>,fingers:array<array<array<double>>>,joints:array<array<double>>>"


def quadratic(at: np.ndarray, values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The quadratic spline through points whose pieces meet halfway between them, but for the first and last halfway place."""
    inner = ((at[1:] + at[:-1]) / 2)[1:-1]
    knots = np.concatenate([[at[0]] * 3, inner, [at[-1]] * 3]).astype(float)

    def basis(x: np.ndarray) -> np.ndarray:
        piece = np.clip(np.searchsorted(knots, x, side="right") - 1, 2, len(knots) - 4)
        out = np.zeros((len(x), len(knots) - 3))
        a, b, c, d = (knots[piece + i] for i in (-1, 0, 1, 2))
        low, high = (c - x) / (c - b), (x - b) / (c - b)
        rows = np.arange(len(x))
        out[rows, piece - 2] = low * (c - x) / (c - a)
        out[rows, piece - 1] = low * (x - a) / (c - a) + high * (d - x) / (d - b)
        out[rows, piece] = high * (x - b) / (d - b)
        return out

    return basis(where) @ np.linalg.solve(basis(at.astype(float)), values)


def linear(at: np.ndarray, values: np.ndarray, where: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(at, where, side="right") - 1, 0, len(at) - 2)
    share = (where - at[i]) / (at[i + 1] - at[i])
    return values[i] + (values[i + 1] - values[i]) * share[:, None]


def monotone(at: np.ndarray, values: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.stack([pchip(at, v, where) for v in values.T], 1)


METHODS = {"pchip": monotone, "linear": linear, "quadratic": quadratic}


def upsampled(points: np.ndarray, kept: np.ndarray, factor: float, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Points (N x D) at int((N - 1) factor + 1) even times, and which of these are kept; runs too short for the method are linear."""
    n = len(points)
    times = np.linspace(0, n - 1, int((n - 1) * factor + 1))
    out, mask = np.zeros((len(times), points.shape[1])), np.zeros(len(times), bool)
    edges = np.diff(np.concatenate([[0], kept.astype(int), [0]]))
    for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        own = (times >= start) & (times <= end)
        at, values = np.arange(start, end), points[start:end]
        if len(at) == 1:
            out[own] = values[0]
        else:
            out[own] = METHODS[method if len(at) > 2 else "linear"](at, values, times[own])
        mask |= own
    gone = np.flatnonzero(~kept)
    out[~mask] = points[gone[0] if len(gone) else 0]
    return out, mask


def from_six(six: np.ndarray) -> np.ndarray:
    """Rotations (nine numbers) from the six of their first two rows."""
    a, b = six[..., :3], six[..., 3:]
    a = a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
    b = b - (a * b).sum(-1, keepdims=True) * a
    b = b / np.maximum(np.linalg.norm(b, axis=-1, keepdims=True), 1e-12)
    return np.concatenate([a, b, np.cross(a, b)], -1)


def upsampled_hands(kept: np.ndarray, r: np.ndarray, t: np.ndarray, fingers: np.ndarray, joints: np.ndarray, factor: float, method: str) -> dict:
    """Windows that share their kept slots (arrays of windows x slots x ...) at finer times; joints keep the lengths of their bones."""
    rows, n = r.shape[:2]

    def finer(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = x.reshape(rows, n, -1)
        out, mask = upsampled(own.transpose(1, 0, 2).reshape(n, -1), kept, factor, method)
        return out.reshape(len(out), rows, own.shape[2]).transpose(1, 0, 2), mask

    turned, mask = finer(r[..., :6])
    m = len(mask)
    bent = finer(fingers[..., :6])[0].reshape(rows, m, -1, 6)
    bones = np.zeros_like(joints)
    for i, p in enumerate(PARENTS[: joints.shape[2]]):
        if p >= 0:
            bones[:, :, i] = joints[:, :, i] - joints[:, :, p]
    lengths = finer(np.linalg.norm(bones, axis=-1))[0]
    ways = finer(bones)[0].reshape(rows, m, -1, 3)
    ways = ways / (np.linalg.norm(ways, axis=-1, keepdims=True) + 1e-8) * lengths[..., None]
    built = np.zeros_like(ways)
    for i, p in enumerate(PARENTS[: joints.shape[2]]):
        if p >= 0:
            built[:, :, i] = built[:, :, p] + ways[:, :, i]
    return {"kept": np.broadcast_to(mask, (rows, m)), "r": from_six(turned), "t": finer(t)[0], "fingers": from_six(bent), "joints": built.reshape(rows, m, -1)}


def flat(column: pa.Array) -> np.ndarray:
    """All numbers of nested lists, in order."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False)


def nested(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """An array of any dimensions as lists of lists, a list by its first one; `null` tells which of its numbers are null."""
    hidden = None if null is None or not null.any() else np.broadcast_to(null, values.shape).reshape(-1)
    column = pa.array(np.ascontiguousarray(values).reshape(-1), mask=hidden)
    for n in reversed(values.shape[1:]):
        column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(column) + 1, n, dtype=np.int32)), column)
    return column


#: Windows that a task computes at once: some MB of numbers.
AT_ONCE = 512
NAMES = ("kept", "r", "t", "fingers", "joints")


def _finer_rows(parts: list[pa.Array], factor: float, method: str) -> pa.Array:
    """The struct of some windows of any length, in their order."""
    whole = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
    lengths = np.where(whole, parts[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(lengths):
        groups.setdefault(tuple(parts[0][int(i)].as_py()), []).append(int(i))
    columns, order = [], []
    for kept, rows in groups.items():
        n, own = len(kept), [p.take(pa.array(rows)) for p in parts]
        r, t, f, j = (flat(p).astype(float, copy=False) for p in own[1:])
        done = upsampled_hands(np.array(kept, bool), r.reshape(len(rows), n, 9), t.reshape(len(rows), n, 3), f.reshape(len(rows), n, -1, 9), j.reshape(len(rows), n, -1, 3), factor, method)
        columns.append([nested(done[c]) for c in NAMES])
        order += rows
    gone = np.flatnonzero(lengths == 0)
    types = [pa.list_(pa.bool_()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.list_(pa.float64()))), pa.list_(pa.list_(pa.float64()))]
    columns.append([pa.nulls(len(gone), t) for t in types])
    back = pa.array(np.argsort(np.array(order + gone.tolist(), int), kind="stable"))
    return pa.StructArray.from_arrays([pa.concat_arrays([c[k].cast(types[k]) for c in columns]).take(back) for k in range(len(NAMES))], NAMES)


def upsample(kept: Column, r: Column, t: Column, fingers: Column, joints: Column, factor: float, method: str = "pchip") -> Column:
    """A hand's window (arrays over its slots; joints in hand space, flat) at finer times, as a struct of arrays; null where any part is."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method}")

    @F.arrow_udf(STATE)
    def run(kept: pa.Array, r: pa.Array, t: pa.Array, fingers: pa.Array, joints: pa.Array) -> pa.Array:
        parts = [kept, r, t, fingers, joints]
        return pa.concat_arrays([_finer_rows([p.slice(i, AT_ONCE) for p in parts], factor, method) for i in range(0, max(len(kept), 1), AT_ONCE)])

    return run(kept, r, t, fingers, joints)
