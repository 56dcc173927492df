"""Training rows of two hands: the frames around an anchor, as actions, masks and states.

Frames are (episode, frame_idx, view_r, view_t, left, right, left_range, right_range). frame_idx runs from 0 without
gaps; view_r and view_t turn world into camera space. A hand is a struct (kept, r, t, fingers, joints, shape): rotations
are nine numbers by rows, fingers an array of them, joints an array of points in world space, shape numbers
that hold for the episode. A range is a struct (start, end) of the frames, both included, that a hand's window may use.

A window has W = past + 1 + future slots, and one after them. Tasks read their episodes' frames in order, a frame once, and compute
the windows of some hundred anchors together; a task holds a batch of frames, however long an episode is.

Hands are some KB a frame. Where they follow from less, frames have what they follow from instead of left and right, and a function `made` of a
batch of frames and a side gives its structs inside the task, so that hands are neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import geometry as g
from reelspan.operators.episodes import by_frame

HANDS = ("left", "right")
#: Parts of a hand that are lists of lists.
NESTED = ("fingers", "joints")
#: What makes a side's hands of a batch of frames.
Made = Callable[[pa.RecordBatch, str], pa.StructArray]
#: Numbers of a hand's wrist in an action, and of all features of actions and of states.
WRIST, ACTIONS, STATES = 6, 192, 212


def check(mode: str, kind: str) -> None:
    if mode not in ("step", "anchor") or kind not in ("angle", "keypoints"):
        raise ValueError(f"mode is step or anchor, not {mode}; kind is angle or keypoints, not {kind}")


def training_rows(frames: DataFrame, past: int, future: int, mode: str = "step", kind: str = "angle", made: Made | None = None) -> DataFrame:
    """episode, frame_idx, absolute and relative (W rows of both hands' numbers), mask (W x 2), state and state_mask (2) for each frame as anchor.

    mode: actions against the frame before (step) or the anchor; kind: finger angles, or joints in hand space (keypoints), as held numbers.
    Slots outside a hand's range hold its nearest frame and count as not kept; the slot after the window does so only where the window itself left
    its range. Slots that aren't kept have identity rotations; their places stay. Rows of a slot or state whose numbers aren't all known are null.
    """
    rows = "array<array<double>>"
    schema = f"{keys(frames)}, absolute {rows}, relative {rows}, mask array<array<boolean>>, state array<double>, state_mask array<boolean>"
    return computed(frames, past, future, mode, kind, _lists, schema, made=made)


def computed(frames: DataFrame, past: int, future: int, mode: str, kind: str, use: Callable[[Block], pa.RecordBatch], schema: str, actions: bool = True, states: bool = True, made: Made | None = None) -> DataFrame:
    """What `use` makes of each block of training rows inside the tasks, where the rows themselves would be many and wide."""
    check(mode, kind)
    parts = ["kept", "r", "t", *(["fingers"] if actions or kind == "angle" else []), *(["joints"] if kind == "keypoints" else []), *(["shape"] if states else [])]
    if made:  # all other columns
        hands = [c for c in frames.columns if c not in ("episode", "frame_idx", "view_r", "view_t", "left_range", "right_range")]
    else:
        hands = [(F.flatten(F.col(f"{s}.{c}")) if c in NESTED else F.col(f"{s}.{c}")).alias(f"{s}_{c}") for s in HANDS for c in parts]
    ranges = [F.col(f"{s}_range.{e}").cast("long").alias(f"{s}_{e}") for s in HANDS for e in ("start", "end")]
    # the window function also puts each episode into one task, in order
    following = F.lead("frame_idx").over(by_frame()).alias("next")
    rows = frames.select("episode", "frame_idx", following, "view_r", "view_t", *ranges, *hands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, first, last in anchored(with_hands(batches, parts, made) if made else batches, past, future):
            for at in range(first, last, AT_ONCE):
                stop = min(at + AT_ONCE, last)
                low = max(0, at - past)
                yield use(block(held.slice(low, stop + future + 1 - low), at - low, stop - low, past, future, mode, kind, actions, states))

    return rows.mapInArrow(run, schema)


def keys(frames: DataFrame) -> str:
    return ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("episode", "frame_idx"))


#: Anchors that are computed at once: some MB of numbers; and frames whose hands are made at once.
AT_ONCE, MADE_AT_ONCE = 512, 2048


def with_hands(batches: Iterator[pa.RecordBatch], parts: list[str], made: Made) -> Iterator[pa.RecordBatch]:
    """Frames with the named parts of their made hands as columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, MADE_AT_ONCE):
            rows = batch.slice(at, MADE_AT_ONCE)
            columns = {c: rows.column(c) for c in ("episode", "frame_idx", "next", "view_r", "view_t", *[f"{s}_{e}" for s in HANDS for e in ("start", "end")])}
            for side in HANDS:
                hand = made(rows, side)
                # flatten also makes the parts of a missing hand null
                found = dict(zip([f.name for f in hand.type], hand.flatten(), strict=True))
                columns |= {f"{side}_{c}": flattened(found[c]) if c in NESTED else found[c] for c in parts}
            yield pa.RecordBatch.from_pydict(columns)


def flattened(column: pa.Array) -> pa.Array:
    """Spark's flatten: lists of lists as one list a row, null where one of them is."""

    def up_to(counts: pa.Array) -> np.ndarray:
        return np.append(0, np.cumsum(counts.fill_null(0).to_numpy(zero_copy_only=False)))

    inner = column.flatten()
    rows = up_to(column.value_lengths())
    gone = np.diff(up_to(inner.is_null().cast(pa.int32()))[rows]) > 0
    mask = gone | column.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(up_to(inner.value_lengths())[rows].astype(np.int32)), inner.flatten(), mask=pa.array(mask))


def anchored(batches: Iterator[pa.RecordBatch], past: int, future: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Rows with the first and last place (not included) of the anchors whose neighbours are all among them; each row is an anchor once."""
    held, done = None, 0
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        ready = held.num_rows - (future + 1)
        if ready > done:
            yield held, done, ready
            low = max(0, ready - past)
            held, done = held.slice(low), ready - low
    if held is not None and held.num_rows > done:
        yield held, done, held.num_rows


@dataclass
class Hand:
    """A hand's part of a block of A anchors: valid (A x W), absolute and relative (A x W x numbers), kept (A), state (A x numbers).

    Flags are 1, 0, or -1 for unknown; `no_` tells which rows of numbers are null.
    """

    valid: np.ndarray | None = None
    absolute: np.ndarray | None = None
    no_absolute: np.ndarray | None = None
    relative: np.ndarray | None = None
    no_relative: np.ndarray | None = None
    kept: np.ndarray | None = None
    state: np.ndarray | None = None
    no_state: np.ndarray | None = None


@dataclass
class Block:
    """Anchors as Arrow columns, and their two hands."""

    episode: pa.Array
    frame_idx: pa.Array
    hands: list[Hand]


@dataclass
class Numbers:
    """Lists of one length as rows of an array; which of them are null (absent), and which are or hold a null (gone)."""

    values: np.ndarray
    absent: np.ndarray
    gone: np.ndarray


def numbers(column: pa.Array) -> Numbers:
    absent = column.is_null().to_numpy(zero_copy_only=False)
    values = column.flatten()
    sizes = set(column.value_lengths().drop_null().unique().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"lists of one part have one length, not {sorted(sizes)}")
    width = sizes.pop() if sizes else 0
    out, gone = np.zeros((len(absent), width)), absent.copy()
    out[~absent] = values.to_numpy(zero_copy_only=False).reshape(-1, width)
    if values.null_count:
        gone[~absent] = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)
    return Numbers(out, absent, gone)


def flags(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SQL's AND of flags."""
    return np.where((a == 0) | (b == 0), 0, np.minimum(a, b))


def euler(m: list[np.ndarray] | dict[int, np.ndarray]) -> np.ndarray:
    """Euler angles, as geometry.to_euler, on a last axis of three."""
    middle = np.fmin(np.maximum(m[6], -1.0), 1.0)
    return np.stack([np.arctan2(m[7], m[8]), -np.arcsin(middle), np.arctan2(m[3], m[0])], -1)


def turn(after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Euler angles of after times before transposed, of arrays whose first axis has the nine numbers."""
    return euler({3 * r + c: after[3 * r] * before[3 * c] + after[3 * r + 1] * before[3 * c + 1] + after[3 * r + 2] * before[3 * c + 2] for r, c in ((2, 1), (2, 2), (2, 0), (1, 0), (0, 0))})


def block(rows: pa.RecordBatch, first: int, last: int, past: int, future: int, mode: str, kind: str, actions: bool, states: bool) -> Block:
    """The anchors `first` to `last` (not included) of rows that hold all their neighbours."""
    n, at = rows.num_rows, np.arange(first, last)
    frame = rows.column("frame_idx").to_numpy(zero_copy_only=False).astype(np.int64)
    ends = rows.column("next").is_null().to_numpy(zero_copy_only=False)
    place = np.arange(n)
    opens = np.append(True, ends[:-1])
    start = np.maximum.accumulate(np.where(opens, place, 0))[at]
    end = np.minimum.accumulate(np.where(ends, place, n - 1)[::-1])[::-1][at]
    view_r, view_t = numbers(rows.column("view_r")), numbers(rows.column("view_t"))
    unseen = (view_r.gone | view_t.gone)[at]
    view = (view_r.values[at].T[:, :, None], view_t.values[at].T[:, :, None])
    steps = np.arange(-past, future + 2)
    hands = []
    for side in HANDS:
        # a hand without a range has no slots
        low, high = (rows.column(f"{side}_{e}").fill_null(-(1 << 40)).to_numpy()[at][:, None] for e in ("start", "end"))
        own = frame[at][:, None] + steps
        slot = np.minimum(np.maximum(own, low), high)
        target = at[:, None] + slot - frame[at][:, None]
        near = (target >= np.maximum(start, at - past)[:, None]) & (target <= np.minimum(end, at + future + 1)[:, None])
        target = np.where(near, target, 0)
        outside = (own < low) | (own > high)
        left_range = (frame[at][:, None] - past < low) | (frame[at][:, None] + future > high)
        outside[:, -1:] = left_range & (own[:, -1:] > high)
        hands.append(_hand(rows, side, at, target, near, slot, outside, view, unseen, past, mode, kind, actions, states))
    return Block(rows.column("episode").slice(first, last - first), rows.column("frame_idx").slice(first, last - first), hands)


def _hand(rows, side, at, target, near, slot, outside, view, unseen, past, mode, kind, actions, states) -> Hand:
    def column(c: str) -> Numbers:
        return numbers(rows.column(f"{side}_{c}"))

    kept, r, t = flags(rows.column(f"{side}_kept")), column("r"), column("t")
    fingers = column("fingers") if actions or kind == "angle" else None
    bones = fingers.values.reshape(len(kept), -1, 9).transpose(2, 0, 1) if fingers else None  # nine, frames, fingers
    if kind == "angle":
        held, absent, gone = euler(bones).reshape(len(kept), -1), fingers.absent, fingers.gone
        loose = np.zeros_like(held)
    else:
        joints = column("joints")
        absent, gone = joints.absent, joints.gone | t.gone
        p = joints.values.reshape(len(kept), -1, 3) - t.values[:, None, :]
        loose, m = p.reshape(len(kept), -1), r.values[:, :, None]
        held = np.stack([m[:, i] * p[:, :, 0] + m[:, 3 + i] * p[:, :, 1] + m[:, 6 + i] * p[:, :, 2] for i in range(3)], -1).reshape(loose.shape)
    gone = gone | r.gone | t.gone
    k = both(np.where(near, kept[target], -1), np.where(outside, 0, 1))
    on = k == 1
    vr, vt = view
    m = r.values[target].transpose(2, 0, 1)
    seen = np.stack([np.where(on, vr[3 * i] * m[c] + vr[3 * i + 1] * m[3 + c] + vr[3 * i + 2] * m[6 + c], vr[3 * i + c]) for i in range(3) for c in range(3)])
    x = t.values[target].transpose(2, 0, 1)
    places = np.stack([vr[3 * i] * x[0] + vr[3 * i + 1] * x[1] + vr[3 * i + 2] * x[2] + vt[i] for i in range(3)], -1)
    none, lost = ~near | absent[target], ~near | gone[target] | unseen[:, None]
    out = Hand()
    if actions:
        base = slice(0, -1) if mode == "step" else slice(past, past + 1)
        out.valid = both(k[:, base], k[:, 1:])
        valid = (out.valid == 1)[:, :, None]
        out.absolute = np.where(valid, np.concatenate([places[:, 1:], euler(seen[:, :, 1:]), np.where(on[:, 1:, None], held[target[:, 1:]], loose[target[:, 1:]])], -1), 0.0)
        if mode == "step":  # at a range's end a slot may follow itself
            onward = turn(bones[:, 1:], bones[:, :-1]).reshape(len(kept) - 1, bones.shape[2] * 3)
            onward = np.concatenate([onward, np.zeros((1, onward.shape[1]))])
            bent = np.where((slot[:, 1:] == slot[:, :-1])[:, :, None], 0.0, onward[target[:, :-1]])
        else:
            bent = turn(bones[:, target[:, 1:]], bones[:, target[:, base]]).reshape(len(at), -1, bones.shape[2] * 3)
        out.relative = np.where(valid, np.concatenate([places[:, 1:] - places[:, base], turn(seen[:, :, 1:], seen[:, :, base]), bent], -1), 0.0)
        out.no_absolute = none[:, 1:] | (valid[:, :, 0] & lost[:, 1:])
        unbent = fingers.gone[target]
        out.no_relative = valid[:, :, 0] & ((lost | unbent)[:, 1:] | (lost | unbent)[:, base])
    if states:
        shape, own = column("shape"), slice(past, past + 1)
        mine = target[:, past]
        numbers_held = np.where(on[:, past, None], held[mine], loose[mine])
        out.state = np.concatenate([places[:, past], euler(seen[:, :, own])[:, 0], numbers_held, shape.values[mine]], -1)
        out.kept, out.no_state = k[:, past], lost[:, past] | shape.gone[mine]
    return out


def listed(values: np.ndarray, null: np.ndarray) -> pa.Array:
    """Rows of numbers (any axes before the last) as lists in lists, where `null` tells which innermost lists are null."""
    offsets = np.arange(0, values.size + 1, max(values.shape[-1], 1), dtype=np.int32) if values.shape[-1] else np.zeros(null.size + 1, np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)), mask=pa.array(null.reshape(-1)))
    return out if null.ndim == 1 else grouped(out, null.shape[1])


def grouped(column: pa.Array, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(column) + 1, each, dtype=np.int32)), column)


def flagged(values: np.ndarray) -> pa.Array:
    return pa.array(values.reshape(-1) == 1, mask=values.reshape(-1) == -1)


def _lists(b: Block) -> pa.RecordBatch:
    h = b.hands
    absolute = listed(np.concatenate([x.absolute for x in h], -1), h[0].no_absolute | h[1].no_absolute)
    relative = listed(np.concatenate([x.relative for x in h], -1), h[0].no_relative | h[1].no_relative)
    mask = grouped(grouped(flagged(np.stack([x.valid for x in h], -1)), 2), h[0].valid.shape[1])
    state = listed(np.concatenate([x.state for x in h], -1), h[0].no_state | h[1].no_state)
    columns = [b.episode, b.frame_idx, absolute, relative, mask, state, grouped(flagged(np.stack([x.kept for x in h], -1)), 2)]
    return pa.record_batch(columns, names=["episode", "frame_idx", "absolute", "relative", "mask", "state", "state_mask"])


def mixed_actions(absolute: Column, relative: Column) -> Column:
    """Relative wrists with absolute fingers, hand by hand, for each row of both."""

    def row(r: Column, a: Column) -> Column:
        half = F.floor(F.size(r) / 2).cast("int")
        parts = [(F.slice(r, first + 1, WRIST), F.slice(a, first + 1 + WRIST, half - WRIST)) for first in (F.lit(0), half)]
        return F.concat(*[x for p in parts for x in p])

    return F.zip_with(relative, absolute, row)


def spread_mask(mask: Column, width: Column, total: int) -> Column:
    """A flag a hand as flags a number: half of `width` each, then false up to `total`."""
    half = F.floor(width / 2).cast("int")
    flags = F.concat(F.array_repeat(F.get(mask, F.lit(0)), half), F.array_repeat(F.get(mask, F.lit(1)), half))
    return F.concat(flags, F.array_repeat(F.lit(False), F.greatest(F.lit(total) - 2 * half, F.lit(0))))


def unified_actions(actions: Column, mask: Column, total: int = ACTIONS) -> tuple[Column, Column]:
    """Rows of actions padded to `total` numbers, masked-out hands as zeros; and their flags."""
    flags = F.zip_with(actions, mask, lambda a, m: spread_mask(m, F.size(a), total))
    return F.zip_with(actions, flags, lambda a, f: g.padded(a, F.slice(f, F.lit(1), F.size(a)), total)), flags


def unified_state(state: Column, mask: Column, action_width: int, total: int = STATES) -> tuple[Column, Column]:
    """A state without the hands' shapes, padded to `total` numbers, masked-out hands as zeros; and its flags."""
    half = action_width // 2
    second = F.floor(F.size(state) / 2).cast("int") + 1
    short = F.concat(F.slice(state, 1, half), F.slice(state, second, F.lit(half)))
    flags = spread_mask(mask, F.lit(action_width), total)
    return g.padded(short, F.slice(flags, 1, action_width), total), flags
