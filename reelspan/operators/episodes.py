"""Episodes as frames: indices, interval and as-of joins, speeds, windows, runs, interpolation, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reelspan.operators.sampling import ordinal


def by_frame() -> WindowSpec:
    return Window.partitionBy("episode").orderBy("frame_idx")


def frames_of(events: DataFrame, episode: str, order: list[str], signal: Column) -> DataFrame:
    """episode, frame_idx, signal of an event table, and the other columns of `events`."""
    w = Window.partitionBy(episode).orderBy(*order)
    others = [c for c in events.columns if c != episode]
    return events.select(F.col(episode).alias("episode"), (F.row_number().over(w) - 1).alias("frame_idx"), signal.alias("signal"), *others)


def frame_index(frames: DataFrame, width: int = 4096) -> DataFrame:
    """episode_idx (dense, by episode, a number) and frame_idx: episodes are ordered inside ranges of `width`, and frames not at all."""
    sizes = frames.groupBy("episode").agg(F.count("*").alias("n"))
    numbered = ordinal(sizes, F.floor(F.col("episode") / width), [F.col("episode")], "episode_idx")
    return numbered.select("episode_idx", "episode", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_idx"))


def recut(frames: DataFrame, points: DataFrame, texts: DataFrame, kept: Column, least: float = 0.5, width: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes cut at one or two points into new ones: (segments, frames of the segments, funnel).

    `points` has episode and points, `texts` episode and texts (one a segment). Episodes with a share of `kept` frames under `least` or with
    another number of points are filtered out. A point ends one segment and begins the next, so its frame is in both. New episodes are
    numbered densely by (episode, segment), inside ranges of `width` episodes; their frames begin at 0 and keep their other columns.
    """
    sizes = frames.groupBy("episode").agg(F.count("*").alias("n"), F.avg(kept.cast("int")).alias("ratio"))
    judged = sizes.join(points, "episode", "left").withColumn("kept", (F.col("ratio") >= least) & F.coalesce(F.size("points").isin(1, 2), F.lit(False)))
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("points", lambda p: p.cast("long")), F.array(F.col("n") - 1))
    cut = judged.filter("kept").join(texts, "episode").withColumn("_e", edges)
    pieces = F.transform(F.sequence(F.lit(0), F.size("points")), lambda i: F.struct(i.alias("segment"), F.get("_e", i).alias("start"), F.get("_e", i + 1).alias("end"), F.get("texts", i).alias("text")))
    segments = cut.select("episode", F.explode(pieces).alias("s")).select("episode", "s.*").withColumn("frames", F.col("end") - F.col("start") + 1)
    segments = ordinal(segments, F.floor(F.col("episode") / width), [F.col("episode"), F.col("segment")], "new_episode")
    own = segments.groupBy("episode").agg(F.collect_list(F.struct("new_episode", "start", "end")).alias("_s"))  # three at most
    here = F.filter("_s", lambda s: (s["start"] <= F.col("frame_idx")) & (F.col("frame_idx") <= s["end"]))
    moved = frames.join(own, "episode").withColumn("_x", F.explode(here)).withColumn("_f", F.col("frame_idx") - F.col("_x.start"))
    others = [c for c in frames.columns if c not in ("episode", "frame_idx")]
    moved = moved.select(F.col("_x.new_episode").alias("episode"), F.col("_f").alias("frame_idx"), F.col("episode").alias("source_episode"), F.col("frame_idx").alias("source_frame"), *others)
    funnel = judged.agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"), F.coalesce(F.sum(F.when(F.col("kept"), F.size("points") + 1)), F.lit(0)).cast("long").alias("segments"))
    return segments, moved, funnel


def uniform_picks(frames: DataFrame, k: int) -> DataFrame:
    """k evenly spaced frames of each episode (all, if it has fewer): floor(i * step), the last one exact."""
    sizes = frames.groupBy("episode").agg(F.count("*").alias("n"))
    step = (F.col("n") - 1).cast("double") / (k - 1)
    many = sizes.withColumn("sample_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(k)) - 1)))
    picked = F.when(F.col("n") <= k, F.col("sample_idx")).when(F.col("sample_idx") == k - 1, F.col("n") - 1).otherwise(F.floor(F.col("sample_idx") * step))
    return many.select("episode", "sample_idx", picked.alias("frame_idx"))


def captions_at(frames: DataFrame, captions: DataFrame, closed: bool = False, width: int = 256) -> DataFrame:
    """Frames with the captions (episode, clip_idx, start_frame, end_frame) that hold them.

    The join is on the episode and a block of `width` frames, so that a frame meets only captions of its block.
    """
    end = F.col("frame_idx") <= F.col("end_frame") if closed else F.col("frame_idx") < F.col("end_frame")
    first, last = F.floor(F.col("start_frame") / width), F.floor(F.col("end_frame") / width)
    blocks = captions.filter("end_frame >= start_frame").withColumn("_block", F.explode(F.sequence(first, last)))
    found = frames.withColumn("_block", F.floor(F.col("frame_idx") / width)).join(blocks, ["episode", "_block"]).drop("_block")
    return found.filter((F.col("frame_idx") >= F.col("start_frame")) & end)


def segment_of(frames: DataFrame, points: DataFrame) -> DataFrame:
    """segment: boundaries (episode, points array) strictly before the frame."""
    count = F.size(F.filter("points", lambda p: p < F.col("frame_idx")))
    return frames.join(points, "episode").withColumn("segment", count).drop("points")


def speeds(frames: DataFrame, width: int = 5) -> DataFrame:
    """speed: absolute change of the signal, 0 at the start; smooth: its sum over a centred window / width."""
    half = width // 2
    moved = frames.withColumn("speed", F.coalesce(F.abs(F.col("signal") - F.lag("signal").over(by_frame())), F.lit(0.0)))
    return moved.withColumn("smooth", F.sum("speed").over(by_frame().rowsBetween(-half, half)) / width)


def hand_summary(frames: DataFrame, sides: dict[str, Column]) -> DataFrame:
    """avg_speed and anno_type of each episode, from the frames where either hand (left, right) is valid.

    A hand's speed is its path over its valid frames, whatever lies between two of them, by the
    episode's frames less one; the faster hand counts. The type is the hand with more valid frames,
    both for equally many, none without any.
    """
    for side, valid in sides.items():
        value = F.when(valid, F.col("signal"))
        before = F.last(value, ignorenulls=True).over(by_frame().rowsBetween(Window.unboundedPreceding, -1))
        frames = frames.withColumn(f"_{side}", F.abs(value - before)).withColumn(f"_n_{side}", valid.cast("long"))
    sums = [F.sum(f"_n_{side}").alias(side) for side in sides] + [F.coalesce(F.sum(f"_{side}"), F.lit(0.0)).alias(f"_{side}") for side in sides]
    out = frames.groupBy("episode").agg(F.count("*").alias("frames"), *sums)
    kind = F.when(F.col("left") > F.col("right"), "left").when(F.col("right") > F.col("left"), "right").when(F.col("left") > 0, "both").otherwise("none")
    speed = F.greatest("_left", "_right") / F.greatest(F.col("frames") - 1, F.lit(1))
    return out.select("episode", "frames", F.col("left").alias("left_frames"), F.col("right").alias("right_frames"), speed.alias("avg_speed"), kind.alias("anno_type"))


def step_actions(frames: DataFrame, kept: Column) -> DataFrame:
    """delta to the next frame where both are kept, else 0."""
    marked = frames.withColumn("_k", kept)
    valid = F.col("_k") & F.coalesce(F.lead("_k").over(by_frame()), F.lit(False))
    delta = F.when(valid, F.lead("signal").over(by_frame()) - F.col("signal")).otherwise(0.0)
    return marked.withColumn("valid", valid).withColumn("delta", delta).drop("_k")


def lookahead(frames: DataFrame, k: int) -> DataFrame:
    """chunk: the signal of the next k frames, the episode's last one held."""
    nexts = F.collect_list("signal").over(by_frame().rowsBetween(1, k))
    held = F.coalesce(F.try_element_at(nexts, F.lit(-1)), F.col("signal"))
    return frames.withColumn("_c", nexts).withColumn("chunk", F.concat(nexts, F.array_repeat(held, k - F.size(nexts)))).drop("_c")


def runs(frames: DataFrame, mask: Column) -> DataFrame:
    """Maximal runs of consecutive masked frames: episode, start_frame, end_frame (exclusive), frames."""
    inside = frames.filter(mask).withColumn("_island", F.col("frame_idx") - F.row_number().over(by_frame()))
    return inside.groupBy("episode", "_island").agg(F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_frame"), F.count("*").alias("frames")).drop("_island")


def interpolated(frames: DataFrame, known: Column) -> DataFrame:
    """filled: the signal where known, else linear between the nearest known frames (none outside them)."""
    at, value = F.when(known, F.col("frame_idx")), F.when(known, F.col("signal"))
    before = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    # backwards, so that this frame grows row by row as well instead of being read again for each
    after = Window.partitionBy("episode").orderBy(F.desc("frame_idx")).rowsBetween(Window.unboundedPreceding, 0)
    ends = frames.withColumns(
        {
            "_a": F.last(at, ignorenulls=True).over(before),
            "_x": F.last(value, ignorenulls=True).over(before),
            "_b": F.last(at, ignorenulls=True).over(after),
            "_y": F.last(value, ignorenulls=True).over(after),
        }
    )
    share = (F.col("frame_idx") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0))
    line = F.col("_x") + (F.col("_y") - F.col("_x")) * share
    return ends.withColumn("filled", F.when(known, F.col("signal")).otherwise(line)).drop("_a", "_x", "_b", "_y")


def rebuilt(actions: DataFrame, start: Column) -> DataFrame:
    """position: the start plus all deltas before the frame."""
    before = by_frame().rowsBetween(Window.unboundedPreceding, -1)
    return actions.withColumn("position", start + F.coalesce(F.sum("delta").over(before), F.lit(0.0)))


def minima(smooth: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Places of local minima (middles of flat ones), the deepest first within `distance`, then by prominence."""
    y = -smooth
    change = np.flatnonzero(np.diff(y) != 0)
    starts, ends = np.append(0, change + 1), np.append(change, len(y) - 1)
    level = y[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.empty(0, int)
    peaks = (starts[top] + ends[top]) // 2
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep[near] = False
    out = []
    for p in peaks[keep]:
        higher = y > y[p]
        left = np.flatnonzero(higher[:p])
        right = np.flatnonzero(higher[p:])
        low = max(y[(left[-1] if len(left) else 0) : p + 1].min(), y[p : (p + right[0] if len(right) else len(y))].min())
        if y[p] - low >= prominence:
            out.append(p)
    return np.array(out, int)


def split_points(smoothed: DataFrame, distance: int = 8, prominence: float = 0.002, edge: int = 15, limit: float = 0.01, shift: int = 5, least: int = 30) -> DataFrame:
    """episode and up to two split frames of episodes of at least `least` frames: slow minima away from the ends."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        smooth = own.sort_values("frame_idx")["smooth"].to_numpy()
        n, found = len(smooth), []
        if n >= least:
            found = [p for p in minima(smooth, distance, prominence) if edge <= p < n - edge and smooth[p] < limit]
            found = sorted({min(p + shift, n - 1) for p in (found[:1] + found[-1:])})
        return pd.DataFrame({"episode": own["episode"].iloc[0], "points": [found]})

    return smoothed.select("episode", "frame_idx", "smooth").groupBy("episode").applyInPandas(run, "episode long, points array<int>")


def pchip(at: np.ndarray, values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation: slopes are weighted harmonic means of the neighbouring secants."""
    h, d = np.diff(at).astype(float), np.diff(values) / np.diff(at)
    if len(at) == 2:
        return np.interp(where, at, values)
    slope = np.zeros(len(at))
    same = d[:-1] * d[1:] > 0
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    slope[1:-1][same] = ((a + b)[same]) / (a[same] / d[:-1][same] + b[same] / d[1:][same])

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    slope[0], slope[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.clip(np.searchsorted(at, where, side="right") - 1, 0, len(h) - 1)
    t = (where - at[i]) / h[i]
    return values[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * slope[i] * t * (1 - t) ** 2 + values[i + 1] * t * t * (3 - 2 * t) + h[i] * slope[i + 1] * t * t * (t - 1)


def interpolated_monotone(frames: DataFrame, known: Column) -> DataFrame:
    """episode, frame_idx and filled: monotone cubic between known frames, null outside the first and last."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("frame_idx")
        at, keep = own["frame_idx"].to_numpy(float), own["known"].fillna(False).to_numpy(bool)
        filled = np.full(len(own), np.nan)
        if keep.sum() >= 2:
            inside = (at >= at[keep][0]) & (at <= at[keep][-1])
            filled[inside] = pchip(at[keep], own["signal"].to_numpy(float)[keep], at[inside])
        filled[keep] = own["signal"].to_numpy(float)[keep]
        return pd.DataFrame({"episode": own["episode"], "frame_idx": own["frame_idx"], "filled": pd.Series(filled, index=own.index, dtype=object).where(~np.isnan(filled), None)})

    rows = frames.select("episode", F.col("frame_idx").cast("long").alias("frame_idx"), "signal", known.alias("known"))
    return rows.groupBy("episode").applyInPandas(run, "episode long, frame_idx long, filled double")
