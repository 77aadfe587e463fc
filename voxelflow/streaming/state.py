"""Streams: interval slices of a second stream, and the voxel map with sliding frames, marginalisation and eviction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import MOMENTS

VOXEL = "vx long, vy long, vz long, frame long, n long, n_fixed long, n_window long, active boolean, removed boolean, l0 double, l1 double, l2 double"
_STATE = "fixed array<double>, frames array<long>, window array<double>"


def as_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant, not a local date and time."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def slice_stream(scans: DataFrame, samples: DataFrame, keys: Sequence[str], begin: str, end: str, time: str, delay: str = "10 seconds", longest: str = "1 hour") -> DataFrame:
    """samples with the scan whose (begin, end] they fall in, as an inner join of two streams; watermarks bound the state, and a scan is through once the samples' watermark has passed its end.

    Samples are kept for scans of up to `longest`; a longer scan stops the query with an error, as its first samples may be gone.
    """
    known = as_event_time(as_event_time(scans, begin), end)
    short = F.col(begin) >= F.col(end) - F.expr(f"INTERVAL {longest}")
    left = known.where(F.when(short | short.isNull(), True).otherwise(F.raise_error(F.lit(f"a scan is longer than {longest}")).cast("boolean"))).withWatermark(end, delay).alias("s")
    right = as_event_time(samples, time).withWatermark(time, delay).alias("m")
    same = [F.col(f"s.{k}") == F.col(f"m.{k}") for k in keys]
    inside = (F.col(f"m.{time}") > F.col(f"s.{begin}")) & (F.col(f"m.{time}") <= F.col(f"s.{end}")) & (F.col(f"m.{time}") >= F.col(f"s.{end}") - F.expr(f"INTERVAL {longest}"))
    on = inside
    for s in same:
        on = on & s
    return left.join(right, on, "inner").select("s.*", *(F.col(f"m.{c}").alias(c) for c in samples.columns if c not in keys))


def counted_slices(sliced: DataFrame, keys: Sequence[str], end: str, delay: str = "10 seconds") -> DataFrame:
    """Number of samples of each scan, once its end has passed the watermark."""
    return sliced.withWatermark(end, delay).groupBy(*keys, end, F.window(end, "1 minute").alias("__window")).agg(F.count("*").alias("n")).drop("__window")


def marginalise(fixed: np.ndarray, frames: list[int], window: np.ndarray, now: int, size: int, most: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """What leaves a window of `size` frames at frame `now` is folded into the fixed moments while those hold under `most` points, and forgotten after."""
    keep = [k for k, f in enumerate(frames) if f > now - size]
    for k, f in enumerate(frames):
        if f <= now - size and fixed[0] < most:
            fixed = fixed + window[k]
    return fixed, [frames[k] for k in keep], window[keep] if keep else np.zeros((0, len(MOMENTS)))


def voxel_map(clusters: DataFrame, size: int = 10, most: int = 100, time: str | None = None, ttl: str = "60 seconds") -> DataFrame:
    """A stream of frame clusters (vx, vy, vz, frame, MOMENTS) to the changes of the voxel map (VOXEL), a row for each voxel and batch that touches it.

    State is kept by voxel: the fixed moments, and those of the frames in its window. A voxel is active while its window
    has points. The window moves with the voxel's own frames. With an event-time column `time`, the clock is that of all voxels: once the
    watermark passes a voxel's last time by `ttl`, its state is removed and a row with `removed` tells of it, so that state is bounded by the
    voxels of the last `ttl` and not by the whole path. A voxel that comes again starts anew.
    """
    from pyspark.sql import SparkSession

    seconds = 0.0
    if time:
        seconds = SparkSession.active().range(1).select(F.expr(f"CAST(unix_millis(TIMESTAMP '2000-01-01' + INTERVAL {ttl}) - unix_millis(TIMESTAMP '2000-01-01') AS DOUBLE)")).first()[0]
        clusters = as_event_time(clusters, time).withWatermark(time, "0 seconds")

    def update(key: tuple, batches: Iterator, state) -> Iterator:  # noqa: ANN001
        import pandas as pd

        fixed, frames, window = np.zeros(len(MOMENTS)), [], np.zeros((0, len(MOMENTS)))
        names = ["vx", "vy", "vz", "frame", "n", "n_fixed", "n_window", "active", "removed", "l0", "l1", "l2"]
        if state.hasTimedOut:
            last = max(state.get[1], default=-1)
            state.remove()
            yield pd.DataFrame([[*key, last, 0, 0, 0, False, True, 0.0, 0.0, 0.0]], columns=names)
            return
        if state.exists:
            f, frames, w = state.get
            fixed, frames, window = np.array(f), list(frames), np.array(w).reshape(-1, len(MOMENTS))
        every = pd.concat(list(batches))
        rows = every.groupby("frame")[list(MOMENTS)].sum().sort_index()
        for frame, row in rows.iterrows():
            if frame in frames:
                window[frames.index(frame)] += row.to_numpy(float)
            else:
                frames, window = [*frames, int(frame)], np.vstack([window, row.to_numpy(float)])
            fixed, frames, window = marginalise(fixed, frames, window, max(frames), size, most)
        total = fixed + window.sum(axis=0)
        n, v = max(total[0], 1.0), total[1:4] / max(total[0], 1.0)
        second = total[4:] / n
        c = np.array([[second[0], second[1], second[2]], [second[1], second[3], second[4]], [second[2], second[4], second[5]]]) - np.outer(v, v)
        values = np.linalg.eigvalsh(c)
        state.update((fixed.tolist(), frames, window.ravel().tolist()))
        if time:
            latest = int(every[time].max().timestamp() * 1000 + seconds)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[*key, max(frames, default=-1), int(total[0]), int(fixed[0]), int(window[:, 0].sum()), bool(window[:, 0].sum() > 0), False, *values]], columns=names)

    return clusters.groupBy("vx", "vy", "vz").applyInPandasWithState(update, VOXEL, _STATE, "update", "EventTimeTimeout" if time else "NoTimeout")
