"""Scalar formulas: image sizes, schedules of learning rates, metric names, device peaks, floating-point operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Peak floating-point operations a second of devices, by a part of their name.
DEVICE_PEAKS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "L40": 181.05e12, "L20": 119.5e12, "H20": 148e12, "910B": 354e12}
UNITS = {"B": 1e9, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15}


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def resized(width: Column, height: Column, min_pixels: int | None, max_pixels: int | None) -> tuple[Column, Column]:
    """Width and height scaled down to max_pixels, then up to min_pixels, each cut to whole pixels."""
    for bound, over in ((max_pixels, True), (min_pixels, False)):
        if bound:
            area = width.cast("double") * height
            scale = F.sqrt(F.lit(float(bound)) / area)
            hit = area > bound if over else area < bound
            width, height = (F.when(hit, F.floor(x * scale)).otherwise(x.cast("long")) for x in (width, height))
    return width, height


def warmup(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), step.cast("double") / F.greatest(F.lit(1.0), F.lit(float(steps))))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def device_peak(name: str, unit: str = "T") -> float:
    """Peak of the first device whose key is in name, in unit; infinite if none is."""
    found = next((x for k, x in DEVICE_PEAKS.items() if k in name.upper()), float("inf"))
    return found / UNITS[unit.upper()]


def flops(lengths: Column, parameters: float, layers: int, heads: int, head_dim: int) -> Column:
    """Aggregate: 6 N sum(len) for dense layers and 12 sum(len^2) d h L for attention."""
    return 6.0 * parameters * F.sum(lengths) + 12.0 * layers * heads * head_dim * F.sum(lengths.cast("double") * lengths)


def unflatten(record: dict[str, object], sep: str = "/") -> dict:
    out: dict = {}
    for name, value in record.items():
        *path, last = name.split(sep)
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def flatten(record: dict, sep: str = "/", top: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for name, value in record.items():
        key = f"{top}{sep}{name}" if top else name
        out |= flatten(value, sep, key) if isinstance(value, dict) else {key: value}
    return out


def checkpoint_step(path: Column) -> Column:
    found = F.regexp_extract(path, r"global_step_(\d+)", 1)
    return F.when(found != "", found.cast("long"))


#: Fixed value: position steps that a second of a video takes.
STEPS_PER_SECOND = 2


#: Tokens whose positions are made at once, so that the arrays on the way don't grow with an Arrow batch.
GRID_TOKENS = 1 << 20


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs, one run after another, and each place's number within its run."""
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + within, within


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _films(videos: np.ndarray, counts: np.ndarray, seconds: np.ndarray | None, given: np.ndarray | None, frames_apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grids of videos (all sequences' in turn, counts each), their seconds a grid and how many each sequence has. A video without seconds has no grid."""
    if frames_apart:
        frames = np.repeat(videos, videos[:, 0], axis=0)
        frames[:, 0] = 1
        return frames, np.zeros(len(frames)), np.diff(_bounds(videos[:, 0])[_bounds(counts)])
    if seconds is None:
        return videos, np.ones(len(videos)), counts
    kept = np.minimum(counts, given)
    return videos[_runs(_bounds(counts)[:-1], kept)[0]], seconds[_runs(_bounds(given)[:-1], kept)[0]], kept


def _grid_positions(lengths: np.ndarray, marks: list[np.ndarray], grids: list[np.ndarray], seconds: list[np.ndarray], counts: list[np.ndarray], merge: int) -> np.ndarray:
    """Positions as grid_positions has them, of many sequences one after another.

    marks: where images' tokens lie and where videos' do; grids, seconds and counts: both kinds' grids, seconds a grid and number a
    sequence. A round takes each sequence to its next grid and past it, so the time is in proportion to tokens and grids.
    """
    bounds = _bounds(lengths)
    cells = np.concatenate(grids) // [1, merge, merge]
    if (cells < 0).any():
        raise ValueError("a grid has a negative size")
    step = np.concatenate(seconds)
    if not np.isfinite(step).all():
        raise ValueError("seconds that aren't finite")
    first = [_bounds(counts[0]), len(grids[0]) + _bounds(counts[1])]
    turn, stop = [b[:-1].copy() for b in first], [b[1:] for b in first]
    marks = [np.append(m, bounds[-1]) for m in marks]
    places = np.empty((3, bounds[-1]), np.int64)
    at, base = bounds[:-1].copy(), np.zeros(len(lengths), np.int64)
    rows = np.flatnonzero(lengths)
    while len(rows):
        start, last = at[rows], bounds[rows + 1]
        # The next token of a kind that has a grid left, or the end.
        ahead = [np.where(k[rows] < e[rows], np.minimum(m[np.searchsorted(m, start)], last), last) for m, k, e in zip(marks, turn, stop)]
        end = np.minimum(*ahead)
        where, within = _runs(start, end - start)
        places[:, where] = np.repeat(base[rows], end - start) + within
        base[rows] += end - start
        more = end < last
        rows, end, last, is_image = rows[more], end[more], last[more], (ahead[0] < ahead[1])[more]
        which = np.where(is_image, turn[0][rows], turn[1][rows])
        turn[0][rows[is_image]] += 1
        turn[1][rows[~is_image]] += 1
        t, h, w = cells[which].T
        size = np.minimum(t * h * w, last - end)
        where, within = _runs(end, size)
        frame, cell = np.divmod(within, np.repeat(h * w, size))
        own = np.repeat(base[rows], size)
        places[0, where] = own + (frame * np.repeat(step[which], size) * STEPS_PER_SECOND).astype(np.int64)
        places[1, where] = own + cell // np.repeat(w, size)
        places[2, where] = own + cell % np.repeat(w, size)
        longest = np.maximum(np.maximum(h, w) - 1, ((t - 1) * step[which] * STEPS_PER_SECOND).astype(np.int64))
        base[rows] += np.where(size > 0, longest + 1, 0)
        at[rows] = end + size
        rows = rows[end + size < last]
    return places


def grid_positions(ids, images, videos, image_id: int, video_id: int, merge: int = 2, seconds=None, frames_apart: bool = False, mask=None) -> np.ndarray:
    """Three rows of positions (time, height, width) of a token sequence.

    Text counts up alike in all rows. A run of image or video tokens takes the cells of the next grid (t, h, w) of
    its kind, in units of merge, on top of where the text stood; text goes on after the largest position. The time of an
    image's cells is 0; a video's frame k stands at k times its seconds a grid (1 by default) and STEPS_PER_SECOND,
    cut to a whole number. With frames_apart every frame of a video is a run of its own with time 0. Places that mask leaves out have
    position 1.
    """
    valid = np.ones(len(ids), bool) if mask is None else np.asarray(mask) == 1
    tokens = np.asarray(ids)[valid]
    stills, films = (np.array(g, np.int64).reshape(-1, 3) for g in (images, videos))
    given = None if seconds is None else np.array([len(seconds)])
    films, step, n = _films(films, np.array([len(films)]), None if seconds is None else np.array(seconds, float), given, frames_apart)
    marks = [np.flatnonzero(tokens == x) for x in (image_id, video_id)]
    places = np.ones((3, len(ids)), np.int64)
    places[:, valid] = _grid_positions(np.array([len(tokens)]), marks, [stills, films], [np.zeros(len(stills)), step], [np.array([len(stills)]), n], merge)
    return places


def _lengths(lists: pa.Array) -> np.ndarray:
    """How long each list is; a null one is empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _known(values: pa.Array, kind: type) -> np.ndarray:
    if values.null_count:
        raise ValueError("a null in a grid or its seconds")
    return values.to_numpy(zero_copy_only=False).astype(kind)


def _shapes(grids: pa.Array) -> np.ndarray:
    """Grids of all lists, in turn: rows of t, h, w."""
    each = grids.flatten()
    if (_lengths(each) != 3).any():
        raise ValueError("a grid is three sizes: t, h, w")
    return _known(each.flatten(), np.int64).reshape(-1, 3)


def grid_positions_udf(image_id: int, video_id: int, merge: int = 2, frames_apart: bool = False):
    """Of columns ids, image grids, video grids (arrays of [t, h, w]) and the videos' seconds a grid: positions as
    grid_positions has them, a struct a token. Null ids have null positions, whatever their grids; null grids are none, null seconds raise."""

    def positions(ids: pa.Array, images: pa.Array, videos: pa.Array, seconds: pa.Array) -> pa.Array:
        if ids.null_count:
            images, videos, seconds = (pc.if_else(ids.is_valid(), c, pa.scalar([], c.type)) for c in (images, videos, seconds))
        if seconds.null_count:
            raise ValueError("null seconds")
        lengths, tokens = _lengths(ids), ids.flatten()
        marks = [np.flatnonzero(pc.fill_null(pc.equal(tokens, x), False).to_numpy(zero_copy_only=False)) for x in (image_id, video_id)]
        stills = _shapes(images)
        films, step, n = _films(_shapes(videos), _lengths(videos), _known(seconds.flatten(), float), _lengths(seconds), frames_apart)
        places = _grid_positions(lengths, marks, [stills, films], [np.zeros(len(stills)), step], [_lengths(images), n], merge)
        cells = pa.StructArray.from_arrays([pa.array(p) for p in places], ["time", "height", "width"])
        return pa.ListArray.from_arrays(pa.array(_bounds(lengths).astype(np.int32)), cells, mask=ids.is_null() if ids.null_count else None)

    @F.arrow_udf("array<struct<time: bigint, height: bigint, width: bigint>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            part = _bounds(_lengths(columns[0]))[:-1] // GRID_TOKENS
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(part)]):
                yield positions(*[c.slice(a, b - a) for c in columns])

    # Else Spark asks a second time, below a repartition, for the filter on sizes that it derives from an explode.
    return run.asNondeterministic()
