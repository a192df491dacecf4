"""Run-length masks: facts, outlines, painting. Small numpy helpers inside Arrow functions.

A mask is ``struct<size: array<int> [height, width], counts: string>`` with column-major runs that start
with background, in the compressed text form of the public COCO format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import balance, spread
from .ranking import with_parts

# Longest accepted text, smallest outline, outline tolerance in pixels.
MAX_COUNTS_CHARS = 2_000_000
MIN_AREA = 8
TOLERANCE = 1.5

MASK_TYPE = T.StructType([T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("counts", T.StringType())])
FACTS = T.StructType([T.StructField("area", T.LongType())]
                     + [T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h")]
                     + [T.StructField("problem", T.StringType())])


def decode_runs(text: str) -> np.ndarray:
    """Run lengths of the compressed text.

    Each number is a group of 5-bit digits, low digit first, bit 5 marking that more follow; from the
    fourth number on it is a difference to the number two places before.
    """
    digits = np.frombuffer(text.encode("latin-1"), dtype=np.uint8).astype(np.int64) - 48
    last = np.flatnonzero((digits & 0x20) == 0)
    if len(digits) == 0 or len(last) == 0 or last[-1] != len(digits) - 1:
        raise ValueError("truncated runs")
    first = np.concatenate(([0], last[:-1] + 1))
    length = last - first + 1
    place = np.arange(len(digits)) - np.repeat(first, length)
    numbers = np.add.reduceat((digits & 0x1F) << (5 * place), first)
    numbers -= np.where(digits[last] & 0x10, np.int64(1) << (5 * length), 0)
    numbers[1::2] = np.cumsum(numbers[1::2])
    numbers[2::2] = np.cumsum(numbers[2::2])
    return numbers


def checked_runs(size, counts) -> tuple[np.ndarray, int, int]:
    """Runs, height and width of a well-formed mask; raises ``ValueError`` with the reason otherwise."""
    if size is None or len(size) != 2 or any(s is None or int(s) <= 0 for s in size):
        raise ValueError("size must be two positive numbers")
    if not counts or len(counts) > MAX_COUNTS_CHARS:
        raise ValueError("counts missing or too long")
    height, width = int(size[0]), int(size[1])
    runs = decode_runs(counts)
    if (runs < 0).any():
        raise ValueError("negative run")
    if runs.sum() != height * width:
        raise ValueError("runs do not cover the mask")
    return runs, height, width


def _extent(runs: np.ndarray, height: int) -> tuple[int, int, int, int]:
    """Tight box (x, y, w, h) of the foreground from run borders alone."""
    ends = np.cumsum(runs)
    lit = np.flatnonzero(runs[1::2]) * 2 + 1
    if len(lit) == 0:
        return 0, 0, 0, 0
    start, stop = ends[lit - 1], ends[lit] - 1
    c0, c1 = start // height, stop // height
    whole = c0 != c1  # a run over a column border touches both the top and the bottom row
    top = np.where(whole, 0, start % height).min()
    bottom = np.where(whole, height - 1, stop % height).max()
    return int(c0.min()), int(top), int(c1.max() - c0.min() + 1), int(bottom - top + 1)


def grid_of(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    """Boolean (height, width) picture."""
    values = np.arange(len(runs)) % 2 == 1
    return np.repeat(values, runs).reshape(width, height).T


def _joined_runs(body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``decode_runs`` of many texts of these lengths in one array: the runs, the text of each, which are foreground, and
    where each text starts. No text is empty or ends within a number."""
    digits = body.astype(np.int64) - 48
    last = np.flatnonzero((digits & 0x20) == 0)
    first = np.concatenate(([0], last[:-1] + 1))
    length = last - first + 1
    place = np.arange(len(digits)) - np.repeat(first, length)
    runs = np.add.reduceat((digits & 0x1F) << (5 * place), first)
    runs -= np.where(digits[last] & 0x10, np.int64(1) << (5 * length), 0)
    row = np.searchsorted(np.cumsum(lengths), last, side="right")
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    at = np.arange(len(row)) - starts[row]
    odd = at % 2 == 1
    for which in (odd, ~odd & (at >= 2)):  # differences to the number two places before
        total = np.cumsum(np.where(which, runs, 0))
        before = total[starts] - np.where(which, runs, 0)[starts]
        runs = np.where(which, total - before[row], runs)
    return runs, row, odd, starts


def batch_facts(sizes, texts) -> pd.DataFrame:
    """``FACTS`` of many masks, whose runs are decoded as one array; reasons as in ``checked_runs``."""
    n = len(sizes)
    problem, height, width, kept, bodies = [None] * n, np.ones(n, np.int64), np.ones(n, np.int64), [], []
    for i, (size, text) in enumerate(zip(sizes, texts)):
        if size is None and text is None:
            continue
        if size is None or len(size) != 2 or any(x is None or int(x) <= 0 for x in size):
            problem[i] = "size must be two positive numbers"
        elif not text or len(text) > MAX_COUNTS_CHARS:
            problem[i] = "counts missing or too long"
        else:
            try:
                body = text.encode("latin-1")
            except ValueError as e:
                problem[i] = str(e)
                continue
            if (body[-1] - 48) & 0x20:
                problem[i] = "truncated runs"
            else:
                height[i], width[i] = int(size[0]), int(size[1])
                kept.append(i)
                bodies.append(body)
    out, sound = np.zeros((n, 5), np.int64), np.zeros(n, dtype=bool)
    for part in _parts_of(kept, bodies):
        rows, joined = np.array(part[0]), part[1]
        runs, row, odd, starts = _joined_runs(np.frombuffer(b"".join(joined), dtype=np.uint8), np.array([len(x) for x in joined]))
        negative = np.minimum.reduceat(runs, starts) < 0
        covers = np.add.reduceat(runs, starts) == height[rows] * width[rows]
        for i in np.flatnonzero(negative | ~covers):
            problem[rows[i]] = "negative run" if negative[i] else "runs do not cover the mask"
        good = ~negative & covers
        sound[rows[good]] = True
        out[rows, 0] = np.add.reduceat(np.where(odd, runs, 0), starts)
        ends = np.cumsum(runs)
        ends -= (ends[starts] - runs[starts])[row]
        lit = np.flatnonzero(odd & (runs != 0) & good[row])
        if not len(lit):
            continue
        high, start, stop = height[rows][row[lit]], ends[lit - 1], ends[lit] - 1
        c0, c1 = start // high, stop // high
        whole = c0 != c1  # a run over a column border touches both the top and the bottom row
        groups = np.flatnonzero(np.diff(row[lit], prepend=-1))
        x, right = np.minimum.reduceat(c0, groups), np.maximum.reduceat(c1, groups)
        top = np.minimum.reduceat(np.where(whole, 0, start % high), groups)
        bottom = np.maximum.reduceat(np.where(whole, high - 1, stop % high), groups)
        out[rows[row[lit][groups]], 1:] = np.stack([x, top, right - x + 1, bottom - top + 1], axis=1)
    columns = {name: pd.array(np.where(sound, out[:, j], 0).astype(kind), dtype=kind.capitalize())
               for j, (name, kind) in enumerate((("area", "int64"), ("x", "int32"), ("y", "int32"), ("w", "int32"), ("h", "int32")))}
    frame = pd.DataFrame(columns)
    frame[~sound] = pd.NA
    frame["problem"] = pd.Series(problem, dtype=object)
    return frame


def _parts_of(rows: list[int], bodies: list[bytes], limit: int = 4_000_000) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of at most ``limit`` bytes in all, or one longer text, at a time."""
    start = size = 0
    for end, body in enumerate(bodies):
        if size and size + len(body) > limit:
            yield rows[start:end], bodies[start:end]
            start, size = end, 0
        size += len(body)
    if start < len(bodies):
        yield rows[start:], bodies[start:]


@F.pandas_udf(FACTS)
def mask_facts(size: pd.Series, counts: pd.Series) -> pd.DataFrame:
    return batch_facts(size, counts)


def mask_stats(df: DataFrame, mask: str = "mask") -> DataFrame:
    """``df`` plus area, x, y, w, h (pixels) and problem (NULL when the mask is sound)."""
    c = F.col(mask)
    return balance(df).withColumn("_f", mask_facts(c["size"], c["counts"])).select(*df.columns, "_f.*")


# ---- outlines -----------------------------------------------------------------------------------

# Ways are numbered clockwise from east; after a move the scan resumes behind the pixel just left. ``_TURNS`` gives the next
# way (``ALONE`` without one) from the way back, times 512, plus the pixel and its neighbours as nine bits: left column first,
# each from the top.
_WAYS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))  # to the right, down
ALONE = 8


def _turns() -> np.ndarray:
    around, table = np.arange(512), np.full((8, 512), ALONE, dtype=np.int8)
    for back in range(8):
        for turn in range(8, 0, -1):
            right, down = _WAYS[(back + turn) % 8]
            table[back, around >> 3 * (right + 1) + down + 1 & 1 == 1] = (back + turn) % 8
    return table.ravel()


_TURNS = _turns()
_TURN_LIST = _TURNS.tolist()
PIXELS = 1 << 23  # of a strip, unless one mask has more
WALKERS = 32  # fewer boundaries are walked one by one


def _walk(near: memoryview, tall: int, moves: list[int], at: int, back: int, home: int) -> list[int]:
    """Boundary pixels clockwise behind ``at`` until ``home`` is met."""
    path = []
    while True:
        way = _TURN_LIST[back << 9 | near[at - tall] | near[at] << 3 | near[at + tall] << 6]
        if way == ALONE:
            return path
        at += moves[way]
        if at == home:
            return path
        path.append(at)
        back = way ^ 4


def _walks(near: np.ndarray, tall: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundary pixels clockwise from each start (entered from the west) until it is met again, and how many each has.

    All take a step at a time, the last few go on one by one.
    """
    moves = np.array([right * tall + down for right, down in _WAYS])
    who, at, home, back = np.arange(len(starts)), starts, starts, np.full(len(starts), 4)
    length, steps, tails = np.ones(len(starts), np.int64), [(who, starts)], []
    while len(who) >= WALKERS:
        way = _TURNS[back << 9 | near[at - tall] | near[at] << 3 | near[at + tall] << 6]
        at = at + moves[way & 7]
        walks = (way != ALONE) & (at != home)
        if not walks.all():
            who, at, home, way = who[walks], at[walks], home[walks], way[walks]
        back = (way ^ 4).astype(np.int64)
        length[who] += 1
        steps.append((who, at))
    view, listed = memoryview(near), moves.tolist()
    for one, *state in zip(who.tolist(), at.tolist(), back.tolist(), home.tolist()):
        tails.append((one, _walk(view, tall, listed, *state)))
        length[one] += len(tails[-1][1])
    first = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.int64)
    for step, (who, at) in enumerate(steps):
        out[first[who] + step] = at
    for one, path in tails:
        out[first[one] + len(steps):first[one] + length[one]] = path
    return out, length


def _traced(ground: np.ndarray, tall: int, columns: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All boundaries of masks that lie side by side in a strip: pixels, and the length and the mask of each boundary.

    ``ground`` has columns of ``tall`` pixels; the last row and the columns before, between and behind masks are empty.
    ``columns`` has the first column of each mask, ``starts`` its first pixel by row and column. A boundary begins at a
    pixel with background on its left that no boundary before has met; masks take their next boundary together.
    """
    near = ground.astype(np.int16) << 1
    near[1:] |= ground[:-1]
    near[:-1] |= ground[1:].astype(np.int16) << 2
    path, length = _walks(near, tall, starts)
    paths, lengths, owners = [path], [length], [np.arange(len(starts))]
    seen = np.zeros(len(ground), dtype=bool)
    seen[path] = True
    left = ground.view(bool)[tall:] > ground.view(bool)[:-tall]
    left = np.flatnonzero(left > seen[tall:]) + tall
    owner = np.searchsorted(columns, left // tall, side="right") - 1
    order = np.lexsort((left // tall, left % tall, owner))
    left, owner = left[order], owner[order]
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    end = np.append(at[1:], len(left))
    while len(at) >= WALKERS:
        met = seen[left[at]]
        if not met.any():
            path, length = _walks(near, tall, left[at])
            paths, lengths, owners = [*paths, path], [*lengths, length], [*owners, owner[at]]
            seen[path] = True
            met = True
        at = at + met
        at, end = at[at < end], end[at < end]
    view, known, moves = memoryview(near), memoryview(seen), [right * tall + down for right, down in _WAYS]
    for a, b in zip(at.tolist(), end.tolist()):
        found, sizes = [], []
        for start in left[a:b].tolist():
            if not known[start]:
                path = [start, *_walk(view, tall, moves, start, 4, start)]
                for pixel in path:
                    known[pixel] = True
                found += path
                sizes.append(len(path))
        paths, lengths, owners = [*paths, np.array(found, np.int64)], [*lengths, np.array(sizes, np.int64)], [*owners, np.full(len(sizes), owner[a])]
    return np.concatenate(paths), np.concatenate(lengths), np.concatenate(owners)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, values.dtype)


def _places(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each stretch counted up from its first place."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def _areas(x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    first = np.cumsum(length) - length
    after = np.arange(1, len(x) + 1)
    after[first + length - 1] = first
    return np.abs(_sums(x * y[after] - x[after] * y, first)) / 2


def _thin(x: np.ndarray, y: np.ndarray, length: np.ndarray, tolerance: float) -> np.ndarray:
    """Line simplification: keep the farthest point of a stretch while it is off by more than the tolerance; the stretches
    of all rings at once."""
    keep = np.zeros(len(x), dtype=bool)
    a = np.cumsum(length) - length
    b = a + length - 1
    keep[a] = keep[b] = True
    while True:
        a, b = a[b - a >= 2], b[b - a >= 2]
        if not len(a):
            return keep
        inner = b - a - 1
        at, first = _places(a + 1, inner), np.cumsum(inner) - inner
        right, down = x[b] - x[a], y[b] - y[a]
        dx, dy = x[at] - np.repeat(x[a], inner), y[at] - np.repeat(y[a], inner)
        away = np.abs(np.repeat(right, inner) * dy - np.repeat(down, inner) * dx)
        closed = (right == 0) & (down == 0)
        if closed.any():
            point = np.repeat(closed, inner)
            away[point] = dx[point] ** 2 + dy[point] ** 2
        most = np.maximum.reduceat(away, first)
        tops = np.flatnonzero(away == np.repeat(most, inner))
        far = tops[np.searchsorted(tops, first)]
        off = np.where(closed, np.hypot(dx[far], dy[far]), most / np.where(closed, 1.0, np.hypot(right, down))) > tolerance
        a, middle, b = a[off], at[far[off]], b[off]
        keep[middle] = True
        a, b = np.concatenate((a, middle)), np.concatenate((middle, b))


def _rings(x: np.ndarray, y: np.ndarray, length: np.ndarray, owner: np.ndarray, min_area: float,
           tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Simplified rings, those of a mask together and largest first; specks are dropped."""
    area = _areas(x, y, length)
    kept = np.flatnonzero((length >= 3) & (area >= min_area))
    kept = kept[np.lexsort((kept, -area[kept], owner[kept]))]
    at = _places((np.cumsum(length) - length)[kept], length[kept])
    x, y, length, owner = x[at], y[at], length[kept], owner[kept]
    keep = _thin(x, y, length, tolerance)
    left = _sums(keep.astype(np.int64), np.cumsum(length) - length)
    keep &= np.repeat(left >= 3, length)
    return x[keep], y[keep], left[left >= 3], owner[left >= 3]


def outlines(picture: np.ndarray, min_area: float = MIN_AREA, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Simplified outlines as (x, y) pixels, largest first; specks are dropped."""
    height, width = picture.shape
    strip = np.zeros((width + 2, height + 1), dtype=np.uint8)
    strip[1:-1, :-1] = picture.T
    lit = np.flatnonzero(picture)
    if not len(lit):
        return []
    row, column = divmod(int(lit[0]), width)
    path, length, owner = _traced(strip.ravel(), height + 1, np.array([1]), np.array([(column + 1) * (height + 1) + row]))
    x, y, length, _ = _rings(path // (height + 1) - 1, path % (height + 1), length, owner, min_area, tolerance)
    return [ring for ring in np.split(np.stack((x, y), axis=1), np.cumsum(length)[:-1])] if len(length) else []


def _strip_outlines(starts: np.ndarray, stops: np.ndarray, row: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_rings`` of masks given by their runs of foreground (first and last place), ``row`` the mask of each."""
    high = height[row]
    c0, c1 = starts // high, stops // high
    n = c1 - c0 + 1  # a run has a piece in each column
    first = np.cumsum(n) - n
    column, high, owner = _places(c0, n), np.repeat(high, n), np.repeat(row, n)
    top, bottom = np.zeros(len(column), np.int64), high - 1
    top[first], bottom[first + n - 1] = starts % height[row], stops % height[row]
    group = np.flatnonzero(np.diff(owner, prepend=-1))
    masks = owner[group]
    which = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
    left, right = column[group], np.maximum.reduceat(column, group)
    up, down = np.minimum.reduceat(top, group), np.maximum.reduceat(bottom, group)
    wide, size = right - left + 2, down - up + 2
    found = []
    by_size = np.argsort(size, kind="stable")
    for some in _strips(by_size, wide, size):
        tall = int(size[some].max())
        some = np.sort(some)
        columns = np.full(len(group), -1)
        columns[some] = 1 + np.cumsum(wide[some]) - wide[some]
        held = slice(None) if len(some) == len(group) else np.flatnonzero(columns[which] >= 0)
        k = which[held]
        x, y = columns[k] + column[held] - left[k], top[held] - up[k]
        begin = x * tall + y
        end = begin + bottom[held] - top[held] + 1
        lengths = np.empty(2 * len(begin) + 1, np.int64)
        lengths[1::2] = end - begin
        lengths[2:-1:2] = begin[1:] - end[:-1]
        lengths[0], lengths[-1] = begin[0], int(wide[some].sum() + 1) * tall - end[-1]
        ground = np.repeat((np.arange(len(lengths)) % 2).astype(np.uint8), lengths)
        at = np.flatnonzero(np.diff(k, prepend=-1))
        across = int(columns[some[-1]] + wide[some[-1]])
        key = np.minimum.reduceat(y * across + x, at)
        path, length, ring = _traced(ground, tall, columns[some], key % across * tall + key // across)
        ring = some[ring]
        of = np.repeat(ring, length)
        found.append(_rings(path // tall - columns[of] + left[of], path % tall + up[of], length, masks[ring], MIN_AREA, TOLERANCE))
    return tuple(np.concatenate(part) for part in zip(*found))


def _strips(order: np.ndarray, wide: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Masks in order of size, as many as fill ``PIXELS`` with columns of the tallest, or one that is larger."""
    start = total = 0
    across, tall = wide[order].tolist(), size[order].tolist()
    for end, (w, h) in enumerate(zip(across, tall)):
        if end > start and (total + w) * h > PIXELS:
            yield order[start:end]
            start, total = end, 0
        total += w
    yield order[start:]


def batch_outlines(sizes: pa.Array, texts: pa.Array) -> pa.Array:
    """The normalised outlines of many masks as lists of lists of points; an unsound mask has none."""
    n = len(sizes)
    sides, first = pc.fill_null(sizes.values, 0).to_numpy(), sizes.offsets.to_numpy()[:-1]
    pair = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy() == 2
    height, width = np.zeros(n, np.int64), np.zeros(n, np.int64)
    height[pair], width[pair] = sides[first[pair]], sides[first[pair] + 1]
    kept, bodies = [], []
    for i, text, sized in zip(range(n), texts.to_pylist(), ((height > 0) & (width > 0)).tolist()):
        body = _body(text) if sized else None
        if body is not None:
            kept.append(i)
            bodies.append(body)
    found = []
    for part in _parts_of(kept, bodies):
        rows, joined = np.array(part[0]), part[1]
        runs, row, odd, starts = _joined_runs(np.frombuffer(b"".join(joined), dtype=np.uint8), np.array([len(x) for x in joined]))
        good = (np.minimum.reduceat(runs, starts) >= 0) & (np.add.reduceat(runs, starts) == height[rows] * width[rows])
        ends = np.cumsum(runs)
        ends -= (ends[starts] - runs[starts])[row]
        lit = np.flatnonzero(odd & (runs != 0) & good[row])
        if len(lit):
            x, y, length, owner = _strip_outlines(ends[lit - 1], ends[lit] - 1, row[lit], height[rows])
            order = np.argsort(owner, kind="stable")
            at = _places((np.cumsum(length) - length)[order], length[order])
            found.append((x[at], y[at], length[order], rows[owner[order]]))
    x, y, length, owner = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    of = np.repeat(owner, length)
    points = np.stack((x / width[of], y / height[of]), axis=1).ravel()
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(points) + 1, 2), pa.int32()), pa.array(points))
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pairs)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), pa.int32()), rings)


def _body(text: str | None) -> bytes | None:
    """The runs of a mask as bytes, None when ``checked_runs`` refuses the text before they are read."""
    if not text or len(text) > MAX_COUNTS_CHARS:
        return None
    try:
        body = text.encode("latin-1")
    except ValueError:
        return None
    return None if (body[-1] - 48) & 0x20 else body


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
def mask_polygons(size: pa.Array, counts: pa.Array) -> pa.Array:
    """Normalised outlines of each mask; an unsound mask has none."""
    return batch_outlines(size, counts)


def explode_polygons(df: DataFrame, mask: str = "mask") -> DataFrame:
    """One row per outline: ``df`` without the mask plus (ring, points)."""
    c = F.col(mask)
    df = balance(df)
    # The outer form keeps the optimizer from adding a size test, which would trace every mask twice.
    return df.withColumn("_p", mask_polygons(c["size"], c["counts"])).select(
        *[x for x in df.columns if x != mask], F.posexplode_outer("_p").alias("ring", "points")).filter("ring is not null")


# ---- painting -----------------------------------------------------------------------------------

ZERO_STEP = 32_768  # zero bytes between two kept states: a window of zlib, which takes two at first, then one at a time


@lru_cache(maxsize=64)
def _after_zeros(n: int) -> tuple[bytes, "zlib._Compress"]:
    """What ``n`` zero bytes give at level 6, and the state behind them."""
    state = zlib.compressobj(6)
    return state.compress(bytes(n)), state


def _compressed(body: np.ndarray) -> bytes:
    """The bytes of ``zlib.compress(body, 6)``; the zeros that lead the body are compressed once for many pictures."""
    lit = body != 0
    lead = int(lit.argmax()) if lit.any() else body.size
    lead -= lead % ZERO_STEP
    if lead < 2 * ZERO_STEP:
        return zlib.compress(body.tobytes(), 6)
    begun, state = _after_zeros(lead)
    rest = state.copy()
    return begun + rest.compress(body[lead:].tobytes()) + rest.flush()


def png_bytes(picture: np.ndarray) -> bytes:
    """An 8-bit single-channel PNG."""
    height, width = picture.shape
    rows = np.concatenate((np.zeros((height, 1), dtype=np.uint8), picture.astype(np.uint8)), axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", _compressed(rows.ravel())) + chunk(b"IEND", b""))


def _filled(points: np.ndarray, height: int, width: int) -> tuple[slice, slice, np.ndarray]:
    """Rows and columns around a polygon, and which pixels there have their centre inside it (even-odd rule); one sweep
    per edge. Beyond the outermost edges every row is outside, so those columns are not looked at."""
    low, high = points.min(axis=0), points.max(axis=0)
    top, left = (max(0, int(np.floor(v)) - 1) for v in (low[1], low[0]))
    bottom, right = min(height, int(np.ceil(high[1])) + 1), min(width, int(np.ceil(high[0])) + 1)
    x = np.arange(left, max(left, right)) + 0.5
    inside = np.zeros((max(0, bottom - top), len(x)), dtype=bool)
    corners = points.tolist()
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        first, last = sorted((y0, y1))
        begin, end = max(0, int(np.ceil(first - 0.5))), min(height, int(np.ceil(last - 0.5)))
        if begin < end:
            crossing = x0 + (np.arange(begin, end) + 0.5 - y0) * (x1 - x0) / (y1 - y0)
            inside[begin - top:end - top] ^= x[None, :] < crossing[:, None]
    return slice(top, top + len(inside)), slice(left, left + len(x)), inside


def fill_polygon(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies inside the polygon (even-odd rule)."""
    whole = np.zeros((height, width), dtype=bool)
    if len(points):
        rows, columns, inside = _filled(points, height, width)
        whole[rows, columns] = inside
    return whole


BLOCK_STEP = 4096


@lru_cache(maxsize=4096)
def _zero_block(n: int, last: bool) -> bytes:
    """``n`` zero bytes as deflate blocks that stand alone."""
    state = zlib.compressobj(1, zlib.DEFLATED, -15)
    return state.compress(bytes(n)) + state.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _packed(layer: np.ndarray, top: int, bottom: int) -> bytes:
    """A zlib stream of a layer that is zero outside the rows ``top`` to ``bottom``, put together of three flushed pieces;
    the zeros around are kept in lengths of whole ``BLOCK_STEP``."""
    before, after = (n * layer.shape[1] // BLOCK_STEP * BLOCK_STEP for n in (top, layer.shape[0] - bottom))
    body = layer.ravel()[before:layer.size - after].tobytes()
    state = zlib.compressobj(1, zlib.DEFLATED, -15)
    check = zlib.adler32(body, before % 65521 << 16 | 1)
    low, high = check & 0xFFFF, ((check >> 16) + after * (check & 0xFFFF)) % 65521
    return b"".join((b"\x78\x01", _zero_block(before, False), state.compress(body), state.flush(zlib.Z_FULL_FLUSH),
                     _zero_block(after, True), struct.pack(">I", high << 16 | low)))


LAYER_FIELDS = "asset_id long, part long, width int, height int, layer binary, boxes long, unreadable long"


NOTHING = slice(0, 0)


def _paint_one(layer: np.ndarray, kind: str, value: int, points, mask) -> slice | None:
    """Paint one shape; the rows it may have painted, or None when it cannot be read."""
    height, width = layer.shape
    if kind == "polygon":
        if points is None or len(points) < 3:
            return NOTHING
        shape = np.clip(np.array([list(p) for p in points], dtype=float), 0, 1) * (width, height)
        rows, columns, inside = _filled(shape, height, width)
        layer[rows, columns][inside] = value
        return rows
    try:
        runs, h, w = checked_runs(mask["size"], mask["counts"])
        if (h, w) == (height, width):
            layer[grid_of(runs, h, w)] = value
            return slice(0, height)
    except (ValueError, TypeError):
        pass
    return None


def _paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Layers of class values from rows in (asset, part, seq) order; one layer is in memory at a time."""
    columns = ["asset_id", "part", "width", "height", "layer", "boxes", "unreadable"]
    key, layer, boxes, unreadable, top, bottom = None, None, 0, 0, 0, 0

    def done() -> tuple:
        height, width = layer.shape
        return (*key, width, height, _packed(layer, min(top, bottom), bottom), boxes, unreadable)

    for batch in batches:
        rows = []
        for asset, part, width, height, kind, index, points, mask in zip(
                batch["asset_id"], batch["part"], batch["width"], batch["height"], batch["kind"],
                batch["class_index"], batch["points"], batch["mask"]):
            if (asset, part) != key:
                if key is not None:
                    rows.append(done())
                key, layer = (asset, part), np.zeros((int(height), int(width)), dtype=np.uint8)
                boxes, unreadable, top, bottom = 0, 0, int(height), 0
            if kind == "bbox":
                boxes += 1
                continue
            painted = _paint_one(layer, kind, int(index) + 1, points, mask)
            if painted is None:
                unreadable += 1
            elif painted.start < painted.stop:
                top, bottom = min(top, painted.start), max(bottom, painted.stop)
        yield pd.DataFrame(rows, columns=columns)
    if key is not None:
        yield pd.DataFrame([done()], columns=columns)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Layers of consecutive parts over each other."""
    rows = rows.sort_values("part")
    out = np.frombuffer(zlib.decompress(rows["layer"].iloc[0]), dtype=np.uint8).copy()
    for body in rows["layer"].iloc[1:]:
        upper = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
        out = np.where(upper > 0, upper, out)
    last = rows.iloc[:1].copy()
    last["part"] = int(rows["up"].iloc[0])
    last["layer"] = [zlib.compress(out.astype(np.uint8).tobytes(), 1)]
    last["boxes"], last["unreadable"] = int(rows["boxes"].sum()), int(rows["unreadable"].sum())
    return last.drop(columns=["up"])


def class_layers(annotations: DataFrame, limit: int = 20_000, fan_in: int = 64) -> DataFrame:
    """(asset_id, width, height, layer, boxes, unreadable): zlib-packed class values per image.

    ``annotations`` holds asset_id, seq, width, height, kind, class_index, points and mask. Boxes are
    counted, not painted. An image with very many annotations is painted in parts that are then laid
    over each other ``fan_in`` at a time, so no task ever holds more than ``limit`` annotations.
    """
    shapes = annotations.filter("kind <> 'classification' and width > 0 and height > 0").fillna({"class_index": 0})
    split = with_parts(shapes, ["asset_id"], [F.col("seq")], limit)
    ordered = spread(split, "asset_id", "part").sortWithinPartitions(
        "asset_id", "part", "seq", "class_index", "points")
    wanted = ("asset_id", "part", "width", "height", "kind", "class_index", "points", "mask")
    layers = ordered.select(*wanted).mapInPandas(_paint, LAYER_FIELDS)
    top = split.filter("part > 0").agg(F.max("part")).first()[0] or 0
    while top > 0:
        up = layers.withColumn("up", F.floor(F.col("part") / fan_in).cast("long"))
        layers = up.groupBy("asset_id", "up").applyInPandas(_merge, LAYER_FIELDS)
        top //= fan_in
    return layers.drop("part")


def class_pixels(layers: DataFrame) -> DataFrame:
    """(asset_id, value, pixels): painted pixels per class value, background left out."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for asset, layer in zip(batch["asset_id"], batch["layer"]):
                n = np.bincount(np.frombuffer(zlib.decompress(layer), dtype=np.uint8), minlength=1)
                rows += [(asset, int(v), int(n[v])) for v in np.flatnonzero(n) if v > 0]
            yield pd.DataFrame(rows, columns=["asset_id", "value", "pixels"])

    return layers.select("asset_id", "layer").mapInPandas(count, "asset_id long, value int, pixels long")


@F.pandas_udf(T.BinaryType())
def layer_png(layer: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([png_bytes(np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(int(h), int(w)))
                      for body, w, h in zip(layer, width, height)])


def mask_column(height: Column, width: Column, counts: Column) -> Column:
    return F.struct(F.array(height.cast("int"), width.cast("int")).alias("size"), counts.alias("counts"))
