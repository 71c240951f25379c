"""Numpy kernels on shapes: borders of labelled chips, tests of rings, unions of polygons, scanlines.

Each works on all sides at once. Only the walk along borders goes from side to side, once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of sides that are compared at once.
PAIRS = 1 << 20
#: Corners of pieces that are united at once; the sides of a shape are not parted.
CORNERS = 1 << 14
_STEPS = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)])


def borders(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(corners, ends, component, area) of all rings of a label image (h, w), whose components are 4-connected and -1 is none.

    ``corners`` (column, row) lie ring after ring, each ring to ``ends``; a component is on the right of its
    rings, so shells have positive areas and holes negative ones. A ring begins at its top left corner.
    Where two cells of a component touch by a corner, a ring stays with its own cell. Rings come by the
    row, then the column of their first corner; of two that begin at the same corner the one to the right first.
    """
    h, w = label.shape
    padded = np.full((h + 2, w + 2), -1, np.int64)
    padded[1:-1, 1:-1] = label
    inner = padded[1:-1, 1:-1]
    begin, way, of = [], [], []
    for d, (beyond, dr, dc) in enumerate(((padded[:-2, 1:-1], 0, 0), (padded[1:-1, 2:], 0, 1), (padded[2:, 1:-1], 1, 1), (padded[1:-1, :-2], 1, 0))):
        r, c = np.nonzero((inner >= 0) & (inner != beyond))
        begin.append((r + dr) * (w + 1) + c + dc)
        way.append(np.full(len(r), d))
        of.append(inner[r, c])
    begin, way, of = np.concatenate(begin), np.concatenate(way), np.concatenate(of)
    order = np.lexsort((way, begin))
    begin, way, of = begin[order], way[order], of[order]
    n = len(begin)
    # a side is known by where it begins and its way
    at = np.full((4, (h + 1) * (w + 1)), -1, np.int64)
    at[way, begin] = np.arange(n)
    end = begin + np.array([1, w + 1, -1, -w - 1])[way]
    follows = np.full(n, -1, np.int64)
    for turn in (3, 0, 1):  # the last that fits stays: to the right, before straight on and to the left
        to = at[(way + turn) % 4, end]
        fits = (to >= 0) & (of[to] == of)
        follows[fits] = to[fits]
    walked, ends = _walk(follows.tolist())
    ring = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    before = np.arange(n) - 1
    before[ends - np.diff(ends, prepend=0)] = ends - 1
    corner = way[walked] != way[walked][before]
    x, y = begin[walked] % (w + 1), begin[walked] // (w + 1)
    x2, y2 = end[walked] % (w + 1), end[walked] // (w + 1)
    area = np.bincount(ring, x * y2 - x2 * y, minlength=len(ends)) / 2
    corners = np.column_stack([x, y])[corner]
    return corners, np.cumsum(np.bincount(ring[corner], minlength=len(ends))), of[walked][ends - 1], area.astype(np.int64)


def _walk(follows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The sides in the order of the rings that they make, and where each ring ends."""
    seen, walked, ends = bytearray(len(follows)), [], []
    for start in range(len(follows)):
        if not seen[start]:
            at = start
            while not seen[at]:
                seen[at] = 1
                walked.append(at)
                at = follows[at]
            ends.append(len(walked))
    return np.array(walked, np.int64), np.array(ends, np.int64)


def close_pairs(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of intervals of the same group that overlap or touch, some at a time.

    A sweep: the intervals that begin while one is active are a range of those sorted by where they begin.
    """
    n = len(low)
    order = np.lexsort((low, of))
    kind = np.concatenate([np.zeros(n, np.int64), np.ones(n, np.int64)])
    events = np.lexsort((kind, np.concatenate([low[order], high[order]]), np.concatenate([of[order], of[order]])))
    begun = np.cumsum(kind[events] == 0)
    until = np.empty(n, np.int64)
    until[events[kind[events] == 1] - n] = begun[kind[events] == 1]
    count = np.maximum(until - np.arange(n) - 1, 0)
    total = np.cumsum(count)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
        own = count[first:last]
        i = np.repeat(np.arange(first, last), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        yield order[i], order[j]
        first = last


def simple_rings(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each ring of corners (the first one not repeated) whether it has an area and its sides meet only at their common corners."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(ring)) - begin[ring]
    after = np.where(nth == sizes[ring] - 1, begin[ring], np.arange(len(ring)) + 1)
    x2, y2 = x[after], y[after]
    good = (sizes >= 3) & (np.bincount(ring, x * y2 - x2 * y, minlength=len(sizes)) != 0)
    for i, j in close_pairs(np.minimum(x, x2), np.maximum(x, x2), ring):
        far = (np.abs(nth[i] - nth[j]) > 1) & (np.abs(nth[i] - nth[j]) < sizes[ring[i]] - 1)
        i, j = i[far], j[far]
        level = (np.maximum(y[i], y2[i]) >= np.minimum(y[j], y2[j])) & (np.maximum(y[j], y2[j]) >= np.minimum(y[i], y2[i]))
        i, j = i[level], j[level]
        side = lambda a, px, py: np.sign((x2[a] - x[a]) * (py - y[a]) - (y2[a] - y[a]) * (px - x[a]))
        meet = (side(i, x[j], y[j]) * side(i, x2[j], y2[j]) <= 0) & (side(j, x[i], y[i]) * side(j, x2[i], y2[i]) <= 0)
        good[ring[i[meet]]] = False
    return good


def strip(line: np.ndarray, half: float, quarter: int = 16) -> list[np.ndarray]:
    """Pieces, all turning left, that cover a line's buffer: a rectangle for each segment, a round join for each bend; ends are flat.

    ``quarter`` steps make a quarter of a circle.
    """
    line = line[np.concatenate([[True], (np.diff(line, axis=0) != 0).any(1)])] if len(line) else line
    if len(line) < 2 or not half > 0:
        return []
    step = np.diff(line, axis=0)
    normal = np.column_stack([-step[:, 1], step[:, 0]]) / np.hypot(step[:, 0], step[:, 1])[:, None] * half
    pieces = [np.array([a - n, b - n, b + n, a + n]) for a, b, n in zip(line[:-1], line[1:], normal, strict=True)]
    for k in range(1, len(step)):
        turn = np.arctan2(step[k - 1, 0] * step[k, 1] - step[k - 1, 1] * step[k, 0], step[k - 1] @ step[k])
        if turn == 0:
            continue
        side = -1.0 if turn > 0 else 1.0  # a bend to the left is open on the right
        first, last = side * normal[k - 1], side * normal[k]
        n = max(1, int(np.ceil(abs(turn) / (np.pi / 2) * quarter - 1e-9)))
        angles = np.arctan2(first[1], first[0]) + turn * np.arange(1, n) / n
        arc = line[k] + half * np.column_stack([np.cos(angles), np.sin(angles)])
        fan = np.concatenate([[line[k]], [line[k] + first], arc, [line[k] + last]])
        pieces.append(fan if turn > 0 else fan[::-1])
    return pieces


def union(pieces: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """(area, rings) of the union of polygons that all turn left; shells turn left and holes right."""
    area, rings, _ = unions(pieces, np.zeros(len(pieces), np.int64), 1)
    return float(area[0]), rings


def unions(pieces: list[np.ndarray], of: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(areas, rings, their shapes) of the unions of polygons that all turn left, for ``n`` shapes at once, by a sweep; ``of`` rises and names a piece's shape.

    Between two heights at which sides of a shape begin, end or cross, its active sides keep their order. Their
    windings add up from left to right, and the shape is where the sum isn't 0. Its left and right sides
    and, at each height, what is covered on one side of it only make the rings, which come by their shapes.
    """
    if not pieces:
        return np.zeros(n), [], np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in pieces])
    x, y = np.concatenate(pieces).astype(float).T
    x2, y2 = x[after := _around(np.repeat(np.arange(len(pieces)), sizes))[1]], y[after]
    of = np.repeat(of, sizes)
    tall = y != y2
    x, y, x2, y2, of = x[tall], y[tall], x2[tall], y2[tall], of[tall]
    wind = np.where(y2 > y, 1, -1)
    up = wind > 0
    x, x2, y, y2 = np.where(up, x, x2), np.where(up, x2, x), np.where(up, y, y2), np.where(up, y2, y)
    # several pieces share sides; equal sides are one, and their windings add up
    first, same = _named(of, x, y, x2, y2)
    wind = np.bincount(same, wind, minlength=len(first)).astype(np.int64)
    first, wind = first[wind != 0], wind[wind != 0]
    x, y, x2, y2, of = x[first], y[first], x2[first], y2[first], of[first]
    levels, level_of = [y, y2], [of, of]
    for i, j in close_pairs(y, y2, of):
        near = (np.maximum(x[i], x2[i]) >= np.minimum(x[j], x2[j])) & (np.maximum(x[j], x2[j]) >= np.minimum(x[i], x2[i]))
        i, j = i[near], j[near]
        ax, ay, bx, by = x2[i] - x[i], y2[i] - y[i], x2[j] - x[j], y2[j] - y[j]
        cross = ax * by - ay * bx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x[j] - x[i]) * by - (y[j] - y[i]) * bx) / cross
            u = ((x[j] - x[i]) * ay - (y[j] - y[i]) * ax) / cross
            meet = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            levels.append((y[i] + t * ay)[meet])
            level_of.append(of[i][meet])
    levels, level_of = np.concatenate(levels), np.concatenate(level_of)
    first, nth = _named(level_of, levels)
    levels, level_of = levels[first], level_of[first]
    low, high = nth[: len(y)], nth[len(y) : 2 * len(y)]
    side = np.repeat(np.arange(len(y)), high - low)
    slab = np.repeat(low, high - low) + np.arange(len(side)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)

    def place(e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where sides are at heights; their own ends exactly."""
        found = x[e] + (at - y[e]) / (y2[e] - y[e]) * (x2[e] - x[e])
        return np.where(at == y[e], x[e], np.where(at == y2[e], x2[e], found))

    middle = place(side, (levels[slab] + levels[slab + 1]) / 2)
    order = np.lexsort((middle, slab))
    side, slab, middle = side[order], slab[order], middle[order]
    total = np.cumsum(wind[side])  # a slab's windings add up to 0
    last = np.ones(len(side), bool)
    last[:-1] = (slab[1:] != slab[:-1]) | (middle[1:] != middle[:-1])
    side, slab, middle, total = side[last], slab[last], middle[last], total[last]
    came = np.concatenate([[0], total[:-1]])
    opens, closes = (came == 0) & (total != 0), (came != 0) & (total == 0)
    area = np.bincount(level_of[slab[opens]], (middle[closes] - middle[opens]) * (levels[slab[opens] + 1] - levels[slab[opens]]), minlength=n)
    edge = opens | closes
    e, s, sign = side[edge], slab[edge], np.where(opens[edge], 1, -1)
    bottom, top = place(e, levels[s]), place(e, levels[s + 1])
    # left sides go down, right sides up
    start = np.column_stack([np.where(sign > 0, top, bottom), np.where(sign > 0, levels[s + 1], levels[s])])
    stop = np.column_stack([np.where(sign > 0, bottom, top), np.where(sign > 0, levels[s], levels[s + 1])])
    # at each height what is covered above only goes to the right, what is covered below only to the left
    at = np.concatenate([s, s + 1])
    where = np.concatenate([bottom, top])
    above, below = np.concatenate([sign, 0 * sign]), np.concatenate([0 * sign, sign])
    order = np.lexsort((where, at))
    at, where, above, below = at[order], where[order], np.cumsum(above[order]), np.cumsum(below[order])
    flat = np.flatnonzero((above[:-1] != below[:-1]) & (at[1:] == at[:-1]) & (where[1:] != where[:-1]))
    right = above[flat] > below[flat]
    a, b = np.column_stack([where[flat], levels[at[flat]]]), np.column_stack([where[flat + 1], levels[at[flat]]])
    start = np.concatenate([start, np.where(right[:, None], a, b)])
    stop = np.concatenate([stop, np.where(right[:, None], b, a)])
    return area, *_stitched(start, stop, np.concatenate([level_of[s], level_of[at[flat]]]))


def _named(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, name): where each different row of the columns stands first, by the rows' order, and the number of each row among them."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) - 1
    return order[new], name


def _around(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the corners before and after each one stand, given the rising number of each corner's ring."""
    begins = np.ones(len(ring), bool)
    begins[1:] = ring[1:] != ring[:-1]
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(ring)) - 1 if len(begin) else begin
    before, after = np.arange(len(ring)) - 1, np.arange(len(ring)) + 1
    before[begin], after[end] = end, begin
    return before, after


def _stitched(start: np.ndarray, stop: np.ndarray, of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(rings, their shapes) of directed pieces, turning left as far as they can where several go on; corners on straight runs are left out."""
    some = (start != stop).any(1)
    start, stop, of = start[some], stop[some], of[some]
    _, name = _named(np.tile(of, 2), *np.concatenate([start, stop]).T)
    begins, ends = name[: len(start)].tolist(), name[len(start) :].tolist()
    out_of: dict[int, list[int]] = {}
    for k, b in enumerate(begins):
        out_of.setdefault(b, []).append(k)
    way = np.arctan2(stop[:, 1] - start[:, 1], stop[:, 0] - start[:, 0])
    run, lengths, seen = [], [], bytearray(len(begins))
    for first, home in enumerate(begins):
        if seen[first]:
            continue
        at, before = first, len(run)
        while at is not None:
            seen[at] = 1
            out_of[begins[at]].remove(at)
            run.append(at)
            goes = out_of[ends[at]] if ends[at] != home else ()
            at = goes[0] if len(goes) == 1 else max(goes, key=lambda k, at=at: (way[k] - way[at] + np.pi) % (2 * np.pi)) if goes else None
        lengths.append(len(run) - before)
    ring, nth = start[run], np.repeat(np.arange(len(lengths)), lengths)
    size = np.maximum.reduceat(np.abs(ring).max(1), np.cumsum(lengths) - lengths)[nth] + 1 if len(run) else np.zeros(0)
    kept = (np.abs(ring[_around(nth)[1]] - ring) > 1e-13 * size[:, None]).any(1)
    ring, nth, own = ring[kept], nth[kept], of[run][kept]
    before, after = _around(nth)
    came, goes = ring - ring[before], ring[after] - ring
    turn = np.abs(came[:, 0] * goes[:, 1] - came[:, 1] * goes[:, 0])
    kept = turn > 1e-11 * np.hypot(*came.T) * np.hypot(*goes.T)
    ring, nth, own = ring[kept], nth[kept], own[kept]
    cut = np.flatnonzero(nth[1:] != nth[:-1]) + 1
    rings = [(r, k) for r, k in zip(np.split(ring, cut), own[np.concatenate([[0], cut])].tolist(), strict=True) if len(r) >= 3] if len(ring) else []
    return [r for r, _ in rings], np.array([k for _, k in rings], np.int64)


def spans(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(of, row, begin, end) of the pixels whose centres lie inside the sides of polygons' rings (even-odd rule), in the order of ``of`` and rows.

    ``of`` names a side's polygon, first to last - 1 are its rows. A side is active in the rows whose
    centres it passes. Its crossing switches the pixels from there on; crossings of a row, in order, are pairs.
    """
    flip = y > y2
    x, x2, y, y2 = np.where(flip, x2, x), np.where(flip, x, x2), np.where(flip, y2, y), np.where(flip, y, y2)
    low, high = (np.minimum(np.maximum(np.ceil(v - 0.5), first), last).astype(np.int64) for v in (y, y2))
    n = high - low
    e = np.repeat(np.arange(len(x)), n)
    row = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    at = (x2[e] - x[e]) * (row + 0.5 - y[e]) / (y2[e] - y[e]) + x[e]
    column = np.clip(np.ceil(at - 0.5), 0, width).astype(np.int64)
    order = np.lexsort((column, row, of[e]))
    row, column, of = row[order], column[order], of[e][order]
    some = column[0::2] < column[1::2]
    return of[0::2][some], row[0::2][some], column[0::2][some], column[1::2][some]
