"""Detection on images in numpy: threshold, components, clusters, quads, codewords.

Images are uint8 arrays indexed [y, x], or stacks [frame, y, x] of one size: inside ``mapInArrow`` a stack of small
frames goes through each step at once.  Every step has the same result as its relational form.
"""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np

from tesserae.config import ConfigError, DetectorConfig, QuadParams

#: Pixels of the frames that go through the steps at once; a larger frame goes alone.
STACK = 1 << 18


def stacks(images: list[np.ndarray]):
    """Places of images of one size, at most :data:`STACK` pixels or one image at a time."""
    sizes: dict[tuple, list[int]] = {}
    for i, im in enumerate(images):
        sizes.setdefault(im.shape, []).append(i)
    for (h, w), places in sizes.items():
        n = max(1, STACK // max(1, h * w))
        for start in range(0, len(places), n):
            yield places[start : start + n]


# Image steps.


def decimate(im: np.ndarray, k: int) -> np.ndarray:
    return im[..., ::k, ::k]


def decimate_three_halves(im: np.ndarray) -> np.ndarray:
    lead, h, w = im.shape[:-2], im.shape[-2] // 3, im.shape[-1] // 3
    b = im[..., : h * 3, : w * 3].astype(np.int32).reshape(*lead, h, 3, w, 3)
    out = np.empty((*lead, h, 2, w, 2), np.uint8)
    for dy in (0, 1):
        for dx in (0, 1):
            out[..., dy, :, dx] = (4 * b[..., 2 * dy, :, 2 * dx] + 2 * b[..., 2 * dy, :, 1] + 2 * b[..., 1, :, 2 * dx] + b[..., 1, :, 1]) // 9
    return out.reshape(*lead, h * 2, w * 2)


def _convolve(im: np.ndarray, kernel: list[int]) -> np.ndarray:
    n, half = len(kernel), len(kernel) // 2
    out, valid = im.copy(), im.shape[-1] - n
    if valid > 0:
        total = 127 + sum(k * im[..., i : i + valid].astype(np.int32) for i, k in enumerate(kernel))
        out[..., half : half + valid] = np.minimum(255, total >> 8)
    return out


def blur(im: np.ndarray, kernel: list[int]) -> np.ndarray:
    return np.swapaxes(_convolve(np.swapaxes(_convolve(im, kernel), -1, -2), kernel), -1, -2)


def sigma_filter(im: np.ndarray, config: DetectorConfig) -> np.ndarray:
    kernel = config.sigma_kernel()
    if kernel is None:
        return im
    soft = blur(im, kernel)
    return soft if config.quad_sigma > 0 else np.clip(2 * im.astype(np.int32) - soft, 0, 255).astype(np.uint8)


def threshold(im: np.ndarray, least: int = 5, size: int = 4, full_blur: bool = False, known: np.ndarray | None = None) -> np.ndarray:
    """0, 127 or 255; pixels that aren't ``known`` have no part in a tile's range."""
    lead, (h, w) = im.shape[:-2], im.shape[-2:]
    th, tw = h // size, w // size
    low, high = (im, im) if known is None else (np.where(known, im, np.uint8(255)), np.where(known, im, np.uint8(0)))
    mn, mx = _tile_fold(low, size, np.minimum), _tile_fold(high, size, np.maximum)
    for axis in (-2, -1):
        a, b = np.moveaxis(mn, axis, 0), np.moveaxis(mx, axis, 0)
        lo, hi = a.copy(), b.copy()
        np.minimum(lo[1:], a[:-1], out=lo[1:])
        np.maximum(hi[1:], b[:-1], out=hi[1:])
        if full_blur:
            np.minimum(lo[:-1], a[1:], out=lo[:-1])
            np.maximum(hi[:-1], b[1:], out=hi[:-1])
        mn, mx = np.moveaxis(lo, 0, axis), np.moveaxis(hi, 0, axis)
    middle, flat = mn + (mx - mn) // 2, mx - mn < least
    xs = np.minimum(np.arange(w) // size, tw - 1)
    middle, flat = np.take(middle, xs, -1), np.take(flat, xs, -1)
    flat[..., tw * size :] = False
    out = np.empty(im.shape, np.uint8)
    tall = lambda a: a[..., : th * size, :].reshape(*lead, th, size, w)
    inner = tall(out)
    np.negative((tall(im) > middle[..., None, :]).view(np.uint8), out=inner)  # 255 where true
    np.copyto(inner, np.uint8(127), where=flat[..., None, :])
    out[..., th * size :, :] = np.negative((im[..., th * size :, :] > middle[..., th - 1 : th, :]).view(np.uint8))
    return out


def _tile_fold(im: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each full tile, by rows and then by columns."""
    th, tw = im.shape[-2] // size, im.shape[-1] // size
    part = functools.reduce(f, [im[..., i : th * size : size, : tw * size] for i in range(size)])
    return functools.reduce(f, [part[..., i::size] for i in range(size)])


def in_known_tiles(known: np.ndarray, size: int = 4) -> np.ndarray:
    """Known pixels whose tile - the nearest full one - has known pixels itself."""
    lead, (h, w) = known.shape[:-2], known.shape[-2:]
    th, tw = h // size, w // size
    some = known[..., : th * size, : tw * size].reshape(*lead, th, size, tw, size).any((-3, -1))
    return known & some[..., np.minimum(np.arange(h) // size, th - 1)[:, None], np.minimum(np.arange(w) // size, tw - 1)]


#: Points are kept at twice their coordinates, so sides stay below this.
MOST_SIDE = 32768


def check_size(shape: tuple[int, int]) -> None:
    if max(shape) >= MOST_SIDE:
        raise ConfigError(f"sides must be below {MOST_SIDE}")


def bayer_threshold(im: np.ndarray, size: int = 32) -> np.ndarray:
    """0 or 1 by the range of each of four phases over 3 x 3 tiles."""
    h, w = im.shape
    th, tw = -(-h // size), -(-w // size)
    out = np.zeros(im.shape, np.uint8)
    for py in (0, 1):
        for px in (0, 1):
            mn, mx = np.full((th + 2, tw + 2), 255), np.zeros((th + 2, tw + 2), int)
            for ty in range(th):
                for tx in range(tw):
                    own = im[ty * size + py : (ty + 1) * size : 2, tx * size + px : (tx + 1) * size : 2]
                    if own.size:
                        mn[ty + 1, tx + 1], mx[ty + 1, tx + 1] = own.min(), own.max()
            win = np.lib.stride_tricks.sliding_window_view
            lo, hi = win(mn, (3, 3)).min((2, 3)), win(mx, (3, 3)).max((2, 3))
            ys, xs = np.arange(py, h, 2), np.arange(px, w, 2)
            at = np.ix_(ys // size, xs // size)
            out[py::2, px::2] = im[py::2, px::2] > lo[at] + (hi[at] - lo[at]) // 2
    return out


def deglitch(t: np.ndarray) -> np.ndarray:
    """Closing of the inner pixels (see the relational form)."""
    win = lambda a: np.lib.stride_tricks.sliding_window_view(a, (3, 3), (-2, -1))
    d = np.full_like(t, 255)
    d[..., 1:-1, 1:-1] = win(t).max((-2, -1))
    out = t.copy()
    out[..., 1:-1, 1:-1] = win(d).min((-2, -1))
    return out


@functools.lru_cache(maxsize=4)
def _inner(n: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pixels of a stack in scan order: those of columns 1 to w - 2, those of them below the first row, and those of column 1."""
    every = np.zeros((3, n, h, w), bool)
    every[0, ..., 1:-1] = every[1, :, 1:, 1:-1] = every[2, ..., 1:2] = True
    inner, below, first = every.reshape(3, -1)
    return inner, below, first & inner


def _links(t: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Pixels in scan order that are linked to the one at each of four offsets. Shifts run over the whole stack; what wraps around is masked."""
    h, w = t.shape[-2:]
    v = np.ascontiguousarray(t).ravel()
    inner, below, first = _inner(v.size // (h * w), h, w)

    def back(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(a.shape, a.dtype)
        out[by:] = a[: a.size - by]
        return out

    def same(by: int) -> np.ndarray:
        out = np.zeros(v.shape, bool)
        np.equal(v[by:], v[: v.size - by], out=out[by:])
        return out

    left, up = same(1), same(w)
    up_before, left_above = back(up, 1), back(left, w)
    some, light = v != 127, below & (v == 255)
    return [
        (some & inner & left, -1),
        (some & below & up & (first | ~(up_before & left_above)), -w),
        (light & same(w + 1) & (first | ~(up_before | left_above)), -w - 1),
        (light & same(w - 1) & ~back(left, w - 1), -w + 1),
    ]


def component_edges(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the numbers y * w + x of equal neighbours; in a stack the numbers go on from frame to frame."""
    rules = _links(t)
    ends = [np.flatnonzero(m) for m, _ in rules]
    return np.concatenate(ends), np.concatenate([e + d for e, (_, d) in zip(ends, rules, strict=True)])


def component_runs(t: np.ndarray, blank: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of linked pixels of a row: each pixel's run, the runs' first pixels, and the first run of each one's component.

    With ``blank`` neighbouring unknown pixels are one run as well, which spares most of the runs.
    """
    (along, _), *others = _links(t)
    if blank:
        none = t.ravel() == 127
        along[1:] |= none[1:] & none[:-1]
    starts = np.flatnonzero(~along)
    run = np.repeat(np.arange(len(starts), dtype=np.int32 if t.size < 1 << 31 else np.int64), np.diff(starts, append=t.size))
    ends = [np.flatnonzero(m) for m, _ in others]
    a, b = run[np.concatenate(ends)], run[np.concatenate([e + d for e, (_, d) in zip(ends, others, strict=True)])]
    root = np.arange(len(starts), dtype=run.dtype)
    while True:
        p, q = root[a], root[b]
        open_ = p != q
        if not open_.any():
            return run, starts, root
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not ((jumped := root[root]) == root).all():
            root = jumped


def components(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least pixel number of each pixel's component, and the component's size."""
    run, starts, root = component_runs(t)
    return starts[root][run].reshape(t.shape), _sizes(t, starts, root)[run].reshape(t.shape)


def _sizes(t: np.ndarray, starts: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Pixels of each run's component."""
    return np.bincount(root, np.diff(starts, append=t.size), len(root)).astype(np.int64)[root]


def boundary(t: np.ndarray, label: np.ndarray, sizes: np.ndarray, least: int = 24) -> tuple[np.ndarray, ...]:
    """Pixels with a boundary point, the pixel on its other side, and the step from one to the other, as places in scan order; ``sizes`` are those of labels."""
    h, w = t.shape[-2:]
    v = t.ravel()
    can = np.zeros(t.shape, bool)
    can[..., : h - 1, 1 : w - 1] = (t != 127)[..., : h - 1, 1 : w - 1]
    can = can.ravel()
    big, found = sizes > least, []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
        by = dy * w + dx
        at = np.flatnonzero(can[: v.size - by] & (v[by:] != v[: v.size - by]))
        at = at[big[label[at]] & big[label[at + by]]]
        if (dx, dy) == (1, 1):
            lower_right = np.zeros(v.size, bool)
            lower_right[at] = True
        elif dx < 0:
            at = at[~lower_right[at - 1]]
        found.append((at, by, dx, dy))
    at = np.concatenate([f[0] for f in found])
    by, dx, dy = (np.repeat(np.array([f[i] for f in found]), [len(f[0]) for f in found]) for i in (1, 2, 3))
    return at, at + by, dx, dy


def _points_at(t: np.ndarray, at: np.ndarray, to: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> list[np.ndarray]:
    """x, y (doubled), gx, gy of boundary points."""
    h, w = t.shape[-2:]
    v, row = t.ravel(), at // w
    d = v[to].astype(np.int64) - v[at]
    return [2 * (at - row * w) + dx, 2 * (row % h) + dy, dx * d, dy * d]


def gradient_points(t: np.ndarray, label: np.ndarray, size: np.ndarray, least: int = 24) -> np.ndarray:
    """Rows (c0, c1, x, y, gx, gy)."""
    label = label.ravel()
    sizes = np.zeros(t.size, np.int64)
    sizes[label] = size.ravel()
    at, to, dx, dy = boundary(t, label, sizes, least)
    a, b = label[at], label[to]
    return np.stack([np.maximum(a, b), np.minimum(a, b), *_points_at(t, at, to, dx, dy)], 1)


# Quads.


def slope_keys(x: np.ndarray, y: np.ndarray, box: np.ndarray | None = None) -> np.ndarray:
    """Key that orders points around the middle of their box, in single precision; ``box`` has left + right and top + bottom of each point's."""
    f = np.float32
    box = np.array([int(x.min()) + int(x.max()), int(y.min()) + int(y.max())]) if box is None else box
    middle = box.astype(f) * f(0.5) + np.array([0.05118, -0.028581], f)
    dx, dy = x.astype(f) - middle[..., 0], y.astype(f) - middle[..., 1]
    base = np.where(dy > 0, np.where(dx > 0, f(65536), f(131072)), np.where(dx > 0, f(0), f(-65536)))
    flip = dy < 0
    dx, dy = np.where(flip, -dx, dx), np.where(flip, -dy, dy)
    turn = dx < 0
    dx, dy = np.where(turn, dy, dx), np.where(turn, -dx, dy)
    return base + dy / dx


def point_moments(im: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """w, wx, wy, wxx, wxy, wyy of points (doubled coordinates) in frames of a stack."""
    px, py = x / 2 + 0.5, y / 2 + 0.5
    ix, iy = px.astype(int), py.astype(int)
    h, w = im.shape[-2:]
    inner = (ix > 0) & (ix + 1 < w) & (iy > 0) & (iy + 1 < h)
    at = (frame * h + np.minimum(np.maximum(iy, 1), h - 2)) * w + np.minimum(np.maximum(ix, 1), w - 2)
    flat = im.ravel()
    i = lambda by: flat[at + by].astype(np.float64)
    wt = np.where(inner, np.hypot(i(1) - i(-1), i(w) - i(-w)) + 1, 1.0)
    out = np.empty((len(x), 6))
    out[:, 0], out[:, 1], out[:, 2] = wt, wt * px, wt * py
    out[:, 3], out[:, 4], out[:, 5] = out[:, 1] * px, out[:, 1] * py, out[:, 2] * py
    return out


def prefix_moments(im: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Running sums of w, wx, wy, wxx, wxy, wyy over ordered points of one image."""
    return np.cumsum(point_moments(im, np.zeros(len(x), int), x, y), 0)


def range_moments(prefix: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from i0 to i1, both included, around the end where i0 > i1; and the number of points."""
    padded = np.concatenate([np.zeros((1, 6)), prefix])
    m = padded[i1 + 1] - padded[i0]
    around = i0 > i1
    return np.where(around[:, None], m + prefix[-1], m), np.where(around, len(prefix) - i0 + i1 + 1, i1 - i0 + 1)


def lines_of(m: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Centre, normal, mean squared error and total error of the lines through points with these sums and numbers."""
    ex, ey = m[:, 1] / m[:, 0], m[:, 2] / m[:, 0]
    cxx, cxy, cyy = m[:, 3] / m[:, 0] - ex * ex, m[:, 4] / m[:, 0] - ex * ey, m[:, 5] / m[:, 0] - ey * ey
    root = np.sqrt(((cxx - cyy) ** 2 + 4 * cxy**2).astype(np.float32)).astype(np.float64)
    low, high = 0.5 * (cxx + cyy - root), 0.5 * (cxx + cyy + root)
    by_x, by_y = cxx - high, cyy - high
    na, nb = by_x * by_x + cxy * cxy, cxy * cxy + by_y * by_y
    one = na > nb
    length = np.sqrt(np.maximum(na, nb).astype(np.float32)).astype(np.float64)
    safe = np.where(length > 0, length, np.inf)
    return {"ex": ex, "ey": ey, "nx": np.where(one, by_x, cxy) / safe, "ny": np.where(one, cxy, by_y) / safe, "mse": low, "err": n * low}


def fit_lines(prefix: np.ndarray, i0, i1) -> dict[str, np.ndarray]:
    """The lines through ranges of one cluster's points."""
    return lines_of(*range_moments(prefix, np.asarray(i0), np.asarray(i1)))


def _in_order(own: np.ndarray, key: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Order by cluster, key (single precision) and ties: one sort of whole numbers, in which equal ones are sorted again."""
    bits = (key + np.float32(0)).view(np.int32)  # one zero
    whole = (own.astype(np.int64) << 32) + (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF)))
    order = np.argsort(whole)
    sorted_ = whole[order]
    again = np.zeros(len(order) + 1, bool)
    again[1:-1] = sorted_[1:] == sorted_[:-1]
    at = np.flatnonzero(again[1:] | again[:-1])
    order[at] = order[at][np.lexsort((ties[order[at]], sorted_[at]))]
    return order


class Clusters:
    """Ordered points of many clusters, one after the other, with running sums that begin anew in each."""

    def __init__(self, moments: np.ndarray, lengths: np.ndarray):
        self.n = lengths
        self.first = np.cumsum(lengths) - lengths
        self.prefix = np.empty_like(moments)
        for s, e in zip(self.first.tolist(), (self.first + lengths).tolist(), strict=True):
            np.cumsum(moments[s:e], 0, out=self.prefix[s:e])

    def lines(self, c: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> dict[str, np.ndarray]:
        """Lines through the points i0 to i1 of clusters c, both included, around the end where i0 > i1."""
        first, n = self.first[c], self.n[c]
        m = self.prefix[first + i1] - np.where((i0 > 0)[:, None], self.prefix[first + np.maximum(i0, 1) - 1], 0)
        around = i0 > i1
        m[around] += self.prefix[(first + n - 1)[around]]
        return lines_of(m, np.where(around, n - i0 + i1 + 1, i1 - i0 + 1))

    def corner_maxima(self, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Candidates for corners, where the fit around a point is worst: by their number k, the clusters (c) and the points' places (c, k)."""
        own = np.repeat(np.arange(len(self.n)), self.n)
        n, first = self.n[own], self.first[own]
        at, reach = np.arange(len(own)) - first, np.minimum(20, n // 12)
        err = self.lines(own, (at - reach) % n, (at + reach) % n)["err"]
        weights = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
        err = sum(wt * err[first + (at + j) % n] for j, wt in zip(range(-3, 4), weights, strict=True))
        top = np.flatnonzero((err > err[first + (at + 1) % n]) & (err > err[first + (at - 1) % n]) & (reach >= 2))
        held: dict[int, list] = {}
        for part in np.split(top, np.flatnonzero(np.diff(own[top])) + 1):
            if len(part) > most:
                part = part[err[part] > np.sort(err[part])[::-1][most]]
            if len(part) >= 4:
                held.setdefault(len(part), []).append((own[part[0]], at[part]))
        return {k: (np.array([c for c, _ in g]), np.array([a for _, a in g])) for k, g in held.items()}

    def best_corners(self, qtp: QuadParams) -> tuple[np.ndarray, np.ndarray]:
        """The four maxima whose lines fit best: clusters in order, and places (c, 4). Clusters without such are left out."""
        found = [(np.zeros(0, int), np.zeros((0, 4), int))]
        for k, (c, top) in self.corner_maxima(qtp.max_nmaxima).items():
            i, j = np.divmod(np.arange(k * k), k)
            line = {name: v.reshape(len(c), k * k) for name, v in self.lines(np.repeat(c, k * k), top[:, i].ravel(), top[:, j].ravel()).items()}
            four = _fours(k)
            sides = [four[:, a] * k + four[:, b] for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))]
            ok = np.logical_and.reduce([line["mse"][:, s] <= qtp.max_line_fit_mse for s in sides])
            ok &= np.abs(line["nx"][:, sides[0]] * line["nx"][:, sides[1]] + line["ny"][:, sides[0]] * line["ny"][:, sides[1]]) <= qtp.cos_critical_rad
            total = np.where(ok, sum(line["err"][:, s] for s in sides), np.inf)
            best = total.argmin(1)
            use = total[np.arange(len(c)), best] / self.n[c] < qtp.max_line_fit_mse
            found.append((c[use], np.take_along_axis(top, four[best], 1)[use]))
        c, places = (np.concatenate(a) for a in zip(*found, strict=True))
        order = np.argsort(c)
        return c[order], places[order]


@functools.lru_cache(maxsize=64)
def _fours(k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(k), 4)))


def intersect(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Meeting points of lines given by centre and normal (last axis), and whether there is one."""
    det = p[..., 2] * q[..., 3] - p[..., 3] * q[..., 2]
    ok = np.abs(det) >= 1e-3
    safe = np.where(ok, det, 1.0)
    r, t = p[..., 2] * p[..., 0] + p[..., 3] * p[..., 1], q[..., 2] * q[..., 0] + q[..., 3] * q[..., 1]
    return np.stack([(r * q[..., 3] - t * p[..., 3]) / safe, (p[..., 2] * t - q[..., 2] * r) / safe], -1), ok


def _heron(a, b, c):
    s = (a + b + c) / 2
    return np.sqrt(np.maximum(0.0, s * (s - a) * (s - b) * (s - c)))


def valid_quad(c: np.ndarray, tag_width: int, qtp: QuadParams) -> np.ndarray:
    """Whether corners (..., 4, 2) make a quadrilateral that is large, square and turned enough."""
    d = np.roll(c, -1, -2) - c
    side, across = np.hypot(d[..., 0], d[..., 1]), np.hypot(*np.moveaxis(c[..., 2, :] - c[..., 0, :], -1, 0))
    area = _heron(side[..., 0], side[..., 1], across) + _heron(side[..., 2], side[..., 3], across)
    e, long = np.roll(d, -1, -2), side * np.roll(side, -1, -1)
    cos = np.abs((d * e).sum(-1)) / np.where(long > 0, long, 1.0)
    turns = d[..., 0] * e[..., 1] >= d[..., 1] * e[..., 0]
    return (area >= 0.95 * tag_width * tag_width) & ((long > 0) & (cos <= qtp.cos_critical_rad) & turns).all(-1)


def merged_corners(prefix: np.ndarray, qtp: QuadParams) -> tuple[int, int, int, int] | None:
    """Another way to four corners: neighbouring runs of points are merged, the cheapest first, until four are left."""
    n = len(prefix)
    starts = list(range(n))
    if n < 8:
        return None
    after = {s: (s + 1) % n for s in starts}
    before = {s: (s - 1) % n for s in starts}

    def entry(s: int) -> tuple[float, int, int, int]:
        """Cost of merging the run at s with the next one, and what it was worked out for."""
        nxt = after[s]
        end = after[nxt]
        return float(fit_lines(prefix, np.array([s]), np.array([(end - 1) % n]))["err"][0]), s, nxt, end

    heap = [entry(s) for s in starts]
    heapq.heapify(heap)
    while len(after) > 4:
        _, s, nxt, end = heapq.heappop(heap)
        if after.get(s) != nxt or after.get(nxt) != end:
            continue  # one of the two runs has changed since
        after[s] = after.pop(nxt)
        before[after[s]] = s
        del before[nxt]
        for q in (before[s], s):
            heapq.heappush(heap, entry(q))
    corners = tuple(sorted(after))
    line = fit_lines(prefix, np.array(corners), np.array(corners[1:] + corners[:1]))
    return corners if (line["mse"] <= qtp.max_line_fit_mse).all() else None


def find_quads(im: np.ndarray, t: np.ndarray, config: DetectorConfig, tag_width: int, normal: bool, reversed_: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quadrilaterals in a stack of frames: frame (q), corners (q, 4, 2), and whether the border is reversed (q)."""
    qtp, none = config.qtp, (np.zeros(0, int), np.zeros((0, 4, 2)), np.zeros(0, bool))
    run, starts, root = component_runs(t, blank=True)
    sizes = _sizes(t, starts, root)
    sizes[t.ravel()[starts] == 127] = 0
    at, to, dx, dy = boundary(t, run, sizes)
    if not len(at):
        return none
    one, other = root[run[at]], root[run[to]]
    key = np.maximum(one, other).astype(np.int64) * t.size + np.minimum(one, other)
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    n = np.diff(np.append(starts, len(key)))
    long = (n >= max(qtp.min_cluster_pixels, 24)) & (n <= 4 * sum(t.shape[1:]))
    if not long.any():
        return none
    order, n = order[np.repeat(long, n)], n[long]
    at = at[order]
    x, y, gx, gy = _points_at(t, at, to[order], dx[order], dy[order])
    starts = np.cumsum(n) - n
    # Clusters of no use go at once: by box and polarity.
    low, high = (np.stack([f.reduceat(x, starts), f.reduceat(y, starts)], 1) for f in (np.minimum, np.maximum))
    sums = np.stack([np.add.reduceat(e, starts) for e in (x * gx + y * gy, gx, gy)], 1)  # whole numbers: exact in any order
    flipped = sums[:, 0] - (((low + high) * 0.5 + (0.05118, -0.028581)) * sums[:, 1:]).sum(1) < 0
    use = ((high - low).prod(1) >= tag_width) & np.where(flipped, reversed_, normal)
    if not use.any():
        return none
    keep = np.repeat(use, n)
    at, x, y, gx, gy = (e[keep] for e in (at, x, y, gx, gy))
    low, high, flipped, n = low[use], high[use], flipped[use], n[use]
    own, frame = np.repeat(np.arange(len(n)), n), at // (t.shape[1] * t.shape[2])
    ties = (((y << 16) + x << 10) + gx + 512 << 10) + gy + 512
    order = _in_order(own, slope_keys(x, y, (low + high)[own]), ties)
    clusters = Clusters(point_moments(im, frame[order], x[order], y[order]), n)
    c, places = clusters.best_corners(qtp)
    if not len(c):
        return none
    line = {k: v.reshape(-1, 4) for k, v in clusters.lines(np.repeat(c, 4), places.ravel(), np.roll(places, -1, 1).ravel()).items()}
    sides = np.stack([line["ex"], line["ey"], line["nx"], line["ny"]], -1)
    corners, met = intersect(sides, np.roll(sides, -1, 1))
    ok = (line["mse"] <= qtp.max_line_fit_mse).all(1) & met.all(1) & valid_quad(corners, tag_width, qtp)
    return frame[clusters.first[c]][ok], corners[ok], flipped[c][ok]


# Refinement and decoding.


def refine(corners: np.ndarray, im: np.ndarray, frame: np.ndarray, flipped: np.ndarray, reach: float) -> np.ndarray:
    """Corners (q, 4, 2) moved to lines through the strongest edges near the sides, in frames of a stack. All sides are searched at once."""
    f = np.float32
    c = corners.astype(f).astype(np.float64)
    steps = np.arange(-reach, reach + 1e-9, 0.25)
    d = np.roll(c, -1, 1) - c
    length = np.hypot(d[..., 0], d[..., 1])
    normal = np.stack([d[..., 1], -d[..., 0]], -1) / np.where(length > 0, length, 1)[..., None] * np.where(flipped, -1, 1)[:, None, None]
    count = np.maximum(16, (length / 8).astype(int))
    place = np.arange(count.max())
    alpha = ((1 + place) / (count[..., None] + 1))[..., None]
    p0 = alpha * c[:, :, None, :] + (1 - alpha) * np.roll(c, -1, 1)[:, :, None, :]
    h, w = im.shape[-2:]
    flat, base = im.ravel(), (frame * (h * w))[:, None, None, None]
    ats = [p0[..., i, None] + steps * normal[..., None, None, i] for i in (0, 1)]

    def pixels(sign):
        x, y = ((a + sign * normal[..., None, None, i]).astype(int) for i, a in enumerate(ats))  # towards zero
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        return ok, flat[base + np.minimum(np.maximum(y, 0), h - 1) * w + np.minimum(np.maximum(x, 0), w - 1)].astype(np.float64)

    (ok1, g1), (ok2, g2) = pixels(1), pixels(-1)
    weight = np.where(ok1 & ok2 & (g1 >= g2), (g2 - g1) ** 2, 0)
    total = weight.sum(-1)
    use = (total > 0) & (place < count[..., None])
    best = p0 + ((weight @ steps) / np.where(total > 0, total, 1))[..., None] * normal[:, :, None, :]
    n = use.sum(-1)
    u = use / np.maximum(n, 1)[..., None]
    e = (best * u[..., None]).sum(2)
    cov = (best * best * u[..., None]).sum(2) - e * e
    cxy = (best[..., 0] * best[..., 1] * u).sum(-1) - e[..., 0] * e[..., 1]
    theta = f(0.5) * np.arctan2((-2 * cxy).astype(f), (cov[..., 1] - cov[..., 0]).astype(f))
    lines = np.stack([e[..., 0], e[..., 1], np.cos(theta), np.sin(theta)], -1)
    at, met = intersect(lines, np.roll(lines, -1, 1))
    met &= (n > 0) & (np.roll(n, -1, 1) > 0) & (length > 0).all(1)[:, None]
    return np.where(np.roll(met, 1, 1)[..., None], np.roll(at, 1, 1), corners)


#: Corners of a tag in its own coordinates, in the order of a quad's corners.
TAG_CORNERS = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], np.float64)


def homographies(corners: np.ndarray, source: np.ndarray = TAG_CORNERS) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 maps with h22 = 1 from four source points to each of the corners (q, 4, 2), and which of them are sound."""
    n = len(corners)
    a, b = np.zeros((n, 8, 8)), corners.reshape(n, 8).astype(np.float64)
    for i, (x, y) in enumerate(source):
        a[:, 2 * i, :3] = a[:, 2 * i + 1, 3:6] = x, y, 1
        for j in (0, 1):
            v = b[:, 2 * i + j]
            a[:, 2 * i + j, 6], a[:, 2 * i + j, 7] = -x * v, -y * v
    h = np.ones((n, 9))
    h[:, :8] = _solve(a, b)
    h = h.reshape(n, 3, 3)
    ok = np.isfinite(h).all((1, 2))
    ok[ok] = np.abs(np.linalg.det(h[ok])) > 1e-300
    return h, ok


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack; NaN where a matrix is singular."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full(b.shape, np.nan)
        return np.concatenate([_solve(a[i : i + 1], b[i : i + 1]) for i in range(len(a))])


def homography(corners: np.ndarray, source: np.ndarray = TAG_CORNERS) -> np.ndarray | None:
    """The map to one tag's corners; None if singular."""
    h, ok = homographies(np.asarray(corners)[None], source)
    return h[0] if ok[0] else None


def fit_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least squares over any number of points (direct linear transform)."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [(x, y, 1, 0, 0, 0, -x * u, -y * u, -u), (0, 0, 0, x, y, 1, -x * v, -y * v, -v)]
    h = np.linalg.svd(np.array(rows, np.float64))[2][-1].reshape(3, 3)
    return h / h[2, 2]


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points under one map or a stack of them."""
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ np.swapaxes(h, -1, -2)
    return q[..., :2] / q[..., 2:]


def sample(im: np.ndarray, frame: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bilinear values at points (q, n, 2) in frames of a stack; NaN outside."""
    q, (h, w) = p - 0.5, im.shape[-2:]
    low = np.floor(q).astype(int)
    x0, y0 = low[..., 0], low[..., 1]
    ok = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < w) & (y0 + 1 < h)
    at = frame[:, None] * (h * w) + np.minimum(np.maximum(y0, 0), h - 2) * w + np.minimum(np.maximum(x0, 0), w - 2)
    fx, fy = q[..., 0] - x0, q[..., 1] - y0
    flat = im.ravel()
    i = lambda by: flat[at + by].astype(np.float64)
    v = i(0) * (1 - fx) * (1 - fy) + i(1) * fx * (1 - fy) + i(w) * (1 - fx) * fy + i(w + 1) * fx * fy
    return np.where(ok, v, np.nan)


def gray_planes(im: np.ndarray, frame: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (x, y, 1) of the light and the dark border's brightness (q, 3), from a strip on either side of each edge of the border."""
    fits, (high, wide), flat = [], im.shape[-2:], im.ravel()
    for tag in _strips(width):
        p = project(h, tag[:, :2])
        x, y = (np.where(np.isfinite(v), np.clip(v, -2, 1 << 20), -2).astype(int) for v in (p[..., 0], p[..., 1]))  # towards zero
        ok = (x >= 0) & (y >= 0) & (x < wide) & (y < high)
        v = flat[np.where(ok, frame[:, None] * (high * wide) + y * wide + x, 0)].astype(np.float64) * ok
        fit = _solve(np.einsum("qs,si,sj->qij", ok.astype(np.float64), tag, tag), v @ tag)
        for i in np.flatnonzero(~np.isfinite(fit).all(1)):  # too few places
            fit[i] = np.linalg.lstsq(tag[ok[i]], v[i, ok[i]], rcond=None)[0] if ok[i].any() else 0
        fits.append(fit)
    return fits[0], fits[1]


@functools.lru_cache(maxsize=64)
def _strips(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, 1) on the light and on the dark side of the border's edges."""
    along = np.arange(width) + 0.5
    sides = []
    for of in ((-0.5, width + 0.5), (0.5, width - 0.5)):
        own = [np.stack(q, 1) for at in of for q in ((np.full(width, at), along), (along, np.full(width, at)))]
        places = np.concatenate(own) / width * 2 - 1
        sides.append(np.concatenate([places, np.ones((len(places), 1))], 1))
    return sides[0], sides[1]


def laplacian(values: np.ndarray, amount: float) -> np.ndarray:
    """values + amount * (4 v - neighbours), zero outside."""
    z = np.pad(values, [(0, 0)] * (values.ndim - 2) + [(1, 1)] * 2)
    return values + amount * (4 * values - z[..., :-2, 1:-1] - z[..., 2:, 1:-1] - z[..., 1:-1, :-2] - z[..., 1:-1, 2:])


def read_words(im: np.ndarray, frame: np.ndarray, h: np.ndarray, bits: np.ndarray, width: int, total: int, reversed_: bool, sharpening: float, contrast: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At homographies (q, 3, 3) in frames of a stack: whether the border has the right polarity and contrast, codewords, and decision margins."""
    white, black = gray_planes(im, frame, h, width)
    tag = (bits + 0.5) / width * 2 - 1
    v = sample(im, frame, project(h, tag))
    plane = np.concatenate([tag, np.ones((len(tag), 1))], 1)
    rel = v - (white @ plane.T + black @ plane.T) / 2
    grid = np.zeros((len(h), total, total))
    at = bits - (width - total) // 2
    grid[:, at[:, 1], at[:, 0]] = np.where(np.isnan(rel), 0, rel)
    value = laplacian(grid, sharpening)[:, at[:, 1], at[:, 0]]
    one = value > 0
    word = (one.astype(np.uint64) << np.arange(len(bits) - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)
    f, ones = np.float32, one.sum(1)
    margin = np.minimum((value * one).sum(1).astype(f) / (1 + ones).astype(f), (-value * ~one).sum(1).astype(f) / (1 + len(bits) - ones).astype(f))
    over = white[:, 2] - black[:, 2]
    return ((over < 0) == reversed_) & (np.abs(over) >= contrast), word, margin
