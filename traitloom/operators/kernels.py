"""Array kernels for what no column expression says: one image (or one small group) at a time.

`on_images` runs a kernel in Arrow batches grouped by image, so a task holds one
image at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# --- grids ---------------------------------------------------------------------------------------------------------


def grid(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """(h, w, channels) array of one image's rows."""
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    out = np.zeros((y.max() + 1, x.max() + 1, len(columns)))
    out[y, x] = pdf[columns].to_numpy(float)
    return out


def cells(img_id, a: np.ndarray, columns: list[str]) -> pd.DataFrame:
    h, w = a.shape[:2]
    y, x = np.divmod(np.arange(h * w), w)
    flat = a.reshape(h * w, -1)
    return pd.DataFrame({"img_id": img_id, "y": y, "x": x, **{c: flat[:, i] for i, c in enumerate(columns)}})


def on_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], columns: list[str]) -> DataFrame:
    """Image in, image out."""
    kind = df.schema["img_id"].dataType.simpleString()
    fields = ", ".join(f"{c} double" for c in columns)

    def run(pdf):
        return cells(pdf["img_id"].iloc[0], kernel(grid(pdf, columns)), columns)

    return df.select("img_id", "y", "x", *columns).groupBy("img_id").applyInPandas(run, f"img_id {kind}, y bigint, x bigint, {fields}")


def facts_of(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, float | None]], columns: list[str], names: list[str]) -> DataFrame:
    """Image in, one row of numbers out."""
    kind = df.schema["img_id"].dataType.simpleString()

    def run(pdf):
        found = kernel(grid(pdf, columns))
        return pd.DataFrame([{"img_id": pdf["img_id"].iloc[0], **{n: found.get(n) for n in names}}]).astype({n: float for n in names})

    return df.select("img_id", "y", "x", *columns).groupBy("img_id").applyInPandas(run, f"img_id {kind}, " + ", ".join(f"{n} double" for n in names))


def of_image_rows(images: DataFrame, kernel: Callable[[np.ndarray], dict[str, float | None]], names: list[str]) -> DataFrame:
    """img_id and one row of numbers for each image row (img_id, width, height, n_channels, data as BGR): no pixel is shuffled.

    The kernel gets (h, w, channels) as RGB, with alpha if there is any, or gray.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for w, h, c, data in zip(*(batch.column(n).to_pylist() for n in ("width", "height", "n_channels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8, h * w * c).reshape(h, w, c).astype(float)
                rows.append(kernel(a if c == 1 else a[..., [2, 1, 0, *range(3, c)]]))
            yield pa.RecordBatch.from_arrays([batch.column("img_id"), *(pa.array([None if r.get(n) is None else float(r[n]) for r in rows], pa.float64()) for n in names)], ["img_id", *names])

    kind = images.schema["img_id"].dataType.simpleString()
    return images.select("img_id", "width", "height", "n_channels", "data").mapInArrow(run, f"img_id {kind}, " + ", ".join(f"{n} double" for n in names))


# --- shapes --------------------------------------------------------------------------------------------------------


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels 1.. of connected parts in reading order, by repeated minimum over neighbours with pointer jumping."""
    h, w = mask.shape
    n = h * w
    label = np.where(mask.ravel(), np.arange(n), n)
    label = np.append(label, n)
    padded = np.full((h + 2, w + 2), n)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while True:
        padded[1:-1, 1:-1] = label[:n].reshape(h, w)
        low = padded[1:-1, 1:-1].copy()
        for dy, dx in steps:
            np.minimum(low, padded[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx], out=low)
        new = np.where(mask.ravel(), low.ravel(), n)
        new = np.append(new, n)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    roots = np.unique(label[:n][mask.ravel()])
    return np.where(mask, np.searchsorted(roots, label[:n].reshape(h, w)) + 1, 0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points, in order."""
    p = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]), float)


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of (x, y) points."""
    ring = hull(points)
    if len(ring) < 3:
        return 0.0
    return abs(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))) / 2


def border(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outer border of the part that holds the first set pixel in reading order, by Moore tracing."""
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    where = np.argwhere(mask)
    if not len(where):
        return []
    start = tuple(where[0].tolist())
    h, w = mask.shape
    inside = lambda p: 0 <= p[0] < h and 0 <= p[1] < w and mask[p]
    ring, at, came = [start], start, 0
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            q = (at[0] + around[d][0], at[1] + around[d][1])
            if inside(q):
                came = (d + 5) % 8 if d % 2 == 0 else (d + 4) % 8
                at = q
                break
        else:
            return ring
        if at == start and len(ring) > 1 or len(ring) > 4 * h * w:
            return ring
        ring.append(at)


def perimeter(mask: np.ndarray) -> float:
    ring = np.array(border(mask), float)
    return float(np.linalg.norm(ring - np.roll(ring, -1, axis=0), axis=1).sum()) if len(ring) > 1 else 0.0


def shape_facts(gray: np.ndarray) -> dict[str, float | None]:
    """Facts of the first labelled part of gray > 1, and the circularity of the largest part's border."""
    labels = components(gray[..., 0] > 1)
    if not labels.max():
        return {}
    sizes = np.bincount(labels.ravel())[1:]
    y, x = np.nonzero(labels == 1)
    area = float(len(y))
    u, v, w = x.var() + 1 / 12, y.var() + 1 / 12, ((x - x.mean()) * (y - y.mean())).mean()
    root = np.hypot(u - v, 2 * w)
    major, minor = np.sqrt(8 * (u + v + root)), np.sqrt(max(0.0, 8 * (u + v - root)))
    corners = np.concatenate([np.stack([x + a, y + b], axis=1) for a in (-0.5, 0.5) for b in (-0.5, 0.5)])
    around = perimeter(labels == 1 + int(sizes.argmax()))
    return {
        "area": area, "length": major, "width": minor, "length_width_ratio": major / minor if minor > 0 else None,
        "eccentricity": float(np.sqrt(max(0.0, 1 - (minor / major) ** 2))), "solidity": area / hull_area(corners),
        "circularity": 4 * np.pi * area / around**2 if around > 0 else None,
    }


def filled(mask: np.ndarray) -> np.ndarray:
    """A mask with its holes: all that no path of outside pixels reaches."""
    outside = components(~np.pad(mask, 1), diagonal=False)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def largest_part(gray: np.ndarray) -> np.ndarray:
    """The part with the longest border, filled; 0 elsewhere."""
    labels = components(gray[..., 0] > 0)
    if not labels.max():
        return gray * 0
    best = max(range(1, labels.max() + 1), key=lambda k: len(border(labels == k)))
    return np.where(filled(labels == best), 255.0, 0.0)[..., None]


def symmetry(gray: np.ndarray, turns: int = 36) -> dict[str, float | None]:
    """The best agreement of the two sides over lines through the centroid."""
    mask = gray[..., 0] > 0
    y, x = np.nonzero(mask)
    if len(y) < 2:
        return {"symmetry": None}
    cy, cx = y.mean(), x.mean()
    best = 0.0
    for t in np.arange(turns) * np.pi / turns:
        d = (x - cx) * np.sin(t) - (y - cy) * np.cos(t)
        my, mx = np.rint(y + 2 * d * np.cos(t)).astype(int), np.rint(x - 2 * d * np.sin(t)).astype(int)
        ok = (my >= 0) & (mx >= 0) & (my < mask.shape[0]) & (mx < mask.shape[1])
        best = max(best, float(mask[my[ok], mx[ok]].sum() / len(y)))
    return {"symmetry": best}


def axis_angle(mask: np.ndarray) -> float:
    y, x = np.nonzero(mask)
    return 0.5 * np.arctan2(2 * ((x - x.mean()) * (y - y.mean())).mean(), x.var() - y.var()) if len(y) > 1 else 0.0


LINE_METRICS = ("overlap_sym", "npix_sym", "avg_darkness", "skinniness")


def metrics_of_line(g: np.ndarray, angle: float, cy: float, cx: float) -> dict[str, float | None]:
    """Of a line through a point: share of pixels mirrored by it, balance of its sides, darkness along it, and skinniness."""
    mask = g > 3
    if mask.sum() < 2:
        return {}
    y, x = np.nonzero(mask)
    d, along = -(x - cx) * np.sin(angle) + (y - cy) * np.cos(angle), (x - cx) * np.cos(angle) + (y - cy) * np.sin(angle)
    my, mx = np.rint(y - 2 * d * np.cos(angle)).astype(int), np.rint(x + 2 * d * np.sin(angle)).astype(int)
    ok = (my >= 0) & (mx >= 0) & (my < mask.shape[0]) & (mx < mask.shape[1])
    left, right = (d < 0).sum(), (d > 0).sum()
    on = np.abs(d) <= 0.5
    out = {"overlap_sym": mask[my[ok], mx[ok]].sum() / len(y), "npix_sym": min(left, right) / max(left, right, 1), "avg_darkness": 1 - g[mask][on].mean() / 255 if on.any() else None, "skinniness": 1 - (np.ptp(d) + 1) / (np.ptp(along) + 1)}
    known = [v for v in out.values() if v is not None]
    return {**out, "mean_all": float(np.mean(known))}


def line_metrics(gray: np.ndarray) -> dict[str, float | None]:
    """metrics_of_line() of the long axis."""
    g = gray[..., 0]
    y, x = np.nonzero(g > 3)
    return metrics_of_line(g, axis_angle(g > 3), y.mean(), x.mean()) if len(y) > 1 else {}


def skeleton(mask: np.ndarray) -> np.ndarray:
    """What openings of ever smaller erosions lose: the middle lines of a mask."""

    def plus(m, f):
        p = np.pad(m, 1)
        return f.reduce([m, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    out = np.zeros_like(mask)
    while mask.any():
        small = plus(mask, np.logical_and)
        out |= mask & ~plus(small, np.logical_or)
        mask = small
    return out


def candidate_lines(mask: np.ndarray, strategy: str = "skeleton_hough", most: int = 40, votes: int = 25) -> list[tuple[float, float, float]]:
    """(angle, y, x of a point) of lines that a blob may be symmetric about.

    ellipse: its moment axes; polygon: chords of its hull's corners whose points at 25, 50 and 75 % lie in it, longest
    first; skeleton_hough: lines with at least `votes` pixels of its skeleton, most first, 30 directions, a pixel apart.
    """
    y, x = np.nonzero(mask)
    if len(y) < 2:
        return []
    if strategy == "ellipse":
        t = axis_angle(mask)
        return [(t, y.mean(), x.mean()), (t + np.pi / 2, y.mean(), x.mean())]
    if strategy == "polygon":
        corners, found = hull(np.stack([x, y], axis=1)), []
        for i in range(len(corners)):
            for j in range(i + 1, len(corners)):
                at = np.rint([corners[i] * (1 - t) + corners[j] * t for t in (0.25, 0.5, 0.75)]).astype(int)
                if mask[at[:, 1], at[:, 0]].all():
                    dx, dy = corners[j] - corners[i]
                    found.append((-np.hypot(dx, dy), float(np.arctan2(dy, dx)), *corners[i][::-1].tolist()))
        return [f[1:] for f in sorted(found)[:most]]
    if strategy != "skeleton_hough":
        raise ValueError(f"unknown strategy: {strategy}")
    sy, sx = np.nonzero(skeleton(mask))
    found = []
    for t in np.arange(30) * np.pi / 30:
        rho = np.rint(-sx * np.sin(t) + sy * np.cos(t)).astype(int)
        for r, n in zip(*np.unique(rho, return_counts=True), strict=True):
            if n >= votes:
                found.append((-int(n), t, r * np.cos(t), -r * np.sin(t)))
    return [f[1:] for f in sorted(found)[:most]]


def upright_by_lines(gray: np.ndarray, strategy: str = "skeleton_hough", metric: str = "overlap_sym") -> np.ndarray:
    """Turned so that the best of the candidate lines is vertical (the long axis without any), cropped, heavy half on top."""
    g = gray[..., 0]
    mask = g > 0
    if not mask.any():
        return gray
    scored = [(metrics_of_line(g, *line).get(metric), line) for line in candidate_lines(mask, strategy)]
    known = [(v, line) for v, line in scored if v is not None]
    return turned_up(g, max(known, key=lambda f: f[0])[1][0] if known else axis_angle(mask))


def upright(gray: np.ndarray) -> np.ndarray:
    """Turned so that the long axis is vertical, cropped to what is set, heavy half on top."""
    g = gray[..., 0]
    return turned_up(g, axis_angle(g > 0)) if (g > 0).any() else gray


def turned_up(g: np.ndarray, angle: float) -> np.ndarray:
    turned = rotated(g, np.pi / 2 - angle)
    y, x = np.nonzero(turned > 0)
    turned = turned[y.min() : y.max() + 1, x.min() : x.max() + 1]
    half = len(turned) // 2
    return (turned[::-1] if (turned[half:] > 0).sum() > (turned[:half] > 0).sum() else turned)[..., None]


def rotated(a: np.ndarray, angle: float) -> np.ndarray:
    """Nearest rotation about the middle on a canvas that holds all of it."""
    h, w = a.shape
    c, s = np.cos(angle), np.sin(angle)
    side = int(np.ceil(np.hypot(h, w))) + 1
    y, x = np.mgrid[:side, :side] - side / 2
    sx, sy = np.rint(c * x + s * y + (w - 1) / 2).astype(int), np.rint(-s * x + c * y + (h - 1) / 2).astype(int)
    ok = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    out = np.zeros((side, side))
    out[ok] = a[sy[ok], sx[ok]]
    return out


# --- smoothing, contrast and size ------------------------------------------------------------------------------------


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation of a plane with mirrored edges."""
    kh, kw = kernel.shape
    p = np.pad(a, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), mode="symmetric")
    return np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(p, kernel.shape), kernel)


def gaussian(a: np.ndarray, size: int = 5) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    line /= line.sum()
    return np.stack([convolved(convolved(a[..., k], line[:, None]), line[None]) for k in range(a.shape[2])], axis=2)


def median(a: np.ndarray, size: int = 5) -> np.ndarray:
    p = np.pad(a, ((size // 2,) * 2, (size // 2,) * 2, (0, 0)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size), axis=(0, 1)), axis=(-2, -1))


def bilateral(a: np.ndarray, size: int = 9, color_sigma: float = 75, space_sigma: float = 75) -> np.ndarray:
    half = size // 2
    p = np.pad(a, ((half, half), (half, half), (0, 0)), mode="symmetric")
    h, w = a.shape[:2]
    total, weight = np.zeros(a.shape), np.zeros((h, w, 1))
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            if dy * dy + dx * dx <= half * half:
                q = p[half + dy : half + dy + h, half + dx : half + dx + w]
                k = np.exp(-(np.abs(q - a).sum(2, keepdims=True) ** 2) / (2 * color_sigma**2) - (dy * dy + dx * dx) / (2 * space_sigma**2))
                total += k * q
                weight += k
    return total / weight


def smoothed_edges(gray: np.ndarray) -> np.ndarray:
    """A mask blurred by a kernel that grows with its share, then cut at half."""
    size = int(5 + 500 * (gray > 0).mean()) | 1
    return np.where(gaussian(gray, min(size, 2 * min(gray.shape[:2]) - 1)) > 127, 255.0, 0.0)


def clahe(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation with bilinear blending of the tiles' tables."""
    g = gray[..., 0].astype(int)
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if h > th and w > tw else "edge")
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            limit = max(clip * th * tw / 256, 1)
            n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
            tables[i, j] = np.cumsum(n) * 255 / (th * tw)
    fy, fx = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda i, j: tables[i[:, None], j[None], g]
    return np.clip(np.rint((1 - ay) * ((1 - ax) * at(y0, x0) + ax * at(y0, x1)) + ay * ((1 - ax) * at(y1, x0) + ax * at(y1, x1))), 0, 255)[..., None]


def matched(channel: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A channel mapped so that its distribution follows a target histogram of 256 shares."""
    n = np.bincount(channel.astype(int).ravel(), minlength=256)
    own, goal = np.cumsum(n) / max(n.sum(), 1), np.cumsum(target) / target.sum()
    held = np.flatnonzero(target)  # levels that are absent would make the curve flat
    return np.interp(own, goal[held], held)[channel.astype(int)]


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, by pixel centres."""
    fy, fx = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, a.shape[0]), (w, a.shape[1])))
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    ay, ax = (fy - y0)[:, None, None], (fx - x0)[None, :, None]
    return (1 - ay) * ((1 - ax) * a[y0][:, x0] + ax * a[y0][:, x1]) + ay * ((1 - ax) * a[y1][:, x0] + ax * a[y1][:, x1])


def resized_by(a: np.ndarray, *, share: float | None = None, total: int | None = None, longest: int | None = None) -> np.ndarray:
    """To a share, to a sum of sides, or to a longest side."""
    h, w = a.shape[:2]
    f = share if share else total / (h + w) if total else longest / max(h, w)
    return resized(a, max(1, round(h * f)), max(1, round(w * f)))


def background_thumbnail(rgba: np.ndarray, grow: int = 3, side: int = 32) -> np.ndarray:
    """r, g, b, mask: what the grown mask covers takes the background's median; blurred and shrunk."""
    mask = rgba[..., 3] > 0
    p = np.pad(mask, grow)
    for dy in range(2 * grow + 1):
        for dx in range(2 * grow + 1):
            mask = mask | p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    out = rgba[..., :3].copy()
    if (~mask).any():
        out[mask] = np.trunc(np.median(out[~mask], axis=0))
    return resized_by(gaussian(out), longest=side)


# --- texture and light -------------------------------------------------------------------------------------------------


def gabor_means(gray: np.ndarray, frequency: float = 0.2) -> dict[str, float]:
    """Mean absolute real response of a Gabor filter at 0 and 90 degrees."""
    sigma = np.sqrt(np.log(2) / 2) / np.pi * 3 / frequency
    half = int(np.ceil(3 * sigma))
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    envelope = np.exp(-(x * x + y * y) / (2 * sigma**2)) / (2 * np.pi * sigma**2)
    return {name: float(np.abs(convolved(gray[..., 0], envelope * np.cos(2 * np.pi * frequency * u))).mean()) for name, u in (("gabor_horizontal", x), ("gabor_vertical", y))}


def texture_facts(gray: np.ndarray) -> dict[str, float]:
    """RMS contrast, edge density, grain, homogeneity of neighbours, and the slope of the radial spectrum."""
    g = gray[..., 0]
    gy, gx = np.gradient(g)
    power = np.abs(np.fft.fft2(g - g.mean())) ** 2
    fy, fx = np.meshgrid(np.fft.fftfreq(g.shape[0]), np.fft.fftfreq(g.shape[1]), indexing="ij")
    radius = np.hypot(fy, fx).ravel()
    ok = (radius > 0) & (power.ravel() > 0)
    slope = np.polyfit(np.log(radius[ok]), np.log(power.ravel()[ok]), 1)[0] if ok.sum() > 2 else 0.0
    return {"rms_contrast": float(g.std()), "edge_density": float((np.hypot(gx, gy) > 20).mean()), "grain": float(np.abs(g - gaussian(gray)[..., 0]).mean()), "homogeneity": float((1 / (1 + np.abs(np.diff(g, axis=1)))).mean()) if g.shape[1] > 1 else 1.0, "spectral_slope": float(slope)}


def retinex(rgb: np.ndarray, sizes: tuple[int, ...] = (15, 81, 251)) -> np.ndarray:
    """Multi-scale retinex: log ratio to the surround, stretched to 0..255 per channel."""
    limit = 2 * min(rgb.shape[:2]) - 1
    a = rgb + 1.0
    out = np.mean([np.log(a) - np.log(gaussian(a, min(s, limit) | 1)) for s in sizes], axis=0)
    lo, hi = out.min(axis=(0, 1)), out.max(axis=(0, 1))
    return np.where(hi > lo, (out - lo) / np.maximum(hi - lo, 1e-9) * 255, 0)


# --- patches -------------------------------------------------------------------------------------------------------------


def patches(lab: np.ndarray, closeness: float = 20.0, least: int = 5) -> np.ndarray:
    """Labels of regions grown from a grid of seeds over 8 neighbours, by colour distance to the seed; 0 where none."""
    h, w = lab.shape[:2]
    step = max(1, max(h, w) // 40)
    out = np.zeros((h, w), int)
    n = 0
    for sy in range(0, h, step):
        for sx in range(0, w, step):
            if out[sy, sx]:
                continue
            near = (np.sqrt(((lab - lab[sy, sx]) ** 2).sum(2)) < closeness) & (out == 0)
            region = np.zeros((h, w), bool)
            region[sy, sx] = True
            while True:
                p = np.pad(region, 1)
                grown = near & (p[:-2, :-2] | p[:-2, 1:-1] | p[:-2, 2:] | p[1:-1, :-2] | p[1:-1, 2:] | p[2:, :-2] | p[2:, 1:-1] | p[2:, 2:] | region)
                if np.array_equal(grown, region):
                    break
                region = grown
            if region.sum() >= least:
                n += 1
                out[region] = n
    return out


def part_patches(labels: np.ndarray, least: int = 5) -> np.ndarray:
    """Numbers of the parts, connected over 4 neighbours, of an image of labels (below 0: none); parts under `least` pixels are 0."""
    out, n = np.zeros(labels.shape, int), 0
    for value in np.unique(labels[labels >= 0]):
        parts = components(labels == value, diagonal=False)
        for k in range(1, parts.max() + 1):
            if (parts == k).sum() >= least:
                n += 1
                out[parts == k] = n
    return out


def longest_run(mask: np.ndarray, angles: int = 36) -> tuple[float, float, float, float, float]:
    """(length, x0, y0, x1, y1) of the longest straight run of set pixels, over lines of `angles` directions a pixel apart."""
    h, w = mask.shape
    best = (0.0, 0.0, 0.0, 0.0, 0.0)
    reach = int(np.ceil(np.hypot(h, w)))
    t = np.arange(-reach, reach + 1)
    for a in np.arange(angles) * np.pi / angles:
        dx, dy = np.cos(a), np.sin(a)
        for off in t:
            x = np.round(w / 2 + off * -dy + t * dx).astype(int)
            y = np.round(h / 2 + off * dx + t * dy).astype(int)
            fine = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            line = np.zeros(len(t), bool)
            line[fine] = mask[y[fine], x[fine]]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(int), [0]))))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                length = float(np.hypot(x[j - 1] - x[i], y[j - 1] - y[i])) + 1
                if length > best[0] + 1e-9:
                    best = (length, float(x[i]), float(y[i]), float(x[j - 1]), float(y[j - 1]))
    return best


def run_facts(a: np.ndarray) -> dict[str, float | None]:
    return dict(zip(("length", "x0", "y0", "x1", "y1"), longest_run(a[..., 0] > 0), strict=True))


def edge_patches(gray: np.ndarray, size: int = 11, below: float = 2.0, least: int = 20) -> np.ndarray:
    """Numbers of the areas between dark lines: parts of pixels that are not under their surroundings' mean by `below`; small ones are 0."""
    half = size // 2
    p = np.pad(gray, half, mode="edge")
    sums = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = gray.shape
    mean = (sums[size : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]) / size**2
    return part_patches(np.where((gray > 0) & (gray >= mean - below), 0, -1), least)


def patch_table(df: DataFrame, columns: tuple[str, str, str] = ("l", "a", "b"), closeness: float = 20.0, how: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """img_id, patch_id, mean colour, centre and size of each grown region, or of those that `how` numbers."""
    kind = df.schema["img_id"].dataType.simpleString()

    def run(pdf):
        a = grid(pdf, list(columns))
        labels = how(a) if how else patches(a, closeness)
        y, x = np.nonzero(labels)
        t = pd.DataFrame({"patch_id": labels[y, x], "c1": a[y, x, 0], "c2": a[y, x, 1], "c3": a[y, x, 2], "cy": y, "cx": x, "n": 1})
        out = t.groupby("patch_id").agg({"c1": "mean", "c2": "mean", "c3": "mean", "cx": "mean", "cy": "mean", "n": "sum"}).reset_index()
        out.insert(0, "img_id", pdf["img_id"].iloc[0])
        return out

    return df.select("img_id", "y", "x", *columns).groupBy("img_id").applyInPandas(run, f"img_id {kind}, patch_id int, c1 double, c2 double, c3 double, cx double, cy double, n bigint")


# --- clustering of small groups --------------------------------------------------------------------------------------------


def distances(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0))


def row_distances(x: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(((x - x[i]) ** 2).sum(1))


def agglomerative(x: np.ndarray, n: int) -> np.ndarray:
    """Ward's linkage by chains of nearest neighbours, without a matrix of all pairs: labels in the order of their first rows."""
    m = len(x)
    centers, sizes, alive = x.astype(float).copy(), np.ones(m), np.ones(m, bool)
    merges, chain = [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            cost = ((centers - centers[i]) ** 2).sum(1) * (sizes * sizes[i] / (sizes + sizes[i]))
            cost[~alive] = np.inf
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        a, b = min(i, j), max(i, j)
        merges.append((cost[j], a, b))
        centers[a] = (centers[a] * sizes[a] + centers[b] * sizes[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        alive[b] = False
    # the cheapest merges, as many as leave n groups; a merge of Ward's linkage never costs less than those inside it
    of = np.arange(m)

    def top(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for _, a, b in sorted(merges, key=lambda t: t[0])[: max(0, m - n)]:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return np.unique([top(i) for i in range(m)], return_inverse=True)[1]


def dbscan(x: np.ndarray, eps: float = 0.5, least: int | None = None) -> np.ndarray:
    """Labels 0.. of density-connected groups, -1 for noise; neighbours are looked up a row at a time."""
    least = x.shape[1] + 1 if least is None else least
    core = np.array([(row_distances(x, i) <= eps).sum() >= least for i in range(len(x))], bool)
    label = np.full(len(x), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = n
        while todo:
            for j in np.flatnonzero((row_distances(x, todo.pop()) <= eps) & (label < 0)):
                label[j] = n
                if core[j]:
                    todo.append(j)
        n += 1
    return label


def hdbscan(x: np.ndarray, least_size: int = 5, least: int | None = None) -> np.ndarray:
    """Labels 0.. of the most stable density clusters, -1 for noise: the spanning tree of mutual reachability, condensed at `least_size`, by excess of mass."""
    m, least = len(x), least_size if least is None else least
    if m < 2 * least_size:
        return np.full(m, -1)
    core = np.array([np.partition(row_distances(x, i), min(least, m) - 1)[min(least, m) - 1] for i in range(m)])
    # Prim's tree, a row of reachabilities at a time
    reach, parent, inside = np.full(m, np.inf), np.zeros(m, int), np.zeros(m, bool)
    edges, i = [], 0
    for _ in range(m - 1):
        inside[i] = True
        d = np.maximum(np.maximum(row_distances(x, i), core), core[i])
        closer = ~inside & (d < reach)
        reach[closer], parent[closer] = d[closer], i
        j = int(np.where(inside, np.inf, reach).argmin())
        edges.append((reach[j], parent[j], j))
        i = j
    # the dendrogram: node m + k joins two nodes at a distance
    of, size, sides, height = list(range(m)), [1] * m, {}, {}

    def top(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for k, (d, a, b) in enumerate(sorted(edges, key=lambda e: e[0])):
        a, b, new = top(a), top(b), m + k
        of[a] = of[b] = new
        of.append(new)
        size.append(size[a] + size[b])
        sides[new], height[new] = (a, b), d

    def leaves(node):
        todo, out = [node], []
        while todo:
            i = todo.pop()
            if i < m:
                out.append(i)
            else:
                todo += sides[i]
        return out

    # condensed clusters: node, density of birth, stability, children
    root = m + len(edges) - 1
    clusters = [{"node": root, "birth": 0.0, "mass": 0.0, "children": [], "points": []}]
    todo = [(root, 0)]
    while todo:
        node, c = todo.pop()
        if node < m:
            continue
        density = 1 / max(height[node], 1e-12)
        big = [s for s in sides[node] if size[s] >= least_size]
        for s in sides[node]:
            if len(big) == 2:
                clusters[c]["mass"] += size[s] * (density - clusters[c]["birth"])
                clusters[c]["children"].append(len(clusters))
                clusters.append({"node": s, "birth": density, "mass": 0.0, "children": [], "points": []})
                todo.append((s, len(clusters) - 1))
            elif s in big:
                todo.append((s, c))
            else:
                clusters[c]["mass"] += size[s] * (density - clusters[c]["birth"])
    chosen = [False] * len(clusters)
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(clusters[k]["mass"] for k in clusters[c]["children"])
        if clusters[c]["children"] and below > clusters[c]["mass"]:
            clusters[c]["mass"] = below
        else:
            chosen[c] = True
            todo = list(clusters[c]["children"])
            while todo:
                k = todo.pop()
                chosen[k] = False
                todo += clusters[k]["children"]
    label, n = np.full(m, -1), 0
    for c in sorted((c for c in range(len(clusters)) if chosen[c]), key=lambda c: min(leaves(clusters[c]["node"]))):
        label[leaves(clusters[c]["node"])] = n
        n += 1
    return label


#: Bytes of a kernel's blocks of pairs, and of all pairs that it keeps in memory; more pairs go to a temporary file.
BLOCK_BYTES, HELD_BYTES = 32 << 20, 256 << 20


class Pairs:
    """Rows of an m x m array, zero at first, in memory or in a temporary file that goes with the object."""

    def __init__(self, m: int):
        self.m, self.file = m, None if 8 * m * m <= HELD_BYTES else tempfile.TemporaryFile(buffering=0)  # noqa: SIM115
        if self.file:
            self.file.truncate(8 * m * m)
        else:
            self.array = np.zeros((m, m))

    def read(self, i: int, j: int) -> np.ndarray:
        if not self.file:
            return self.array[i:j]
        self.file.seek(8 * i * self.m)
        return np.fromfile(self.file, float, (j - i) * self.m).reshape(j - i, self.m)

    def write(self, i: int, rows: np.ndarray) -> None:
        if not self.file:
            self.array[i : i + len(rows)] = rows
            return
        self.file.seek(8 * i * self.m)
        rows.tofile(self.file)


def row_blocks(m: int) -> list[tuple[int, int]]:
    step = max(1, BLOCK_BYTES // (8 * max(m, 1)))
    return [(i, min(i + step, m)) for i in range(0, m, step)]


def block_squares(x: np.ndarray, i: int, j: int) -> np.ndarray:
    """Squared distances of the rows from i to j to all rows."""
    s = (x**2).sum(1)
    return np.maximum(s[i:j, None] + s[None] - 2 * x[i:j] @ x.T, 0)


def median_square(x: np.ndarray) -> float:
    """The median of all squared distances, each row's to itself included: bins are counted and narrowed until few values are left."""
    m, blocks = len(x), row_blocks(len(x))
    if len(blocks) == 1:
        return float(np.median(block_squares(x, 0, m)))
    middle = sorted({(m * m - 1) // 2, m * m // 2})
    found = []
    for rank in middle:
        lo, hi, before = 0.0, max(float(block_squares(x, i, j).max()) for i, j in blocks), 0
        while True:
            edges = np.linspace(lo, hi, 4097)
            count = sum(np.histogram(block_squares(x, i, j), edges)[0] for i, j in blocks)
            k = int(np.searchsorted(before + count.cumsum(), rank, side="right"))
            before, lo, hi, inside = before + int(count[:k].sum()), edges[k], edges[k + 1], int(count[k])
            if 8 * inside <= BLOCK_BYTES or not lo < (lo + hi) / 2 < hi:
                break
        last = k == 4095  # the last bin holds its upper end
        values = np.concatenate([d[(d >= lo) & ((d <= hi) if last else (d < hi))] for i, j in blocks for d in [block_squares(x, i, j)]]) if 8 * inside <= BLOCK_BYTES else np.array([lo])
        found.append(float(np.sort(values)[rank - before]) if len(values) > rank - before else lo)
    return sum(found) / len(found)


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 400, rate: float = 100.0, seed: int = 1) -> np.ndarray:
    """A two-dimensional embedding that keeps neighbours, by gradient steps on all pairs, a block of rows at a time."""
    m = len(x)
    if m < 3:
        return np.zeros((m, 2))
    blocks = row_blocks(m)
    target, used, least, total = np.log(min(perplexity, (m - 1) / 3)), np.ones(m), np.zeros(m), np.zeros(m)
    for i, j in blocks:
        for r, row in enumerate(block_squares(x, i, j), i):
            lo, hi, beta = 0.0, np.inf, 1.0
            own = np.delete(row, r)
            least[r] = own.min()
            for _ in range(60):
                used[r] = beta
                w = np.exp(-(own - least[r]) * beta)
                total[r] = w.sum()
                w /= total[r]
                if -(w * np.log(np.maximum(w, 1e-300))).sum() > target:
                    lo = beta
                    beta = beta * 2 if hi == np.inf else (lo + hi) / 2
                else:
                    hi = beta
                    beta = (lo + hi) / 2
    pairs = Pairs(m)
    for i, j in blocks:
        d = block_squares(x, i, j)
        near = np.exp(np.minimum((least[i:j, None] - d) * used[i:j, None], 0)) / total[i:j, None] + np.exp(np.minimum((least[None] - d) * used[None], 0)) / total[None]
        near[np.arange(j - i), np.arange(i, j)] = 0
        pairs.write(i, np.maximum(near / (2 * m), 1e-12))
    y = np.random.default_rng(seed).normal(0, 1e-4, (m, 2))
    move = np.zeros_like(y)
    for k in range(rounds):
        # the sum of all weights is known after the last block, so both sides of the gradient are summed apart
        pull, push, weight = np.zeros((m, 3)), np.zeros((m, 3)), 0.0
        ends = np.column_stack([y, np.ones(m)])
        for i, j in blocks:
            q = 1 / (1 + block_squares(y, i, j))
            q[np.arange(j - i), np.arange(i, j)] = 0
            weight += q.sum()
            pull[i:j] = (pairs.read(i, j) * q) @ ends
            push[i:j] = (q * q) @ ends
        f = (4.0 if k < 100 else 1.0) * pull - push / weight
        gradient = 4 * (f[:, 2:] * y - f[:, :2])
        move = (0.5 if k < 100 else 0.8) * move - rate * gradient
        y = y + move
        y -= y.mean(0)
    return y


def affinity(x: np.ndarray, rounds: int = 200, damping: float = 0.7) -> np.ndarray:
    """Affinity propagation with the median similarity as preference, a block of rows at a time: each pass ends a round and begins the next."""
    n = len(x)
    preference = -median_square(x)
    responsible, available = Pairs(n), Pairs(n)
    total, best = np.zeros(n), np.zeros(n, int)

    def positive(r, own):
        p = np.maximum(r, 0)
        p[own] = r[own]
        return p

    for k in range(rounds + 1):
        sums = np.zeros(n)
        for i, j in row_blocks(n):
            r, a, rows = responsible.read(i, j), available.read(i, j), np.arange(j - i)
            own = (rows, np.arange(i, j))
            if k:
                p = positive(r, own)
                new = np.minimum(0, total[None] - p)
                new[own] = total[i:j] - p[own]
                a = damping * a + (1 - damping) * new
            if k == rounds:
                best[i:j] = (a + r).argmax(1)
                continue
            s = -block_squares(x, i, j)
            s[own] = preference
            t = a + s
            top = t.argmax(1)
            first = t[rows, top]
            t[rows, top] = -np.inf
            new = s - first[:, None]
            new[rows, top] = s[rows, top] - t.max(1)
            r = damping * r + (1 - damping) * new
            sums += positive(r, own).sum(0)
            responsible.write(i, r)
            available.write(i, a)
        total = sums
    return np.unique(best, return_inverse=True)[1]


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 1) -> np.ndarray:
    """Isolation-forest scores in (0, 1]: higher is more isolated."""
    rng = np.random.default_rng(seed)
    n = min(sample, len(x))
    c = lambda m: 0.0 if m <= 1 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    depth = np.zeros(len(x))

    def walk(rows: np.ndarray, inside: np.ndarray, level: int, limit: int):
        spread = np.ptp(x[inside], axis=0) if len(inside) else np.zeros(x.shape[1])
        if level >= limit or len(inside) <= 1 or not spread.any():
            depth[rows] += level + c(len(inside))
            return
        k = rng.choice(np.flatnonzero(spread > 0))
        at = rng.uniform(x[inside, k].min(), x[inside, k].max())
        walk(rows[x[rows, k] < at], inside[x[inside, k] < at], level + 1, limit)
        walk(rows[x[rows, k] >= at], inside[x[inside, k] >= at], level + 1, limit)

    for _ in range(trees):
        walk(np.arange(len(x)), rng.choice(len(x), n, replace=False), 0, int(np.ceil(np.log2(max(n, 2)))))
    return 2 ** (-depth / trees / max(c(n), 1e-9))


#: Bytes of arrays that a kernel may hold for one group.
GROUP_BYTES = 4 << 30
#: Arrays of all pairs that a kernel keeps, in a temporary file where they are many, and the bytes they may take.
PAIRS_KEPT, PAIR_BYTES = {"agglomerative": 0, "dbscan": 0, "hdbscan": 0, "affinity": 2, "tsne": 1}, 64 << 30


def largest_group(rows: int, dims: int, algorithm: str) -> bool:
    """Whether a group of so many rows fits GROUP_BYTES, and its pairs PAIR_BYTES."""
    return 8 * 8 * rows * max(1, dims) <= GROUP_BYTES and 8 * PAIRS_KEPT[algorithm] * rows * rows <= PAIR_BYTES


def cluster_groups(df: DataFrame, group: str, key: str, algorithm: str, **options) -> DataFrame:
    """group, key, label (or the place x, y for tsne): a kernel on each group's `features`.

    A group is one task's.  Linkage and density clustering hold no pairs, so a group may have any number of rows that fit
    GROUP_BYTES; affinity propagation and t-SNE need all pairs by definition, which go through a temporary file of up to
    PAIR_BYTES, a block at a time.  Sizes are checked first.
    """
    from pyspark.sql import functions as F

    size = df.groupBy(group).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    if not largest_group(size.n or 0, size.d or 0, algorithm):
        raise ValueError(f"a group of {size.n} rows needs over {GROUP_BYTES} bytes of rows or {PAIR_BYTES} of pairs for {algorithm}; use cluster.fitted, or agglomerative, dbscan or hdbscan")
    kernel = {"agglomerative": agglomerative, "dbscan": dbscan, "hdbscan": hdbscan, "affinity": affinity, "tsne": tsne}[algorithm]
    g, k = (df.schema[c].dataType.simpleString() for c in (group, key))

    def run(pdf):
        pdf = pdf.sort_values(key)
        out = kernel(np.stack(pdf["features"].to_numpy()), **options)
        found = {"label": out} if out.ndim == 1 else {"x": out[:, 0], "y": out[:, 1]}
        return pd.DataFrame({group: pdf[group].to_numpy(), key: pdf[key].to_numpy(), **found})

    return df.select(group, key, "features").groupBy(group).applyInPandas(run, f"{group} {g}, {key} {k}, " + ("x double, y double" if algorithm == "tsne" else "label int"))
