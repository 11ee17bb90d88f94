"""Picture kernels in numpy, for Arrow UDFs: one 8-bit picture in, numbers or a picture out. Borders are mirrored without the edge pixel."""

from __future__ import annotations

import struct
import zlib

import numpy as np

WHITE = 255
#: Weights of blue, green and red in grey.
GREY = np.array([0.114, 0.587, 0.299])
_PNG = b"\x89PNG\r\n\x1a\n"


# codec


def decode_png(data: bytes) -> tuple[np.ndarray, dict[str, str]] | None:
    """(picture in BGR order, text chunks) of an 8-bit PNG without interlace; None for anything else."""
    if not data or data[:8] != _PNG:
        return None
    at, packed, head, palette, texts = 8, b"", None, None, {}
    try:
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            at += 12 + n
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed += body
            elif kind == b"tEXt":
                key, _, value = body.partition(b"\0")
                texts[key.decode("latin-1")] = value.decode("utf-8", "replace")
        w, h, depth, colour, _, _, interlace = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlace:
            return None
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    except (struct.error, zlib.error, KeyError, TypeError, ValueError):
        return None
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:], above, channels)
    image = out.reshape(h, w, channels)
    if colour == 3:
        image = palette[image[:, :, 0]]
    elif channels < 3:
        image = np.repeat(image[:, :, :1], 3, axis=2)
    return np.ascontiguousarray(image[:, :, 2::-1]), texts


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = bytearray(len(line))
    for i, x in enumerate(line.tolist()):
        left, up, corner = (out[i - step] if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        out[i] = (x + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode_png(image: np.ndarray, texts: dict[str, str] | None = None) -> bytes:
    """Grey (h, w) or BGR (h, w, 3)."""
    grey = image.ndim == 2
    rows = image if grey else image[:, :, ::-1].reshape(len(image), -1)
    body = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if grey else 2, 0, 0, 0)
    extra = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode()) for k, v in (texts or {}).items())
    return _PNG + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


# features


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ GREY).astype(np.uint8)


def _pad(image: np.ndarray, n: int) -> np.ndarray:
    mode = "reflect" if min(image.shape) > n else "edge"
    return np.pad(image, n, mode=mode)


def _filter(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    n = len(kernel) // 2
    p, (h, w) = _pad(image.astype(np.float64), n), image.shape
    return sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(len(kernel)) for j in range(len(kernel)) if kernel[i, j])


def sharpness(g: np.ndarray) -> float:
    return float(_filter(g, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])).var())


def contrast(g: np.ndarray) -> float:
    low, high = np.percentile(g, [5, 95])
    return float(high - low)


def median5(g: np.ndarray) -> np.ndarray:
    p, (h, w) = np.pad(g, 2, mode="edge"), g.shape
    out = np.empty_like(g)
    for y in range(0, h, 64):
        end = min(h, y + 64)
        out[y:end] = np.median(np.stack([p[y + i : end + i, j : j + w] for i in range(5) for j in range(5)]), axis=0)
    return out


def noise_snr(g: np.ndarray) -> float:
    noise = (g.astype(float) - median5(g)).std()
    return 100.0 if noise < 1e-6 else float(g.astype(float).std() / noise)


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny: Sobel gradients, thinning across the edge, and weak pixels kept where they touch strong ones."""
    gx = _filter(g, np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]))
    gy = _filter(g, np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]]))
    size = np.abs(gx) + np.abs(gy)
    p, (h, w) = np.pad(size, 1), g.shape
    near = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    steep, flat, same = np.abs(gy) > 2.414 * np.abs(gx), np.abs(gy) < 0.414 * np.abs(gx), gx * gy > 0
    before = np.select([flat, steep, same], [near(0, -1), near(-1, 0), near(-1, -1)], near(-1, 1))
    after = np.select([flat, steep, same], [near(0, 1), near(1, 0), near(1, 1)], near(1, -1))
    thin = (size > before) & (size >= after)
    weak, strong = thin & (size > low), thin & (size > high)
    while True:
        grown = dilate(strong) & weak
        if (grown == strong).all():
            return strong
        strong = grown


def dilate(mask: np.ndarray) -> np.ndarray:
    p, (h, w) = np.pad(mask, 1), mask.shape
    return np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def background(g: np.ndarray, part: int = 10) -> tuple[float, float]:
    """Mean deviation and mean of the corners, each a tenth (or another part) of the shorter side; under 5 pixels: 0 and the whole picture's mean."""
    k = min(g.shape) // part
    if k < 5:
        return 0.0, float(g.mean())
    corners = [c[:, s] for c in (g[:k], g[-k:]) for s in (slice(None, k), slice(-k, None))]
    return float(np.mean([c.std() for c in corners])), float(np.mean([c.mean() for c in corners]))


def features(image: np.ndarray) -> dict[str, float]:
    g = grey(image)
    std, mean = background(g)
    return {"sharpness": sharpness(g), "contrast": contrast(g), "brightness": float(g.mean()), "noise_snr": noise_snr(g), "edge_density": float(edges(g).mean()), "bg_std": std, "bg_mean": mean}


# enhancement


def sharpen(g: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(_filter(g, np.array([[0, -0.5, 0], [-0.5, 3, -0.5], [0, -0.5, 0]]))), 0, 255).astype(np.uint8)


def smooth(g: np.ndarray, size: int = 3) -> np.ndarray:
    row = {3: np.array([1, 2, 1]) / 4, 5: np.array([1, 4, 6, 4, 1]) / 16}[size]
    return np.rint(_filter(g, np.outer(row, row))).astype(np.uint8)


def equalise(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: a table of levels for each tile, blended between the four nearest tiles."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    area = th * tw
    table = np.empty((tiles, tiles, 256))
    most = max(1, int(clip * area / 256))
    for i in range(tiles):
        for j in range(tiles):
            count = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(count - most, 0).sum()
            table[i, j] = np.cumsum(np.minimum(count, most) + over / 256) * 255 / area
    place = lambda n, t: np.clip((np.arange(n) + 0.5) / t - 0.5, 0, tiles - 1)
    y, x = place(h, th), place(w, tw)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: table[a[:, None], b[None, :], g]
    mixed = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def skew(g: np.ndarray, step: float = 0.5) -> float:
    """Degrees: the median slope of straight edges within 30 degrees of level; 0 without one. A line is a cell of the Hough table with 100 edge
    pixels and a quarter of the width."""
    y, x = np.nonzero(edges(g))
    if not len(y):
        return 0.0
    need, found = max(100, g.shape[1] // 4), []
    for degrees in np.arange(-29.5, 30, step):
        t = np.radians(degrees)
        rho = np.rint(y * np.cos(t) - x * np.sin(t)).astype(int)
        votes = np.bincount(rho - rho.min())
        found += [degrees] * int((votes >= need).sum())
    return float(np.median(found)) if found else 0.0


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear, white outside."""
    h, w = image.shape[:2]
    p = np.pad(image.astype(np.float64), ((1, 1), (1, 1), *[(0, 0)] * (image.ndim - 2)), constant_values=WHITE)
    y, x = np.clip(y, -1, h) + 1, np.clip(x, -1, w) + 1
    y0, x0 = np.minimum(y.astype(int), h), np.minimum(x.astype(int), w)
    fy, fx = y - y0, x - x0
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    mixed = (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Anticlockwise about the centre, white where nothing was."""
    h, w = image.shape[:2]
    cy, cx, t = h // 2, w // 2, np.radians(degrees)
    y, x = np.mgrid[:h, :w]
    dy, dx = y - cy, x - cx
    return _sample(image, cy + np.sin(t) * dx + np.cos(t) * dy, cx + np.cos(t) * dx - np.sin(t) * dy)


def _weights(n: int, m: int, shrink: bool) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) from n to m pixels: cubic, or by covered area when shrinking."""
    scale = n / m
    if shrink:
        low, high = np.arange(m) * scale, (np.arange(m) + 1) * scale
        at = np.floor(low).astype(int)[:, None] + np.arange(int(np.ceil(scale)) + 1)
        weight = np.clip(np.minimum(high[:, None], at + 1) - np.maximum(low[:, None], at), 0, None)
    else:
        where = (np.arange(m) + 0.5) * scale - 0.5
        at = np.floor(where).astype(int)[:, None] + np.arange(-1, 3)
        d, a = np.abs(where[:, None] - at), -0.75
        weight = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a)
    return np.clip(at, 0, n - 1), weight / weight.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    shrink = height * width < image.shape[0] * image.shape[1]
    out = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        at, weight = _weights(out.shape[axis], size, shrink)
        out = sum(np.take(out, at[:, k], axis=axis) * weight[:, k].reshape([-1 if i == axis else 1 for i in range(out.ndim)]) for k in range(at.shape[1]))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def normalise_size(image: np.ndarray, least: int = 2000, most: int = 4000) -> np.ndarray:
    h, w = image.shape[:2]
    long = max(h, w)
    if least <= long <= most:
        return image
    scale = (least if long < least else most) / long
    return resize(image, max(1, int(h * scale)), max(1, int(w * scale)))


# perspective


def _components(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (x, y) of each connected piece, the largest first: runs of each row, joined where they touch the row above."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    above: list[tuple[int, int, int]] = []
    for y, line in enumerate(mask):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        here = []
        for start, end in turns.reshape(-1, 2):
            me = len(parent)
            parent.append(me)
            runs.append((y, int(start), int(end)))
            here.append((me, int(start), int(end)))
            for other, s, e in above:
                if s <= end and e >= start:
                    parent[root(other)] = root(me)
        above = here
    pieces: dict[int, list[np.ndarray]] = {}
    for k, (y, s, e) in enumerate(runs):
        pieces.setdefault(root(k), []).append(np.array([[s, y], [e - 1, y]]))
    return sorted((np.concatenate(p) for p in pieces.values()), key=lambda p: -np.ptp(p[:, 0]) * np.ptp(p[:, 1]))


def _hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _simplify(p: np.ndarray, off: float) -> np.ndarray:
    """A closed outline with no point further than off from it: split at the farthest point, again and again."""

    def keep(line: np.ndarray) -> list[np.ndarray]:
        if len(line) < 3:
            return [line[0]]
        a, b = line[0], line[-1]
        v = b - a
        away = np.abs(v[0] * (line[:, 1] - a[1]) - v[1] * (line[:, 0] - a[0])) / (np.hypot(*v) or 1)
        k = int(away.argmax())
        return keep(line[: k + 1]) + keep(line[k:]) if away[k] > off else [a]

    start = int(((p - p.mean(axis=0)) ** 2).sum(axis=1).argmax())
    p = np.roll(p, -start, axis=0)
    far = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    return np.array(keep(p[: far + 1]) + keep(np.vstack([p[far:], p[:1]])))


def order_corners(p: np.ndarray) -> np.ndarray:
    total, turn = p.sum(axis=1), p[:, 1] - p[:, 0]
    return p[[total.argmin(), turn.argmin(), total.argmax(), turn.argmax()]]


def find_corners(g: np.ndarray, least_share: float = 0.15, off_share: float = 0.02, side: int = 800) -> np.ndarray | None:
    """The document's corners from top left, clockwise: of the five widest outlines the first that covers enough of the picture and
    has four sides. Looked for at a side of at most 800 pixels."""
    scale = max(1.0, max(g.shape) / side)
    small = g if scale == 1 else resize(g, int(g.shape[0] / scale), int(g.shape[1] / scale))
    lines = dilate(dilate(edges(smooth(small, 5))))
    for piece in _components(lines)[:5]:
        outline = _hull(piece)
        if len(outline) < 4 or _area(outline) < least_share * small.size:
            continue
        around = np.hypot(*(outline - np.roll(outline, -1, axis=0)).T).sum()
        corners = _simplify(outline, off_share * around)
        if len(corners) == 4:
            return order_corners(corners * scale)
    return None


def straighten(image: np.ndarray) -> np.ndarray:
    """The document alone, seen from above; the picture as it is where no outline is found."""
    corners = find_corners(grey(image))
    if corners is None:
        return image
    tl, tr, br, bl = corners
    w = int(max(np.hypot(*(tr - tl)), np.hypot(*(br - bl))))
    h = int(max(np.hypot(*(bl - tl)), np.hypot(*(br - tr))))
    if w < 2 or h < 2:
        return image
    to = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows = []
    for (u, v), (x, y) in zip(to, corners, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
    m = np.append(np.linalg.solve(np.array(rows), corners.ravel()), 1).reshape(3, 3)
    v, u = np.mgrid[:h, :w]
    x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]).astype(float), axes=1)
    return _sample(image, y / z, x / z)


def preprocess(image: np.ndarray, strategy: str) -> np.ndarray:
    """Grey, enhanced as the strategy says, its long side between 2000 and 4000 pixels."""
    g = grey(image)
    if strategy == "minimal":
        g = sharpen(g)
    elif strategy in ("moderate", "aggressive"):
        g = smooth(equalise(g))
        angle = skew(g)
        if abs(angle) > 0.5:
            g = rotate(g, angle)
        if strategy == "aggressive":
            g = straighten(g)
    return normalise_size(g)
