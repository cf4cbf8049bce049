"""The error-corrected two-dimensional symbol: payload bytes, Reed-Solomon code, tiles, and reading it from images.

The artwork is a parameter: a square grid of 0 and 1. Its inked tiles whose four neighbours are all inked carry one bit each
(cleared for 0); the others stay as they are, so a reader can find the mark by them. `disc` is an artwork made by rule.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from attesta.functions.seals import ALPHABET
from attesta.sources.spread import spread

# Field, layout of the payload and tolerances of the reader.
POLY, DATA, PARITY, MAGIC = 0x11D, 11, 24, 0x1F
PAYLOAD = re.compile(r"CVR\|R1-((?:20|21)[0-9]{2})-([0-9]{6})\|([0-9]{1,3})\|([A-Z2-7]{4})-([A-Z2-7]{4})")
N, LEAST_MATCH, LEAST_PART, INSIDE = 44, 0.72, 0.02, 0.6
LEAST_SIDE, LEAST_DARK = 40, 200


# --- K8, K15: the field ---


def _tables() -> tuple[list[int], list[int]]:
    exp, log, x = [0] * 510, [0] * 256, 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLY if x & 128 else 0)
    return exp, log


EXP, LOG = _tables()
_PRODUCTS = np.array([[EXP[LOG[a] + LOG[b]] if a and b else 0 for b in range(256)] for a in range(256)], np.uint8)


def mul(a: int, b: int) -> int:
    return EXP[LOG[a] + LOG[b]] if a and b else 0


def inv(a: int) -> int:
    return EXP[255 - LOG[a]]


def _trim(p: list[int]) -> list[int]:
    while p and not p[-1]:
        p.pop()
    return p


def poly_mul(a: list[int], b: list[int]) -> list[int]:
    """Coefficients from the lowest power on."""
    out = [0] * (len(a) + len(b) - 1) if a and b else []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] ^= mul(x, y)
    return out


def poly_at(p: list[int], x: int) -> int:
    y = 0
    for c in reversed(p):
        y = mul(y, x) ^ c
    return y


def _divmod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, q, top = a[:], [0] * max(0, len(a) - len(b) + 1), inv(b[-1])
    for i in range(len(a) - len(b), -1, -1):
        q[i] = f = mul(a[i + len(b) - 1], top)
        for j, y in enumerate(b):
            a[i + j] ^= mul(f, y)
    return _trim(q), _trim(a)


@lru_cache
def _generator(parity: int) -> tuple[int, ...]:
    g = [1]
    for i in range(parity):
        g = poly_mul(g, [EXP[i], 1])
    return tuple(g)


@lru_cache
def _parity_rows(n: int, parity: int) -> np.ndarray:
    """The parity of each of the `n` words that are 1 in one place: the rest of x**(place + parity) by the generator."""
    rests = [_divmod([0] * (parity + n - 1 - j) + [1], list(_generator(parity)))[1] for j in range(n)]
    return np.array([(r + [0] * parity)[:parity][::-1] for r in rests], np.uint8)


@lru_cache
def _powers(n: int, parity: int) -> np.ndarray:
    """What the bytes of a word of `n` count in each syndrome."""
    return np.array([[EXP[i * j % 255] for i in range(parity)] for j in reversed(range(n))], np.uint8).reshape(n, parity)


def rs_encode(data: bytes, parity: int = PARITY) -> bytes:
    """K9: data followed by its parity: the rest of data * x**parity by the generator, a sum over the bytes."""
    d = np.frombuffer(bytes(data), np.uint8)
    return bytes(data) + (np.bitwise_xor.reduce(_PRODUCTS[d[:, None], _parity_rows(len(d), parity)], 0).tobytes() if len(d) else bytes(parity))


def rs_decode(code: bytes, parity: int = PARITY) -> bytes | None:
    """The data, with up to parity // 2 wrong bytes put right; None beyond that.

    The key equation is solved by Euclid's algorithm; what comes out is checked once more.
    """
    word = list(code[::-1])
    syndromes = np.bitwise_xor.reduce(_PRODUCTS[np.frombuffer(bytes(code), np.uint8)[:, None], _powers(len(code), parity)], 0).tolist()
    if any(syndromes):
        a, b, s, t = [0] * parity + [1], _trim(syndromes[:]), [], [1]
        while len(b) - 1 >= parity // 2:
            q, r = _divmod(a, b)
            qt = poly_mul(q, t)
            nxt = [(s[i] if i < len(s) else 0) ^ (qt[i] if i < len(qt) else 0) for i in range(max(len(s), len(qt)))]
            a, b, s, t = b, r, t, _trim(nxt)
            if not b:
                return None
        if not t or not t[0]:
            return None
        unit = inv(t[0])
        locator, value = [mul(c, unit) for c in t], [mul(c, unit) for c in b]
        slope = [c if i % 2 == 0 else 0 for i, c in enumerate(locator[1:])]
        places = [i for i in range(len(word)) if poly_at(locator, EXP[-i % 255]) == 0]
        if len(places) != len(locator) - 1:
            return None
        for i in places:
            x = EXP[-i % 255]
            d = poly_at(slope, x)
            if not d:
                return None
            word[i] ^= mul(EXP[i % 255], mul(poly_at(value, x), inv(d)))
        if any(poly_at(word, EXP[i]) for i in range(parity)):
            return None
    return bytes(word[::-1][: len(code) - parity])


# --- K6, K7: payload ---


def pack(payload: str) -> bytes | None:
    """K6: the bytes of a payload; None for one that the symbol can't carry."""
    m = PAYLOAD.fullmatch(payload or "")
    if not m or not 2000 <= int(m[1]) <= 2255 or not 1 <= int(m[3]) <= 255:
        return None
    seal = 0
    for c in m[4] + m[5]:
        seal = seal << 5 | ALPHABET.index(c)
    return bytes([MAGIC, int(m[1]) - 2000]) + int(m[2]).to_bytes(3, "big") + bytes([int(m[3])]) + seal.to_bytes(5, "big")


def unpack(data: bytes | None) -> str | None:
    if not data or data[0] != MAGIC or not data[5]:
        return None
    bits = int.from_bytes(data[6:11], "big")
    seal = "".join(ALPHABET[bits >> 35 - 5 * i & 31] for i in range(8))
    return f"CVR|R1-{2000 + data[1]}-{int.from_bytes(data[2:5], 'big'):06d}|{data[5]}|{seal[:4]}-{seal[4:]}"


def payload_bits(payload: str) -> np.ndarray | None:
    """K7: the 280 bits, the highest of each byte first."""
    data = pack(payload)
    return None if data is None else np.unpackbits(np.frombuffer(rs_encode(data), np.uint8))


def bits_payload(bits: np.ndarray) -> str | None:
    n = 8 * (DATA + PARITY)
    return unpack(rs_decode(np.packbits(np.asarray(bits[:n], np.uint8)).tobytes())) if len(bits) >= n else None


# --- K11, K13, K14: tiles ---


@lru_cache
def disc(n: int = N) -> tuple[str, ...]:
    """An artwork by rule: a disc with a bar and a square left blank, which no turn of it repeats."""
    c = (n - 1) / 2
    ink = lambda y, x: (y - c) ** 2 + (x - c) ** 2 <= (n / 2 - 2) ** 2 and not (0.68 * n <= y <= 0.76 * n and 0.22 * n <= x <= 0.6 * n) and not (0.25 * n <= y <= 0.36 * n and 0.6 * n <= x <= 0.7 * n)
    return tuple("".join("1" if ink(y, x) else "0" for x in range(n)) for y in range(n))


class Artwork:
    """A grid with its carriers in reading order and its fixed tiles: ON, HOLE (ink on all four sides in row and column), FIELD."""

    def __init__(self, rows: tuple[str, ...]) -> None:
        self.grid = np.array([[int(c) for c in r] for r in rows], np.uint8)
        pad = np.pad(self.grid, 1)
        inner = (self.grid & pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]).astype(bool)
        self.carriers = np.argwhere(inner)
        seen = np.maximum.accumulate
        g = self.grid
        sides = seen(g, 0) & seen(g[::-1], 0)[::-1] & seen(g, 1) & seen(g[:, ::-1], 1)[:, ::-1]
        blank = g == 0
        self.on, self.hole, self.field = (g == 1) & ~inner, blank & (sides == 1), blank & (sides == 0)
        ys, xs = np.nonzero(g)
        n = len(g)
        self.ink = np.stack([xs + 0.5 - n / 2, ys + 0.5 - n / 2])
        self.ink_cols = xs.max() - xs.min() + 1
        #: Groups of tiles as one reads them: what is inked for sure, what is blank for sure (holes first), and the bits.
        self.parts = {"on": np.argwhere(self.on), "blank": np.concatenate([np.argwhere(self.hole), np.argwhere(self.field)]), "bits": self.carriers[: 8 * (DATA + PARITY)]}
        self.holes = int(self.hole.sum())


@lru_cache
def artwork(rows: tuple[str, ...]) -> Artwork:
    return Artwork(rows)


def tiles_for(payload: str, art: Artwork) -> np.ndarray | None:
    """The tiles of a payload; carriers beyond its bits stay inked."""
    bits = payload_bits(payload)
    if bits is None or len(bits) > len(art.carriers):
        return None
    tiles = art.grid.copy()
    k = art.carriers[: len(bits)]
    tiles[k[:, 0], k[:, 1]] = bits
    return tiles


def tiles_payload(tiles: np.ndarray, art: Artwork) -> str | None:
    return bits_payload(tiles[art.carriers[:, 0], art.carriers[:, 1]])


def rasterize(tiles: np.ndarray, px: int = 512, quiet: float = 0.08) -> np.ndarray:
    """Grey pixels of tiles with a quiet zone."""
    pad, n = math.floor(px * quiet + 0.5), len(tiles)
    at = np.floor(pad + np.arange(n + 1) * px / n + 0.5).astype(int)
    wide = np.diff(at, prepend=0, append=px + 2 * pad)
    return np.pad(np.where(tiles, 0, 255).astype(np.uint8), 1, constant_values=255).repeat(wide, 1).repeat(wide, 0)


@lru_cache
def _rects(n: int, px: int) -> list[list[str]]:
    s = px / n
    return [[f'<rect x="{c * s:.2f}" y="{r * s:.2f}" width="{s + 0.35:.2f}" height="{s + 0.35:.2f}" fill="#111"/>' for c in range(n)] for r in range(n)]


def svg(tiles: np.ndarray, px: int = 512) -> str:
    """The tiles as rectangles."""
    rects = _rects(len(tiles), px)
    inked = "".join(rects[r][c] for r, c in np.argwhere(tiles).tolist())
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {px} {px}" width="{px}" height="{px}"><rect width="{px}" height="{px}" fill="#fff"/>{inked}</svg>'


# --- K12: reading an image ---


def otsu_level(gray: np.ndarray) -> int:
    h = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    gap = np.where(ok, mass / np.maximum(below, 1) - (mass[-1] - mass) / np.maximum(above, 1), 0)
    return int((below * above * gap**2).argmax()) if ok.any() else 128


def local_levels(gray: np.ndarray, radius: int, bias: float) -> np.ndarray:
    """The mean of the box around each pixel, from the integral image, less `bias`."""
    h, w = gray.shape
    ii = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, 0, np.float64), 1, out=ii[1:, 1:])
    y0, y1 = np.maximum(np.arange(h) - radius, 0)[:, None], np.minimum(np.arange(h) + radius + 1, h)[:, None]
    x0, x1 = np.maximum(np.arange(w) - radius, 0)[None], np.minimum(np.arange(w) + radius + 1, w)[None]
    rows = ii[y1[:, 0]] - ii[y0[:, 0]]
    return (rows.take(x1[0], 1) - rows.take(x0[0], 1)) / ((y1 - y0) * (x1 - x0)) - bias


def _runs(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the runs of dark pixels, `to` excluded, in reading order."""
    h, w = dark.shape
    edged = np.zeros((h, w + 2), np.bool_)
    edged[:, 1:-1] = dark
    flat = edged.ravel()
    at = np.flatnonzero(flat[1:] != flat[:-1])
    y, a = np.divmod(at[::2], w + 2)
    return y, a, at[1::2] - y * (w + 2)


def components(dark: np.ndarray) -> np.ndarray:
    """Boxes (area, x0, y0, x1, y1) of the parts whose pixels touch, corners included: runs of each row, joined with those of the row above."""
    y, a, b = _runs(dark)
    n, wide = len(y), dark.shape[1] + 2
    # The runs of the row above that touch a run are neighbours of each other.
    first, last = np.searchsorted(y * wide + b, (y - 1) * wide + a), np.searchsorted(y * wide + a, (y - 1) * wide + b, "right")
    many = np.maximum(0, last - first)
    j = np.repeat(np.arange(n), many)
    i = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    part = np.arange(n)  # the first run of each part, as far as it is known
    while len(i):
        p, q = part[i], part[j]
        open_ = p != q
        if not open_.any():
            break
        i, j, p, q = i[open_], j[open_], p[open_], q[open_]
        np.minimum.at(part, np.maximum(p, q), np.minimum(p, q))
        while (part != (up := part[part])).any():
            part = up
    tops, which = np.unique(part, return_inverse=True)
    box = np.zeros((len(tops), 5), np.int64)
    box[:, 0] = np.bincount(which, b - a, len(tops))
    box[:, 1:3] = dark.size
    for c, at, x in ((1, np.minimum, a), (2, np.minimum, y), (3, np.maximum, b - 1), (4, np.maximum, y)):
        at.at(box[:, c], which, x)
    return box


def _around(parts: np.ndarray) -> tuple[int, int, int, int]:
    return int(parts[:, 1].min()), int(parts[:, 2].min()), int(parts[:, 3].max()), int(parts[:, 4].max())


def candidates(parts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Where the mark may be: the largest part with all that lies near (grown until nothing is), with what lies inside it, with everything of some size, alone."""
    if not len(parts):
        return []
    big = parts[parts[:, 0] >= LEAST_PART * parts[:, 0].max()]
    first = big[[big[:, 0].argmax()]]
    inside = lambda lo, hi, a, b: np.maximum(0, np.minimum(big[:, hi], b) - np.maximum(big[:, lo], a) + 1)
    _, x0, y0, x1, y1 = first[0]
    share = inside(1, 3, x0, x1) * inside(2, 4, y0, y1) / ((big[:, 3] - big[:, 1] + 1) * (big[:, 4] - big[:, 2] + 1))
    cluster, size = np.array([x0, y0, x1, y1]), 0
    while True:
        x0, y0, x1, y1 = cluster
        gap = max(4, 0.15 * max(x1 - x0 + 1, y1 - y0 + 1))
        near = (np.maximum(x0 - big[:, 3], big[:, 1] - x1) <= gap) & (np.maximum(y0 - big[:, 4], big[:, 2] - y1) <= gap)
        if near.sum() == size:
            break
        size, cluster = near.sum(), np.array(_around(big[near]))
    found = [tuple(map(int, cluster)), _around(big[(share >= INSIDE) | (big[:, 0] == big[:, 0].max())]), _around(big), _around(first)]
    return list(dict.fromkeys(found))


def _longest_runs(dark: np.ndarray) -> np.ndarray:
    """The longest run of dark pixels in each row."""
    y, a, b = _runs(dark)
    best = np.zeros(len(dark), np.int64)
    np.maximum.at(best, y, b - a)
    return best


def trimmed(dark: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes without margins that only hold thin strokes, from thin to thick."""
    ys, xs = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    if not len(ys):
        return []
    whole = int(xs[0]), int(ys[0]), int(xs[-1]), int(ys[-1])
    tile = min(whole[2] - whole[0], whole[3] - whole[1]) + 1
    rows, cols = _longest_runs(dark), _longest_runs(dark.T)
    out = []
    for k in (1, 2, 3, 4, 5, 6, 8):
        y, x = np.flatnonzero(rows >= tile / N * k), np.flatnonzero(cols >= tile / N * k)
        if len(y) and len(x):
            out.append((int(x[0]), int(y[0]), int(x[-1]), int(y[-1])))
    return [b for b in dict.fromkeys(out) if b != whole and b[2] > b[0] and b[3] > b[1]]


_ROUGH, _SIZES = tuple((d, 1.0) for d in range(0, 360, 5)), tuple(float(k) for k in np.arange(0.97, 1.0301, 0.005))


def _places(art: Artwork, part: str, box: tuple[int, int, int, int], shape: tuple[int, int], turns: tuple[tuple[int, float], ...]) -> tuple[np.ndarray, ...]:
    """Where a part of the tiles lies in the picture for each (degrees, size) of `turns`: is it inside, the pixel above and left of it, how far it is from there, and the nearest pixel."""
    (h, w), n = shape, len(art.grid)
    x0, y0, x1, y1 = box
    gx, gy = art.parts[part][:, 1] + 0.5 - n / 2, art.parts[part][:, 0] + 0.5 - n / 2
    xs, ys = [], []
    for deg, k in turns:
        c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        px, py = art.ink[0] * c - art.ink[1] * s, art.ink[0] * s + art.ink[1] * c
        left, right, top, foot = px.min(), px.max(), py.min(), py.max()
        pitch = k * max((x1 - x0 + 1) / (right - left + 1), (y1 - y0 + 1) / (foot - top + 1))
        xs.append((x0 + x1) / 2 + pitch * (gx * c - gy * s - (left + right) / 2))
        ys.append((y0 + y1) / 2 + pitch * (gx * s + gy * c - (top + foot) / 2))
    fx, fy = np.array(xs), np.array(ys)
    ok = (fx >= 0) & (fy >= 0) & (fx < w - 1) & (fy < h - 1)
    fx, fy = np.where(ok, fx, 0), np.where(ok, fy, 0)
    ix, iy = fx.astype(int), fy.astype(int)
    return ok, iy * w + ix, fx - ix, fy - iy, np.floor(fy + 0.5).astype(int) * w + np.floor(fx + 0.5).astype(int)


# Pictures of one size often have their marks in one place: for a few boxes with all their turns (2 MB each at most), and for single turns.
_many_places, _one_place = lru_cache(32)(_places), lru_cache(256)(_places)
#: Turns whose blank tiles are read at once.
_SOME = 12


def _dark(gray: np.ndarray, levels: np.ndarray | int, art: Artwork, part: str, box: tuple[int, int, int, int], turns: tuple[tuple[int, float], ...], only: np.ndarray | None = None) -> np.ndarray:
    """The tiles of a part, read between the pixels, a row for each turn, or for `only` these."""
    places = (_one_place if len(turns) == 1 else _many_places)(art, part, box, gray.shape, turns)
    ok, at, ax, ay, near = places if only is None else (x[only] for x in places)
    g, w = gray.ravel(), gray.shape[1]
    v = (g[at] * (1 - ax) + g[at + 1] * ax) * (1 - ay) + (g[at + w] * (1 - ax) + g[at + w + 1] * ax) * ay
    return ok & (v <= (levels.ravel()[near] if isinstance(levels, np.ndarray) else levels))


def _best_turn(gray: np.ndarray, levels: np.ndarray | int, art: Artwork, box: tuple[int, int, int, int], turns: tuple[tuple[int, float], ...], above: float) -> tuple[float, tuple[int, float] | None]:
    """The first turn of the highest score, if that is more than `above`. The inked tiles bound a score: most turns end with them."""
    on = _dark(gray, levels, art, "on", box, turns).mean(1)
    best, at = above, -1
    order = np.argsort(-on, kind="stable")
    order = order[on[order] > above]
    for k in range(0, len(order), _SOME):
        some = order[k : k + _SOME]
        some = some[on[some] >= best]
        if not len(some):
            break
        blank = _dark(gray, levels, art, "blank", box, turns, some)
        score = np.minimum(on[some], 1 - blank[:, art.holes :].mean(1))
        if art.holes:
            score = np.minimum(score, 1 - blank[:, : art.holes].mean(1))
        top = float(score.max())
        first = int(some[score == top].min())
        if top > best or top == best and 0 <= first < at:
            best, at = top, first
    return best, turns[at] if at >= 0 else None


def _read(gray: np.ndarray, levels: np.ndarray | int, box: tuple[int, int, int, int], art: Artwork) -> str | None:
    """The payload of the mark that fills a box, at the turn and size at which the tiles that carry nothing fit best."""
    best, turn = _best_turn(gray, levels, art, box, _ROUGH[:1], -1.0)
    if best < 1:
        best, turn = _best_turn(gray, levels, art, box, _ROUGH, -1.0)
        # A score below LEAST_MATCH isn't read, so it need not be known.
        fine = tuple((d, k) for d in range(turn[0] - 4, turn[0] + 5) for k in _SIZES)
        best, finer = _best_turn(gray, levels, art, box, fine, max(best, np.nextafter(LEAST_MATCH, 0)))
        turn = finer or turn
    return bits_payload(_dark(gray, levels, art, "bits", box, (turn,))[0]) if best >= LEAST_MATCH else None


def decode_image(gray: np.ndarray, art: Artwork, retry: bool = True) -> str | None:
    """The payload of the mark in an image, or None. Two thresholds, all candidate boxes, then boxes without thin strokes."""
    h, w = gray.shape
    if min(h, w) < LEAST_SIDE:
        return None
    darks = []
    for find in (otsu_level, lambda g: local_levels(g, max(8, math.floor(min(h, w) / 12 + 0.5)), 6)):
        levels = find(gray)
        dark = gray <= levels
        if dark.sum() < LEAST_DARK:
            continue
        darks.append(dark)
        for box in candidates(components(dark)):
            if max(box[2] - box[0], box[3] - box[1]) + 1 >= art.ink_cols:
                if (got := _read(gray, levels, box, art)) is not None:
                    return got
    if retry:
        for x0, y0, x1, y1 in dict.fromkeys(b for d in darks for b in trimmed(d)):
            if (got := decode_image(gray[y0 : y1 + 1, x0 : x1 + 1], art, False)) is not None:
                return got
    return None


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """Luma as the reader weighs it, cut to whole numbers."""
    return (rgb[..., 0] * 0.3 + rgb[..., 1] * 0.59 + rgb[..., 2] * 0.11).astype(np.uint8)


def shrunk(gray: np.ndarray, side: int = 700) -> np.ndarray:
    """A frame whose shorter side is at most `side` pixels, by nearest pixels."""
    k = side / min(gray.shape)
    if k >= 1:
        return gray
    y, x = (np.minimum((np.arange(max(1, int(n * k))) + 0.5) / k, n - 1).astype(int) for n in gray.shape)
    return gray[np.ix_(y, x)]


# --- DataFrame operators ---

_S, _B = T.StringType(), T.BinaryType()


@F.pandas_udf(_B)
def encode_udf(payload: pd.Series) -> pd.Series:
    """K7, K9: the code word of each payload; null for one that can't be carried."""
    return pd.Series([None if (d := pack(p)) is None else rs_encode(d) for p in payload], dtype=object)


@F.pandas_udf(_S)
def decode_udf(code: pd.Series) -> pd.Series:
    """The payload of each received word."""
    return pd.Series([None if c is None or len(c) != DATA + PARITY else unpack(rs_decode(bytes(c))) for c in code], dtype=object)


encode_udf, decode_udf = encode_udf.asNondeterministic(), decode_udf.asNondeterministic()  # a filter on the result would run them again


def tiles_udf(rows: tuple[str, ...] | None = None):
    """The tiles of each payload as text, row by row."""
    rows = rows or disc()

    @F.pandas_udf(_S)
    def run(payload: pd.Series) -> pd.Series:
        made = (tiles_for(p, artwork(rows)) for p in payload)
        return pd.Series([None if x is None else (x + 48).tobytes().decode() for x in made], dtype=object)

    return run.asNondeterministic()


def read_tiles_udf(rows: tuple[str, ...] | None = None):
    """K11 inverse."""
    rows = rows or disc()
    n = len(rows)

    @F.pandas_udf(_S)
    def run(tiles: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else tiles_payload((np.frombuffer(s.encode(), np.uint8) - 48).reshape(n, n), artwork(rows)) for s in tiles], dtype=object)

    return run


def raster_udf(rows: tuple[str, ...] | None = None, px: int = 220):
    """Payloads as square grey images, one byte a pixel."""
    rows = rows or disc()

    @F.pandas_udf(_B)
    def run(payload: pd.Series) -> pd.Series:
        made = (tiles_for(p, artwork(rows)) for p in payload)
        return pd.Series([None if x is None else rasterize(x, px).tobytes() for x in made], dtype=object)

    return run


def svg_udf(rows: tuple[str, ...] | None = None, px: int = 512):
    """Payloads as SVG."""
    rows = rows or disc()

    @F.pandas_udf(_S)
    def run(payload: pd.Series) -> pd.Series:
        made = (tiles_for(p, artwork(rows)) for p in payload)
        return pd.Series([None if x is None else svg(x, px) for x in made], dtype=object)

    return run.asNondeterministic()


def decode_images(images: DataFrame, rows: tuple[str, ...] | None = None, deal: bool = True) -> DataFrame:
    """K12 over (image_id, width, height, gray): (image_id, payload); a task reads its images one by one, null where none is found.

    deal: move the pictures so that all tasks have some; not for pictures that are made in the tasks that read them.
    """
    rows = rows or disc()

    @F.pandas_udf(_S)
    def run(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        ok = lambda g, w, h: g is not None and w and h and len(g) >= w * h
        return pd.Series([decode_image(shrunk(np.frombuffer(g, np.uint8)[: w * h].reshape(h, w)), artwork(rows)) if ok(g, w, h) else None for g, w, h in zip(gray, width, height)], dtype=object)

    return (spread(images) if deal else images).select("image_id", run("gray", "width", "height").alias("payload"))


def baseline(pixels: DataFrame, side: int, n: int = N) -> DataFrame:
    """(image_id, r, c, ink, carrier) from the pixels (image_id, x, y, v) of square pictures of `side` pixels.

    A tile is inked where more than half of its pixels are darker than 200; it carries a bit where its four neighbours are inked.
    """
    cell = side / n
    t = pixels.withColumn("r", F.floor(F.col("y") / cell).cast("int")).withColumn("c", F.floor(F.col("x") / cell).cast("int"))
    g = t.groupBy("image_id", "r", "c").agg((F.avg((F.col("v") < 200).cast("int")) > 0.5).alias("ink"))
    row, col = Window.partitionBy("image_id", "r").orderBy("c"), Window.partitionBy("image_id", "c").orderBy("r")
    beside = lambda f, w: F.coalesce(f("ink").over(w), F.lit(False))
    return g.withColumn("carrier", F.col("ink") & beside(F.lag, row) & beside(F.lead, row) & beside(F.lag, col) & beside(F.lead, col))


def artwork_rows(tiles: DataFrame, n: int = N) -> tuple[str, ...]:
    """The artwork of one picture's tiles (r, c, ink) of `baseline`, as the rows that the other operators take; n by n tiles."""
    got = {(r["r"], r["c"]): r["ink"] for r in tiles.select("r", "c", "ink").limit(n * n + 1).collect()}
    if len(got) != n * n:
        raise ValueError(f"an artwork has {n} by {n} tiles")
    return tuple("".join("1" if got[y, x] else "0" for x in range(n)) for y in range(n))


def fixed_groups(tiles: DataFrame) -> DataFrame:
    """(image_id, r, c, part) of the tiles that carry nothing: 'on', 'hole' or 'field', by running maxima from four sides."""
    sides = []
    for by, along in (("r", "c"), ("c", "r")):
        for order in (F.col(along).asc(), F.col(along).desc()):
            w = Window.partitionBy("image_id", by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            sides.append(F.max("ink").over(w))
    enclosed = sides[0] & sides[1] & sides[2] & sides[3]
    part = F.when(F.col("carrier"), None).when(F.col("ink"), "on").when(enclosed, "hole").otherwise("field")
    return tiles.withColumn("part", part).filter("part IS NOT NULL").select("image_id", "r", "c", "part")


def recovery(spark, trials: int, rates: list[float], parities: list[int], flips_seed: int = 1) -> DataFrame:
    """(parity, rate, trials, recovered): how often a word comes back when each bit is flipped with probability `rate`."""
    cells = [(p, r) for p in parities for r in rates]

    @F.pandas_udf(T.IntegerType())
    def run(trial: pd.Series, parity: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for t, p, r in zip(trial, parity, rate):
            rng = np.random.default_rng([flips_seed, int(t), int(p), int(r * 10_000)])
            data = rng.integers(0, 256, DATA, np.uint8).tobytes()
            code = np.frombuffer(rs_encode(data, int(p)), np.uint8)
            noise = np.packbits(rng.random(len(code) * 8) < r)
            out.append(int(rs_decode((code ^ noise).tobytes(), int(p)) == data))
        return pd.Series(out)

    grid = spark.createDataFrame(cells, "parity int, rate double")
    each = grid.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).repartition(spark.sparkContext.defaultParallelism)
    return each.withColumn("ok", run("trial", "parity", "rate")).groupBy("parity", "rate").agg(F.count("*").alias("trials"), F.sum("ok").alias("recovered"))
