"""Arithmetic on blocks of scanlines, as arrays [rows, columns, bands]: what one task does with its rows."""

from __future__ import annotations

import functools
import math

import numpy as np


@functools.lru_cache(4096)
def taps(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """For each output place the input places and weights of a triangle widened by the shrink; places beyond an end weigh nothing."""
    ratio = out / size
    reach = max(1.0, 1.0 / ratio)
    centre = (np.arange(out) + 0.5) / ratio - 0.5
    first = np.ceil(centre - reach).astype(np.int64)
    index = first[:, None] + np.arange(math.ceil(2 * reach) + 1)
    weight = np.maximum(0.0, 1.0 - np.abs(index - centre[:, None]) / reach)
    weight[(index < 0) | (index >= size)] = 0
    return np.clip(index, 0, size - 1), weight


def resample(values: np.ndarray, index: np.ndarray, weight: np.ndarray, digits: int = 6) -> np.ndarray:
    """Weighted means along the first axis, with the last digits cut so that the order of a sum does not show."""
    total = np.zeros((len(index), *values.shape[1:]))
    for k in range(index.shape[1]):
        total += values[index[:, k]] * weight[:, k].reshape(-1, *[1] * (values.ndim - 1))
    return np.round(total / weight.sum(axis=1).reshape(-1, *[1] * (values.ndim - 1)), digits)


#: Up to so many weights a pass is one matrix product.
DENSE = 1 << 16


@functools.lru_cache(1024)
def weights(size: int, out: int) -> np.ndarray:
    """The taps as a matrix [out, size] whose rows sum to one."""
    index, weight = taps(size, out)
    full = np.zeros((out, size))
    np.add.at(full, (np.arange(out)[:, None], index), weight)
    return full / full.sum(axis=1, keepdims=True)


def across(values: np.ndarray, out: int) -> np.ndarray:
    """Columns resampled to `out`."""
    size = values.shape[1]
    if out != size and size * out <= DENSE:
        return np.round(weights(size, out) @ values, 6)
    return values if out == size else resample(values.transpose(1, 0, 2), *taps(size, out)).transpose(1, 0, 2)


def down(values: np.ndarray, first: int, size: int, out: int, start: int, stop: int) -> np.ndarray:
    """Output rows start..stop of an image of `size` rows, of which `values` are those from `first` on."""
    if out == size:
        return values[start - first : stop - first]
    if size * out <= DENSE:
        own = weights(size, out)[start:stop, first : first + len(values)]
        return np.round((own @ values.reshape(len(values), -1)).reshape(stop - start, *values.shape[1:]), 6)
    index, weight = taps(size, out)
    return resample(values, np.clip(index[start:stop] - first, 0, len(values) - 1), weight[start:stop])


def whole(values: np.ndarray) -> np.ndarray:
    """Half away from zero, within a byte."""
    return np.clip(np.floor(values + 0.5), 0, 255)


def premultiply(values: np.ndarray) -> np.ndarray:
    return np.concatenate([whole(values[..., :3] * values[..., 3:] / 255.0), values[..., 3:]], axis=-1)


def unpremultiply(values: np.ndarray) -> np.ndarray:
    alpha = values[..., 3:]
    return np.concatenate([np.where(alpha == 0, 0, whole(values[..., :3] * 255.0 / np.maximum(alpha, 1))), alpha], axis=-1)


#: sRGB transfer of each byte, and back from light.
LIGHT = np.round(np.where(np.arange(256) / 255.0 <= 0.04045, np.arange(256) / 255.0 / 12.92, ((np.arange(256) / 255.0 + 0.055) / 1.055) ** 2.4), 9)


def from_light(values: np.ndarray) -> np.ndarray:
    coded = np.where(values <= 0.0031308, values * 12.92, 1.055 * np.maximum(values, 0.0) ** (1 / 2.4) - 0.055)
    return whole(np.round(coded * 255.0, 4))


@functools.lru_cache(256)
def kernel(sigma: float) -> np.ndarray:
    """Gaussian of radius ceil(3 sigma)."""
    radius = math.ceil(3 * sigma)
    raw = np.array([math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)])
    return raw / sum(raw.tolist())


def radius(sigma: float) -> int:
    return math.ceil(3 * sigma) if sigma > 0 else 0


class Rows:
    """Some rows of an image of `height` rows, from `first` on; filters give back those whose neighbours are there."""

    def __init__(self, values: np.ndarray, first: int, height: int):
        self.values, self.first, self.height = values, first, height

    def blurred(self, sigma: float) -> Rows:
        """Separable passes, rows first; beyond an edge of the image its last pixels count again."""
        weights, reach = kernel(sigma), radius(sigma)
        places = np.clip(np.arange(self.values.shape[1])[None, :] + np.arange(-reach, reach + 1)[:, None], 0, self.values.shape[1] - 1)
        wide = np.round(sum(w * self.values[:, at] for w, at in zip(weights, places)), 6)
        stop = self.first + len(self.values)
        start = 0 if self.first == 0 else self.first + reach
        end = self.height if stop == self.height else stop - reach
        rows = np.arange(start, end)
        near = np.clip(rows[None, :] + np.arange(-reach, reach + 1)[:, None], 0, self.height - 1) - self.first
        return Rows(np.round(sum(w * wide[at] for w, at in zip(weights, near)), 6), start, self.height)

    def cut(self, start: int, stop: int) -> np.ndarray:
        return self.values[start - self.first : stop - self.first]

    def blur(self, sigma: float) -> Rows:
        soft = self.blurred(sigma)
        return Rows(whole(soft.values), soft.first, self.height)

    def sharpen(self, sigma: float) -> Rows:
        """v + (v - blur(v)) on the colour bands."""
        soft = self.blurred(sigma)
        own = self.cut(soft.first, soft.first + len(soft.values))
        return Rows(np.concatenate([whole(2.0 * own[..., :3] - soft.values[..., :3]), own[..., 3:]], axis=-1), soft.first, self.height)

    def pixelate(self, n: int, start: int, stop: int) -> Rows:
        """Block means of n x n for the rows start..stop, the last blocks filled up by mirroring the image."""
        height, width = self.height, self.values.shape[1]
        n = min(n, max(height, width))
        top, bottom = start // n * n, -(-stop // n) * n

        def mirrored(places: np.ndarray, size: int) -> np.ndarray:
            turn = places % (2 * size)
            return np.where(turn < size, turn, 2 * size - 1 - turn)

        rows = mirrored(np.arange(top, bottom), height) - self.first
        columns = mirrored(np.arange(-(-width // n) * n), width)
        blocks = self.values[rows][:, columns].reshape((bottom - top) // n, n, len(columns) // n, n, -1)
        means = whole(blocks.sum(axis=(1, 3)) / (n * n))
        return Rows(means.repeat(n, axis=0).repeat(n, axis=1)[start - top : stop - top, :width], start, height)


def pixelate_halo(n: int, height: int, width: int) -> int:
    """Rows around a band that its blocks and their mirrored rows can need."""
    return 2 * min(n, max(height, width)) if n > 1 else 0


def orientation(angle: int, flip: bool, rotate: int, flip_h: bool, flip_v: bool) -> tuple[bool, bool, bool]:
    """(turned, rows reversed, columns reversed) of turning by the stored angle, mirroring, turning as asked and mirroring as asked.

    A result pixel (y, x) is the stored pixel whose row is y (x where turned) and whose column is x (y where turned).
    """
    turned = rows = columns = False
    for quarter, mirror_x, mirror_y in ((angle, flip, False), (rotate, flip_h, flip_v)):
        for _ in range(quarter // 90 % 4):
            rows, columns = (rows, not columns) if turned else (not rows, columns)
            turned = not turned
        if mirror_x:
            rows, columns = (not rows, columns) if turned else (rows, not columns)
        if mirror_y:
            rows, columns = (rows, not columns) if turned else (not rows, columns)
    return turned, rows, columns


def flatten(pixels: np.ndarray, back) -> np.ndarray:
    """Alpha blended onto a colour, one for all or one per pixel."""
    alpha = pixels[..., 3:]
    mixed = np.floor((pixels[..., :3] * alpha + np.asarray(back, float) * (255.0 - alpha)) / 255.0 + 0.5)
    return np.concatenate([mixed, np.full_like(alpha, 255)], axis=-1)


def over(pixels: np.ndarray, mark: np.ndarray, opacity: np.ndarray) -> np.ndarray:
    """`mark` times opacity over as many pixels."""
    s, d = mark[:, 3:] / 255.0 * opacity[:, None], pixels[:, 3:] / 255.0
    o = s + d * (1.0 - s)
    mixed = (mark[:, :3] * s + pixels[:, :3] * d * (1.0 - s)) / np.where(o == 0, 1.0, o)
    colour = np.where(o == 0, 0, whole(np.round(mixed, 6)))
    return np.concatenate([colour, whole(np.round(o * 255.0, 6))], axis=-1)


def finish(lines: list[bytes], marks: list[bytes | None], p: dict[str, np.ndarray]) -> list[bytes]:
    """Many lines of any widths at once: background where opaque, then the mark's lines over them, once or tiled. `p` has a value per line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines)) // 4
    starts = np.cumsum(size) - size
    pixels = np.frombuffer(b"".join(lines), np.uint8).reshape(-1, 4).astype(float)
    row = np.repeat(np.arange(len(lines)), size)
    at = np.flatnonzero(p["opaque"][row])
    pixels[at] = flatten(pixels[at], np.stack([p[f"bg_{c}"][row[at]] for c in "rgb"], axis=-1))
    length = np.fromiter((len(m) // 4 if m else 0 for m in marks), np.int64, len(marks))
    if length.any():
        own = np.frombuffer(b"".join(m for m in marks if m), np.uint8).reshape(-1, 4).astype(float)
        first = np.cumsum(length) - length
        at = np.flatnonzero(length[row] > 0)
        of = row[at]
        x, tiled = at - starts[of], p["tiled"][of]
        count = -(-size[of] // np.maximum(p["tile_w"][of], 1))
        skip = ((count + (count % 2 == 0)) * p["tile_w"][of] - size[of]) // 2
        place = np.where(tiled, (x + skip) % np.maximum(p["tile_w"][of], 1) - p["tile_left"][of], x - p["wm_left"][of])
        inside = (place >= 0) & (place < length[of])
        mark = np.zeros((len(at), 4))
        mark[inside] = own[first[of[inside]] + place[inside]]
        use = inside | tiled
        pixels[at[use]] = over(pixels[at[use]], mark[use], p["wm_opacity"][of[use]])
    data = pixels.astype(np.uint8).tobytes()
    return [data[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), size.tolist())]
