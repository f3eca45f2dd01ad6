"""Colour conversions as Column expressions over 8-bit channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(c: Column) -> Column:
    return c / F.lit(255.0)


def is_foreground(r: Column, g: Column, b: Column) -> Column:
    """A pixel counts unless it is pure black."""
    return (r != 0) | (g != 0) | (b != 0)


def hue_sector(r: Column, g: Column, b: Column, *, last_wins: bool) -> Column:
    """Hue in sixths of a turn, in [-1, 5); null where the pixel is grey.

    Where two channels tie for the maximum, `last_wins` takes blue before green before red.
    """
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    by = {"r": (g - b) / d, "g": F.lit(2.0) + (b - r) / d, "b": F.lit(4.0) + (r - g) / d}
    channel = {"r": r, "g": g, "b": b}
    out = F.when(top == low, None)
    for k in "bgr" if last_wins else "rgb":
        out = out.when(channel[k] == top, by[k])
    return out


@dataclass(frozen=True)
class Triple:
    """Three channels of a colour space."""

    a: Column
    b: Column
    c: Column

    def __iter__(self):
        return iter((self.a, self.b, self.c))


def hsv(r: Column, g: Column, b: Column) -> Triple:
    """Hue, saturation and value in [0, 1]."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    turn = hue_sector(r, g, b, last_wins=True) / 6.0
    h = F.coalesce(F.when(turn < 0, turn + 1.0).otherwise(turn), F.lit(0.0))
    s = F.when(top == 0, F.lit(0.0)).otherwise((top - low) / top.cast("double"))
    return Triple(h, s, top / F.lit(255.0))


def hls8(r: Column, g: Column, b: Column) -> Triple:
    """8-bit hue (0..180), lightness and saturation (0..255), rounded half to even."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    both = (top + low).cast("double")
    degrees = hue_sector(r, g, b, last_wins=False) * 60.0
    h = F.coalesce(F.bround(F.when(degrees < 0, degrees + 360.0).otherwise(degrees) / 2.0), F.lit(0.0))
    s = F.when(top == low, F.lit(0.0)).when(both < 255.0, (top - low) * 255.0 / both).otherwise((top - low) * 255.0 / (F.lit(510.0) - both))
    return Triple(h, F.bround(both / 2.0), F.bround(s))


def hls(r: Column, g: Column, b: Column) -> Triple:
    """The 8-bit triple scaled to [0, 1]."""
    h, l, s = hls8(r, g, b)  # noqa: E741
    return Triple(h / 180.0, l / 255.0, s / 255.0)


def linear(c: Column) -> Column:
    u = unit(c)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> Triple:
    """CIELAB with the D65 white of the 2 degree observer."""
    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.95047
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    z = (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)
    return Triple(f(y) * 116.0 - 16.0, (f(x) - f(y)) * 500.0, (f(y) - f(z)) * 200.0)


def gray8(r: Column, g: Column, b: Column) -> Column:
    """Luma in fixed point: 14 fractional bits, rounded."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def delta_e76(p: Triple, q: Triple) -> Column:
    return F.sqrt(sum(((m - n) * (m - n) for m, n in zip(p, q, strict=True)), F.lit(0.0)))


def black_alpha(r: Column, g: Column, b: Column, threshold: int = 0, wrap: bool = False) -> Column:
    """0 where the channels' sum is at most the threshold; `wrap` sums modulo 256."""
    total = r + g + b
    return F.when((total % 256 if wrap else total) <= threshold, 0).otherwise(255)


def converted(r: Column, g: Column, b: Column, space: str) -> Triple | Column:
    """Channels in another space: rgb, bgr, hsv, hls, hls8, cielab, grey or binary."""
    simple = {"rgb": lambda: Triple(r, g, b), "bgr": lambda: Triple(b, g, r), "hsv": lambda: hsv(r, g, b), "hls": lambda: hls(r, g, b), "hls8": lambda: hls8(r, g, b), "cielab": lambda: lab(r, g, b)}
    if space in simple:
        return simple[space]()
    if space in ("grey", "gray"):
        return gray8(r, g, b)
    if space == "binary":
        return F.when(gray8(r, g, b) > 127, 255).otherwise(0)
    raise ValueError(f"unknown colour space: {space}")
