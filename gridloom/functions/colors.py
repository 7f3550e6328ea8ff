"""Colours: contrast as column expressions, palettes and their configuration on the driver."""

from __future__ import annotations

import colorsys
import json
import logging
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)

# The first colours of a palette, in order.
VIVID = (
    (255, 0, 0), (0, 255, 0), (0, 128, 255), (255, 0, 255), (255, 140, 0),
    (0, 255, 255), (255, 255, 0), (180, 0, 255), (255, 20, 147), (0, 255, 127),
    (255, 69, 0), (160, 80, 255), (255, 215, 0), (50, 255, 50), (255, 105, 180),
    (0, 191, 255), (255, 165, 0), (180, 120, 255), (255, 80, 80), (80, 255, 200),
)
# The golden ratio's fraction, and per background the lightness (usual, least, most) and its own colour.
GOLDEN = 0.6180339887498948
BACKGROUNDS = {"dark": (0.8, 0.7, 0.95, (0, 0, 0)), "light": (0.35, 0.15, 0.5, (255, 255, 255))}
LIGHTNESS_STEP, LIGHTNESS_TRIES, HUE_SPREAD, DARKEN = 0.04, 25, 0.08, 0.7

RGB = tuple[int, int, int]


def luminance_column(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 0-255 channels (WCAG 2.1)."""

    def linear(c: Column) -> Column:
        c = c / F.lit(255.0)
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_column(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hex_column(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def rgb_columns(code: Column) -> list[Column]:
    """Channels of a column of "#rrggbb"; null where it is none."""
    ok = code.rlike("^#[0-9A-Fa-f]{6}$")
    return [F.when(ok, F.conv(F.substring(code, i, 2), 16, 10).cast("int")) for i in (2, 4, 6)]


def hsl_columns(h: Column, s: Column, lightness: Column) -> list[Column]:
    """Channels, truncated to 0 .. 255, of hue, saturation and lightness in 0 .. 1."""
    reach = s * F.least(lightness, F.lit(1.0) - lightness)

    def channel(offset: int) -> Column:
        k = (F.lit(float(offset)) + h * 12) % 12
        c = lightness - reach * F.greatest(F.lit(-1.0), F.least(k - 3, F.least(F.lit(9.0) - k, F.lit(1.0))))
        return F.floor(c * 255 + F.lit(1e-9)).cast("int")

    return [channel(0), channel(8), channel(4)]


def luminance(rgb: RGB) -> float:
    lin = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (x / 255 for x in rgb)]
    return sum(w * c for w, c in zip((0.2126, 0.7152, 0.0722), lin, strict=True))


def contrast(a: RGB, b: RGB) -> float:
    low, high = sorted((luminance(a), luminance(b)))
    return (high + 0.05) / (low + 0.05)


def parse_hex(code: str) -> RGB | None:
    code = "#" + code.strip().lstrip("#")
    try:
        return tuple(int(code[i : i + 2], 16) for i in (1, 3, 5)) if len(code) == 7 else None
    except ValueError:
        return None


def _shade(hue: float, lightness: float, saturation: float) -> RGB:
    return tuple(int(c * 255) for c in colorsys.hls_to_rgb(hue, lightness, saturation))


def _spun(index: int, background: str, saturation: float, least_contrast: float, hue_start: float) -> RGB:
    """Colour `index` of the endless series: hues by the golden ratio, lightness in four steps, moved until the contrast is enough."""
    usual, low, high, behind = BACKGROUNDS[background]
    light = min(high, max(low, usual + (index % 4 - 1.5) * HUE_SPREAD))
    hue, strong = (hue_start + index * GOLDEN) % 1.0, min(1.0, saturation * 1.1)
    step = LIGHTNESS_STEP if background == "dark" else -LIGHTNESS_STEP
    color = _shade(hue, light, strong)
    for _ in range(LIGHTNESS_TRIES):
        if contrast(color, behind) >= least_contrast:
            break
        light = min(0.95, max(0.05, light + step))
        color = _shade(hue, light, strong)
    return color


def palette(n: int, alpha: int = 255, background: str = "dark", saturation: float = 0.95, contrast_ratio: float = 4.5, hue_start: float = 0.0, custom: list[str] | None = None) -> list[tuple[int, int, int, int]]:
    """n colours: custom ones first (invalid ones are skipped) or else the vivid ones, then the endless series."""
    if not 0 <= alpha <= 255:
        raise ValueError(f"alpha must be in 0-255: {alpha}")
    if background not in BACKGROUNDS:
        raise ValueError(f"background must be one of {list(BACKGROUNDS)}: {background}")
    if not 0 <= saturation <= 1:
        raise ValueError(f"saturation must be in 0-1: {saturation}")
    if custom:
        parsed = [parse_hex(c) for c in custom]
        if None in parsed:
            LOG.warning("invalid colours are skipped")
        first = [c for c in parsed if c]
    else:
        first = [c if background == "dark" else tuple(int(x * DARKEN) for x in c) for c in VIVID]
    first = first[: max(0, n)]
    rest = [_spun(i, background, saturation, contrast_ratio, hue_start) for i in range(len(first), n)]
    return [(*c, alpha) for c in [*first, *rest]]


def palette_table(spark: SparkSession, colors: list[tuple[int, int, int, int]]) -> DataFrame:
    """idx, r, g, b, a; a lookup table to broadcast."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colors)], "idx int, r int, g int, b int, a int")


def label_colors(label: Column, seed: int = 42) -> list[Column]:
    """Channels by a hash of the label: the same for the same seed, and black for 0."""
    return [F.when(label == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(label.cast("bigint"), F.lit(seed), F.lit(k)), F.lit(256)).cast("int")) for k in range(3)]


@dataclass
class ColorConfig:
    """Settings of a palette; every one of them is honoured."""

    background: str = "dark"
    alpha: int = 255
    saturation: float = 0.95
    contrast_ratio: float = 4.5
    hue_start: float = 0.0
    custom_colors: list[str] | None = None
    custom_rgb_colors: list[tuple[int, int, int]] | None = None
    use_predefined: bool = True
    max_predefined: int = 20
    validate_contrast: bool = True
    fallback_to_algorithmic: bool = True

    def __post_init__(self):
        if self.background not in BACKGROUNDS:
            raise ValueError(f"background must be one of {list(BACKGROUNDS)}: {self.background}")
        for name, low, high in (("alpha", 0, 255), ("saturation", 0, 1), ("hue_start", 0, 1), ("contrast_ratio", 1, 21)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be in {low}-{high}: {getattr(self, name)}")
        if self.custom_rgb_colors and not self.custom_colors:
            self.custom_colors = ["#{:02X}{:02X}{:02X}".format(*c) for c in self.custom_rgb_colors]
        if self.custom_colors:
            self.custom_colors = [("#" + c.strip().lstrip("#")).upper() for c in self.custom_colors]

    def generate(self, n: int) -> list[tuple[int, int, int, int]]:
        least = self.contrast_ratio if self.validate_contrast else 1.0
        own = self.custom_colors
        if not own and not self.use_predefined:
            return [(*_spun(i, self.background, self.saturation, least, self.hue_start), self.alpha) for i in range(n)]
        colors = palette(n, self.alpha, self.background, self.saturation, least, self.hue_start, own)
        first = len([c for c in own if parse_hex(c)]) if own else min(self.max_predefined, len(VIVID))
        if not own and n > first:
            colors[first:] = [(*_spun(i, self.background, self.saturation, least, self.hue_start), self.alpha) for i in range(first, n)]
        if n > first and not self.fallback_to_algorithmic:
            raise ValueError(f"{n} colours are asked for, and there are {first}")
        return colors

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> ColorConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.to_dict(), f, indent=2)

    @classmethod
    def load(cls, path: str) -> ColorConfig:
        """From a JSON file, at the top or under "colors" or "color_config"; any failure gives the defaults."""
        try:
            with open(path) as f:
                values = json.load(f)
            return cls.from_dict(values.get("colors") or values.get("color_config") or values)
        except (OSError, ValueError, TypeError, AttributeError):
            LOG.warning("no usable colour settings in %s", path)
            return cls()
