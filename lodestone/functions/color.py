"""Colour values of the shape ``Name_#hex`` and their grouping into twelve families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and swatch of each family.
FAMILIES = {
    "schwarz": ("Schwarz", "#000000"),
    "weiss": ("Weiß", "#FFFFFF"),
    "grau": ("Grau", "#9E9E9E"),
    "beige": ("Beige", "#E8CFAF"),
    "braun": ("Braun", "#8B5A2B"),
    "rot": ("Rot", "#D32F2F"),
    "rosa": ("Rosa", "#E91E63"),
    "orange": ("Orange", "#FB8C00"),
    "gelb": ("Gelb", "#FDD835"),
    "gruen": ("Grün", "#43A047"),
    "blau": ("Blau", "#1E88E5"),
    "lila": ("Lila", "#8E24AA"),
}
SHAPE = r"^(.*)_(#[0-9A-Fa-f]{3,8})$"


def let(value: Column, then) -> Column:
    """then(value) with the value computed once: a tree that names it often would grow with each name."""
    return F.element_at(F.transform(F.array(value), then), 1)


def parse(value: Column) -> Column:
    """Struct of name and hex; without a code the whole value is the name and hex is null."""
    fits = value.rlike(SHAPE)
    return F.struct(F.when(fits, F.regexp_extract(value, SHAPE, 1)).otherwise(value).alias("name"), F.when(fits, F.regexp_extract(value, SHAPE, 2)).alias("hex"))


def channels(code: Column) -> Column:
    """Struct r, g, b in 0..1 with nulls where the code can't be read."""
    bare = F.regexp_replace(code, "^#", "")
    full = F.when(bare.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(bare, "(.)", "$1$1")).when(bare.rlike("^[0-9A-Fa-f]{6}"), F.substring(bare, 1, 6))
    return let(full, lambda x: F.struct(*((F.conv(F.substring(x, at, 2), 16, 10).cast("double") / 255).alias(c) for c, at in (("r", 1), ("g", 3), ("b", 5)))))


def hsl(rgb: Column) -> Column:
    """Struct of chroma, lightness, saturation and hue (0 to 360)."""
    r, g, b = rgb["r"], rgb["g"], rgb["b"]
    ends = F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("top"), F.least(r, g, b).alias("low"))
    return let(ends, _hsl)


def _hsl(ends: Column) -> Column:
    r, g, b, top, low = (ends[c] for c in ("r", "g", "b", "top", "low"))
    chroma, light = top - low, (top + low) / 2
    spread = 1 - F.abs(2 * light - 1)
    saturation = F.when((chroma == 0) | (spread == 0), 0.0).otherwise(chroma / spread)
    sector = F.when(chroma == 0, 0.0).when(top == r, ((g - b) / chroma) % 6).when(top == g, (b - r) / chroma + 2).otherwise((r - g) / chroma + 4)
    return let(sector * 60, lambda hue: F.struct(chroma.alias("c"), light.alias("l"), saturation.alias("s"), F.when(hue < 0, hue + 360).otherwise(hue).alias("h")))


def classify(code: Column) -> Column:
    """Family of a colour code, null where it can't be read; the first rule that holds decides."""
    return let(channels(code), lambda rgb: F.when(rgb["r"].isNotNull(), let(hsl(rgb), _classify)))


def _classify(x: Column) -> Column:
    c, light, s, h = x["c"], x["l"], x["s"], x["h"]
    red = (h < 15) | (h >= 330)
    return (
        F.when(light <= 0.16, "schwarz")
        .when((light >= 0.93) & (c <= 0.10), "weiss")
        .when(c <= 0.10, "grau")
        .when((light >= 0.90) & (c <= 0.22), "beige")
        .when(red & (s <= 0.35) & (light >= 0.55), "beige")
        .when(red & (light >= 0.80) & (s <= 0.90), F.when(h < 15, "beige").otherwise("rosa"))
        .when(h >= 330, F.when((s >= 0.60) & (light <= 0.55), "rot").otherwise("rosa"))
        .when(h < 15, "rot")
        .when(h < 45, F.when(light >= 0.75, "beige").when((s >= 0.75) & (light >= 0.45), "orange").otherwise("braun"))
        .when(h < 70, F.when((light >= 0.85) & (s <= 0.60), "beige").otherwise("gelb"))
        .when(h < 165, "gruen")
        .when(h < 255, "blau")
        .when(h < 290, "lila")
        .otherwise(F.when(light <= 0.35, "lila").otherwise("rosa"))
    )


def group(value: Column) -> Column:
    """``Label_#hex`` of the value's family, or null."""
    names = F.create_map(*(F.lit(x) for slug, (label, swatch) in FAMILIES.items() for x in (slug, f"{label}_{swatch}")))
    return let(classify(parse(value)["hex"]), lambda family: F.when(family.isNotNull(), F.element_at(names, family)))


MODES = ("default", "color", "groupedcolortile")


def display_mode(name: str | None) -> str:
    """An unknown mode is the default."""
    return name if name in MODES else MODES[0]


def is_color(mode: str) -> bool:
    return display_mode(mode) != MODES[0]


def is_grouped(mode: str) -> bool:
    return display_mode(mode) == "groupedcolortile"
