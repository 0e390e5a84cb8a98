"""Photometric clean-up and classification, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: light distributions in the order of their ids (fixed values)
LIGHT_DISTRIBUTIONS = (
    "Laterally symmetrical narrow", "Laterally symmetrical medium", "Laterally symmetrical wide", "Symmetrical in each quadrant", "Symmetric about 0-180 plane", "Symmetric about 90-270 plane", "Asymmetrical", "Asymmetrical flood",
    "Asymmetrical wide flood", "Diffuse half spherical", "Diffuse full spherical", "Direct", "Indirect", "Direct indirect", "Other",
)
#: safety classes in the order of their ids (fixed values)
SAFETY_CLASSES = ("0", "I", "0I", "II", "III")
MAX_FLUX, MAX_POWER, MAX_ANGLE, MAX_EFFICACY, MAX_DEPTH = 1e6, 1e4, 360.0, 300.0, 1000


def capped(x: Column, cap: float) -> Column:
    """x if it is finite, not negative and not above the cap."""
    return F.when(~F.isnan(x) & (x >= F.lit(0.0)) & (x <= F.lit(cap)), x)


def efficacy(flux: Column, power: Column) -> Column:
    return F.when(power > 0, flux / power)


def sanitized(p: Column) -> Column:
    """A photometry struct with impossible figures nulled and efficacy made anew."""

    def clean(p: Column) -> Column:
        flux, power = capped(p["flux_lm"], MAX_FLUX), capped(p["power_w"], MAX_POWER)
        made = F.when(flux.isNotNull() & (power > 0), (flux / power).cast("float")).otherwise(p["efficacy_lm_w"])
        out = p.withField("flux_lm", flux).withField("power_w", power).withField("efficacy_lm_w", capped(made, MAX_EFFICACY))
        out = out.withField("beam_deg", capped(p["beam_deg"], MAX_ANGLE)).withField("field_deg", capped(p["field_deg"], MAX_ANGLE))
        return F.when(p.isNotNull(), out)

    return once(p, clean)


def sane_depth(x: Column) -> Column:
    return F.when(x <= MAX_DEPTH, x)


def symmetry_of(distribution: Column) -> Column:
    d = distribution
    return F.when(d.between(0, 3), "Rotational").when(d.between(4, 5), "Axial").when(d.between(6, 8), "Asymmetric").when(d.between(9, 10), "Diffuse").when(d.between(11, 13), "Rotational").otherwise("Unknown")


def classify(lor: Column, dlor: Column, ulor: Column, beam: Column, symmetry: Column) -> Column:
    """Light distribution from output ratios in percent, the beam angle and the file's symmetry (rotational, c0_c180, c90_c270, both, none)."""
    name = dict(enumerate(LIGHT_DISTRIBUTIONS))
    finite = ~F.isnan(beam) & (F.abs(beam) < float("inf"))
    lateral = F.when(~finite | (beam <= 0) | beam.isNull(), name[1]).when(beam <= 30, name[0]).when(beam <= 60, name[1]).otherwise(name[2])
    planes = F.when(symmetry == "rotational", lateral).when(symmetry == "c0_c180", name[4]).when(symmetry == "c90_c270", name[5]).when(symmetry == "both", name[3])
    free = F.when((dlor >= 90) & (ulor <= 5) & finite & (beam <= 30), name[11]).otherwise(name[6])
    full = F.when((F.abs(dlor - ulor) <= 20) & finite & (beam >= 150), name[10]).otherwise(name[13])
    half = (dlor >= 80) & finite & (beam >= 120)
    return F.when(lor >= 5, F.when(ulor >= 80, name[12]).when((dlor >= 20) & (ulor >= 20), full).when(dlor < 50, name[14]).when(half, name[9]).otherwise(F.coalesce(planes, free)))


def din_code(c: Column) -> Column:
    """struct(cct, cri) of the first three-digit run from 8 or 9 with a tail of 15 or more."""
    runs = F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    good = F.filter(runs, lambda r: (F.length(r) == 3) & F.substring(r, 1, 1).isin("8", "9") & F.substring(r, 2, 2).cast("int").between(15, 99))
    first = F.try_element_at(good, F.lit(1))
    return F.when(first.isNotNull(), F.struct((F.substring(first, 2, 2).cast("int") * 100).alias("cct"), (F.substring(first, 1, 1).cast("int") * 10).alias("cri")))


def kelvin(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    good = F.filter(runs, lambda r: (F.length(r) == 4) & r.try_cast("int").between(1500, 9999))
    return F.try_element_at(good, F.lit(1)).cast("int")


def rendering(c: Column) -> Column:
    """The number right after the first "ra", from 50 to 100."""
    tail = F.regexp_extract(c, r"(?i)^(?:(?!ra).)*ra([0-9]*)", 1).try_cast("int")
    return F.when(tail.between(50, 100), tail)


def colour(appearance: Column, render: Column) -> Column:
    """struct(cct, cri): a DIN code in either text wins, else the plain figures."""
    din = F.coalesce(din_code(appearance), din_code(render))
    plain = F.struct(F.coalesce(kelvin(appearance), kelvin(render)).alias("cct"), F.coalesce(rendering(render), rendering(appearance)).alias("cri"))
    return F.coalesce(din, plain)


#: polar profiles of the distributions in their order (fixed values): for the planes C0 and C90 lobes of (height, centre, width) in degrees,
#: width 0 being constant, and the range of angles outside which they are 0
GLYPHS = (
    (((1.0, 0.0, 12.0),), ((1.0, 0.0, 12.0),), (0, 180)),
    (((1.0, 0.0, 25.0),), ((1.0, 0.0, 25.0),), (0, 180)),
    (((1.0, 0.0, 45.0),), ((1.0, 0.0, 45.0),), (0, 180)),
    (((1.0, 0.0, 25.0),), ((1.0, 0.0, 30.0),), (0, 180)),
    (((1.0, 0.0, 18.0),), ((1.0, 0.0, 40.0),), (0, 180)),
    (((1.0, 0.0, 40.0),), ((1.0, 0.0, 18.0),), (0, 180)),
    (((1.0, 25.0, 22.0),), ((1.0, 10.0, 28.0),), (0, 180)),
    (((1.0, 35.0, 30.0),), ((1.0, 15.0, 35.0),), (0, 180)),
    (((1.0, 55.0, 38.0),), ((1.0, 25.0, 42.0),), (0, 180)),
    (((1.0, 0.0, 0.0),), ((1.0, 0.0, 0.0),), (0, 90)),
    (((1.0, 0.0, 0.0),), ((1.0, 0.0, 0.0),), (0, 180)),
    (((1.0, 0.0, 28.0),), ((1.0, 0.0, 28.0),), (0, 90)),
    (((1.0, 180.0, 28.0),), ((1.0, 180.0, 28.0),), (90, 180)),
    (((1.0, 0.0, 25.0), (0.6, 180.0, 25.0)), ((1.0, 0.0, 25.0), (0.6, 180.0, 25.0)), (0, 180)),
    (((0.7, 0.0, 0.0),), ((0.7, 0.0, 0.0),), (0, 180)),
)


def _lobe(gamma: Column, lobe: Column) -> Column:
    z = (gamma - lobe["centre"]) / F.nullif(lobe["width"], F.lit(0.0))
    return lobe["height"] * F.coalesce(F.exp(-0.5 * z * z), F.lit(1.0))


def _profile(shape: Column, plane: str) -> Column:
    """Intensities from 0 (down) to 180 degrees, every 5."""

    def at(gamma: Column) -> Column:
        inside = gamma.between(shape["low"], shape["high"])
        return F.when(inside, F.array_max(F.transform(shape[plane], lambda lobe: _lobe(gamma, lobe)))).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(180), F.lit(5)), at)


def glyph(distribution: Column) -> Column:
    """struct(c0, c90, both) of a distribution id: radii of its polar curves, 37 samples each, scaled so that the largest of
    both is 1, and whether the second curve differs enough to be drawn. Null for ids out of the table."""
    lobes = lambda part: F.array(*[F.struct(F.lit(h).alias("height"), F.lit(c).alias("centre"), F.lit(w).alias("width")) for h, c, w in part])
    table = F.array(*[F.struct(lobes(a).alias("c0"), lobes(b).alias("c90"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for a, b, (lo, hi) in GLYPHS])
    shape = F.get(table, distribution.cast("int"))
    c0, c90 = _profile(shape, "c0"), _profile(shape, "c90")
    top0, top90 = F.array_max(c0), F.array_max(c90)
    top = F.greatest(top0, top90, F.lit(1e-6))
    apart = lambda a, b: F.abs(a - b) / F.greatest(a, F.lit(1e-6))
    both = (apart(top0, top90) > 0.05) | (apart(F.get(c0, F.lit(18)), F.get(c90, F.lit(18))) > 0.1) | (apart(F.get(c0, F.lit(27)), F.get(c90, F.lit(27))) > 0.1) | (apart(F.get(c0, F.lit(36)), F.get(c90, F.lit(36))) > 0.1)
    scaled = lambda curve: F.transform(curve, lambda x: x / top)
    return F.when(shape.isNotNull(), F.struct(scaled(c0).alias("c0"), scaled(c90).alias("c90"), both.alias("both")))


def glyph_path(curve: Column, size: float = 64.0, pad: float = 4.0) -> Column:
    """The closed curve of scaled radii as the path of a drawing of that size: down the right side, up the mirrored left one."""
    middle, radius = size / 2, size / 2 - pad

    def point(r: Column, k: Column, side: int) -> Column:
        angle = F.radians(90 - 5 * k)
        return F.format_string("%.2f %.2f", middle + side * r * F.cos(angle) * radius, middle + r * F.sin(angle) * radius)

    right = F.transform(curve, lambda r, k: point(r, k, 1))
    left = F.reverse(F.transform(curve, lambda r, k: point(r, k, -1)))
    return F.concat(F.lit("M"), F.array_join(F.concat(right, left), " L"), F.lit(" Z"))
