"""Values mined from product names, as regular expressions over a string column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words in a name and the product form they mean, first match counts (fixed values)
FORM_WORDS = (
    ("rectangular", "Square"), ("rectangle", "Square"), ("square", "Square"), ("round", "Round"), ("rounded", "Rounded"), ("linear", "Linear"), ("cuboid", "Cuboid"),
    ("cylinder", "Cylinder"), ("cylindrical", "Cylinder"), ("cone", "Cone"), ("conical", "Cone"), ("sphere", "Sphere"), ("spherical", "Sphere"), ("areal", "Areal"),
)
#: leaf words too general to tell an application (fixed values)
STOP_WORDS = ("other", "general", "areas", "zones", "lighting", "fields", "facilities", "places", "rooms", "stations", "spaces", "paths", "roads")


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def flux(c: Column) -> Column:
    return _group(c, r"(?i)\b([0-9]{1,7})(?:\.[0-9]+)?\s*lm\b").cast("int").cast("float")


def power(c: Column) -> Column:
    product = r"(?i)\b([0-9]{1,3})\s*x\s*([0-9]{1,4})(?:\.[0-9]+)?\s*W\b"
    single = r"(?i)\b([0-9]{1,4})(?:\.[0-9]+)?\s*W\b"
    return F.when(c.rlike(product), _group(c, product, 1).cast("int") * _group(c, product, 2).cast("int")).otherwise(_group(c, single).cast("int")).cast("float")


def beam(c: Column) -> Column:
    pair = r"\b([0-9]{1,3})x([0-9]{1,3})°"
    a, b = _group(c, pair, 1).cast("int"), _group(c, pair, 2).cast("int")
    return F.when(c.rlike(pair), F.when(F.least(a, b) < 5, F.greatest(a, b)).otherwise(F.least(a, b))).otherwise(_group(c, r"\b([0-9]{1,3})°").cast("int")).cast("float")


def canonical(value: Column, known: Iterable[str]) -> Column:
    return F.when(value.isin(*known), value)


def ip_code(c: Column, known: Iterable[str]) -> Column:
    return canonical(_group(c, r"\b(IP[0-9]{2}K?)\b"), known)


def ik_rating(c: Column, known: Iterable[str]) -> Column:
    return canonical(_group(c, r"\b(IK[0-9]{2}\+?)\b"), known)


_DIN = r"(?:^|\s)([89])([0-9]{2})(?=\s|$|[),;.])"


def cri(c: Column) -> Column:
    return (_group(c, _DIN, 1).cast("int") * 10).cast("smallint")


def cct(c: Column) -> Column:
    """Colour temperature of a three-digit code; if there is no such code, an explicit Kelvin value."""
    tail = _group(c, _DIN, 2).cast("int")
    kelvin = _group(c, r"(?i)\b([0-9]{4,5})\s*K\b").cast("int")
    return F.when(c.rlike(_DIN), F.when(tail.between(15, 100), tail * 100)).otherwise(F.when(kelvin.between(1500, 10000), kelvin))


def cri_checked(c: Column) -> Column:
    """cri of a code whose temperature is in range."""
    return F.when(_group(c, _DIN, 2).cast("int").between(15, 100), cri(c))


def emergency(c: Column) -> Column:
    return c.rlike(r"(?i)\bEM\s*[0-9]+(?:/[0-9]+)?h\b")


def has_word(c: Column, word: str) -> Column:
    """Substring between bytes that are no ASCII letters, digits or underscores."""
    return c.rlike("(?<![A-Za-z0-9_])\\Q" + word + "\\E(?![A-Za-z0-9_])")


def form(c: Column) -> Column:
    low = F.lower(c)
    first, *rest = FORM_WORDS
    out = F.when(has_word(low, first[0]), first[1])
    for word, value in rest:
        out = out.when(has_word(low, word), value)
    return out


def singular(word: str) -> str | None:
    if len(word) < 5 or not word.endswith("s") or word.endswith(("ss", "us", "is", "ous")):
        return None
    return word[:-3] + "y" if word.endswith("ies") else word[:-1]


def taxonomy(path: str) -> tuple[str, str | None, str]:
    """Top, mid and leaf of "Top: Mid: Leaf"; mid only of three segments or more."""
    parts = [p.strip() for p in path.split(":")]
    return parts[0], parts[1] if len(parts) >= 3 else None, parts[-1]


def taxonomy_of(path: Column) -> Column:
    """struct(top, mid, leaf) of a text column, as taxonomy gives it."""
    parts = F.transform(F.split(path, ":"), lambda x: F.trim(x))
    return F.struct(F.get(parts, F.lit(0)).alias("top"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).alias("mid"), F.element_at(parts, -1).alias("leaf"))


def probes(applications: list[str]) -> list[tuple[str, int]]:
    """(text, application id), longest first: phrases and words of the leaves and their singulars; the first id keeps a text."""
    import re

    found: dict[str, int] = {}
    for k, path in enumerate(applications):
        leaf = re.sub(r"\([^)]*\)", " ", taxonomy(path)[2]).replace("/", " ").replace("-", " ").lower()
        words = leaf.split()
        own = [" ".join(words)] if len(words) > 1 and len(leaf.strip()) >= 4 else []
        for w in words:
            if len(w) >= 4 and w not in STOP_WORDS:
                own += [w, *([s] if (s := singular(w)) else [])]
        for text in own:
            found.setdefault(text, k)
    return sorted(found.items(), key=lambda p: -len(p[0]))


def applications(c: Column, table: list[tuple[str, int]]) -> Column:
    """Ids whose probe stands in the name, each once, longest probes first."""
    if not table:
        return F.array().cast("array<smallint>")
    low = F.lower(c)
    return F.array_distinct(F.array_compact(F.array(*[F.when(has_word(low, text), F.lit(k).cast("smallint")) for text, k in table])))


def anchored(table: list[tuple[str, int]]) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, int]]]:
    """(anchor, probe, id, place) of the probes that hold an ASCII word, their first one, and the other probes. A probe stands in a text
    only where its anchor is one of the text's own words."""
    import re

    found = [(re.search("[a-z0-9_]+", text), text, k, place) for place, (text, k) in enumerate(table)]
    return [(m[0], text, k, place) for m, text, k, place in found if m], [(text, k) for m, text, k, _ in found if not m]


def applications_joined(names: DataFrame, key: str, name: str, table: list[tuple[str, int]]) -> DataFrame:
    """(key, applications) of the rows of which any probe stands in the name, as applications gives it, for tables of thousands of probes.

    One pass: the words of each name meet the broadcast probes by their anchors (the table comes from the driver, so it is small),
    candidates are verified exactly, and only matches are shuffled, to be put together by key. Keys must be unique.
    """
    spark = names.sparkSession
    anchors, rest = anchored(table)
    if not anchors:
        found = names.select(key, applications(F.col(name), table).alias("applications"))
        return found.where(F.size("applications") > 0)
    probes_ = F.broadcast(spark.createDataFrame(anchors, "__anchor string, __text string, __id smallint, __place int"))
    low = names.select(F.col(key), F.lower(name).alias("__low"))
    words = low.select("*", F.explode(F.array_distinct(F.regexp_extract_all("__low", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))).alias("__anchor"))
    bounded = F.expr(r"__low rlike concat('(?<![A-Za-z0-9_])\\Q', __text, '\\E(?![A-Za-z0-9_])')")
    hits = words.join(probes_, "__anchor").where(F.contains("__low", "__text") & bounded).select(key, "__place", "__id")
    if rest:
        own = {text: place for place, (text, _) in enumerate(table)}
        for text, k in rest:
            hits = hits.unionByName(low.where(has_word(F.col("__low"), text)).select(key, F.lit(own[text]).alias("__place"), F.lit(k).cast("smallint").alias("__id")))
    ordered = F.array_sort(F.collect_list(F.struct("__place", "__id")))
    return hits.groupBy(key).agg(F.array_distinct(F.transform(ordered, lambda x: x["__id"])).alias("applications"))


def values(c: Column, ip_known: Iterable[str], ik_known: Iterable[str]) -> dict[str, Column]:
    """Every mined value of a name."""
    return {"flux_lm": flux(c), "power_w": power(c), "beam_deg": beam(c), "ip_code": ip_code(c, ip_known), "ik_rating": ik_rating(c, ik_known), "cri_ra": cri_checked(c), "cct_k": cct(c), "emergency": emergency(c), "form": form(c)}


def keywords(c: Column, ip_known: Iterable[str], ik_known: Iterable[str]) -> Column:
    """Every mined value as a keyword."""
    return keywords_of(values(c, ip_known, ik_known))


def keywords_of(v) -> Column:
    """Values (by their names, in a dict or a struct) as keywords."""
    whole = lambda x: x.cast("int").cast("string")
    return F.array_compact(
        F.array(
            F.concat(whole(v["flux_lm"]), F.lit("lm")),
            F.concat(whole(v["power_w"]), F.lit("W")),
            F.concat(whole(v["beam_deg"]), F.lit("°")),
            v["ip_code"],
            v["ik_rating"],
            F.concat(F.lit("CRI"), v["cri_ra"].cast("string")),
            F.concat(v["cct_k"].cast("string"), F.lit("K")),
            F.when(v["emergency"], F.lit("emergency")),
            v["form"],
        )
    )
