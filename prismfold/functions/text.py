"""String functions, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: legal forms that end a company's name (fixed values)
LEGAL_SUFFIXES = (
    "s.a.", "s.a", "sa", "gmbh", "g.m.b.h.", "ag", "a.g.", "ltd", "ltd.", "limited", "inc", "inc.", "incorporated", "llc", "l.l.c.", "co", "co.", "company", "kg", "k.g.",
    "ohg", "o.h.g.", "se", "plc", "n.v.", "nv", "b.v.", "bv", "s.r.l.", "srl", "s.p.a.", "spa", "s.l.", "sl", "s.l.u.", "slu", "oy", "ab", "as", "a.s.",
)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once however often f uses it. Inside lambdas of higher-order functions Spark neither shares common
    expressions nor splits them off, so that expressions built on each other grow, and cost, as the product of their uses."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ascii_folded(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def folded_contains(haystack: Column, needle: str) -> Column:
    """Substring test: the needle in full lower case, the haystack folded in ASCII only. One pass over the text: (?i) without (?u)
    folds A-Z alone, and no folded copy of a long text is made."""
    quoted = needle.lower().replace("\\E", "\\E\\\\E\\Q")
    return haystack.rlike(f"(?i)\\Q{quoted}\\E")


def article_key(c: Column) -> Column:
    """Letters and digits of an identifier, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def slug(c: Column) -> Column:
    """ASCII lower case, - and _ as spaces, single spaces, no ends."""
    return F.trim(F.regexp_replace(F.translate(c, UPPER + "-_", LOWER + "  "), " +", " "))


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def hex_id(c: Column) -> Column:
    """A 64-digit hexadecimal id in lower case, else null."""
    return F.when(c.rlike("^[0-9a-fA-F]{64}$"), F.lower(c))


def manufacturer_key(c: Column) -> Column:
    """Comparable company name: words of letters and digits, trailing legal forms dropped (a name of nothing else is empty), runs of single letters joined."""
    forms = sorted({" ".join(s.replace(".", " ").split()) for s in LEGAL_SUFFIXES}, key=lambda s: (-len(s), s))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.translate(c, UPPER, LOWER), r"[^\p{L}\p{N}]", " "), " +", " "))
    bare = F.regexp_replace(words, f"(?:(?:^| )(?:{'|'.join(forms)}))+$", "")
    return F.regexp_replace(bare, "(?<=(?:^| )[^ ]) (?=[^ ](?: |$))", "")


def snippet(c: Column, limit: int = 200) -> tuple[Column, Column]:
    """The first characters with an ellipsis, and whether any were cut."""
    cut = F.char_length(c) > limit
    return F.when(cut, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c), F.coalesce(cut, F.lit(False))


def described(descriptions: Column, limit: int = 200) -> tuple[Column, Column]:
    """The snippet of an array of (locale, text): of the English text, else of the first."""
    english = F.try_element_at(F.filter(descriptions, lambda d: F.lower(d["locale"]) == "en"), F.lit(1))
    return snippet(F.coalesce(english, F.try_element_at(descriptions, F.lit(1)))["text"], limit)


def percent_path(c: Column) -> Column:
    """Percent-encoding of a path that keeps its slashes."""
    return F.array_join(F.transform(F.split(c, "/"), lambda s: F.regexp_replace(F.regexp_replace(F.url_encode(s), r"\+", "%20"), "%7E", "~")), "/")


def viewer_link(base: str, origin: Column, path: Column) -> Column:
    """Link with the encoded file address as a parameter: the inner path keeps its slashes, the whole is encoded once more."""
    inner = F.concat(origin, F.lit("/"), percent_path(path))
    return F.concat(F.lit(base), F.regexp_replace(F.url_encode(inner), r"\+", "%20"))
