"""URL filter: fixed rules first, then a tree of path templates per host, learnt from labelled pages.

Level by level the next path segment of each page becomes part of its template. A segment that holds a fair share of its
branch stays as it is, the others are variable and become a wildcard ({#} for numbers, with or without an extension,
{*} for the rest). Kept segments of one branch that agree statistically in what follows and in their labels are merged. A template's purity
is the share of good labels below it, smoothed by that of its parent branch, up to the host and all hosts; templates of
too low a purity are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

NUMBER = r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"
#: rows and share of its branch that a segment needs to stay; rest: what is compared of two branches
FEWEST, SHARE = 5, 0.02
FIGURES = ("ends", "numbered", "good")
#: beyond the levels of the tree a template ends in /**
DEPTH = 6
#: weight of the parent branch in pages, least purity of a template that is kept
WEIGHT, PURE = 10.0, 0.5
#: differences that chance may make (in standard errors) or that do not matter
CHANCE, MINOR = 2.6, 0.05


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first "://", up to "/", "?" or "#", with A to Z in lower case, and from there up
    to "?" or "#". Both are empty for null and for a text without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. rules are (verdict, host/path): a policy of
    some hundred lines at most. A rule fits its host and all subdomains, and paths that start with its own; of equally long
    ones the first counts."""
    cases = []
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + below)
        cases.append(F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    found = F.coalesce(*cases, F.lit(None).cast("struct<rule:string,verdict:string>"))
    return found["rule"], found["verdict"]


def _agree(a: Sequence[float], b: Sequence[float]) -> bool:
    """Two branches (n, ends, numbered, good, labelled): every share is equal up to chance or a minor difference."""
    for k, n, m in ((1, a[0], b[0]), (2, a[0], b[0]), (3, a[4], b[4])):
        if not n or not m:
            continue
        p, q, both = a[k] / n, b[k] / m, (a[k] + b[k]) / (n + m)
        if abs(p - q) > MINOR and abs(p - q) > CHANCE * (both * (1 - both) * (1 / n + 1 / m)) ** 0.5:
            return False
    return True


def merged(children: list[tuple]) -> dict[str, str]:
    """Names of a branch's kept segments (segment, n, ends, numbered, good, labelled; 1 / SHARE of them at most): the largest first, each
    joins the first group that agrees with it as a whole. A group's name lists its segments."""
    groups: list[tuple[list[str], list[float]]] = []
    for segment, *figures in sorted(children, key=lambda c: (-c[1], c[0])):
        for names, sums in groups:
            if _agree(sums, figures):
                names.append(segment)
                sums[:] = [x + y for x, y in zip(sums, figures)]
                break
        else:
            groups.append(([segment], [float(x) for x in figures]))
    return {s: names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}" for names, _ in groups for s in names}


def _names(frames):
    for f in frames:
        rows = [(host, template, s, to) for host, template, children in zip(f["host"], f["template"], f["children"]) for s, to in merged([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in children]).items()]
        yield pd.DataFrame(rows, columns=["host", "template", "segment", "named"])


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """urls (host, path, good and any other columns) with the template of each row.

    One pass a level over all rows; segments are counted with partial sums before the shuffle, and what a branch keeps is
    1 / SHARE segments at most. Joins back are by host, template and segment, where Spark splits what is skewed.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = shared.written(urls.withColumn("parts", parts).withColumn("template", F.lit("")))
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    branch = ["host", "template"]
    for k in range(min(deepest, depth)):
        rows = rows.withColumn("segment", F.get("parts", F.lit(k)))
        after = F.get("parts", F.lit(k + 1))
        seen = rows.where("segment is not null").groupBy(*branch, "segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(after.isNull()).alias("ends"), F.count_if(after.rlike(NUMBER)).alias("numbered"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.count("good").alias("labelled"))
        seen = shared.written(seen)
        total = seen.groupBy(*branch).agg(F.sum("n").alias("total"))
        kept = seen.where(F.col("n") >= FEWEST).join(total, branch).where(F.col("n") >= SHARE * F.col("total"))
        children = kept.groupBy(*branch).agg(F.collect_list(F.struct("segment", "n", *FIGURES, "labelled")).alias("children"))
        named = shared.written(children.mapInPandas(_names, "host string, template string, segment string, named string"))
        wild = F.when(F.col("segment").rlike(NUMBER), "{#}").otherwise("{*}")
        step = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("named", wild)))
        rows = shared.written(rows.join(named, [*branch, "segment"], "left").withColumn("template", step).drop("segment", "named"))
    return rows.withColumn("template", F.when(F.size("parts") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("parts")


def purities(rows: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(host, template, purity) of every template: good shares smoothed from all pages over the host down the tree."""
    leaves = rows.groupBy("host", "template").agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"), F.count("good").cast("double").alias("labelled"))
    leaves = shared.written(leaves)
    steps = F.split("template", "/")
    above = leaves.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(steps, 1, k), "/").alias("prefix")))).alias("up"))
    sums = above.groupBy("host", F.col("up.prefix").alias("prefix")).agg(F.sum("good").alias("g"), F.sum("labelled").alias("m"))
    line = above.select("host", "template", F.col("up.level").alias("level"), F.col("up.prefix").alias("prefix")).join(sums, ["host", "prefix"])
    line = line.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "g", "m"))).alias("line"))
    every = leaves.agg(F.sum("good").alias("g"), F.sum("labelled").alias("m")).first()
    base = ((every.g or 0.0) + 1.0) / ((every.m or 0.0) + 1.0)  # without labels every template is pure
    purity = F.aggregate("line", F.lit(float(base)), lambda p, s: (s["g"] + weight * p) / (s["m"] + weight))
    return line.select("host", "template", purity.alias("purity"))


@shared.call
def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, weight: float = WEIGHT, pure: float = PURE) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row a page, allow or block.

    labels has id_col and good (1 or 0); of a page's labels the worst counts, nulls are none. Where a rule fits it decides,
    elsewhere the purity of the page's template. Without labels nothing but rules blocks. Null urls and those without a host are one
    branch of their own; equal rows are judged alike, rows without an id have no labels; longer paths than depth segments
    share the template of their beginning; empty tables give none. Further columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is None:
        rows = rows.withColumn("good", F.lit(None).cast("int"))
    else:
        known = labels.select(F.col(id_col).alias("page_id"), F.col("good").cast("int").alias("good")).where("page_id is not null and good is not null")
        rows = rows.join(known.groupBy("page_id").agg(F.min("good").alias("good")), "page_id", "left")
    rows = shared.written(templates(rows, depth))
    rows = rows.join(purities(rows, weight), ["host", "template"], "left")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < pure, "block").otherwise("allow")
    return shared.lasting(rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity"))
