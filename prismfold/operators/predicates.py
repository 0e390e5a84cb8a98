"""A Spec as Spark columns: document scope, variant scope, and both."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_contains
from ..plans.spec import Field, Registry, Spec


def at(base: Column | None, path: str) -> Column:
    """A dotted path from a struct column, or from the row."""
    if base is None:
        return F.col(path)
    return reduce(lambda c, name: c[name], path.split("."), base)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bare_predicate(field: Field, value, base: Column | None) -> Column:
    """A field's condition on a document row or a variant; null where the value is. To filter by: a null does there
    what false does, and file readers can use the plain comparison."""
    x = at(base, field.path)
    if field.kind == "single":
        return x.isin(*value)
    if field.kind == "multi":
        return F.exists(x, lambda e: e.isin(*value))
    if field.kind == "min":
        return x >= F.lit(value).cast(field.type)
    low, high = (F.lit(v).cast(field.type) for v in value)
    inside = (x >= low) & (x <= high)
    if field.type in ("float", "double"):
        inside &= ~F.isnan(x)
    if field.gate:
        inside &= at(base, field.gate[0]) == F.lit(field.gate[1])
    return inside


def predicate(field: Field, value, base: Column | None) -> Column:
    """The same for masks; never null."""
    return _sure(bare_predicate(field, value, base))


def _flag(registry: Registry, field: Field, want: bool) -> Column:
    """Some variant has the flag as wanted; not correlated with variant conditions."""

    def holds(v: Column) -> Column:
        x = at(v, field.path)
        return (x.isNotNull() if field.present else _sure(x)) == F.lit(want)

    return _sure(F.exists(registry.variants, holds))


def text_predicate(needle: str, locale: str | None) -> Column:
    found = F.exists("descriptions", lambda d: folded_contains(d["text"], needle) & (F.lit(True) if locale is None else d["locale"] == locale))
    return _sure(found) | _sure(folded_contains(F.col("manufacturer"), needle)) | _sure(folded_contains(F.col("product"), needle)) | _sure(F.exists("keywords", lambda k: folded_contains(k, needle)))


def _doc_conditions(spec: Spec, registry: Registry, one) -> list[Column]:
    """Conditions on the document, cheap ones first, text last."""
    fields = [f for f in registry.fields if f.scope == "doc" and spec.get(f.name) is not None]
    plain = [one(f, spec.get(f.name), None) for f in fields if f.kind not in ("flag", "text")]
    flags = [_flag(registry, f, spec.get(f.name)) for f in fields if f.kind == "flag"]
    text = [text_predicate(spec.get(f.name), spec.get("locale")) for f in fields if f.kind == "text"]
    return [*plain, *flags, *text]


def doc_scope(spec: Spec, registry: Registry) -> Column:
    """All document conditions as a mask."""
    return _all(_doc_conditions(spec, registry, predicate))


def variant_scope(spec: Spec, registry: Registry) -> Callable[[Column], Column]:
    """All variant conditions, to hold on the same variant."""
    fields = [f for f in registry.fields if f.scope == "variant" and spec.get(f.name) is not None]
    return lambda v: _all([predicate(f, spec.get(f.name), v) for f in fields])


def document_matches(spec: Spec, registry: Registry) -> Column:
    match = doc_scope(spec, registry)
    if spec.has_variant_predicate(registry):
        match &= _sure(F.exists(registry.variants, variant_scope(spec, registry)))
    return match


def in_scope(docs: DataFrame, spec: Spec, registry: Registry) -> DataFrame:
    """The documents that meet all document conditions, each a filter of its own that can reach the scan."""
    return reduce(DataFrame.where, _doc_conditions(spec, registry, bare_predicate), docs)


def matching(docs: DataFrame, spec: Spec, registry: Registry) -> DataFrame:
    """The documents that match as a whole: in scope, and some variant meets all variant conditions."""
    docs = in_scope(docs, spec, registry)
    return docs.where(F.exists(registry.variants, variant_scope(spec, registry))) if spec.has_variant_predicate(registry) else docs
