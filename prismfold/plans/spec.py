"""The query: a filter over named fields, its URL and JSON codecs, and its algebra. No Spark job runs here."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any
from urllib.parse import parse_qsl, quote, urlencode


@dataclass(frozen=True)
class Field:
    """One filterable axis.

    kind: single (nullable id in list), multi (array overlap), range, integer_range, min, flag (some variant has
    flag == wanted), text. scope: doc or variant. path: column, or path inside a variant. gate: (path,
    value) that must hold as well. key: short name in URLs. numeric: list items are integers.
    """

    name: str
    kind: str
    scope: str
    path: str
    key: str = ""
    gate: tuple[str, Any] | None = None
    present: bool = False
    numeric: bool = False
    type: str = "double"


@dataclass(frozen=True)
class Facet:
    """One counted axis: values come from a doc column (single or array) or from all variants of a doc."""

    name: str
    relaxes: str
    path: str
    source: str  # doc, doc_array, variant, variant_array, presence, subtype
    flag: str = ""


@dataclass(frozen=True)
class Registry:
    fields: tuple[Field, ...]
    facets: tuple[Facet, ...]
    doc_id: str = "doc_id"
    variants: str = "variants"
    order: tuple[str, ...] = ("doc_id",)

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def facet(self, name: str) -> Facet:
        return next(f for f in self.facets if f.name == name)

    def by_key(self, key: str) -> Field | None:
        return next((f for f in self.fields if f.key == key), None)


@dataclass(frozen=True)
class Spec:
    """Set fields with their values: or within a field, and across fields; empty lists and texts are unset."""

    items: tuple[tuple[str, Any], ...] = ()

    @staticmethod
    def of(**values: Any) -> Spec:
        return Spec().replace(**values)

    def replace(self, **values: Any) -> Spec:
        now = dict(self.items)
        for name, value in values.items():
            value = tuple(value) if isinstance(value, (list, tuple, set)) else value
            if value is None or value == () or value == "":
                now.pop(name, None)
            else:
                now[name] = value
        return Spec(tuple(sorted(now.items())))

    def get(self, name: str) -> Any:
        return dict(self.items).get(name)

    def without(self, *names: str) -> Spec:
        return Spec(tuple((k, v) for k, v in self.items if k not in names))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(k for k, _ in self.items)

    def has_variant_predicate(self, registry: Registry) -> bool:
        return any(registry.field(n).scope == "variant" for n in self.names if n != "locale")

    def is_text_only(self) -> bool:
        return "text" in self.names and set(self.names) <= {"text", "locale"}

    def scoped(self, field: str, canonical: str | None) -> Spec:
        """Tenant lock: the field is overwritten by the tenant's canonical name."""
        return self if canonical is None else self.replace(**{field: (canonical,)})

    def toggled(self, field: str, value: Any) -> Spec:
        """A facet click: the value enters the field's list, or leaves it."""
        now = tuple(self.get(field) or ())
        return self.replace(**{field: tuple(v for v in now if v != value) if value in now else (*now, value)})

    def toggled_emergency(self, value: str, unspecified: str = "(unspecified)") -> Spec:
        """Subtype click; the unspecified value asks for the flag instead and clears subtypes."""
        if value == unspecified:
            return self.replace(emergency_type=None, has_emergency=None if self.get("has_emergency") else True)
        return self.toggled("emergency_type", value)

    def applied(self, field: str, value: Any) -> Spec:
        """A suggestion taken: manufacturers toggle, other values are added; the text is cleared."""
        if field == "manufacturer":
            return self.toggled(field, value).replace(text=None)
        now = tuple(self.get(field) or ())
        return self.replace(text=None, **{field: now if value in now else (*now, value)})

    def chips(self) -> list[tuple[str, Any]]:
        """Active filters, one entry for each list item."""
        out: list[tuple[str, Any]] = []
        for name, value in self.items:
            spread = isinstance(value, tuple) and not (len(value) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value) and name in RANGES)
            out += [(name, v) for v in value] if spread else [(name, value)]
        return out

    def without_chip(self, name: str, value: Any) -> Spec:
        now = self.get(name)
        if isinstance(now, tuple) and name not in RANGES:
            return self.replace(**{name: tuple(v for v in now if v != value)})
        return self.without(name)


RANGES = frozenset(("flux", "power", "efficacy", "cct", "beam", "recessed_depth"))


def slider(low: float, high: float, rails: tuple[float, float], moved: str) -> tuple[float, float] | None:
    """A range slider's handles clamped to each other; at both rails the filter is cleared."""
    if moved == "low":
        low = min(low, high)
    else:
        high = max(low, high)
    return None if low <= rails[0] and high >= rails[1] else (low, high)


def one_sided(low, high, integer_max: int | None = None):
    """Open ends: infinities for floats, 0 and the type's maximum for integers."""
    if low is None and high is None:
        return None
    if integer_max is None:
        return (-math.inf if low is None else low, math.inf if high is None else high)
    return (0 if low is None else low, integer_max if high is None else high)


def number(x: float) -> str:
    """An integer where x is within 1e-3 of one, else the shortest decimal."""
    return str(round(x)) if math.isfinite(x) and abs(x - round(x)) < 1e-3 else repr(float(x))


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def to_query_pairs(spec: Spec, registry: Registry) -> list[tuple[str, str]]:
    """Short keys in the registry's order; unset fields are left out."""
    out = []
    for f in registry.fields:
        v = spec.get(f.name)
        if v is None:
            continue
        if f.kind in ("range", "integer_range"):
            out.append((f.key, f"{number(v[0])}-{number(v[1])}"))
        elif f.kind == "flag":
            out.append((f.key, "1" if v else "0"))
        elif f.kind in ("single", "multi"):
            out.append((f.key, ",".join(map(str, v))))
        else:
            out.append((f.key, str(v)))
    if spec.get("locale"):
        out.append(("locale", spec.get("locale")))
    return out


def _range(text: str, integer: bool):
    lo, sep, hi = text.partition("-")
    try:
        pair = (int(lo), int(hi)) if integer else (float(lo), float(hi))
    except ValueError:
        return None
    return pair if sep and all(map(math.isfinite, pair)) and pair[0] <= pair[1] else None


def _flag(text: str):
    return {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}.get(text.lower())


def from_query_pairs(pairs, registry: Registry) -> Spec:
    """Lenient: unknown keys are ignored, a malformed value unsets its field, bad list items and repeats are skipped."""
    spec = Spec()
    for key, text in pairs:
        if key == "locale":
            spec = spec.replace(locale=text if len(text.encode()) == 2 else None)
            continue
        f = registry.by_key(key)
        if f is None:
            continue
        if f.kind in ("range", "integer_range"):
            value: Any = _range(text, f.kind == "integer_range")
        elif f.kind == "flag":
            value = _flag(text)
        elif f.kind == "min":
            value = int(text) if text.isdigit() else None
        elif f.kind == "text":
            value = text
        else:
            items: list[Any] = [t for t in text.split(",") if t]
            if f.numeric:
                items = [int(t) for t in items if t.isdigit()]
            value = tuple(dict.fromkeys(items))
        spec = spec.replace(**{f.name: value})
    return spec


def to_query_string(spec: Spec, registry: Registry) -> str:
    return urlencode(to_query_pairs(spec, registry), quote_via=quote, safe=",")


def from_query_string(text: str, registry: Registry) -> Spec:
    return from_query_pairs([(k, v) for k, v in parse_qsl(text.lstrip("?"), keep_blank_values=True) if k], registry)


def from_json(text: str | Mapping[str, Any], registry: Registry) -> Spec:
    """Missing fields take their default; geometry is an old name of mounting_place."""
    raw = json.loads(text) if isinstance(text, str) else dict(text)
    if "geometry" in raw:
        raw.setdefault("mounting_place", raw.pop("geometry"))
    known = {f.name for f in registry.fields} | {"locale"}
    return Spec().replace(**{k: v for k, v in raw.items() if k in known})


def to_json(spec: Spec) -> str:
    return json.dumps(dict(spec.items), sort_keys=True)


def from_cli(registry: Registry, known: Mapping[str, Mapping[str, int]] | None = None, **flags: Any) -> tuple[Spec, list[str]]:
    """Command-line flags: MIN:MAX ranges with open ends; values outside their dictionary warn and are ignored."""
    spec, warnings = Spec(), []
    for name, value in flags.items():
        f = next((f for f in registry.fields if f.name == name), None)
        if name == "locale":
            spec = spec.replace(locale=value)
        elif f is None or value is None:
            continue
        elif f.kind in ("range", "integer_range") and isinstance(value, str):
            lo, _, hi = value.partition(":")
            kind = int if f.kind == "integer_range" else float
            spec = spec.replace(**{name: one_sided(kind(lo) if lo else None, kind(hi) if hi else None, 65535 if kind is int else None)})
        elif known and name in known:
            ids = [known[name].get(v) for v in value]
            warnings += [f"{name}: {v!r} is not canonical" for v, k in zip(value, ids) if k is None]
            spec = spec.replace(**{name: tuple(k for k in ids if k is not None)})
        else:
            spec = spec.replace(**{name: value})
    return spec, warnings
