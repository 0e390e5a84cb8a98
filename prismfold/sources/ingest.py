"""Product files in, documents out: listing, archives, photometric files, extraction, increments, samples, manifests."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import mining, photometry
from ..functions.text import once, unicode_trim
from ..operators import fold
from ..plans.luminaires import VARIANT
from . import snapshot

PATTERN = "*.[gG][lL][dD][fF]"
#: archives a task, where small rows that cost much each are dealt out
TASK_ROWS = 5000
#: parsed archives held at once
PARSED_ROWS = 250


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, relative, length, mtime (epoch seconds), and content where asked for; all folders below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    return files.select("path", relative.alias("relative"), "length", F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if content else []))


def dealt(rows: DataFrame, n: int, *key: str, each: int = TASK_ROWS) -> DataFrame:
    """n rows in tasks of about `each`, by the key: Spark cuts files by their bytes, which leaves short rows with much work in one task."""
    return rows.repartition(-(-n // each) or 1, *key)


#: typed elements of a variant, with the table that has their values and what they are also called
MARKS = {"Application": "applications", "Label": "labels", "ProductForm": "product_form", "IKRating": "ik_rating", "Adjustability": "adjustability", "IngressProtectionIPCode": "ip_code", "ElectricalSafetyClass": "safety_class", "LightDistribution": "light_distribution"}
_ALSO = {"IPCode": "IngressProtectionIPCode", "SafetyClass": "ElectricalSafetyClass"}

_PRODUCT = "path string, unique_id string, manufacturer string, name array<struct<locale:string,text:string>>, product_number array<struct<locale:string,text:string>>, texts array<struct<ord:int,locale:string,text:string>>, gtins array<string>, version struct<major:int,minor:int,rc:int>, applications array<string>, variants array<struct<id:string,name:array<struct<locale:string,text:string>>,mountings:map<string,string>,marks:array<struct<field:string,value:string>>,model:boolean,emergency:string,emergency_block:boolean,lamp_changeable:array<string>,lamp_fixed:array<string>,gear:array<string>>>, ldts array<string>, files array<struct<id:string,content_type:string,name:string>>, error string"


def _locales(node) -> list[dict]:
    return [{"locale": (n.get("language") or "").strip(), "text": n.text or ""} for n in (node.iter() if node is not None else ()) if n.tag.endswith("Locale")]


def parse_archive(path: str, content: bytes) -> dict:
    """One archive as a product row; any failure becomes the row's error, never an exception."""
    import xml.etree.ElementTree as ET

    row: dict = {c.strip().split(" ")[0]: None for c in ("path", "unique_id", "manufacturer", "error")}
    row |= {"path": path, "name": [], "product_number": [], "texts": [], "gtins": [], "version": None, "applications": [], "variants": [], "ldts": [], "files": []}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read(next(n for n in z.namelist() if n.lower().rsplit("/", 1)[-1] == "product.xml")))
            for n in root.iter():
                if "}" in n.tag:
                    n.tag = n.tag.rsplit("}", 1)[-1]
            first = lambda node, tag: next((e for e in node.iter(tag) if e is not node), None) if node is not None else None
            text = lambda node, tag: None if (e := first(node, tag)) is None else e.text or ""
            head, meta = root.find("Header"), first(root, "ProductMetaData")
            row["manufacturer"], row["unique_id"] = text(head, "Manufacturer"), text(head, "UniqueGldfId") or text(head, "UniqueProductId")
            version = first(head, "FormatVersion")
            if version is not None:
                row["version"] = {"major": int(version.get("major") or 0), "minor": int(version.get("minor") or 0), "rc": int(version.get("pre-release") or 0)}
            row["name"], row["product_number"] = _locales(meta.find("Name") if meta is not None else None), _locales(meta.find("ProductNumber") if meta is not None else None)
            row["gtins"] = [g.text or "" for g in (meta.iter("GTIN") if meta is not None else [])]
            order = 0

            def gather(node, *tags):
                nonlocal order
                for tag in tags:
                    for entry in _locales(node.find(tag) if node is not None else None):
                        row["texts"].append({"ord": order, **entry})
                        order += 1

            gather(meta, "Name", "Description", "TenderText", "ProductNumber")
            row["files"] = [{"id": f.get("id") or "", "content_type": f.get("contentType") or "", "name": f.text or ""} for f in root.iter("File")]
            row["applications"] = [a.text or "" for a in root.iter("Application")]
            names = {n.rsplit("/", 1)[-1]: n for n in z.namelist()}
            row["ldts"] = [z.read(names[f["name"]]).decode("latin-1") for f in row["files"] if f["content_type"].startswith("ldc/") and f["name"] in names]
            lamps = {s: [e.text or "" for n in root.iter(s) for e in n.iter("CIE97LampType")] for s in ("ChangeableLightSource", "FixedLightSource")}
            gear = [e.text or "" for e in root.iter("Interface")]
            for v in root.iter("Variant"):
                gather(v, "Name", "Description", "ProductNumber", "TenderText")
                mounts = {f"{place.tag}.{kind.tag}": kind.findtext("RecessedDepth") or kind.get("recessedDepth") or "" for m in v.iter("Mountings") for place in m for kind in (list(place) or [place])}
                marks = [{"field": _ALSO.get(e.tag, e.tag), "value": e.text.strip()} for e in v.iter() if _ALSO.get(e.tag, e.tag) in MARKS and (e.text or "").strip()]
                block = first(v, "EmergencyLighting")
                row["variants"].append({"id": v.get("id") or "", "name": _locales(v.find("Name")), "mountings": mounts, "marks": marks, "model": first(v, "ModelGeometryReference") is not None or first(v, "SimpleGeometryReference") is not None, "emergency": text(block, "EmergencyLightingType"), "emergency_block": block is not None, "lamp_changeable": lamps["ChangeableLightSource"], "lamp_fixed": lamps["FixedLightSource"], "gear": gear})
    except Exception as e:  # a bad file is a row with its error
        row["error"] = f"{type(e).__name__}: {e}"
    return row


_LISTED = ("relative", "length", "mtime")


def products(files: DataFrame) -> DataFrame:
    """Parsed archives of a listing with content, broken ones with their error."""
    schema = StructType.fromDDL(f"{_PRODUCT}, relative string, length long, mtime long")
    arrow = to_arrow_schema(schema)
    own = pa.schema([f for f in arrow if f.name not in _LISTED])

    def parsed(path: str, content: bytes) -> dict:
        row = parse_archive(path, content)
        for v in row["variants"]:
            v["mountings"] = list(v["mountings"].items())  # Arrow's form of a map
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, PARSED_ROWS) for whole in batches for k in range(0, whole.num_rows, PARSED_ROWS)):
            rows = [parsed(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist())]
            out = pa.RecordBatch.from_pylist(rows, schema=own)
            listed = [b.column(c).cast(arrow.field(c).type) for c in _LISTED]  # the listing's columns come along: nothing is joined back
            yield pa.RecordBatch.from_arrays([*out.columns, *listed], schema=arrow)

    return files.select("path", "content", *_LISTED).mapInArrow(run, schema)


LDT = "flux float, power float, appearance string, rendering string, lorl float, dff float, symmetry int, beam float, field float"


def parse_ldt(text: str | None) -> dict | None:
    """A EULUMDAT file's first lamp set, output ratios, symmetry and half-peak and tenth-peak angles of its first plane."""
    try:
        lines = [x.strip().replace(",", ".") for x in (text or "").splitlines()]
        number = lambda k: float(lines[k] or 0)
        symmetry, planes, n_gamma = int(number(2)), int(number(3)), int(number(5))
        dff, lorl, sets = number(21), number(22), max(1, int(number(25)))
        at = 26
        lamps = abs(int(float(lines[at] or 1)))
        flux, appearance, rendering, power = number(at + 2 * sets), lines[at + 3 * sets], lines[at + 4 * sets], number(at + 5 * sets)
        angles = at + 6 * sets + 10
        gammas = [number(angles + planes + k) for k in range(n_gamma)]
        first = [number(angles + planes + n_gamma + k) for k in range(n_gamma)]
        peak = max(first, default=0.0)

        def width(share):
            if peak <= 0:
                return None
            top = first.index(peak)
            for k in range(top, len(first) - 1):
                if first[k + 1] < share * peak <= first[k]:
                    step = (first[k] - share * peak) / (first[k] - first[k + 1])
                    return 2 * (gammas[k] + step * (gammas[k + 1] - gammas[k]))
            return 2 * gammas[-1] if gammas else None

        return {"flux": flux * max(1, lamps), "power": power * max(1, lamps), "appearance": appearance, "rendering": rendering, "lorl": lorl, "dff": dff, "symmetry": symmetry, "beam": width(0.5), "field": width(0.1)}
    except (IndexError, ValueError):
        return None


def ldt_stats(c: Column) -> Column:
    """A photometry struct of a photometric file's text; null if it cannot be read."""

    @F.pandas_udf(LDT)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(x.split(" ")[0] for x in LDT.split(", "))
        return pd.DataFrame([parse_ldt(t) or empty for t in texts], columns=list(empty))

    p = parsed(c)
    colour = photometry.colour(p["appearance"], p["rendering"])
    positive = lambda x: F.when(~F.isnan(x) & (x > 0), x)
    dlor = F.when(p["dff"] > 0, p["dff"] / 100).cast("float")
    ulor = F.when(p["lorl"] > 0, F.greatest(F.lit(0.0), p["lorl"] / 100 * (1 - F.coalesce(p["dff"], F.lit(0.0)) / 100))).cast("float")
    symmetry = F.when(p["symmetry"] == 1, "Rotational").when(p["symmetry"].isin(2, 3, 4), "Axial").when(p["symmetry"] == 0, "Asymmetric").otherwise("Unknown")
    stats = F.struct(
        p["flux"].alias("flux_lm"), p["power"].alias("power_w"), F.when(p["power"] > 0, (p["flux"] / p["power"]).cast("float")).alias("efficacy_lm_w"), colour["cct"].alias("cct_k"), colour["cri"].cast("smallint").alias("cri_ra"), F.lit(None).cast("tinyint").alias("r9"),
        positive(p["beam"]).alias("beam_deg"), positive(p["field"]).alias("field_deg"), ulor.alias("ulor"), dlor.alias("dlor"), symmetry.alias("symmetry"), F.lit(None).cast("smallint").alias("light_distribution"),
    )
    return F.when(p["flux"].isNotNull() & p["symmetry"].isNotNull(), stats)


def picked_text(texts: Column) -> Column:
    """English first, else the first that is not blank."""
    some = F.filter(texts, lambda t: F.trim(t["text"]) != "")
    return F.coalesce(F.try_element_at(F.filter(some, lambda t: F.lower(t["locale"]) == "en"), F.lit(1))["text"], F.try_element_at(some, F.lit(1))["text"])


def gathered_descriptions(texts: Column) -> Column:
    """Texts of two-byte locales joined by spaces in visit order, sorted by locale; blank ones left out."""
    some = F.filter(texts, lambda t: (F.trim(t["text"]) != "") & (F.octet_length(t["locale"]) == 2))
    locales = F.array_sort(F.array_distinct(F.transform(some, lambda t: F.lower(t["locale"]))))
    joined = lambda code: F.array_join(F.transform(F.array_sort(F.transform(F.filter(some, lambda t: F.lower(t["locale"]) == code), lambda t: F.struct(t["ord"], t["text"]))), lambda t: t["text"]), " ")
    return F.transform(locales, lambda code: F.struct(code.alias("locale"), joined(code).alias("text")))


def mounting(m: Column) -> tuple[Column, Column, Column]:
    """Place, type and recessed depth of a mounting map (Place.Type to depth text), by fixed ladders."""
    ladders = (("Ceiling", ("Recessed", "SurfaceMounted", "Pendant")), ("Wall", ("Recessed", "SurfaceMounted")), ("WorkingPlane", ("FreeStanding",)), ("Ground", ("Recessed", "PoleTop", "PoleIntegrated", "FreeStanding", "SurfaceMounted")))
    keys = F.map_keys(m)
    place, kind, depth = F.lit("Unknown"), F.lit("Unknown"), F.lit(None).cast("bigint")
    for name, kinds in reversed(ladders):
        here = F.array_join(keys, "|").rlike(rf"(?:^|\|){name}\.")
        own, own_depth = F.lit("Unknown"), F.lit(None).cast("bigint")
        for k in reversed(kinds):
            has = F.array_contains(keys, f"{name}.{k}")
            own = F.when(has, k).otherwise(own)
            own_depth = F.when(has, F.greatest(F.lit(0).cast("bigint"), F.try_element_at(m, F.lit(f"{name}.{k}")).try_cast("bigint")) if k == "Recessed" else F.lit(None).cast("bigint")).otherwise(own_depth)
        place, kind, depth = F.when(here, name).otherwise(place), F.when(here, own).otherwise(kind), F.when(here, own_depth).otherwise(depth)
    return place, kind, photometry.sane_depth(depth)


def document_id(unique: Column, fallback: Column) -> Column:
    """SHA-256 of the trimmed unique id, else of the fallback, else zeros."""
    trimmed = unicode_trim(unique)
    return F.when(trimmed != "", F.sha2(trimmed, 256)).when(fallback.isNotNull(), F.sha2(fallback, 256)).otherwise("0" * 64)


def version_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.format_string("%d.%d.%s", v["major"], v["minor"], F.when(v["rc"] > 0, F.format_string("-rc.%d", v["rc"])).otherwise("")))


def documents(files: DataFrame, dictionaries: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Documents and their warnings from listed files with content; broken files are left out (see products)."""
    known = dictionaries or {}
    ids = lambda name, x: (F.array_position(F.array(*map(F.lit, known[name])), x) - 1).cast("smallint") if known.get(name) else F.lit(None).cast("smallint")
    valid = lambda x: F.when(x >= 0, x)
    p = products(files).where("error is null")
    p = p.withColumn("ldt", ldt_stats(F.try_element_at("ldts", F.lit(1))))
    name = picked_text(F.col("name"))

    # what several columns draw on is worked out once a variant: its label, then what is mined from that
    p = p.withColumn("variants", F.transform("variants", lambda v: v.withField("label", F.coalesce(picked_text(v["name"]), v["id"]))))
    mined_of = lambda v: F.struct(*[c.alias(n) for n, c in mining.values(v["label"], known.get("ip_code", ("",)), known.get("ik_rating", ("",))).items()])
    p = p.withColumn("variants", F.transform("variants", lambda v: v.withField("mined", mined_of(v))))
    table = mining.probes(list(known.get("applications", ())))
    flat = lambda f: F.flatten(F.transform("variants", f))

    def typed_ids(v: Column, field: str) -> Column:
        """Ids of a variant's known values of a typed element, in their order."""
        return F.array_compact(F.transform(F.filter(v["marks"], lambda m: m["field"] == field), lambda m: valid(ids(MARKS[field], m["value"]))))

    def variant(v: Column, ix: Column) -> Column:
        label = v["label"]
        place, kind, depth = mounting(v["mountings"])
        mined = {n: v["mined"][n] for n in ("flux_lm", "power_w", "cct_k", "cri_ra", "beam_deg")}
        typed = F.try_element_at(typed_ids(v, "LightDistribution"), F.lit(1))
        none = F.lit(None)
        fields = {n: F.coalesce(F.col("ldt")[n], mined.get(n, none.cast(t))).cast(t) for n, t in (("flux_lm", "float"), ("power_w", "float"), ("efficacy_lm_w", "float"), ("cct_k", "int"), ("cri_ra", "smallint"), ("r9", "tinyint"), ("beam_deg", "float"), ("field_deg", "float"), ("ulor", "float"), ("dlor", "float"))}
        symmetry = F.when(F.col("ldt").isNotNull(), F.col("ldt")["symmetry"]).otherwise(photometry.symmetry_of(typed))
        stats = F.struct(*[c.alias(n) for n, c in fields.items()], symmetry.alias("symmetry"), typed.alias("light_distribution"))
        some = F.col("ldt").isNotNull() | typed.isNotNull()
        for c in mined.values():
            some = some | c.isNotNull()
        gear = F.array_distinct(F.filter(F.transform(v["gear"], lambda g: valid(ids("control_gear", g))), lambda g: g.isNotNull())) if known.get("control_gear") else F.array().cast("array<smallint>")
        lamps = F.array_compact(F.transform(F.concat(v["lamp_changeable"], v["lamp_fixed"]), lambda x: valid(ids("lamp_type", x))))
        return F.struct(
            ix.cast("int").alias("id"), label.alias("name"), photometry.sanitized(F.when(some, stats)).alias("photometry"), place.alias("mounting_place"), kind.alias("mounting_type"), depth.alias("recessed_depth_mm"), v["model"].alias("has_3d"), F.try_element_at(lamps, F.lit(1)).alias("lamp_type"),
            gear.alias("control_gear_interfaces"), v["emergency_block"].alias("has_emergency_lighting"), valid(ids("emergency_type", v["emergency"])).alias("emergency_lighting_type"), F.lit(0).alias("emitter_count"), F.lit(0).alias("source_index"),
        ).cast(VARIANT)

    def first(field: str, mined: str | None = None) -> Column:
        """Variant by variant the typed value, then the mined one; the first there is."""
        own = lambda v: F.try_element_at(typed_ids(v, field), F.lit(1))
        both = flat(lambda v: F.array(own(v), *([valid(ids(MARKS[field], v["mined"][mined]))] if mined else [])))
        return F.try_element_at(F.array_compact(both), F.lit(1))

    def united(field: str, *more: Column) -> Column:
        return F.array_sort(F.array_distinct(F.concat(flat(lambda v: typed_ids(v, field)), *more)))

    def unknown(m: Column) -> Column:
        """A typed value that its table lacks; without a table nothing can be said."""
        return F.coalesce(*[F.when(m["field"] == field, valid(ids(name, m["value"])).isNull()) for field, name in MARKS.items() if known.get(name)], F.lit(False))

    source = F.struct(F.lit("Path").alias("kind"), F.col("relative").alias("value"))
    mined_words = flat(lambda v: mining.keywords_of(v["mined"]))
    typed_words = flat(lambda v: F.transform(F.filter(v["marks"], lambda m: F.coalesce(*[F.when(m["field"] == field, valid(ids(name, m["value"])).isNotNull()) for field, name in MARKS.items() if known.get(name)], F.lit(False))), lambda m: m["value"]))
    mined_apps = flat(lambda v: mining.applications(v["label"], table))
    app_words = F.transform(mined_apps, lambda k: F.get(F.array(*map(F.lit, known["applications"])), k.cast("int"))) if known.get("applications") else F.array().cast("array<string>")
    words = F.array_sort(F.array_distinct(F.array_compact(F.concat(mined_words, typed_words, app_words))))
    gtin = F.try_element_at(F.filter("gtins", lambda g: F.trim(g) != ""), F.lit(1))
    loose_apps = F.array_compact(F.transform("applications", lambda a: valid(ids("applications", a))))
    warning = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    of_doc = [F.when(c, warning(k, F.lit(""))) for k, c in (("ManufacturerEmpty", F.trim(F.coalesce("manufacturer", F.lit(""))) == ""), ("DocIdUnavailable", F.trim(F.coalesce("unique_id", F.lit(""))) == ""))]
    of_photometry = lambda v: F.array(F.when(F.size("ldts") == 0, warning("PhotometryMissing", v["id"])), F.when((F.size("ldts") > 0) & F.col("ldt").isNull(), warning("PhotometryParseFailed", v["id"])))
    of_values = lambda v: F.transform(F.filter(v["marks"], unknown), lambda m: warning("NonCanonicalEnumValue", F.concat_ws(" ", v["id"], m["field"], m["value"])))
    warnings = F.array_compact(F.concat(F.array(*of_doc), flat(of_values), flat(of_photometry)))
    return p.select(
        document_id(F.col("unique_id"), F.concat(F.lit("path:"), "relative")).alias("doc_id"), source.alias("source"), F.array(source).alias("source_paths"), F.trim(F.coalesce("manufacturer", F.lit(""))).alias("manufacturer"), F.coalesce(name, F.lit("")).alias("product"), gtin.alias("gtin"), picked_text(F.col("product_number")).alias("product_code"),
        gathered_descriptions(F.col("texts")).alias("descriptions"), words.alias("keywords"), united("Application", loose_apps, mined_apps).alias("applications"), united("Label").alias("labels"), united("Adjustability").alias("adjustability"),
        first("IngressProtectionIPCode", "ip_code").alias("ip_code"), first("ElectricalSafetyClass").alias("safety_class"), first("IKRating", "ik_rating").alias("ik_rating"), first("ProductForm", "form").alias("product_form"),
        F.transform("variants", variant).alias("variants"), F.struct(F.col("length").alias("size_bytes"), F.col("mtime").alias("mtime_epoch_s"), version_text(F.col("version")).alias("format_version")).alias("file_meta"), "path", warnings.alias("warnings"),
    )


def incremental(listed: DataFrame, old: DataFrame) -> DataFrame:
    """listed with reused: same relative path, equal size and equal known time as in the snapshot (relative, length, mtime)."""
    old = old.select("relative", F.col("length").alias("old_length"), F.col("mtime").alias("old_mtime"))
    return listed.join(old, "relative", "left").withColumn("reused", F.coalesce((F.col("length") == F.col("old_length")) & (F.col("mtime") == F.col("old_mtime")), F.lit(False))).drop("old_length", "old_mtime")


def sample(listed: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Exactly n files, all if there are fewer; the same ones for a seed."""
    if n <= 0:
        raise ValueError("a sample needs at least one file")
    rank = F.rand() if seed is None else F.xxhash64(F.lit(seed), "path")
    return listed.orderBy(rank, "path").limit(n)


def manifest(files: DataFrame, target: str, force: bool = False) -> DataFrame:
    """Write hashes and sizes of files (with content) as JSON; a folder with files is refused without force."""
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not force and fs.exists(path) and len(fs.listStatus(path)):
        raise FileExistsError(target)
    out = files.select("relative", "length", F.sha2("content", 256).alias("sha256"))
    out.repartition(1).sortWithinPartitions("relative").write.mode("overwrite").json(target)  # contents are hashed where they are read
    return out


def copy_sample(files: DataFrame, target: str) -> DataFrame:
    """Write each file (with content) below target under its relative path; (relative, copied bytes). Executors write, so target is a shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for relative, content in zip(b["relative"], b["content"]):
                place = os.path.join(target.removeprefix("file://"), relative.lstrip("/"))
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(f"{place}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{place}.part", place)  # a task that runs again writes the same file
            yield pd.DataFrame({"relative": b["relative"], "copied": [len(c) for c in b["content"]]})

    return files.select("relative", "content").mapInPandas(run, "relative string, copied long")


BUNDLE, BUNDLE_MANIFEST = "files", "manifest"


def write_bundle(files: DataFrame, target: str, force: bool = False) -> DataFrame:
    """Files (with content) as one table below target, and their manifest (relative, length, sha256) as JSON beside it; the manifest.

    Executors write through Hadoop's file systems, and a table is there whole once its job is committed; the manifest is made
    of what was stored, last, so a bundle with a manifest is complete. A target with files is refused without force, which
    replaces the bundle. For loose files on a mounted folder see copy_sample."""
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and len(fs.listStatus(path)):
        if not force:
            raise FileExistsError(target)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, BUNDLE_MANIFEST), True)
    hashed = files.select("path", "relative", "length", "mtime", F.sha2("content", 256).alias("sha256"), "content")
    hashed.write.mode("overwrite").parquet(f"{target}/{BUNDLE}")
    listed = spark.read.parquet(f"{target}/{BUNDLE}").select("relative", "length", "sha256")
    listed.repartition(1).sortWithinPartitions("relative").write.mode("overwrite").json(f"{target}/{BUNDLE_MANIFEST}")
    return listed


def read_bundle(spark: SparkSession, target: str) -> DataFrame:
    """The files of a complete bundle, as listing gives them with content; documents() takes them."""
    spark.read.text(f"{target}/{BUNDLE_MANIFEST}/_SUCCESS")  # refuses a bundle without its manifest
    return spark.read.parquet(f"{target}/{BUNDLE}").drop("sha256")


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """Files of a bundle whose content is not what its manifest says, on either side: (relative, problem)."""
    said = spark.read.schema("relative string, length long, sha256 string").json(f"{target}/{BUNDLE_MANIFEST}").withColumn("said", F.lit(True))
    held = spark.read.parquet(f"{target}/{BUNDLE}").select("relative", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("now"))
    both = said.join(held, "relative", "full")
    wrong = F.when(F.col("said").isNull(), "not listed").when(F.col("now").isNull(), "missing").when((F.col("n") != F.col("length")) | (F.col("now") != F.col("sha256")), "changed")
    return both.select("relative", wrong.alias("problem")).where("problem is not null")


def as_json(docs: DataFrame) -> DataFrame:
    """Documents with their warnings as one JSON text each (column json)."""
    return docs.select(F.to_json(F.struct("*")).alias("json"))


def rebuilt(listed: DataFrame, old: DataFrame, extract, path: str = "relative") -> DataFrame:
    """Documents of all listed files: those of unchanged files from the snapshot, the rest extracted anew; deleted files
    drop out. extract turns listed rows into documents; a document's file is source.value, its size and time are in file_meta."""
    known = old.select(F.col("source.value").alias(path), F.col("file_meta.size_bytes").alias("length"), F.col("file_meta.mtime_epoch_s").alias("mtime"))
    marked = incremental(listed, known)
    same = marked.where("reused").select(F.col(path).alias("__file"))
    kept = old.join(same, F.col("source.value") == F.col("__file"), "left_semi")
    return kept.unionByName(extract(marked.where("not reused").drop("reused")), allowMissingColumns=True)


def build_index(spark: SparkSession, root: str, path: str, dictionaries: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Files below root as a new build at path: families, aliases of their members, and the files that could not be read, each a
    snapshot of its own (families, aliases, failures). One row of figures: files, failures, documents and variants in and out.

    Archives are parsed once; everything else reads what was stored.
    """
    files = listing(spark, root, content=True)
    parsed = documents(files, dictionaries)
    snapshot.write(parsed, f"{path}/documents")
    docs = snapshot.read(spark, f"{path}/documents")
    snapshot.write(fold.fold(docs.drop("warnings", "path"), nameless=False), f"{path}/families")
    families = snapshot.read(spark, f"{path}/families")
    snapshot.write(fold.aliases(families), f"{path}/aliases")
    seen = docs.select("path")
    snapshot.write(listing(spark, root).join(seen, "path", "left_anti").select("relative", "length"), f"{path}/failures")
    failures = snapshot.read(spark, f"{path}/failures").agg(F.count(F.lit(1)).alias("failures"))
    return fold.fold_stats(docs, families).crossJoin(failures).withColumn("files", F.col("docs_in") + F.col("failures"))


def rebuild_buckets(listed: DataFrame, path: str, extract) -> list[int]:
    """Bring a snapshot in buckets by path (snapshot.write_bucketed) up to the listed files: only new and changed files are
    extracted, files that are gone drop out, and only the buckets of those are rewritten; their numbers."""
    spark = listed.sparkSession
    old = snapshot.read_bucketed(spark, path)
    known = old.select(F.col("source.value").alias("relative"), F.col("file_meta.size_bytes").alias("length"), F.col("file_meta.mtime_epoch_s").alias("mtime"), F.col("path").alias("__path"))
    marked = incremental(listed, known)
    gone = known.join(listed, "relative", "left_anti").select(F.col("__path").alias("path"))
    return snapshot.update_bucketed(spark, path, extract(marked.where("not reused").drop("reused")), gone)


def inspect(parsed: DataFrame, *keep: str) -> DataFrame:
    """Files of each archive by class of content type, with variants and locales (and columns to keep): a row stays a row, nothing
    is shuffled."""
    bucket = lambda kind: F.when(kind.startswith("ldc/"), "ldc").when(kind.startswith("image/"), "image").when(kind.startswith("geo/"), "geo").when(kind.startswith("spectrum/"), "spectrum").otherwise("other")
    kinds = parsed.select("path", "manufacturer", F.size("variants").alias("n_variants"), F.size(F.array_distinct(F.transform("texts", lambda t: t["locale"]))).alias("n_locales"), *keep, F.transform("files", lambda f: bucket(f["content_type"])).alias("__kinds"))
    return kinds.select("*", *[F.coalesce(F.size(F.filter("__kinds", lambda k: k == F.lit(b))), F.lit(0)).cast("long").alias(b) for b in ("ldc", "image", "geo", "spectrum", "other")]).drop("__kinds")


def file_of_variant(files: Column, n_variants: Column, ix: Column) -> Column:
    """The positional file when there is one for each variant and ix is in range, else the first."""
    return F.when((F.size(files) == n_variants) & (ix >= 0) & (ix < F.size(files)), F.try_element_at(files, ix + 1)).otherwise(F.try_element_at(files, F.lit(1)))


def picture(name: Column, content_type: Column, content: Column) -> Column:
    """struct(mime, content) of a product picture: the type as given, with image/ in front of a bare name; without one, by the file's extension."""
    kind = F.lower(F.trim(content_type))
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    by_name = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "svg", "image/svg+xml").when(ext != "", F.concat(F.lit("image/"), ext)).otherwise("application/octet-stream")
    mime = F.when(kind.isNull() | (kind == ""), by_name).when(kind.contains("/"), kind).otherwise(F.concat(F.lit("image/"), kind))
    return F.struct(mime.alias("mime"), content.alias("content"))


def corpus_root(explicit: str | None = None, debug: str = "CATALOGUE_DEBUG_ROOT", variable: str = "CATALOGUE_ROOT") -> str:
    root = explicit or os.environ.get(debug) or os.environ.get(variable)
    if not root:
        raise ValueError("no corpus root given")
    return root


def snapshot_path(root: str, variable: str = "CATALOGUE_CACHE") -> str | None:
    """From the environment (an empty text switches snapshots off), else beside the corpus."""
    given = os.environ.get(variable)
    return None if given == "" else given or f"{root.rstrip('/')}/.index"
