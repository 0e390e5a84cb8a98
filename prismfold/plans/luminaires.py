"""The product catalogue's schema, its fields and its facets."""

from __future__ import annotations

from .spec import Facet, Field, Registry

SOURCE = "struct<kind:string,value:string>"
PHOTOMETRY = "struct<flux_lm:float,power_w:float,efficacy_lm_w:float,cct_k:int,cri_ra:smallint,r9:tinyint,beam_deg:float,field_deg:float,ulor:float,dlor:float,symmetry:string,light_distribution:smallint>"
VARIANT = f"struct<id:int,name:string,photometry:{PHOTOMETRY},mounting_place:string,mounting_type:string,recessed_depth_mm:bigint,has_3d:boolean,lamp_type:smallint,control_gear_interfaces:array<smallint>,has_emergency_lighting:boolean,emergency_lighting_type:smallint,emitter_count:int,source_index:int>"
DOCUMENT = f"doc_id string, source {SOURCE}, source_paths array<{SOURCE}>, manufacturer string, product string, gtin string, product_code string, descriptions array<struct<locale:string,text:string>>, keywords array<string>, applications array<smallint>, labels array<smallint>, adjustability array<smallint>, ip_code smallint, safety_class smallint, ik_rating smallint, product_form smallint, variants array<{VARIANT}>, file_meta struct<size_bytes:bigint,mtime_epoch_s:bigint,format_version:string>"

P = "photometry."
LUMINAIRES = Registry(
    fields=(
        Field("text", "text", "doc", "", "text"),
        Field("manufacturer", "single", "doc", "manufacturer", "mfr"),
        Field("applications", "multi", "doc", "applications", "app", numeric=True),
        Field("labels", "multi", "doc", "labels", "lbl", numeric=True),
        Field("adjustability", "multi", "doc", "adjustability", "adj", numeric=True),
        Field("ip_code", "single", "doc", "ip_code", "ip", numeric=True),
        Field("safety_class", "single", "doc", "safety_class", "sc", numeric=True),
        Field("ik_rating", "single", "doc", "ik_rating", "ik", numeric=True),
        Field("product_form", "single", "doc", "product_form", "pf", numeric=True),
        Field("flux", "range", "variant", P + "flux_lm", "flux", type="float"),
        Field("power", "range", "variant", P + "power_w", "pw", type="float"),
        Field("efficacy", "range", "variant", P + "efficacy_lm_w", "eff", type="float"),
        Field("cct", "integer_range", "variant", P + "cct_k", "cct", type="int"),
        Field("cri_min", "min", "variant", P + "cri_ra", "cri", type="int"),
        Field("beam", "range", "variant", P + "beam_deg", "beam", type="float"),
        Field("recessed_depth", "integer_range", "variant", "recessed_depth_mm", "depth", gate=("mounting_type", "Recessed"), type="bigint"),
        Field("mounting_place", "single", "variant", "mounting_place", "mp"),
        Field("mounting_type", "single", "variant", "mounting_type", "mt"),
        Field("light_distribution", "single", "variant", P + "light_distribution", "ld", numeric=True),
        Field("has_photometry", "flag", "doc", "photometry", "phot", present=True),
        Field("has_3d", "flag", "doc", "has_3d", "m3d"),
        Field("has_emergency", "flag", "doc", "has_emergency_lighting", "em"),
        Field("lamp_type", "single", "variant", "lamp_type", "lt", numeric=True),
        Field("control_gear", "multi", "variant", "control_gear_interfaces", "cg", numeric=True),
        Field("emergency_type", "single", "variant", "emergency_lighting_type", "et", numeric=True),
    ),
    facets=(
        Facet("manufacturer", "manufacturer", "manufacturer", "doc"),
        Facet("applications", "applications", "applications", "doc_array"),
        Facet("labels", "labels", "labels", "doc_array"),
        Facet("adjustability", "adjustability", "adjustability", "doc_array"),
        Facet("ip_code", "ip_code", "ip_code", "doc"),
        Facet("safety_class", "safety_class", "safety_class", "doc"),
        Facet("ik_rating", "ik_rating", "ik_rating", "doc"),
        Facet("product_form", "product_form", "product_form", "doc"),
        Facet("mounting_place", "mounting_place", "mounting_place", "variant"),
        Facet("mounting_type", "mounting_type", "mounting_type", "variant"),
        Facet("light_distribution", "light_distribution", P + "light_distribution", "variant"),
        Facet("has_photometry", "has_photometry", "photometry", "presence"),
        Facet("has_3d", "has_3d", "has_3d", "presence"),
        Facet("has_emergency", "has_emergency", "has_emergency_lighting", "presence"),
        Facet("lamp_type", "lamp_type", "lamp_type", "variant"),
        Facet("control_gear", "control_gear", "control_gear_interfaces", "variant_array"),
        Facet("emergency_type", "emergency_type", "emergency_lighting_type", "subtype", flag="has_emergency_lighting"),
    ),
)
