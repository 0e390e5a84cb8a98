"""Small catalogue documents."""

import json

from pyspark.sql import functions as F

from prismfold.plans.luminaires import DOCUMENT


def photometry(flux, power, cct, **more):
    return {"flux_lm": flux, "power_w": power, "efficacy_lm_w": flux / power, "cct_k": cct, "cri_ra": 80, "beam_deg": 60.0, "field_deg": 120.0, "ulor": 0.0, "dlor": 1.0, "symmetry": "Rotational", "light_distribution": 0} | more


def variant(ix, flux=None, power=None, cct=None, **more):
    p = None if flux is None else photometry(flux, power, cct)
    return {"id": ix, "name": f"v{ix}", "photometry": p, "mounting_place": "Ceiling", "mounting_type": "SurfaceMounted", "has_3d": False, "control_gear_interfaces": [], "has_emergency_lighting": False, "emitter_count": 0, "source_index": 0} | more


def doc(doc_id, manufacturer="LEDVANCE", product="BayArena", **more):
    base = {"doc_id": doc_id, "source": {"kind": "Path", "value": f"{doc_id}.x"}, "source_paths": [], "manufacturer": manufacturer, "product": product, "descriptions": [], "keywords": [], "applications": [], "labels": [], "adjustability": [], "variants": [variant(0, 1500.0, 15.0, 4000)], "file_meta": {"size_bytes": 1000}}
    return base | more


SAMPLE = doc(
    "sample", descriptions=[{"locale": "de", "text": "Hallenstrahler für Sportstätten"}, {"locale": "en", "text": "High-bay luminaire for sports halls"}], keywords=["sports"], applications=[10, 20], labels=[0, 1], adjustability=[0], ip_code=25, safety_class=1, ik_rating=8, product_form=2,
    variants=[variant(0, 10000.0, 100.0, 4000), variant(1, 20000.0, 180.0, 5000)],
)


def frame(spark, *docs):
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string")
    return rows.select(F.from_json("j", DOCUMENT).alias("d")).select("d.*")
