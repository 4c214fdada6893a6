"""Preset files: JSON with records, keys and attributes whose conflicts count."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import KnowledgeGraph, export_graph
from ..operators.linking import resolve
from ..plans.ontology import Ontology
from .records import DESCRIPTORS, RECORDS
from .shared import local_frame


def read_preset(spark: SparkSession, preset: dict) -> tuple[DataFrame, DataFrame, Ontology]:
    """Records and descriptors of a preset; its attributes make one key, without constraints."""
    records, descriptors = [], []
    for k, r in enumerate(preset["records"], 1):
        records.append((k, r["entityType"], r["perspective"], r["uid"]))
        descriptors += [(k, d["attr"], str(d["value"]), d["start"], d["end"], i) for i, d in enumerate(r["descriptors"])]
    ontology = Ontology()
    if preset.get("identityKeys"):
        ontology.add_identity_key("preset", *preset["identityKeys"])
    return local_frame(spark, records, RECORDS), local_frame(spark, descriptors, DESCRIPTORS), ontology


def merged_ontology(presets: list[dict]) -> Ontology:
    """One ontology for several presets: a key for each set of attributes, a unique constraint for each conflict attribute."""
    out, seen = Ontology(), set()
    for p in presets:
        name = "_".join(p["identityKeys"])
        if name and name not in seen:
            out.add_identity_key(name, *p["identityKeys"])
            seen.add(name)
        for attr in p.get("conflictAttrs", []):
            if f"unique_{attr}" not in seen:
                out.add_constraint(f"unique_{attr}", attr)
                seen.add(f"unique_{attr}")
    return out


def preset_graph(spark: SparkSession, preset: dict) -> KnowledgeGraph:
    records, descriptors, ontology = read_preset(spark, preset)
    return export_graph(records, descriptors, resolve(records, descriptors, ontology), ontology)


def load_presets(path: str) -> list[dict]:
    """A preset file on the driver: a list, or an object with the list under ``presets``."""
    with open(path) as f:
        found = json.load(f)
    return found["presets"] if isinstance(found, dict) else found
