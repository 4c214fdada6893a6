"""Readable keys of clusters: tokens of their identifying values and a hash suffix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import key_suffix, token_of
from ..plans.ontology import Ontology
from .golden import cluster_values
from .intervals import dealt


def dominant_entity_type(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """The type of most records of a cluster; of equals the first by name."""
    counts = assignments.join(records.select("record_id", "entity_type"), "record_id").groupBy("cluster_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster_id").agg(F.max_by("entity_type", F.struct("n", _before("entity_type"))).alias("entity_type"))


def _before(column: str):
    """Orders strings downwards, so that the first by name is the maximum: complements its bytes' hex digits."""
    digits = F.translate(F.hex(F.encode(F.col(column), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(digits, F.lit("G"))  # a string comes before those that continue it


def _top(counts: DataFrame, keys: list[str], what: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.max_by(what, F.struct("n", _before(what))).alias(what))


def pick_values(values: DataFrame) -> DataFrame:
    """(cluster_id, attr, value): the value with most descriptors; of equals the first."""
    counts = values.groupBy("cluster_id", "attr", "value").agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, ["cluster_id", "attr"], "value")


def pick_attr_values(values: DataFrame) -> DataFrame:
    """(cluster_id, attr, value): of the attribute with most descriptors."""
    counts = values.groupBy("cluster_id", "attr").agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, ["cluster_id"], "attr").join(pick_values(values), ["cluster_id", "attr"])


def cluster_signatures(records: DataFrame, descriptors: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cluster_id, signature): everything that is said of a cluster's records, sorted and joined."""
    who = assignments.join(records, "record_id").select("cluster_id", F.concat(F.lit("record:"), F.concat_ws(":", "entity_type", "perspective", "uid")).alias("part"))
    at = F.concat(F.col("start_ts").cast("string"), F.lit(":"), F.col("end_ts").cast("string"))
    what = cluster_values(descriptors, assignments).select("cluster_id", F.concat("attr", F.lit("="), "value", F.lit("@"), at).alias("part"))
    return dealt(who.unionByName(what), ["cluster_id"]).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("part")), "|").alias("signature"))


def cluster_seeds(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, ontology: Ontology) -> DataFrame:
    """(cluster_id, entity_type, identity_key, tokens, material)."""
    values = dealt(cluster_values(descriptors, assignments), ["cluster_id"])
    types = dominant_entity_type(records, assignments).join(cluster_signatures(records, descriptors, assignments), "cluster_id")
    named = {t.name: ontology.key_attributes_for_type(t.name) for t in ontology.entity_types.values() if t.key_attributes}
    default = Ontology(identity_keys=ontology.identity_keys).key_attributes_for_type("")
    plans = [(F.col("entity_type") == name, attrs, key) for name, (attrs, key) in named.items()]
    plans.append((~F.col("entity_type").isin(list(named)) if named else F.lit(True), *default))
    out = []
    for condition, attrs, key in plans:
        of = types.where(condition)
        if not attrs:
            met = of.join(pick_attr_values(values), "cluster_id")
            part = F.concat("attr", F.lit("="), "value")
            tokens = F.array(token_of(F.col("attr"), F.col("value"), F.col("entity_type")))
            material = F.concat("entity_type", F.lit("|fallback|"), part, F.lit("|"), "signature")
            out.append(met.select("cluster_id", "entity_type", F.concat(F.lit("fallback_"), "attr").alias("identity_key"), tokens.alias("tokens"), material.alias("material")))
            continue
        picked = pick_values(values.where(F.col("attr").isin(attrs))).groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("kv"))
        met = of.join(picked, "cluster_id", "left")
        value = lambda a: F.coalesce(F.try_element_at("kv", F.lit(a)), F.lit("unknown"))
        tokens = F.array(*[token_of(F.lit(a), value(a), F.col("entity_type")) for a in attrs])
        parts = F.concat_ws("|", *[F.concat(F.lit(a + "="), value(a)) for a in attrs])
        material = F.concat("entity_type", F.lit(f"|{key}|"), parts, F.lit("|"), "signature")
        made = met.select("cluster_id", "entity_type", F.lit(key).alias("identity_key"), tokens.alias("tokens"), material.alias("material"))
        out.append(made.where(F.exists("tokens", lambda t: t != "")))
    return reduce(DataFrame.unionByName, out)


def cluster_keys(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, ontology: Ontology) -> DataFrame:
    """(cluster_id, cluster_key, identity_key): of each type the shortest run of tokens that one cluster has alone."""
    # a type's seeds are of one plan, so they have equally many tokens
    seeds = cluster_seeds(records, descriptors, assignments, ontology).withColumn("width", F.size("tokens"))
    prefixes = seeds.select("entity_type", "cluster_id", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("len"), "tokens")
    prefixes = prefixes.withColumn("prefix", F.array_join(F.slice("tokens", 1, F.col("len")), "-"))
    alone = prefixes.groupBy("entity_type", "len", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("cluster_id").alias("cluster_id")).where("n = 1")
    shortest = alone.groupBy("cluster_id").agg(F.min("len").alias("len"))
    met = seeds.join(shortest, "cluster_id", "left")
    base = F.array_join(F.slice("tokens", 1, F.coalesce("len", "width")), "-")
    key = F.concat(F.when(base == "", "UNK").otherwise(base), F.lit("-"), key_suffix(F.col("material")))
    return met.select("cluster_id", key.alias("cluster_key"), "identity_key")


__all__ = ["cluster_keys", "cluster_seeds", "cluster_signatures", "dominant_entity_type", "pick_attr_values", "pick_values"]
