"""What identifies entities: keys, strong identifiers, constraints, crosswalks and perspectives."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import local_frame


@dataclass(frozen=True)
class IdentityKey:
    name: str
    attributes: tuple[str, ...]

    def matches(self, other: IdentityKey) -> bool:
        """Whether both are of the same attributes, in any order."""
        return set(self.attributes) == set(other.attributes)


@dataclass(frozen=True)
class StrongIdentifier:
    attribute: str
    name: str = ""


class ConstraintKind(str, Enum):
    UNIQUE = "UNIQUE"
    UNIQUE_WITHIN_PERSPECTIVE = "UNIQUE_WITHIN_PERSPECTIVE"


@dataclass(frozen=True)
class Constraint:
    name: str
    attribute: str
    kind: ConstraintKind = ConstraintKind.UNIQUE


@dataclass(frozen=True)
class Crosswalk:
    perspective: str
    uid: str
    canonical_id: str
    start_ts: int
    end_ts: int


@dataclass(frozen=True)
class EntityType:
    name: str
    attributes: tuple[str, ...] = ()
    key_attributes: tuple[str, ...] = ()
    requires_strong_identifier: bool = False


@dataclass
class Ontology:
    identity_keys: list[IdentityKey] = field(default_factory=list)
    strong_identifiers: list[StrongIdentifier] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    crosswalks: list[Crosswalk] = field(default_factory=list)
    entity_types: dict[str, EntityType] = field(default_factory=dict)
    perspective_weights: dict[str, int] = field(default_factory=dict)
    permanent_attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Intervals of one attribute that take part in a record's keys, the longest first; None: all of them.
    key_intervals: int | None = 8

    def add_identity_key(self, name: str, *attributes: str) -> Ontology:
        self.identity_keys.append(IdentityKey(name, attributes))
        return self

    def add_strong_identifier(self, attribute: str, name: str = "") -> Ontology:
        self.strong_identifiers.append(StrongIdentifier(attribute, name or attribute))
        return self

    def add_constraint(self, name: str, attribute: str, kind: ConstraintKind | str = ConstraintKind.UNIQUE) -> Ontology:
        self.constraints.append(Constraint(name, attribute, ConstraintKind(kind)))
        return self

    def add_crosswalk(self, crosswalk: Crosswalk) -> Ontology:
        self.crosswalks.append(crosswalk)
        return self

    def add_entity_type(self, entity_type: EntityType) -> Ontology:
        self.entity_types[entity_type.name] = entity_type
        return self

    # keys and strong identifiers hold for every entity type
    def identity_keys_for_type(self, entity_type: str) -> list[IdentityKey]:
        return list(self.identity_keys)

    def strong_identifiers_for_type(self, entity_type: str) -> list[StrongIdentifier]:
        return list(self.strong_identifiers)

    def is_strong_identifier(self, entity_type: str, attribute: str) -> bool:
        return attribute in self.strong_attributes

    @property
    def strong_attributes(self) -> list[str]:
        return list(dict.fromkeys(s.attribute for s in self.strong_identifiers))

    @property
    def constraint_attributes(self) -> list[str]:
        return list(dict.fromkeys(c.attribute for c in self.constraints))

    def crosswalks_for_perspective(self, perspective: str) -> list[Crosswalk]:
        return [c for c in self.crosswalks if c.perspective == perspective]

    def constraints_for_attribute(self, attribute: str) -> list[Constraint]:
        return [c for c in self.constraints if c.attribute == attribute]

    def weight(self, perspective: str) -> int:
        return self.perspective_weights.get(perspective, 0)

    def compare_perspectives(self, a: str, b: str) -> int:
        """Negative where ``a`` comes first, the heavier coming first."""
        return self.weight(b) - self.weight(a)

    def has_higher_precedence(self, a: str, b: str) -> bool:
        return self.weight(a) > self.weight(b)

    def is_permanent_attribute(self, perspective: str, attribute: str) -> bool:
        return attribute in self.permanent_attributes.get(perspective, ())

    def authoritative_perspective(self, attribute: str) -> str | None:
        """The heaviest perspective that owns the attribute; its weight must be above 0; of equals the first by name."""
        owners = [(-self.weight(p), p) for p, attrs in self.permanent_attributes.items() if attribute in attrs and self.weight(p) > 0]
        return min(owners)[1] if owners else None

    def key_attributes_for_type(self, entity_type: str) -> tuple[list[str], str]:
        """The attributes that a cluster key is made of, and their name."""
        of = self.entity_types.get(entity_type)
        if of and of.key_attributes:
            return list(of.key_attributes), "entity_key"
        if self.identity_keys:
            longest = max(self.identity_keys, key=lambda k: len(k.attributes))
            return list(longest.attributes), longest.name
        return [], "fallback"

    def to_dict(self) -> dict:
        return {
            "identity_keys": [{"name": k.name, "attributes": list(k.attributes)} for k in self.identity_keys],
            "strong_identifiers": [{"attribute": s.attribute, "name": s.name} for s in self.strong_identifiers],
            "constraints": [{"name": c.name, "attribute": c.attribute, "kind": c.kind.value} for c in self.constraints],
            "crosswalks": [vars(c) for c in self.crosswalks],
            "entity_types": [{"name": t.name, "attributes": list(t.attributes), "key_attributes": list(t.key_attributes), "requires_strong_identifier": t.requires_strong_identifier} for t in self.entity_types.values()],
            "perspective_weights": self.perspective_weights,
            "permanent_attributes": {p: list(a) for p, a in self.permanent_attributes.items()},
            "key_intervals": self.key_intervals,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, d: dict) -> Ontology:
        out = cls(
            perspective_weights=dict(d.get("perspective_weights", {})),
            permanent_attributes={p: tuple(a) for p, a in d.get("permanent_attributes", {}).items()},
            key_intervals=d.get("key_intervals", 8),
        )
        for k in d.get("identity_keys", []):
            out.add_identity_key(k["name"], *k["attributes"])
        for s in d.get("strong_identifiers", []):
            out.add_strong_identifier(**(s if isinstance(s, dict) else {"attribute": s}))
        for c in d.get("constraints", []):
            out.add_constraint(c["name"], c["attribute"], c.get("kind", "UNIQUE"))
        for c in d.get("crosswalks", []):
            out.add_crosswalk(Crosswalk(**c))
        for t in d.get("entity_types", []):
            out.add_entity_type(EntityType(t["name"], tuple(t.get("attributes", ())), tuple(t.get("key_attributes", ())), t.get("requires_strong_identifier", False)))
        return out

    @classmethod
    def from_json(cls, text: str) -> Ontology:
        return cls.from_dict(json.loads(text))

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, list(self.perspective_weights.items()), "perspective string, weight long")

    def crosswalk_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.perspective, c.uid, c.canonical_id, c.start_ts, c.end_ts) for c in self.crosswalks]
        return local_frame(spark, rows, "perspective string, uid string, canonical_id string, start_ts long, end_ts long")
