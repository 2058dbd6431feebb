"""Profiles: everything about a domain that the operators need, declared.

A profile is a YAML file, or one of the presets here. It holds the heading levels and reference patterns of a
kind of document, the closed schema of its graph, and how entities are resolved, indexed, validated and
retrieved. Loading checks it: an error here is better than an empty result on a cluster.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from typing import Any


class ProfileError(ValueError):
    pass


def safe_name(name: str) -> str:
    """The name itself if it is made of letters, digits and underscores; anything else may not become part of a query."""
    if not name or not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ProfileError(f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class Level:
    name: str
    pattern: str

    @property
    def groups(self) -> int:
        return re.compile(self.pattern).groups


@dataclass(frozen=True)
class Reference:
    name: str
    pattern: str
    target_level: str
    relation: str = "REFERS_TO"


@dataclass(frozen=True)
class Kind:
    """A label or relation. Without declared properties it has a name and is open; with them it is closed."""

    label: str
    properties: tuple[tuple[str, str, bool], ...] = (("name", "STRING", False),)
    closed: bool = False


@dataclass(frozen=True)
class Resolution:
    labels: tuple[str, ...]
    strategy: str
    threshold: float = 0.9


@dataclass(frozen=True)
class Profile:
    name: str
    levels: tuple[Level, ...]
    chunk_at: str
    max_chars: int = 4000
    split_at: str | None = None
    references: tuple[Reference, ...] = ()
    labels: tuple[Kind, ...] = ()
    relations: tuple[Kind, ...] = ()
    patterns: tuple[tuple[str, str, str], ...] = ()
    parser_relations: tuple[str, ...] = ()
    resolution: tuple[Resolution, ...] = ()
    vector: dict[str, Any] = field(default_factory=dict)
    fulltext: dict[str, Any] = field(default_factory=dict)
    constraints: tuple[tuple[str, str], ...] = ()
    max_degree: int = 500
    exempt: tuple[str, ...] = ()
    min_coverage: float = 0.9
    no_orphans: tuple[str, ...] = ()
    hops: int = 2
    expansion: str = ""
    vocabulary: dict[str, Any] = field(default_factory=dict)
    additional: tuple[bool, bool, bool] = (False, False, False)

    @property
    def chunk_rank(self) -> int:
        return [x.name for x in self.levels].index(self.chunk_at)

    def check(self) -> Profile:
        """Raise at the first rule that the profile breaks."""
        names = [x.name for x in self.levels]
        if self.chunk_at not in names:
            raise ProfileError(f"chunks are cut at {self.chunk_at!r}, which is none of the levels {names}")
        for p in [x.pattern for x in self.levels] + [x.pattern for x in self.references] + ([self.split_at] if self.split_at else []):
            if re.compile(p, re.M).search(""):
                raise ProfileError(f"a pattern that can match nothing has no place: {p!r}")
        if any(self.additional):
            raise ProfileError("the schema must be closed: additional types and patterns are not allowed")
        labels, relations = {x.label for x in self.labels}, {x.label for x in self.relations}
        for a, r, b in self.patterns:
            if {a, b} - labels or r not in relations:
                raise ProfileError(f"pattern {(a, r, b)} names what is not declared")
        for kind in (*self.labels, *self.relations):
            safe_name(kind.label)
            if kind.closed and not kind.properties:
                raise ProfileError(f"{kind.label}: an empty list of properties; leave it out for an open one")
        for label, prop in self.constraints:
            safe_name(label), safe_name(prop)
        return self


def _kind(entry: Any) -> Kind:
    if isinstance(entry, str):
        return Kind(entry)
    if "properties" not in entry:
        return Kind(entry["label"])
    own = tuple((p["name"], p.get("type", "STRING"), bool(p.get("required", False))) for p in entry["properties"] or ())
    if not own:
        raise ProfileError(f"{entry['label']}: an empty list of properties; leave it out for an open one")
    return Kind(entry["label"], own, True)


def from_dict(data: dict) -> Profile:
    """A profile from the nested dictionary of its YAML file."""
    seg, schema = data["segmentation"], data.get("schema") or {}
    valid, get, index = data.get("validation") or {}, data.get("retrieval") or {}, data.get("indexes") or {}
    return Profile(
        name=data["name"],
        levels=tuple(Level(x["level"], x["pattern"]) for x in seg["hierarchy"]),
        chunk_at=seg["chunk_at"],
        max_chars=int(seg.get("max_chunk_chars", 4000)),
        split_at=seg.get("subsplit_pattern"),
        references=tuple(Reference(x.get("name", ""), x["pattern"], x.get("target_level", ""), x.get("relation", "REFERS_TO")) for x in seg.get("xref_patterns") or ()),
        labels=tuple(map(_kind, schema.get("node_types") or ())),
        relations=tuple(map(_kind, schema.get("relationship_types") or ())),
        patterns=tuple(tuple(x) for x in schema.get("patterns") or ()),
        parser_relations=tuple(data.get("deterministic_relations") or ()),
        resolution=tuple(Resolution(tuple(x["labels"]), x["strategy"], float(x.get("threshold", 0.9))) for x in data.get("resolution") or ()),
        vector=dict(index.get("vector") or {}),
        fulltext=dict(index.get("fulltext") or {}),
        constraints=tuple((x["label"], x["property"]) for x in index.get("constraints") or ()),
        max_degree=int(valid.get("max_degree", 500)),
        exempt=tuple(valid.get("degree_exempt") or valid.get("max_degree_exempt") or ()),
        min_coverage=float(valid.get("min_provenance_coverage", 0.9)),
        no_orphans=tuple(valid.get("forbid_orphan_labels") or ()),
        hops=int(get.get("hops", 2)),
        expansion=get.get("expansion") or get.get("expansion_query") or "",
        vocabulary=dict(data.get("vocabulary") or {}),
        additional=tuple(bool(schema.get(k, False)) for k in ("additional_node_types", "additional_relationship_types", "additional_patterns")),
    ).check()


def load(name: str, folders: tuple[str, ...] = ("profiles", ".")) -> Profile:
    """A profile by path, by its file's name in one of the folders (.yaml or .yml), or by a preset's name."""
    import yaml

    tried = [name] + [os.path.join(f, name + e) for f in folders for e in ("", ".yaml", ".yml")]
    for path in tried:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return from_dict(yaml.safe_load(f))
    if name in PRESETS:
        return PRESETS[name]
    raise ProfileError(f"no profile {name!r}; presets are {sorted(PRESETS)}")


# Presets

_ROMAN, _MARK = "[IVXLC]", "[-–—:.]"


def _heading(word: str, number: str) -> str:
    """A heading word, its number, perhaps a mark, and the title, which may stand on the next line."""
    return "".join(["^", r"\s*", word, r"\s+", f"({number})", r"\s*", _MARK, "?", r"\s*", "(.*)", "$"])


def _article(lead: str) -> str:
    return lead + r"articles?\s*(\d+)"


_BIS = r"\d+(?:\s*(?:bis|ter|quater))?"
_ELIDED = "(?:l.)?"

STATUTES = Profile(
    name="statutes",
    levels=(
        Level("livre", _heading("LIVRE", _ROMAN + "+")),
        Level("titre", _heading("TITRE", _ROMAN + "+")),
        Level("chapitre", _heading("CHAPITRE", "[IVXLC0-9]+")),
        Level("section", _heading("Section", "[0-9IVXLC]+")),
        Level("article", _heading("Article", _BIS)),
    ),
    chunk_at="article",
    max_chars=4000,
    split_at=r"^\s*(?:\d+[°)]|[a-z]\))\s+",
    references=(
        Reference("article", rf"(?:articles?|art\.)\s*({_BIS})", "article"),
        Reference("paragraph", r"alin[ée]as?\s*(premier|second|\d+)", "alinea"),
        Reference("repeal", _article(r"(?:abrogation de|abrog[ée])\s+" + _ELIDED), "article", "REPEALS"),
        Reference("amendment", _article(r"(?:remplac[ée]|modifi[ée])\s+" + _ELIDED), "article", "AMENDS"),
        Reference("derogation", _article(r"(?:nonobstant|par d[ée]rogation)\s+(?:l.|aux?\s+)?"), "article", "DEROGATES_FROM"),
        Reference("condition", _article(r"sous r[ée]serve\s+(?:des?\s+dispositions\s+)?(?:du\s+|de\s+l.)?"), "article", "EXCEPTION_TO"),
    ),
    labels=tuple(map(Kind, "Act Clause Definition Obligation Actor Condition Sanction Authority Jurisdiction".split())),
    relations=tuple(map(Kind, "CONTAINS PARENT_OF DEFINES REFERS_TO AMENDS REPEALS EXCEPTION_TO DEROGATES_FROM IMPOSES APPLIES_TO CONDITIONED_ON SANCTIONED_BY ENFORCES IN_FORCE_IN".split())),
    patterns=(
        ("Act", "CONTAINS", "Clause"), ("Act", "IN_FORCE_IN", "Jurisdiction"), ("Clause", "DEFINES", "Definition"), ("Clause", "IMPOSES", "Obligation"),
        *(("Clause", r, "Clause") for r in ("REFERS_TO", "PARENT_OF", "REPEALS", "AMENDS", "DEROGATES_FROM", "EXCEPTION_TO")),
        ("Obligation", "SANCTIONED_BY", "Sanction"), ("Obligation", "CONDITIONED_ON", "Condition"), ("Obligation", "APPLIES_TO", "Actor"), ("Authority", "ENFORCES", "Obligation"),
    ),
    parser_relations=("REPEALS", "AMENDS", "REFERS_TO", "PARENT_OF", "CONTAINS"),
    resolution=(Resolution(("Jurisdiction", "Authority", "Actor"), "fuzzy", 0.9), Resolution(("Definition",), "exact")),
    vector={"name": "chunk_vectors", "label": "Chunk", "property": "embedding", "dimensions": 1536, "similarity": "cosine"},
    fulltext={"name": "chunk_words", "labels": ["Chunk"], "properties": ["text"]},
    constraints=(("Act", "name"), ("Clause", "name"), ("Document", "path"), ("Chunk", "id")),
    max_degree=300,
    min_coverage=0.95,
    no_orphans=("Condition", "Sanction", "Obligation"),
    hops=3,
    expansion="statutes",
).check()

COOKBOOK = Profile(
    name="cookbook",
    levels=(Level("section", r"^#\s+(.+)$"), Level("recipe", r"^##\s+(.+)$")),
    chunk_at="recipe",
    max_chars=6000,
    split_at=r"^###\s+(?:Notes|Method|Instructions|Ingredients)",
    references=(Reference("recipe", r"(?:cf\.|voir|see)\s+(?:recipe\s+)?" + '"([^"]+)"', "recipe", "PAIRS_WITH"),),
    labels=tuple(map(Kind, "Recipe Ingredient Technique Equipment Cuisine Course Allergen DietTag".split())),
    relations=tuple(map(Kind, "USES_INGREDIENT REQUIRES_TECHNIQUE REQUIRES_EQUIPMENT BELONGS_TO IS_COURSE VARIANT_OF PAIRS_WITH SUBSTITUTES_FOR CONTAINS_ALLERGEN EXCLUDED_BY EXCLUDES".split())),
    patterns=(
        *(("Recipe", r, x) for r, x in (("PAIRS_WITH", "Recipe"), ("VARIANT_OF", "Recipe"), ("IS_COURSE", "Course"), ("BELONGS_TO", "Cuisine"), ("REQUIRES_EQUIPMENT", "Equipment"), ("REQUIRES_TECHNIQUE", "Technique"), ("USES_INGREDIENT", "Ingredient"))),
        *(("Ingredient", r, x) for r, x in (("EXCLUDED_BY", "DietTag"), ("CONTAINS_ALLERGEN", "Allergen"), ("SUBSTITUTES_FOR", "Ingredient"))),
        ("DietTag", "EXCLUDES", "Allergen"),
    ),
    parser_relations=("PAIRS_WITH",),
    resolution=(Resolution(("Ingredient",), "vocabulary"), Resolution(("Cuisine", "Equipment", "Technique"), "fuzzy", 0.88), Resolution(("Course", "DietTag", "Allergen"), "exact")),
    vector={"name": "chunk_vectors", "label": "Chunk", "property": "embedding", "dimensions": 1536, "similarity": "cosine"},
    fulltext={"name": "chunk_words", "labels": ["Chunk"], "properties": ["text"]},
    constraints=(("Ingredient", "name"), ("Recipe", "name"), ("Chunk", "id")),
    max_degree=5000,
    exempt=("olive oil", "black pepper", "water", "salt"),
    min_coverage=0.9,
    no_orphans=("Technique", "Ingredient"),
    expansion="cookbook",
).check()

_CAPS = r"[A-Z0-9'\-]"
HANDBOOK = Profile(
    name="handbook",
    levels=(
        Level("part", _heading("(?:Part|PART)", "[IVXLC0-9]+")),
        Level("chapter", _heading("(?:Chapter|CHAPTER)", "[IVXLC0-9]+|[A-Z][a-z]+")),
        Level("section", "^([A-Z]" + _CAPS + "{3,}(?:" + r"\s+" + _CAPS + r"+){0,6})\s*$"),
    ),
    chunk_at="section",
    max_chars=5000,
    split_at=r"^\s*(?:\d+[.)]|Step\s+\d+)\s+",
    references=(Reference("chapter", r"see\s+chapter\s+([IVXLC0-9]+)", "chapter"), Reference("page", r"see\s+(?:p\.|page)\s*(\d+)", "page")),
    labels=tuple(map(Kind, "FireLay Technique Material Tool Purpose Condition Hazard SafetyRule".split())),
    relations=tuple(map(Kind, "SERVES_PURPOSE REQUIRES_MATERIAL BUILT_WITH REQUIRES_TOOL SUITED_FOR UNSUITED_FOR HAS_HAZARD MITIGATED_BY VARIANT_OF PREPARED_BY SUBSTITUTES_FOR".split())),
    patterns=(
        *(("FireLay", r, x) for r, x in (("SERVES_PURPOSE", "Purpose"), ("REQUIRES_MATERIAL", "Material"), ("BUILT_WITH", "Technique"), ("SUITED_FOR", "Condition"), ("UNSUITED_FOR", "Condition"), ("VARIANT_OF", "FireLay"), ("HAS_HAZARD", "Hazard"))),
        *(("Technique", r, x) for r, x in (("REQUIRES_MATERIAL", "Material"), ("REQUIRES_TOOL", "Tool"), ("SUITED_FOR", "Condition"), ("UNSUITED_FOR", "Condition"), ("HAS_HAZARD", "Hazard"), ("VARIANT_OF", "Technique"))),
        ("Material", "SUBSTITUTES_FOR", "Material"), ("Material", "SUITED_FOR", "Condition"), ("Tool", "SUBSTITUTES_FOR", "Tool"), ("Hazard", "MITIGATED_BY", "SafetyRule"),
    ),
    resolution=(Resolution(("Purpose", "Tool", "Technique", "FireLay"), "fuzzy", 0.88), Resolution(("Condition", "Material"), "semantic", 0.9), Resolution(("Hazard",), "fuzzy", 0.9)),
    vector={"name": "chunk_vectors", "label": "Chunk", "property": "embedding", "dimensions": 384, "similarity": "cosine"},
    fulltext={"name": "chunk_words", "labels": ["Chunk"], "properties": ["text"]},
    constraints=(("Technique", "name"), ("FireLay", "name"), ("Chunk", "id")),
    max_degree=200,
    exempt=("dry wood", "fuel", "kindling", "tinder", "wood", "fire"),
    min_coverage=0.85,
    no_orphans=("Hazard", "Technique", "FireLay"),
    expansion="handbook",
).check()

PRESETS = {p.name: p for p in (STATUTES, COOKBOOK, HANDBOOK)}


def with_limits(profile: Profile, **changes: Any) -> Profile:
    return replace(profile, **changes).check()
