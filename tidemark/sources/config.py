"""Category configuration: a YAML file as checked rows, and the coercion of specifications by its schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("string", "integer", "number", "boolean")


class ConfigError(ValueError):
    """All that is wrong with a file, at once."""


@dataclass(frozen=True)
class Field:
    type: str
    enum: tuple[str, ...] = ()
    unit: str | None = None


@dataclass(frozen=True)
class Category:
    name: str
    fields: dict[str, Field]
    retailers: list[dict[str, Any]] = field(default_factory=list)
    seeds: list[dict[str, Any]] = field(default_factory=list)
    resolution: dict[str, Any] = field(default_factory=dict)
    communities: list[dict[str, Any]] = field(default_factory=list)
    sentiment: dict[str, Any] = field(default_factory=dict)

    def enabled(self) -> list[dict[str, Any]]:
        return [r for r in self.retailers if r.get("enabled", True)]


#: The keys that a file may have, at each place.
TOP = {"name", "spec_schema", "retailers", "seed_products", "resolution", "communities", "sentiment"}
PLACES = {"retailers": ("name", {"name", "base_url", "brand_source", "brand", "fetch", "parser", "enabled", "notes"}), "seed_products": ("model", {"brand", "model", "aliases", "spec"}), "communities": ("id", {"id", "kind", "name", "weight", "window_days", "max_items", "enabled", "notes"})}


def load(path: str | Path) -> Category:
    """The category of a file; raises with every problem that it has."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text())
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} is no mapping")
    return check(raw, str(path))


def check(raw: dict[str, Any], source: str) -> Category:
    wrong = [f"unknown key {k}" for k in sorted(raw.keys() - TOP)]
    if not str(raw.get("name") or "").strip():
        wrong.append("name is missing")
    schema = raw.get("spec_schema") or {}
    if not schema:
        wrong.append("spec_schema has no field")
    fields = {}
    for k, v in schema.items():
        if not isinstance(v, dict) or v.get("type") not in TYPES:
            wrong.append(f"spec_schema.{k}: type must be one of {', '.join(TYPES)}")
            continue
        if v.get("enum") and v["type"] != "string":
            wrong.append(f"spec_schema.{k}: only strings have an enum")
        fields[k] = Field(v["type"], tuple(map(str, v.get("enum") or ())), v.get("unit"))
    for place, (key, known) in PLACES.items():
        seen = set()
        for i, row in enumerate(raw.get(place) or []):
            name = row.get(key)
            wrong += [f"{place}[{i}]: unknown key {k}" for k in sorted(row.keys() - known)]
            if not str(name or "").strip():
                wrong.append(f"{place}[{i}]: {key} is missing")
            ident = (row.get("brand"), name) if place == "seed_products" else name
            if ident in seen:
                wrong.append(f"{place}[{i}]: {ident} stands twice")
            seen.add(ident)
            for k in row.get("spec") or {}:
                if k not in fields:
                    wrong.append(f"{place}[{i}]: spec field {k} is not in spec_schema")
    for k in (raw.get("resolution") or {}).get("identity_fields") or []:
        if k not in fields:
            wrong.append(f"resolution: identity field {k} is not in spec_schema")
    words = raw.get("sentiment") or {}
    wrong += [f"sentiment: {w} is both praise and complaint" for w in sorted(set(words.get("positive") or ()) & set(words.get("negative") or ()))]
    if wrong:
        raise ConfigError(f"{source}:\n  - " + "\n  - ".join(wrong))
    return Category(raw["name"], fields, list(raw.get("retailers") or []), list(raw.get("seed_products") or []), raw.get("resolution") or {}, list(raw.get("communities") or []), words)


def seeds(spark: SparkSession, category: Category) -> DataFrame:
    """brand, model, aliases and spec of the category's seed products."""
    rows = [(s.get("brand"), s["model"], list(s.get("aliases") or []), {k: str(v) for k, v in (s.get("spec") or {}).items()}) for s in category.seeds]
    return spark.createDataFrame(rows, "brand string, model string, aliases array<string>, spec map<string,string>")


def coerced(value: Column, f: Field) -> Column:
    """A text as the field's type, in its plain form; null if it cannot be, or is none of the enum."""
    plain = F.trim(value)
    if f.type == "boolean":
        out = F.when(F.lower(plain).isin("true", "false"), F.lower(plain))
    elif f.type == "integer":
        out = F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("long").cast("string"))
    elif f.type == "number":
        out = plain.try_cast("double").cast("string")
    else:
        out = value
    return F.when(out.isin(list(f.enum)), out) if f.enum else out


def validated(spec: Column, fields: dict[str, Field]) -> Column:
    """What of a map of texts fits the schema: unknown fields, nulls and values of another type or outside the enum go."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), coerced(spec[k], f).alias("v")) for k, f in fields.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def rejected(spec: Column, fields: dict[str, Field]) -> Column:
    """The fields of a map that ``validated`` leaves out, in order."""
    return F.array_sort(F.array_except(F.map_keys(spec), F.map_keys(validated(spec, fields))))
