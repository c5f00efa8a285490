"""Content-addressed identities of derived products and what a change invalidates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Components in the order in which they are built.
COMPONENTS = ("source", "geometry", "climate", "events", "traits", "vase", "render")


def stable_json(value: Any) -> str:
    """JSON with sorted keys and no spaces; what JSON has no type for becomes text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def content_hash(value: Any, length: int = 16) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()[:length]


# The names in a key's payload, which its hash depends on: component, identity, versions, inputs, and
# below the names of the identities, versions and inputs of each kind.


def cache_key(component: str, identity: Mapping, versions: Mapping, inputs: Mapping | None = None) -> str:
    return f"{component}:" + content_hash({"component": component, "identity": identity, "versions": versions, "inputs": inputs or {}}, 24)


def geometry_key(fire_id: str, source_geometry_hash: str, geometry_version: str, geometry_method: str = "canonical_fire_time_geometry") -> str:
    return cache_key("geometry", {"fire_id": fire_id}, {"geometry": geometry_version}, {"method": geometry_method, "source_geometry_hash": source_geometry_hash})


def climate_key(fire_id: str, geometry_cache_key: str, climate_source: str, variables: Sequence[str], temporal_resolution: str, climate_version: str) -> str:
    inputs = {"climate_source": climate_source, "geometry_cache_key": geometry_cache_key, "temporal_resolution": temporal_resolution, "variables": sorted(variables)}
    return cache_key("climate", {"fire_id": fire_id}, {"climate": climate_version}, inputs)


def event_key(fire_id: str, climate_cache_key: str, event_version: str, method: str, parameters: Mapping) -> str:
    return cache_key("events", {"fire_id": fire_id}, {"events": event_version}, {"climate_cache_key": climate_cache_key, "method": method, "parameters": parameters})


def vase_key(fire_id: str, geometry_cache_key: str, climate_cache_key: str, vase_version: str, parameters: Mapping) -> str:
    return cache_key("vase", {"fire_id": fire_id}, {"vase": vase_version}, {"climate_cache_key": climate_cache_key, "geometry_cache_key": geometry_cache_key, "parameters": parameters})


def render_key(fire_id: str, vase_cache_key: str, render_version: str, asset_type: str, parameters: Mapping | None = None) -> str:
    return cache_key("render", {"fire_id": fire_id, "asset_type": asset_type}, {"render": render_version}, {"parameters": parameters or {}, "vase_cache_key": vase_cache_key})


def invalidated(changed: Iterable[str]) -> tuple[str, ...]:
    """The changed components and all that are built after them; the order is a chain."""
    changed = list(changed)
    if unknown := set(changed) - set(COMPONENTS):
        raise ValueError(f"unknown components {sorted(unknown)}")
    return COMPONENTS[min(map(COMPONENTS.index, changed)) :] if changed else ()


def _quoted(c: Column) -> Column:
    """A column of text as a JSON string, with the escapes of plain JSON."""
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def key_column(component: str, identity: Mapping[str, Column], versions: Mapping[str, str], inputs: Mapping[str, Column | str | list]) -> Column:
    """:func:`cache_key` over columns of ASCII text, without leaving the JVM: the JSON is put together in key order."""
    def part(value: Any) -> Column:
        return _quoted(value) if isinstance(value, Column) else F.lit(stable_json(value))

    def block(items: Mapping[str, Any]) -> list[Column]:
        out: list[Column] = [F.lit("{")]
        for i, k in enumerate(sorted(items)):
            out += [F.lit(("," if i else "") + json.dumps(k) + ":"), part(items[k])]
        return [*out, F.lit("}")]

    payload = F.concat(F.lit(f'{{"component":"{component}","identity":'), *block(identity), F.lit(',"inputs":'), *block(inputs), F.lit(',"versions":'), *block(versions), F.lit("}"))
    return F.concat(F.lit(f"{component}:"), F.substring(F.sha2(payload, 256), 1, 24))
