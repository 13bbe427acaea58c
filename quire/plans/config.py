"""Inheritable profiles: resolution on the driver, settings as tables.

A profile is a dict with ``key``, an optional ``extends`` (one key or several),
``modules`` and nested settings.  Children's dicts merge into their parents',
scalars and lists replace, null overrides; modules append unless
``modules_replace`` is given; ``<name>_replace`` replaces a list or dict whole."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ["error", "warning", "pass", "skipped", "unverifiable"]


class ConfigError(ValueError):
    """A profile that can't be resolved."""


def merged(base: dict, child: dict) -> dict:
    """``child`` merged over ``base``."""
    out = dict(base)
    for k, v in child.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolved(key: str, profiles: dict[str, dict], seen: tuple[str, ...] = ()) -> dict:
    """The profile with all it inherits, and its lineage from the root."""
    if key in seen:
        raise ConfigError(f"profiles extend one another in a circle: {' -> '.join((*seen, key))}")
    if key not in profiles:
        raise ConfigError(f"no profile {key!r}")
    own = dict(profiles[key])
    parents = own.pop("extends", [])
    base: dict[str, Any] = {"lineage": [], "modules": []}
    for p in [parents] if isinstance(parents, str) else parents:
        up = resolved(p, profiles, (*seen, key))
        base = merged(base, {**up, "modules": [], "lineage": []}) | {"modules": list(dict.fromkeys(base["modules"] + up["modules"])), "lineage": list(dict.fromkeys(base["lineage"] + up["lineage"]))}
    replaced = own.pop("modules_replace", None)
    modules = replaced if replaced is not None else list(dict.fromkeys(base["modules"] + own.get("modules", [])))
    for k in [k for k in own if k.endswith("_replace")]:
        base[k[: -len("_replace")]] = own.pop(k)
    return merged(base, own) | {"modules": modules, "lineage": [*base["lineage"], key], "key": key}


def flat(settings: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted path → value of the leaves."""
    out: dict[str, Any] = {}
    for k, v in settings.items():
        path = f"{prefix}{k}"
        out |= flat(v, path + ".") if isinstance(v, dict) and v else {path: v}
    return out


_MISSING = object()


def setting(profile: dict, path: str, default: Any = None, track: str | None = None) -> Any:
    """A setting by dotted path; a track's settings win, and its null removes the value."""
    own = flat(profile.get("tracks", {}).get(track, {}).get("settings", {})) if track else {}
    if path in own:
        return own[path]
    node: Any = profile
    for part in path.split("."):
        node = node.get(part, _MISSING) if isinstance(node, dict) else _MISSING
        if node is _MISSING:
            return default
    return node


def validated(profile: dict) -> dict:
    """The profile, if its tracks and severities are sound."""
    tracks = profile.get("tracks")
    if not tracks:
        raise ConfigError("a profile needs tracks")
    if profile.get("default_track", next(iter(tracks))) not in tracks:
        raise ConfigError("the default track is none of the tracks")
    for check, s in profile.get("severity_overrides", {}).items():
        if s not in SEVERITIES:
            raise ConfigError(f"{check}: no severity {s!r}")
    return profile


def settings_table(spark: SparkSession, profiles: dict[str, dict]) -> DataFrame:
    """(profile, path, value): every resolved leaf as text."""
    rows = [(k, p, None if v is None else str(v)) for k in profiles for p, v in flat(resolved(k, profiles)).items()]
    return spark.createDataFrame(rows, "profile string, path string, value string")


def inheritance(edges: DataFrame, settings: DataFrame, rounds: int = 16) -> DataFrame:
    """(profile, path, value): settings inherited along (profile, parent) edges; the
    nearest ancestor's value wins.  Edges in a circle end after ``rounds`` steps."""
    reach = settings.select(F.col("profile").alias("owner")).union(edges.select("profile")).distinct().select(F.col("owner").alias("profile"), F.col("owner"), F.lit(0).alias("steps"))
    front, all_ = reach, reach
    for k in range(1, rounds):
        front = front.join(edges.withColumnRenamed("profile", "owner"), "owner").select("profile", F.col("parent").alias("owner"), F.lit(k).alias("steps"))
        if front.isEmpty():
            break
        all_ = all_.unionByName(front)
    at = all_.join(settings.withColumnRenamed("profile", "owner"), "owner")
    return at.groupBy("profile", "path").agg(F.min_by("value", "steps").alias("value"))
