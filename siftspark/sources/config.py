"""Folder configuration from YAML, checked when it is read."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field

from siftspark.operators.tags import GATES

# Processor kinds in the order they run, and other keys of a block.
KINDS = ("image_embed", "tagger", "ocr", "caption", "topic_kw", "text_embed", "faces", "layout")
OTHER_KEYS = ("route", "ocr_when", "caption_when", "exclude_patterns", "overrides")
LOCKED = ("text_embed", "image_embed", "faces")  # models that must agree for results to be compared


@dataclass(frozen=True)
class Folder:
    path: str
    processors: dict[str, str]
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    auto: bool = False
    gates: dict[str, tuple[tuple[str, ...], int]] = field(default_factory=lambda: dict(GATES))
    excludes: tuple[str, ...] | None = None

    def processors_for(self, path: str) -> dict[str, str]:
        parts = {p.lower() for p in path.split("/")}
        return next((p for n, p in self.overrides.items() if n.lower() in parts), self.processors)


@dataclass(frozen=True)
class Config:
    folders: dict[str, Folder] = field(default_factory=dict)
    private: tuple[str, ...] = ()

    def models(self) -> set[tuple[str, str]]:
        return {kv for f in self.folders.values() for block in (f.processors, *f.overrides.values()) for kv in block.items()}


def off(value: object) -> bool:
    return value is None or value is False or (isinstance(value, str) and value.strip().lower() == "off")


def _strings(value: object, what: str) -> tuple[str, ...]:
    value = [value] if isinstance(value, str) else value
    if not isinstance(value, list) or any(not isinstance(v, str) for v in value):
        raise ValueError(f"{what} must be a list of strings, not {value!r}")
    return tuple(value)


def _processors(block: dict, defaults: dict, where: str) -> dict[str, str]:
    if strange := sorted(set(block) - set(KINDS) - set(OTHER_KEYS)):
        warnings.warn(f"unknown keys {strange} in {where} are ignored", stacklevel=3)
    chosen = {k: block.get(k, defaults.get(k)) for k in KINDS}
    chosen = {k: v for k, v in chosen.items() if not off(v)}
    for k, v in chosen.items():
        if not isinstance(v, str):
            raise ValueError(f"{k} in {where} must be a model name or 'off', not {v!r}")
    return chosen


def parse(raw: dict) -> Config:
    defaults = raw.get("defaults") or {}
    if strange := sorted(set(defaults) - set(KINDS)):
        warnings.warn(f"unknown keys {strange} in defaults are ignored", stacklevel=2)
    folders = {}
    for name, block in (raw.get("folders") or {}).items():
        block, where = block or {}, f"folder {name!r}"
        route = block.get("route")
        if route is not None and (not isinstance(route, str) or route.strip().lower() != "auto"):
            raise ValueError(f"route in {where} must be 'auto' or left out, not {route!r}")
        gates = {k: (_strings(block[f"{k}_when"], f"{k}_when in {where}") if block.get(f"{k}_when") is not None else labels, rank) for k, (labels, rank) in GATES.items()}
        excludes = block.get("exclude_patterns")
        if excludes is not None:
            excludes = _strings(excludes, f"exclude_patterns in {where}")
            for p in excludes:
                try:
                    re.compile(p)
                except re.error as e:
                    raise ValueError(f"exclude_patterns in {where}: {p!r} is no pattern: {e}") from e
        overrides = {n: _processors(b or {}, defaults, f"override {n!r} of {where}") for n, b in (block.get("overrides") or {}).items()}
        folders[name] = Folder(os.path.expanduser(name), _processors(block, defaults, where), overrides, route is not None, gates, excludes)
    private = raw.get("private")
    config = Config(folders, () if private is None else tuple(map(os.path.expanduser, _strings(private, "private"))))
    for kind in LOCKED:
        used: dict[str, list[str]] = {}
        for name, f in folders.items():
            if kind in f.processors:
                used.setdefault(f.processors[kind], []).append(name)
        if len(used) > 1:
            warnings.warn(f"folders use different {kind} models, whose results cannot be compared: {used}", stacklevel=2)
    return config


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f) or {})
