"""Configuration: sections of parameters from YAML with overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from tessera.schema import Chunking, Evaluation, Layout, Retrieval


@dataclass(frozen=True)
class Generation:
    default_task: str = "wiki"
    assistant_fallback: bool = True
    query_rewrite: bool = True
    history_turns: int = 4
    task_classification: bool = True
    prepare: str = "merged"
    scope_inference: bool = True
    scope_inference_mode: str = "merged"
    inline_images: int = 4
    timeout_seconds: float | None = 180.0


@dataclass(frozen=True)
class Api:
    public_base_url: str = "http://localhost:8000"
    concurrent: int = 6
    depth: int = 12
    retry_after: int = 15
    timeout_seconds: float | None = 300.0


@dataclass(frozen=True)
class Config:
    layout: Layout = field(default_factory=Layout)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    evaluation: Evaluation = field(default_factory=Evaluation)
    generation: Generation = field(default_factory=Generation)
    api: Api = field(default_factory=Api)


def _typed(current: Any, value: Any, name: str) -> Any:
    """``value`` as the type of the default; timeouts that are null, zero or negative are off."""
    if name.endswith("timeout_seconds"):
        return float(value) if value not in (None, "") and float(value) > 0 else None
    if value is None or current is None:
        return value if not isinstance(value, str) or value == "" else float(value)
    if isinstance(current, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(current, (int, float)):
        return type(current)(value)
    if isinstance(current, tuple):
        return tuple(int(x) for x in (value.split(",") if isinstance(value, str) else value))
    return value


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """The defaults, changed by a YAML file and then by ``TESSERA_SECTION_NAME`` variables."""
    given: dict[str, dict] = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as file:
            given = yaml.safe_load(file) or {}
    environment = os.environ if environment is None else environment
    config = Config()
    for section in fields(config):
        own = getattr(config, section.name)
        if not is_dataclass(own):
            continue
        changes = {}
        for f in fields(own):
            value = environment.get(f"TESSERA_{section.name}_{f.name}".upper(), (given.get(section.name) or {}).get(f.name, own))
            if value is not own:
                changes[f.name] = _typed(getattr(own, f.name), value, f.name)
        if unknown := set(given.get(section.name) or {}) - {f.name for f in fields(own)}:
            raise ValueError(f"unknown settings in {section.name}: {', '.join(sorted(unknown))}")
        config = replace(config, **{section.name: replace(own, **changes)})
    return config


def for_evaluation(config: Config) -> Config:
    """Deterministic: no rewriting, classification, scope inference or fallback."""
    return replace(config, generation=replace(config.generation, query_rewrite=False, task_classification=False, scope_inference=False, assistant_fallback=False))
