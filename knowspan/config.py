"""Settings of the operators, with the defaults they have in production."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Gate:
    """What a document has to be to enter. Thresholds, directories and names."""

    enabled: bool = True
    min_size: int | None = 512
    min_chars: int | None = 300
    code_ratio: float | None = 0.6
    blacklist: tuple[str, ...] = ()
    path_whitelist: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ("node_modules", "dist", "build", "out", "coverage", ".git", "__pycache__", ".venv", "venv", "target", "vendor", ".next", ".cache", ".idea", ".vscode", ".output", ".nuxt")
    name_whitelist: tuple[str, ...] = ("AGENTS.md", "AGENT.md", "CLAUDE.md", "SKILL.md", "SKILLS.md")
    keywords: tuple[str, ...] = ("prd", "需求", "测试", "test record", "复盘", "设计", "方案", "总结", "笔记")


@dataclass(frozen=True)
class Search:
    limit: int = 20
    oversample: int = 3
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Attention:
    warm_days: int = 90
    cold_days: int = 180
    warm_touches: int = 1
    cooling_hours: int = 48
    duplicate_cosine: float = 0.92
    neighbours: int = 50
    neighbour_days: int = 30
    daily_limit: int = 5
    soft_percent: float = 80
    queue_cap: int = 20
    stages_five: tuple[int, ...] = (1, 3, 7, 14, 30)
    stages_three: tuple[int, ...] = (1, 3, 7)


@dataclass(frozen=True)
class Sessions:
    gap_minutes: int = 30
    weak_overlap: float = 0.2


def load(kind: type, text: str | None):
    """Settings of ``kind`` from JSON text; what is missing, of the wrong type or not JSON keeps its default."""
    base = kind()
    try:
        given = json.loads(text or "{}")
    except ValueError:
        return base
    if not isinstance(given, dict):
        return base
    change = {}
    for f in fields(kind):
        if f.name in given:
            value, default = given[f.name], getattr(base, f.name)
            if isinstance(default, tuple):
                if isinstance(value, list) and all(isinstance(x, type(default[0]) if default else str) for x in value):
                    change[f.name] = tuple(value)
            elif isinstance(value, bool) == isinstance(default, bool) and isinstance(value, (int, float, type(default))):
                change[f.name] = value
    return replace(base, **change)


def gate_issues(gate: Gate) -> list[tuple[str, str]]:
    """(field, what is wrong) of gate settings."""
    found = []
    for name in ("min_size", "min_chars"):
        value = getattr(gate, name)
        if value is not None and value < 0:
            found.append((name, "is negative"))
    if gate.code_ratio is not None and not 0 <= gate.code_ratio <= 1:
        found.append(("code_ratio", "isn't between 0 and 1"))
    found += [("exclude_dirs", f"{d} has a slash and can't match a segment") for d in gate.exclude_dirs if "/" in d]
    found += [(f.name, "has an empty entry") for f in fields(Gate) if isinstance(getattr(gate, f.name), tuple) and any(not e.strip() for e in getattr(gate, f.name))]
    return found
