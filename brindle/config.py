"""Settings from a TOML file: unknown keys are errors, levels are clamped, one source or a list of sources but not both."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

KINDS = ("none", "lite", "db", "mcp")


@dataclass
class SourceConfig:
    kind: str = "none"
    repo: str | None = None
    path: str | None = None
    url: str | None = None
    timeout_ms: int = 5000

    def check(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of source: {self.kind}")
        if self.kind in ("lite", "db") and not self.path or self.kind == "mcp" and not self.url:
            raise ValueError(f"a source of kind {self.kind} needs a {'url' if self.kind == 'mcp' else 'path'}")


@dataclass
class Config:
    default_validation_level: int = 1
    symbol_source: SourceConfig = field(default_factory=SourceConfig)
    symbol_sources: list[SourceConfig] = field(default_factory=list)
    tools: list[str] | None = None

    def sources(self) -> dict[str, SourceConfig]:
        if self.symbol_sources and self.symbol_source.kind != "none":
            raise ValueError("either symbol_source or symbol_sources, not both")
        named = {}
        for s in self.symbol_sources or ([self.symbol_source] if self.symbol_source.kind != "none" else []):
            name = s.repo or (None if self.symbol_sources else "default")
            if not name or name in named:
                raise ValueError("each of symbol_sources needs a repo of its own")
            s.check()
            named[name] = s
        return named


def _make(kind: type, values: dict):
    odd = set(values) - {f.name for f in fields(kind)}
    if odd:
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    return kind(**values)


def load(path: str | None) -> Config:
    if path is None:
        return Config()
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    raw["symbol_source"] = _make(SourceConfig, raw.get("symbol_source", {}))
    raw["symbol_sources"] = [_make(SourceConfig, s) for s in raw.get("symbol_sources", [])]
    config = _make(Config, raw)
    config.default_validation_level = max(1, min(3, config.default_validation_level))
    config.sources()
    return config
