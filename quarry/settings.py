"""Settings: defaults, then a JSON file, then QUARRY_* variables, then overrides."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from quarry.errors import ConfigurationError


LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


@dataclass(frozen=True)
class Settings:
    root: str = "quarry-data"
    max_commits: int = 10  # refresh compacts an index of more commits
    max_sort_candidates: int | None = None  # None: field sorts are exact
    max_line_bytes: int = 1 << 20
    max_bytes_per_trigger: int = 64 << 20
    trigger_seconds: float = 2.0
    plugins: tuple[str, ...] = ()
    strict_plugins: bool = False
    host: str = "127.0.0.1"  # of the HTTP server
    port: int = 9280
    log_level: str = "INFO"
    log_format: str = "text"  # or json

    def __post_init__(self) -> None:
        bad = [n for n in ("max_commits", "max_line_bytes", "max_bytes_per_trigger") if getattr(self, n) < 1]
        bad += [n for n, ok in (("root", self.root), ("trigger_seconds", self.trigger_seconds > 0), ("port", 0 <= self.port < 65536), ("max_sort_candidates", self.max_sort_candidates is None or self.max_sort_candidates > 0), ("log_level", self.log_level in LOG_LEVELS), ("log_format", self.log_format in ("text", "json"))) if not ok]
        if bad:
            raise ConfigurationError(f"setting {bad[0]!r} can't be {getattr(self, bad[0])!r}")


def _cast(name: str, kind: str, value: Any) -> Any:
    try:
        if "tuple" in kind:
            return tuple(x for x in value.split(",") if x) if isinstance(value, str) else tuple(value)
        if kind == "bool":
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}[str(value).lower()]
        if "int" in kind:
            return None if value in (None, "", "none") and "None" in kind else int(value)
        return float(value) if kind == "float" else str(value)
    except (ValueError, TypeError, KeyError):
        raise ConfigurationError(f"setting {name!r} can't be {value!r}") from None


def load_settings(path: str | None = None, env: dict[str, str] | None = None, **overrides: Any) -> Settings:
    known = {f.name: str(f.type) for f in fields(Settings)}
    merged = asdict(Settings())
    layers = [json.loads(Path(path).read_text()) if path else {}]
    layers.append({k[7:].lower(): v for k, v in (os.environ if env is None else env).items() if k.startswith("QUARRY_")})
    for layer in [*layers, overrides]:
        for k, v in layer.items():
            if k not in known:
                raise ConfigurationError(f"unknown setting {k!r}")
            merged[k] = _cast(k, known[k], v)
    return Settings(**merged)
