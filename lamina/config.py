"""Settings of an engine, from code or a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """``merge_below``: compaction runs only while the load of running statements is below this."""

    root: str | None = None
    index_granularity: int = 8192
    compression: str = "zstd"
    merge_below: int = 30
    merge_seconds: float = 1.0
    host: str = "127.0.0.1"
    port: int = 8123
    max_connections: int = 100

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """From ``path`` or the file that LAMINA_CONFIG names; unknown keys are errors, no file gives defaults."""
        path = path or os.environ.get("LAMINA_CONFIG")
        if not path:
            return cls()
        with open(path, "rb") as file:
            found = tomllib.load(file)
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**found)
