"""Settings of a crawl: defaults, overridden by a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Config:
    """Defaults of the engine's settings."""

    onion: bool = False
    testing: bool = False
    force_recrawl: bool = False
    reset_fail_streak: bool = False
    max_domains: int = 0
    start_clients: int = 560
    max_clients: int = 1000
    sleep_seconds: int = 4
    sleep_spread_seconds: int = 4
    turn_requests: int = 10
    turn_spread: int = 50
    least_timeouts: int = 3
    most_timeouts: int = 20
    refresh_minutes: int = 5

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Defaults with the file's known keys; a missing file gives the defaults."""
        p = Path(path)
        raw = json.loads(p.read_text()) if p.exists() else {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def describe(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in asdict(self).items())
