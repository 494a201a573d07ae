"""Limits of a run, from the environment or by default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    agent_timeout: int = 800
    max_agent_turns: int = 40
    max_compile_attempts: int = 3
    max_revision_attempts: int = 3
    max_polls: int = 60
    poll_seconds: int = 10
    tool_timeout: int = 120

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Limits:
        """Each limit from the variable of its name in capitals, where that is set."""
        env = dict(os.environ) if env is None else env
        return cls(**{f.name: int(env[f.name.upper()]) for f in fields(cls) if env.get(f.name.upper())})


def with_file(path: str, env: dict[str, str]) -> dict[str, str]:
    """env, with what a file of NAME=value lines adds; what is set already stays."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sep, value = line.strip().partition("=")
                if sep and name and not name.startswith("#"):
                    out[name.strip().removeprefix("export ")] = value.strip().strip("'\"")
    return {**out, **env}
