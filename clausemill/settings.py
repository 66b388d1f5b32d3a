"""Settings: layered values, and economies by whatever a person types."""

from __future__ import annotations

import os
from pathlib import Path

from .functions.scoring import token_set_ratio_of

# Spellings of economies.
ECONOMIES = {"sg": ("singapore", "sgp"), "au": ("australia", "aus"), "my": ("malaysia", "mys")}
LEAST_MATCH = 70.0


def env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file that may not be there; quotes around a value and comments are left out."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except OSError:
        return {}
    out = {}
    for line in (x.strip().removeprefix("export ").strip() for x in lines):
        name, is_set, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if is_set and name.isidentifier() and name.isascii() and not line.startswith("#"):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[name] = value[1:-1] if quoted else value.split(" #", 1)[0].rstrip()
    return out


def setting(name: str, files: list[str | Path], default: str = "") -> str:
    """The environment's value, else the first file's that has one."""
    return os.environ.get(name) or next((v for v in (env_file(f).get(name) for f in files) if v), default)


def economy(typed: str) -> str:
    """The code of an economy, tolerant of case and slips; an error where no spelling is near enough."""
    key = typed.strip().lower()
    spellings = {s: code for code, others in ECONOMIES.items() for s in (code, *others)}
    if key in spellings:
        return spellings[key]
    best = max(spellings, key=lambda s: token_set_ratio_of(key, s))
    if token_set_ratio_of(key, best) < LEAST_MATCH:
        raise ValueError(f"unknown economy {typed!r}; known are {', '.join(sorted(ECONOMIES))}")
    return spellings[best]
