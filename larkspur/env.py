"""Settings from .env files and from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

from .sources.readers import parse_env


def find_env(start: str | os.PathLike | None = None) -> Path | None:
    """The nearest .env of a folder, its parents and this project; only if there is none, the nearest
    .env.example."""
    here = Path(start or os.getcwd()).resolve()
    folders = list(dict.fromkeys([here, *here.parents, Path(__file__).resolve().parents[1]]))
    return next((f / name for name in (".env", ".env.example") for f in folders if (f / name).is_file()), None)


def load_env(path: str | os.PathLike | None = None, override: bool = False) -> Path | None:
    """Put the values of a file into the environment; what is set there already stays, unless
    override. Gives the file that was read; a missing .env is replaced by the .env.example beside it."""
    found = Path(path) if path else find_env()
    if found and not found.is_file() and found.name == ".env":
        found = found.with_name(".env.example")
    if not found or not found.is_file():
        return None
    for key, value in parse_env(found.read_text(encoding="utf-8-sig")).items():
        if override or key not in os.environ:
            os.environ[key] = value
    return found


def flag(name: str, default: bool, source: Mapping[str, str] | None = None) -> bool:
    value = (os.environ if source is None else source).get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def number(name: str, default, source: Mapping[str, str] | None = None):
    """The value as a number of the default's type; the default if it isn't one."""
    try:
        return type(default)((os.environ if source is None else source)[name])
    except (KeyError, ValueError):
        return default
