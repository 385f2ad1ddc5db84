"""A project's settings: ``project.wattframe`` (TOML), looked for upwards from the working directory."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from wattframe.errors import NameProblem, WattError

NAME, SUFFIX = "project.wattframe", ".wq"
_PATHS, _TEXTS = ("db", "csv", "mapping", "queries"), ("name", "postgres", "encoding")


@dataclass
class Config:
    path: str | None = None
    name: str | None = None
    db: str | None = None
    csv: str | None = None
    mapping: str | None = None
    queries: str | None = None
    postgres: str | None = None
    encoding: str | None = None
    params: dict = field(default_factory=dict)


def find_config(start: str | None = None) -> str | None:
    at = Path(start or os.getcwd()).resolve()
    return next((str(p / NAME) for p in (at, *at.parents) if (p / NAME).is_file()), None)


def load_config(path: str) -> Config:
    """Paths in the file are relative to it."""
    try:
        with open(path, "rb") as f:
            said = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise WattError(f"{path}: {e}") from e
    known = (*_PATHS, *_TEXTS, "params")
    if unknown := sorted(set(said) - set(known)):
        raise NameProblem(f"{path}: no setting is called '{unknown[0]}'", unknown[0], known)
    if not isinstance(said.get("params", {}), dict):
        raise WattError(f"{path}: params has to be a table")
    if bad := [k for k in (*_PATHS, *_TEXTS) if not isinstance(said.get(k, ""), str)]:
        raise WattError(f"{path}: {bad[0]} has to be text")
    if said.get("db") and said.get("csv"):
        raise WattError(f"{path}: db and csv are both set")
    here = os.path.dirname(os.path.abspath(path))
    return Config(path, **{k: os.path.join(here, v) if k in _PATHS else v for k, v in said.items()})


def project_config(path: str | None = None, look: bool = True) -> Config:
    """The named settings, else those found, else none."""
    path = path or (find_config() if look else None)
    return load_config(path) if path else Config()


def resolve_script(config: Config, name: str) -> str:
    """A script by its path, or by its name among the project's queries."""
    tried = [name, name + SUFFIX] + ([os.path.join(config.queries, n) for n in (name, name + SUFFIX)] if config.queries else [])
    for path in tried:
        if os.path.isfile(path):
            return path
    raise WattError(f"there is no script {name}; looked for {', '.join(tried)}")
