"""Configuration: YAML with ``${VAR}`` and ``${VAR:default}`` taken from the environment."""

from __future__ import annotations

import copy
import os
import re
from pathlib import Path
from types import SimpleNamespace
from typing import Any

_VAR = re.compile(r"[$][{](?P<var>[A-Za-z_]\w*)(?P<alt>:[^}]*)?[}]")

#: Sections and their settings; one without a default must be given if its section is.
NEEDED = object()
SECTIONS: dict[str, dict[str, Any]] = {
    "repository": {"branch": None, "name": None, "path": None},
    "gitlab": {"private_token": NEEDED, "project_id": NEEDED, "url": NEEDED, "branch": None},
    "store": {"path": "graph"},
    "parsing": {"strict": False, "ast_enabled": True, "languages": ["python"], "ignore_patterns": ["*.min.js", "*.pyc", ".git/**", "__pycache__/**", "node_modules/**"]},
    "sync": {"max_commits": None, "batch_size": 500},
}


def resolve(value: Any) -> Any:
    """Variables replaced in all strings below ``value``; one that is neither set nor has a default is an error."""

    def one(m: re.Match) -> str:
        default = m["alt"][1:] if m["alt"] else None
        found = os.environ.get(m["var"], default)
        if found is None:
            raise ValueError(f"the environment variable {m['var']} is not set and has no default")
        return found

    if isinstance(value, str):
        return _VAR.sub(one, value)
    if isinstance(value, dict):
        return {key: resolve(item) for key, item in value.items()}
    return list(map(resolve, value)) if isinstance(value, list) else value


class Config:
    """Settings by section as attributes; ``gitlab`` is None unless configured."""

    def __init__(self, **given: dict | None):
        for section, defaults in SECTIONS.items():
            own = given.get(section)
            if own is None and section == "gitlab":
                self.gitlab = None
                continue
            unknown = set(own or {}) - set(defaults)
            values = copy.deepcopy(defaults) | (own or {})
            missing = [k for k, v in values.items() if v is NEEDED]
            if unknown or missing:
                raise ValueError(f"{section}: " + ", ".join([f"{k} is unknown" for k in sorted(unknown)] + [f"{k} is missing" for k in missing]))
            setattr(self, section, SimpleNamespace(**values))

    @property
    def repo_name(self) -> str:
        """The configured name, else one made of the project's number."""
        name = self.repository.name or (f"project-{self.gitlab.project_id}" if self.gitlab else None)
        if not name:
            raise ValueError("repository.name or gitlab.project_id must be set")
        return name

    @property
    def remote(self) -> bool:
        """Without a local clone everything comes from the service."""
        return bool(self.gitlab) and not self.repository.path


def load_config(path: str | Path) -> Config:
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(f"no configuration at {path}")
    raw = resolve(yaml.safe_load(Path(path).read_text()) or {})
    return Config(**{k: v for k, v in raw.items() if k in SECTIONS})
