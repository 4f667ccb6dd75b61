"""What a run is told from outside, with its fallbacks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import ClassVar


@dataclass(frozen=True)
class RunInputs:
    check: str = ""
    base: str = "origin/develop"
    head: str = "HEAD"
    repo: str = "."
    head_ref: str = ""
    title: str = ""
    body: str = ""
    is_fork: bool = False
    model: str = ""
    config_path: str = ""

    #: Where each is looked for, in order.
    NAMES: ClassVar = {
        "check": ("INPUT_CHECK", "CHECK"), "base": ("INPUT_BASE", "BASE"), "head": ("INPUT_HEAD", "HEAD_SHA"), "repo": ("INPUT_REPO",),
        "head_ref": ("PR_HEAD_REF",), "title": ("PR_TITLE",), "body": ("PR_BODY",), "model": ("INPUT_MODEL",), "config_path": ("INPUT_CONFIG_PATH",),
    }

    @classmethod
    def of(cls, env: Mapping[str, str]) -> RunInputs:
        """Empty values count as missing."""
        found = {field: next((env[n] for n in names if env.get(n)), None) for field, names in cls.NAMES.items()}
        return cls(**{k: v for k, v in found.items() if v is not None}, is_fork=env.get("PR_IS_FORK") == "true")
