"""What operators may do. Operators get a Policy; none of them reads the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# Texts that mean yes.
TRUTHY = ("1", "true", "yes", "on")


def truthy(value: str | None, default: bool = True) -> bool:
    return default if value is None else value.strip().lower() in TRUTHY


@dataclass(frozen=True)
class Policy:
    """Feature switches, the workspace root, and what relative paths and ~ stand for (the root, if there is no cwd).
    Approval that is switched off denies whatever would need it."""

    root: str = "/"
    approval_enabled: bool = True
    shell_enabled: bool = True
    search_enabled: bool = True
    browser_enabled: bool = True
    cwd: str | None = None
    home: str = "/root"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Policy:
        env = os.environ if env is None else env
        return cls(
            root=os.path.realpath(os.path.expanduser(env.get("AGENT_WORKSPACE_ROOT") or os.getcwd())),
            approval_enabled=truthy(env.get("AGENT_ENABLE_HUMAN_APPROVAL")),
            shell_enabled=truthy(env.get("AGENT_ENABLE_SHELL_COMMANDS")),
            search_enabled=truthy(env.get("AGENT_ENABLE_WEB_SEARCH")),
            browser_enabled=truthy(env.get("AGENT_ENABLE_BROWSER_TOOLS")),
            cwd=os.getcwd(),
            home=os.path.expanduser("~"),
        )
