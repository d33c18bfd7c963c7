"""Settings from the environment: the first name that is set, lists parted by commas."""

from __future__ import annotations

import os
from collections.abc import Mapping


def first_set(*names: str, default: str | None = None, env: Mapping[str, str] = os.environ) -> str | None:
    """The value of the first name that has a non-empty one."""
    return next((env[n] for n in names if env.get(n)), default)


def listed(raw: str | None, first: str | None = None) -> list[str]:
    """Distinct entries in order, blank ones left out; ``first`` leads where it is missing."""
    found = [x.strip() for x in (raw or "").split(",")]
    found = list(dict.fromkeys(x for x in found if x))
    return found if first is None or first in found else [first, *found]
