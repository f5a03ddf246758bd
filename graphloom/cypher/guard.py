"""Refuses queries that delete or drop; reading and merging are allowed."""

from __future__ import annotations

import re

_STRING = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"")
_DESTROYS = re.compile(r"\b(?:detach\s+delete|delete|drop)\b|\bcall\s+(?:db|apoc)\.[\w.]*drop", re.IGNORECASE)


def is_destructive(query: str) -> bool:
    """Whether a query would delete something; words inside string literals don't count."""
    return bool(_DESTROYS.search(_STRING.sub("''", query)))
