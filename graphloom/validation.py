"""Bounds of arguments that come from outside."""

from __future__ import annotations

# Fixed values: (least, most) length of a text argument, or value of a number.
TEXT = {"text": (10, 50_000), "question": (3, 2_000), "cypher": (5, 5_000)}
NUMBERS = {"max_results": (1, 100), "count": (1, 100), "depth": (1, 5), "k": (1, 100)}


def check(**values) -> None:
    """Raises ValueError for a named argument outside its bounds; unknown names are refused."""
    for name, v in values.items():
        if name in TEXT:
            low, high = TEXT[name]
            if not isinstance(v, str) or not low <= len(v) <= high:
                raise ValueError(f"{name} must have {low} to {high} characters")
        elif name in NUMBERS:
            low, high = NUMBERS[name]
            if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        else:
            raise ValueError(f"unknown argument {name}")
