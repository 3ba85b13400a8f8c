"""Names of columns that an operator adds for its own use."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, columns: Iterable[str]) -> str:
    """``_name``, or the first of ``_name1``, ``_name2``, … that no column has, case aside."""
    taken, found, k = {c.lower() for c in columns}, f"_{name}", 0
    while found.lower() in taken:
        k += 1
        found = f"_{name}{k}"
    return found
