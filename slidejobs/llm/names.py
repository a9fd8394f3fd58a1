"""Names for helper columns beside a user's own."""

from __future__ import annotations


def unused(columns: list[str], name: str) -> str:
    """name, with underscores added until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
