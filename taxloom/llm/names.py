"""Names for columns that an operator adds on the way."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """One name per stem, none of them among ``columns`` (in any case of letters) or each other."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
