"""Sequences as strings of roles: each item becomes one character for the set of facts that hold of it.

What a rule says about neighbours is then a regular expression over that string, and what it says of one item is a list of
decisions, the first of which that holds of the item's facts counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

_BASE = 0x100


def encoded(facts: Iterable[int]) -> str:
    """One character for each item's bits."""
    return "".join(chr(_BASE + bits) for bits in facts)


def having(bits: int, without: int = 0, width: int = 8) -> str:
    """A character class of the items that have all of some bits and none of others."""
    return "[" + "".join(chr(_BASE + k) for k in range(1 << width) if k & bits == bits and not k & without) + "]"


Fact = Callable[[str], object]


def decided(table: Iterable[tuple[tuple[str, ...], str]], facts: Mapping[str, Fact], item: str) -> str:
    """The outcome of the first row all of whose facts hold; `~name` is a fact that must not."""
    for names, outcome in table:
        if all(bool(facts[n.lstrip("~")](item)) != n.startswith("~") for n in names):
            return outcome
    raise ValueError("a table ends with a row that always holds")
