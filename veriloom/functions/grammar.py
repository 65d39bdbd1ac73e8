"""Small builders of patterns in the JVM's dialect: words, numbers, gaps and LaTeX commands."""

from __future__ import annotations

from collections.abc import Iterable

#: A group in braces, options in brackets, as LaTeX commands take them.
BRACES, OPTIONS = r"\{[^{}]*\}", r"(?:\[[^\]]*\])*"
SPACE = r"\s*"
#: Numbers as printed: whole, with a decimal part or without, with thousands separators, with a sign and perhaps no whole part.
WHOLE, PLAIN, GROUPED, SIGNED = r"\d+", r"\d+(?:\.\d+)?", r"\d[\d,]*(?:\.\d+)?", r"-?\d*\.?\d+"
#: Not inside a longer number.
ALONE = r"(?<![\d.])"


def one(*parts: str) -> str:
    """One of the parts."""
    return f"(?:{'|'.join(parts)})"


def taken(part: str) -> str:
    """A part that is a group of the match."""
    return f"({part})"


def maybe(part: str) -> str:
    return f"(?:{part})?"


def words(*stems: str) -> str:
    """One of the words; a stem with a star stands for all words that begin with it."""
    return rf"\b{one(*(s.replace('*', r'\w*') for s in stems))}\b"


def command(*names: str) -> str:
    """A LaTeX command of one of the names."""
    return r"\\" + (one(*names) if len(names) > 1 else names[0])


def upto(most: int, part: str, lazy: bool = True) -> str:
    """At most so many repeats of a part, as few as will do."""
    return f"(?:{part}){{0,{most}}}{'?' if lazy else ''}"


def spaced(*parts: str) -> str:
    """Parts with white space or nothing between them."""
    return SPACE.join(parts)


def listed(stems: Iterable[str]) -> str:
    return "|".join(stems)
