"""Words of names and questions, and how many of them meet."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# Name hints that stand for a place to group by, also inside compact names.
DIMENSION_HINTS = (
    "category", "type", "provider", "artist", "country", "city", "region",
    "sector", "year", "month", "date", "location", "pickup", "dropoff", "vendor",
    "genre", "state", "segment", "class", "group",
)
NUMERIC_DIMENSION_HINTS = (
    "id", "year", "month", "date", "location", "pickup", "dropoff", "vendor",
    "city", "region", "state", "country", "zone",
)
COMPACT_PREFIXES = {"pu": "pickup", "do": "dropoff"}

_INSIDE = frozenset(h for h in (*DIMENSION_HINTS, *NUMERIC_DIMENSION_HINTS) if len(h) > 3)


def plain_words(text: str) -> frozenset[str]:
    """Lower-case words and numbers, each also without a final ``s``."""
    found = re.findall("[a-z0-9]+", text.lower())
    return frozenset(found).union(w.removesuffix("s") for w in found if len(w) > 1)


def _unpacked(word: str) -> Iterable[str]:
    """What a compact word such as ``pulocationid`` holds."""
    yield from (h for h in _INSIDE if h in word)
    if word.endswith("id"):
        yield "id"
    meaning, rest = COMPACT_PREFIXES.get(word[:2]), word[2:]
    # a prefix means something only before a place or a key ("does" stays plain)
    if meaning and (rest.endswith("id") or any(h in rest for h in _INSIDE)):
        yield meaning


# Words that mark a column of times.
TIME_WORDS = frozenset(("date", "datetime", "time", "timestamp", "year", "month", "week"))


def tells_time(name: str) -> bool:
    """True when a word of the name (also in camel case) is a word of time."""
    return not TIME_WORDS.isdisjoint(plain_words(re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", name)))


def name_words(text: str) -> frozenset[str]:
    """``plain_words`` with ``-ies`` also read as ``-y`` and compact words unpacked."""
    found = re.findall("[a-z0-9]+", text.lower())
    singular = (w.removesuffix("ies") + "y" for w in found if w.endswith("ies") and len(w) > 3)
    return plain_words(text).union(singular, *map(_unpacked, found))


def best_first(items: Iterable, key: Callable, then: Callable | None = None) -> list:
    """Items by falling ``key``; equal ones keep their order, or go by falling ``then``."""
    items = list(items)
    if then is not None:
        items.sort(key=then, reverse=True)
    return sorted(items, key=key, reverse=True)
