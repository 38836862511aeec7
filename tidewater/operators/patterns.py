"""Many patterns at once: one pass over each text by an automaton, whatever the number of patterns."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip


@lru_cache(8)
def _automaton(patterns: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of some patterns, once per worker; each knows its place, of a repeated one the first."""
    found = ahocorasick.Automaton()
    for i, p in reversed(list(enumerate(patterns))):
        if p:
            found.add_word(p, i)
    found.make_automaton()
    return found


def first_match(c: Column, patterns: list[str]) -> Column:
    """The place (from 0) of the first pattern, in their order, that a text contains; null for none and for null."""
    held = tuple(patterns)

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        machine = _automaton(held)
        return pd.Series([min((i for _, i in machine.iter(t)), default=None) if t and len(machine) else None for t in texts], dtype="Int32")

    return run(c)


def all_matches(c: Column, patterns: list[str]) -> Column:
    """How often each pattern occurs that a text contains, overlaps counted: an array of (place, n); null for null."""
    held = tuple(patterns)

    @F.pandas_udf("array<struct<place: int, n: int>>")
    def run(texts: pd.Series) -> pd.Series:
        machine = _automaton(held)
        out = []
        for t in texts:
            counts: dict[int, int] = {}
            if t and len(machine):
                for _, i in machine.iter(t):
                    counts[i] = counts.get(i, 0) + 1
            out.append(None if t is None else [{"place": i, "n": n} for i, n in sorted(counts.items())])
        return pd.Series(out)

    return run(c)


def taxonomy_of(c: Column, entries: list[tuple[str, str]], least: int = 8) -> Column:
    """As `functions.text.taxonomy`, for tables of any length: one pass over a label instead of a test for each entry.

    Exact label, else the first entry longer than `least` that the label contains, else the label stripped.
    """
    names = dict(entries)
    long = [(p, n) for p, n in names.items() if len(p) > least]
    key = F.lower(strip(c))
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    inside = F.get(F.array(*(F.lit(n) for _, n in long)), first_match(key, [p for p, _ in long])) if long else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(table, key), inside, strip(c))
