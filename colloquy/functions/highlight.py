"""Marking many terms in texts: one automaton per list of terms, built once per task and run over each text.

An alternation tries its terms one after the other at every character; an automaton reads a text
once, however many terms there are. The terms may differ from row to row (the keywords of a row's
cluster, joined to it); a task keeps the automata of the lists that it met last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html

SPANS = "array<struct<start:int,length:int>>"


class _Folds(dict):
    """Code point to code point of its case-folded form; characters without a single one stay."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        low = (up if len(up) == 1 else chr(code)).lower()
        self[code] = ord(low[0])
        return self[code]


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Same length, without case."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def _automaton(terms):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, len(t))
    found.make_automaton()
    return found


def outer_terms(terms: list[str | None]) -> list[str]:
    """Terms trimmed and folded, each once, without those inside a longer one."""
    folded = sorted({fold(t.strip()) for t in terms if t and t.strip()})
    if not folded:
        return []
    every, inner = _automaton(folded), set()
    for t in folded:
        inner.update(t[end + 1 - n : end + 1] for end, n in every.iter(t) if n < len(t))
    return [t for t in folded if t not in inner]


@lru_cache(maxsize=64)
def _prepared(terms: tuple):
    kept = outer_terms(list(terms))
    return _automaton(kept) if kept else None


def find(text: str, terms: tuple) -> list[tuple[int, int]]:
    """(start, length) from the left, without overlaps.

    No term lies inside another, so matches in the order of their ends are also in that of their
    starts, and at each start there is one.
    """
    found, spans, free = _prepared(terms), [], 0
    for end, n in found.iter(fold(text)) if found else ():
        if end + 1 - n >= free:
            spans.append((end + 1 - n, n))
            free = end + 1
    return spans


def _between(text: str | None, found: list[tuple[int, int]], left: str, right: str) -> str | None:
    out, at = [], 0
    for start, n in found:
        out += [text[at:start], left, text[start : start + n], right]
        at = start + n
    return "".join([*out, text[at:]]) if out else text


def _mark(text: str, terms: tuple, left: str, right: str) -> str:
    return _between(text, find(text, terms), left, right)


def _rows(texts: pd.Series, terms: pd.Series):
    for t, ks in zip(texts, terms):
        yield t, tuple(ks) if ks is not None else ()


def spans(text: Column, terms: Column) -> Column:
    """Places of the terms in characters from 0, whatever their case; null for a null text."""

    @F.pandas_udf(SPANS)
    def located(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([None if t is None else [{"start": s, "length": n} for s, n in find(t, k)] for t, k in _rows(texts, lists)], dtype=object)

    return located(text, terms)


def marked(text: Column, terms: Column, left: str = "**", right: str = "**") -> Column:
    """The text with every term between ``left`` and ``right``; no terms or null ones leave it as it is."""

    @F.pandas_udf("string")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([None if t is None else _mark(t, k, left, right) for t, k in _rows(texts, lists)], dtype=object)

    return put(text, terms)


@lru_cache(maxsize=64)
def _listed(terms: str) -> tuple:
    return tuple(json.loads(terms))


def marked_and_counted(text: Column, terms: Column, left: str = "**", right: str = "**") -> Column:
    """``marked`` and the number of marks n in one walk over the text; ``terms`` is a list as JSON text.

    Where many rows have one list, its text is read once per worker; an array would be made into
    as many Python strings for every row.
    """

    @F.pandas_udf("marked string, n int")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            told, counts = [], []
            for t, ks in zip(texts, lists):
                found = find(t, _listed(ks)) if t and ks else []
                told.append(_between(t, found, left, right))
                counts.append(len(found))
            yield pd.DataFrame({"marked": pd.Series(told, dtype=object), "n": pd.Series(counts, dtype="int32")})

    return put(text, terms)


def marked_html(text: Column, terms: Column) -> Column:
    """Escaped text with marked terms; line ends become breaks."""
    shown = marked(escape_html(text), F.transform(terms, escape_html), "<mark>", "</mark>")
    return F.replace(shown, F.lit("\n"), F.lit("<br>"))
