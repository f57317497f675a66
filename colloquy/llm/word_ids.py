"""Words of whole texts as numbers, for operators that count words in tasks.

A task numbers the words it meets in order of appearance. Texts travel as UTF-8; of all letters only
A to Z are lower-cased, and as every byte of a longer character is above 0x7F, a class of ASCII
characters and of all others cuts bytes exactly where it cuts characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Runs of digits, letters and everything beyond ASCII; and the same without digits.
ALPHANUMERIC = re.compile(rb"[0-9a-z\x80-\xff]+")
ALPHABETIC = re.compile(rb"[a-z\x80-\xff]+")


class WordIndex(dict):
    """word -> number; an unknown word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_slices(batches, pattern: re.Pattern, index: WordIndex, text: str = "text", most: int = 1 << 21):
    """(batch, first row, end row, ids, ends): ids of the words of a slice of rows and where each row ends in them.

    A slice has about ``most`` bytes of text; a longer text stands alone, whole. Null texts have no words.
    """
    find = pattern.findall
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        start = size = 0
        ids, ends = [], []
        for i, t in enumerate(texts):
            if t:
                ids.extend(map(index.__getitem__, find(t.lower())))
                size += len(t)
            ends.append(len(ids))
            if size > most or i + 1 == len(texts):
                yield batch, start, i + 1, np.array(ids, np.int64), np.array(ends, np.int64)
                start, size, ids, ends = i + 1, 0, [], []


def row_numbers(ends: np.ndarray) -> np.ndarray:
    """The row of each word, from the places where rows end."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def totals(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order with the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = keys.argsort(kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(c[order], at) for c in counts))
