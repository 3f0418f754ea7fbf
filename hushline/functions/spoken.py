"""Syllables that are spoken before and in matched words.

Spark's expressions cut a text, strip each word of it several times and walk all words again for every match.  Here an Arrow
function counts the syllables of all words of many texts by a few array operations; the counts are those of ``text.syllables``.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from hushline.functions import text as T

#: Characters that are looked at together; a longer text is looked at alone.
BLOCK = 200_000


@cache
def space_table() -> np.ndarray:
    """Whether a code point below 65,536 is white space; none above is."""
    space = re.compile(f"[{T.WS}]")
    return np.array([space.match(chr(c)) is not None for c in range(65_536)])


def block_ranges(most: int):
    """A function of text lengths to ranges of rows with at most ``most`` characters, or one row; made anew, so that workers need no import."""

    def ranges(sizes: list[int]):
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > most:
                yield first, i
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield first, len(sizes)

    return ranges


def spoken(text: Column, starts: Column, words: Column) -> Column:
    """struct<total, m: array<struct<before, own>>> of a text and the places and words of its matches.

    ``total`` counts the syllables of all white-space words, ``before`` those of the words ahead of the one that begins at the
    match (all, if none does), ``own`` those of the matched words themselves.
    """
    space, ranges, ws = space_table(), block_ranges(BLOCK), T.WS
    vowel = np.isin(np.arange(128), [ord(c) for c in "aeiouy"])

    def run(text: pa.Array, starts: pa.Array, words: pa.Array) -> pa.Array:
        ends, other, groups = re.compile(rf"\A[{ws}]+|[{ws}]+\Z"), re.compile("[^a-z]"), re.compile("[aeiouy]+")
        hard_le, known = re.compile(r"[^aeiouy]le\Z"), {"": 0, None: 0}

        def own(word):
            if word not in known:
                low = ends.sub("", word.lower())
                letters = other.sub("", low)
                n = len(groups.findall(letters))
                n = n - (letters.endswith("e") and n > 1) + (hard_le.search(letters) is not None)
                known[word] = 1 if len(low) <= 2 or not letters else max(1, n)
            return known[word]

        def counted(chars):
            """Starts of the words, and running sums of their syllables."""
            gap = space[np.minimum(chars, 65_535)]
            opens = ~gap
            opens[1:] &= gap[:-1]
            at = np.flatnonzero(opens)
            n = len(at)
            ids = np.cumsum(opens) - 1
            size = np.bincount(ids[~gap], minlength=n)
            low = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
            # the two other characters whose lower case holds an ASCII letter; the second has two characters
            low[chars == 0x212A] = 107
            dotted = np.flatnonzero(chars == 0x130)
            if len(dotted):
                low[dotted] = 105
                size = size + np.bincount(ids[dotted], minlength=n)
            pos = np.flatnonzero((low >= 97) & (low <= 122))
            letter, of = low[pos], ids[pos]
            v = vowel[letter]
            begins = v.copy()
            begins[1:] &= ~v[:-1] | (of[1:] != of[:-1])
            found, letters = np.bincount(of[begins], minlength=n), np.bincount(of, minlength=n)
            last = np.cumsum(letters) - 1
            with_e = np.zeros(n, bool)
            some = letters > 0
            with_e[some] = letter[last[some]] == 101
            le = np.flatnonzero(with_e & (letters >= 3))
            le = le[(letter[last[le] - 1] == 108) & ~v[last[le] - 2]]
            count = found - (with_e & (found > 1))
            count[le] += 1
            count = np.where((size <= 2) | ~some, 1, np.maximum(count, 1))
            return at, np.concatenate([[0], np.cumsum(count)])

        texts = [t or "" for t in text.to_pylist()]
        per_row = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first_of = np.concatenate([[0], np.cumsum(per_row)])
        places = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        total, before = np.zeros(len(texts), np.int32), np.zeros(len(places), np.int32)
        for a, b in ranges([len(t) for t in texts]):
            # line feeds are white space, so no word crosses from text to text
            chars = np.frombuffer("\n".join([*texts[a:b], ""]).encode("utf-32-le"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
            at, sums = counted(chars)
            edge = np.searchsorted(at, offsets)
            total[a:b] = sums[edge[1:]] - sums[edge[:-1]]
            mine = slice(first_of[a], first_of[b])
            row = np.repeat(np.arange(b - a), per_row[a:b])
            place = places[mine] + offsets[row]
            i = np.searchsorted(at, place)
            begun = np.append(at, -1)[i] == place
            before[mine] = np.where(begun, sums[i] - sums[edge[row]], total[a:b][row])
        pairs = pa.StructArray.from_arrays([pa.array(before), pa.array([own(w) for w in words.flatten().to_pylist()], pa.int32())], ["before", "own"])
        return pa.StructArray.from_arrays([pa.array(total), pa.ListArray.from_arrays(pa.array(first_of, pa.int32()), pairs)], ["total", "m"])

    return F.arrow_udf(run, "struct<total:int,m:array<struct<before:int,own:int>>>")(text, starts, words)
