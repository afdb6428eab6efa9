"""Remembered results for the segments of texts, for tokenizers that never join over a space.

A space between two solid characters (letters, digits, underscore, visible ASCII)
cuts a text: tokenizers that put such a space in front of the token after it give
for the whole text what they give for the segments, one after the other. Where it
is not certain that a character is solid, the text is not cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most entries of each of two generations, and the longest segment that is remembered.
KEPT, LONGEST = 300_000, 64
#: Stands for a cut without a space.
MARK = "\x01"
# Ranges of Latin letters, all of the Unicode class L.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_solid = re.compile(r"[\w!-~](?s:.*[\w!-~])?\Z")
#: A part that surely is a segment of its own: solid at both ends, or after a mark at the end, or a marked line break.
_sure = re.compile(rf"{MARK}\n\Z|{MARK}?[\w!-~](?s:.*[\w!-~])?\Z")


def cut(text: str) -> list[str]:
    """The segments of a text; joined, they are the text."""
    parts = text.split(" ")
    out, open_ = [], [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if before and part and _solid.match(before[-1]) and _solid.match(part[0]):
            out.append("".join(open_))
            open_ = []
        open_ += (" ", part)
    return [*out, "".join(open_)]


class Kept(dict):
    """A dictionary of at most two generations of ``most`` entries, and those of one batch."""

    def __init__(self, most: int):
        self.most = most
        self.older: dict = {}

    def age(self) -> None:
        """Begin a new generation if this one is full. Call it between batches."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self.older.get(key)
        if value is not None:
            self[key] = value
        return value


class SegmentTable:
    """``compute`` gives the values (not None) of a list of segments; those of short ones are kept.

    ``nothing`` is the value of the empty segment. With ``leading``, a text stands
    for itself with a space in front, unless it is empty. With ``signs``, texts are
    also cut after Latin words that one of these signs follows, and around a line
    break between such a sign and a word: for tokenizers that split at word borders.
    ``most`` segments, twice, are kept (``KEPT`` by default).
    """

    def __init__(self, compute: Callable[[list[str]], list], nothing: object, leading: bool = False, signs: str = "", most: int | None = None):
        self.compute, self.nothing, self.leading = compute, nothing, leading
        #: Values of segments, by what follows the space that they begin with, or by MARK and the segment.
        self.spaced = Kept(KEPT if most is None else most)
        own = re.escape(signs)
        self.cuts = [] if not signs else [
            (rf"([{LATIN}])([{own}])", rf"\1 {MARK}\2"), (rf"([{own}])\n([{LATIN}])", f"\\1 {MARK}\n {MARK}\\2"),
        ]

    def _parts(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Texts split at spaces, after a mark was put (with a space) where they are cut without one; and texts that hold marks themselves."""
        own = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) if self.cuts else np.zeros(len(texts), bool)
        for pattern, with_mark in self.cuts:
            texts = pc.replace_substring_regex(texts, pattern, with_mark)
        return pc.split_pattern(texts, " "), np.flatnonzero(own)

    def _cut(self, texts: pa.Array, rows: list[int]) -> dict[int, list[str]]:
        front = " " if self.leading else ""
        own = ((row, texts[row].as_py()) for row in rows)
        return {row: cut(front + text) if text else [] for row, text in own}

    def values(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """The values of distinct segments, and for each text its segments by their number in that list.

        ``which[ends[i]:ends[i + 1]]`` are those of text i. The empty text has none.
        """
        spaced = self.spaced
        spaced.age()
        lists, unclear = self._parts(texts)
        coded = lists.values.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        starts = lists.offsets.to_numpy().astype(np.int64)
        heads, sizes = starts[:-1], np.diff(starts)
        found = [spaced[w] for w in words]
        new = [i for i, value in enumerate(found) if value is None]
        odd = np.zeros(len(words), bool)
        odd[[i for i in new if not (words[i].isalnum() or _sure.match(words[i]))]] = True
        loose = odd[which]
        first: list[str] = []
        if not self.leading:
            # What a text begins with has no space before it: a segment of its own, next in number.
            first = [words[i] for i in which[heads]]
            which[heads] = len(words) + np.arange(len(first))
            loose[heads] = [not f or size > 1 and not _solid.match(f[-1:]) for f, size in zip(first, sizes.tolist())]
        loose[starts[unclear]] = True
        # Texts that can't be cut at each of their spaces.
        cuts = self._cut(texts, np.unique(np.searchsorted(starts, np.flatnonzero(loose), "right") - 1).tolist())
        extra = [s for segments in cuts.values() for s in segments]
        known = [spaced[s[1:]] if s[:1] == " " else None for s in extra]

        sought = [i for i in new if not odd[i]]
        done = self.compute([*(words[i][1:] if words[i][0] == MARK else f" {words[i]}" for i in sought), *first, *(s for s, v in zip(extra, known) if v is None)])
        for i, value in zip(sought, done):
            found[i] = value
            if len(words[i]) <= LONGEST:
                spaced[words[i]] = value
        rest = iter(done[len(sought) + len(first):])
        values = [
            *(self.nothing if v is None else v for v in found), *done[len(sought):len(sought) + len(first)],
            *(next(rest) if v is None else v for v in known),
        ]
        if not cuts:
            return values, which, starts
        rows, at, before = [], len(words) + len(first), 0
        for row, segments in cuts.items():
            rows += (which[starts[before]:starts[row]], np.arange(at, at + len(segments)))
            at, before = at + len(segments), row + 1
            sizes[row] = len(segments)
        return values, np.concatenate([*rows, which[starts[before]:]]), np.r_[0, np.cumsum(sizes)]
