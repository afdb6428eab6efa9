"""Periodic runs of words (operator 13).

A run is a stretch of words with smallest period q, at least ``times`` periods and
``least`` words long, that neither neighbour extends. Each run holds the Lyndon
root of one of two opposite orders of the words: from that root's start i the next
smaller suffix begins at i + q. So every position gives two candidates, one for
each order, and a candidate is extended to both sides by the longest common
extension of i and i + q, forwards in the suffix tree of the words and backwards in
that of their reversal. Trees are Ukkonen's; a tour of the tree turns the lowest
common ancestor of two leaves into a minimum over a range of the tour, which two
overlapping blocks of a table answer in constant time.

Trees are built where a run can be: all words of a run lie in windows of ``window``
words that the text repeats, so stretches without such windows are left out, and no
neighbour outside such a stretch can extend a run.

Defined results: a NULL or empty text, or one of white space, has no words and no
runs; rows with equal or NULL keys are described one by one. Memory grows with the
longest repetitive stretch of one text, about 0.4 KB a word.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import in_batches, texts

LEAST, TIMES = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Stretches of one text share a tree up to so many words.
POOL = 1 << 16


def tree_tour(word: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of the suffix tree of ``word`` in order, and the depth of the ancestor between neighbours.

    The last word must occur once. Leaves are named by where their suffix starts;
    depths count words.
    """
    n = len(word)
    many = max(word) + 1
    first, last, link = array("i", [0]), array("i", [0]), array("i", [0])
    edges: dict[int, int] = {}
    find = edges.get
    node = at = length = due = 0
    for i, c in enumerate(word):
        due += 1
        waiting = 0
        while due:
            if not length:
                at = i
            key = node * many + word[at]
            below = find(key)
            if below is None:
                edges[key] = len(first)
                first.append(i), last.append(n), link.append(0)
                inner = node
            else:
                start = first[below]
                span = last[below] - start
                if span > i + 1 - start:
                    span = i + 1 - start
                if length >= span:
                    at += span
                    length -= span
                    node = below
                    continue
                if word[start + length] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                inner = len(first)
                edges[key] = inner
                first.append(start), last.append(start + length), link.append(0)
                edges[inner * many + c] = inner + 1
                first.append(i), last.append(n), link.append(0)
                first[below] = start + length
                edges[inner * many + word[start + length]] = below
            if waiting:
                link[waiting] = inner
            waiting = inner
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - due + 1
    return _tour(edges, many, np.array(first, np.int64), np.array(last, np.int64), n)


def _tour(edges: dict[int, int], many: int, first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk the tree in the order of the words; note each leaf and the depth of the turn before it."""
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    to = np.fromiter(edges.values(), np.int64, len(edges))
    order = np.argsort(keys)
    to, above = to[order], keys[order] // many
    begin = np.searchsorted(above, np.arange(len(first) + 1)).tolist()
    to, span = to.tolist(), (last - first).tolist()
    leaves, turns = [], []
    stack = [(0, 0)]  # a node and the depth of its parent
    lowest = 0
    push, pop, leaf, turn = stack.append, stack.pop, leaves.append, turns.append
    while stack:
        node, depth = pop()
        # The node is reached by a turn at its parent, unless it is its parent's first child.
        if depth < lowest:
            lowest = depth
        depth += span[node] if node else 0
        low, high = begin[node], begin[node + 1]
        if low == high:
            leaf(n - depth)
            turn(lowest)
            lowest = n
        else:
            for child in range(high - 1, low - 1, -1):
                push((to[child], depth))
    return np.array(leaves, np.int64), np.array(turns[1:], np.int32)


class Extensions:
    """Longest common extensions of positions of a word sequence."""

    def __init__(self, word: list[int]):
        self.leaves, turns = tree_tour(word)
        self.rank = np.empty(len(word), np.int64)
        self.rank[self.leaves] = np.arange(len(word))
        self.table = [turns]
        while 2 * (1 << len(self.table) - 1) <= len(turns):
            below, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(below[:-half], below[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and at ``b`` (never equal) have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << int(k))])
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value; the length where there is none."""
    out, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(word: list[int], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of a word sequence, by start and then period."""
    n = len(word)
    if n < max(least, times):
        return np.empty((0, 3), np.int64)
    end = max(word) + 1
    onward, back = Extensions([*word, end]), Extensions([*word[::-1], end])
    rank = onward.rank[:n]
    found = []
    for order in (rank, -rank):
        after = next_smaller(order.tolist())
        root = np.arange(n)
        period = after - root
        root, after, period = (x[(after < n) & (period * times <= n)] for x in (root, after, period))
        high = after + onward.common(root, after)
        low = root.copy()
        inner = root > 0
        low[inner] -= back.common(n - root[inner], n - after[inner])
        found.append(np.stack([low, high - low, period], 1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(least, times * rows[:, 2])]
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def window(least: int, times: int) -> int:
    """The fewest words of a run that equal the word one period later, over all periods."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repetitive(words: list[bytes], size: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of words all of which lie in windows that occur twice or more.

    Windows are compared by hash; a collision only makes a stretch longer.
    """
    n = len(words)
    if n <= size:
        return []
    mixed = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    done = 1
    while done < size:
        step = min(done, size - done)
        mixed = (mixed[:-step] ^ (mixed[:-step] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + mixed[step:]
        done += step
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    starts = np.flatnonzero(np.isin(mixed, twice))
    cuts = np.flatnonzero(starts[1:] > starts[:-1] + size)
    return list(zip(starts[np.r_[0, cuts + 1]].tolist(), (starts[np.r_[cuts, len(starts) - 1]] + size).tolist()))


def find(words: list[bytes], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text's words, by start and then period."""
    stretches = [s for s in repetitive(words, window(least, times)) if s[1] - s[0] >= least]
    found, pool, origin = [], [], []
    number: dict[bytes, int] = {}

    def search() -> None:
        rows = runs_of(pool, least, times)
        if len(rows):
            rows[:, 0] = np.array(origin)[rows[:, 0]]
            found.append(rows)
        pool.clear(), origin.clear()

    for low, high in stretches:
        if pool and len(pool) + high - low > POOL:
            search()
        if pool:  # no run goes over a word that occurs once
            pool.append(number.setdefault(b"%d %d" % (low, high), len(number)))
            origin.append(-1)
        pool.extend(number.setdefault(w, len(number)) for w in words[low:high])
        origin.extend(range(low, high))
    if pool:
        search()
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def kept_words(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(rows):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per row: key, all runs of the text, and the text without what runs repeat.

    ``change``, if given, is applied to a row's key and words first. One pass
    without a shuffle.
    """
    kind = dict(docs.dtypes)[key]

    def described(columns: dict) -> dict:
        runs, collapsed = [], []
        for own, t in zip(columns["doc_id"].to_pylist(), columns["text"].to_pylist()):
            words = t.encode().split()  # bytes are split at ASCII white space alone
            if change is not None:
                words = change(own, words)
            rows = find(words, least, times)
            runs.append(rows)
            collapsed.append(b" ".join(kept_words(words, rows)).decode())
        ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
        flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        each = pa.StructArray.from_arrays(
            [pa.array(flat[:, i]) for i in range(3)], fields=[pa.field(n, pa.int64()) for n in ("start", "length", "period")])
        kind_of = pa.list_(pa.field("element", each.type))
        return {"doc_id": columns["doc_id"], "runs": pa.ListArray.from_arrays(pa.array(ends), each, kind_of), "collapsed": collapsed}

    return in_batches(
        texts(docs, key, text), f"doc_id {kind}, runs array<{RUN}>, collapsed string", described)


def strongest(runs: Column | str) -> Column:
    """The run with the greatest exact length / period, the first of equals; NULL without runs."""
    def better(best: Column, run: Column) -> Column:
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def listed(runs: Column | str) -> Column:
    """Each run as a line ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
