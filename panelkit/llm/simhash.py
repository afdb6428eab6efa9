"""SimHash near-duplicates (operator 5) by a Gray-order hierarchical index.

Fingerprints link when at most ``DISTANCE`` of their 64 bits differ. Cut into
more blocks than that, two linked fingerprints agree in at least
``blocks - DISTANCE`` of them, so every choice of that many blocks is one table
of the index: fingerprints with the same bits there form a group, and each
linked pair meets in a group of some table. The number of blocks follows the
number of fingerprints, to keep groups small; the result does not depend on it.

Within a group, fingerprints are sorted by their rank in the reflected Gray
order, in which neighbours differ in few bits. Runs of ``FANOUT`` neighbours form
a node that keeps the bits all of them share, runs of nodes an upper node, and so
on. Two nodes can hold a linked pair only if at most ``DISTANCE`` of the bits that
both share differ, so a comparison goes down from the roots and drops whole
groups of pairs at once.

Only distinct fingerprints enter the index, each once a table, and a group hands
on no more links than it has fingerprints: a spanning forest, which keeps every
connection. Groups above ``CHUNK`` fingerprints are dealt to several tasks, a pair
of parts in each, so that no task holds a large group.

Defined results: a NULL, empty or blank text has fingerprint zero, which links
like any other; documents with equal keys or texts keep their own rows; a
component in which all keys are NULL has a NULL component_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import in_batches, texts
from panelkit.llm.components import connected
from panelkit.session import stage

SHINGLE = 4
SEED = 42
DISTANCE = 4
FANOUT = 8
#: Fingerprints of a group that one task compares among themselves.
CHUNK = 2048
#: Expected fingerprints of a group, above which the index takes one block more.
GROUP = 2048
#: Pairs of nodes that are compared at a time.
PAIRS = 1 << 18


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of the word shingles of a text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = begin + size
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        spans = zip(begin[: len(words) - SHINGLE + 1].tolist(), end[SHINGLE - 1:].tolist())
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    raw = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 1 << 16):
        bits = np.unpackbits(raw[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(raw), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = dict(docs.dtypes)[key]
    return in_batches(
        texts(docs, key, text), f"doc_id {kind}, fp long",
        lambda c: {"doc_id": c["doc_id"], "fp": [fingerprint(t) for t in c["text"].to_pylist()]},
    )


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Rank of each 64-bit pattern in the reflected Gray order."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The bits of each table's key: every choice of all but ``distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def choose_blocks(n: int, distance: int = DISTANCE) -> int:
    """Blocks at which a group of evenly spread fingerprints is expected to stay small."""
    for blocks in range(distance + 1, distance + 5):
        if n <= GROUP << (64 * (blocks - distance) // blocks):
            return blocks
    return distance + 5


class Level:
    """Nodes of one level: first and last child, and the bits that all below share."""

    def __init__(self, first, last, pattern, mask):
        self.first, self.last, self.pattern, self.mask = first, last, pattern, mask


def levels_of(fps: np.ndarray, group: np.ndarray) -> list[Level]:
    """Levels from the leaves to the roots; a node never spans two groups."""
    at = np.arange(len(fps))
    out = [Level(at, at + 1, fps, np.full(len(fps), ~np.uint64(0)))]
    while True:
        below = out[-1]
        turn = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        if len(turn) == len(group):
            return out
        place = np.arange(len(group)) - np.repeat(turn, np.diff(np.append(turn, len(group))))
        first = np.flatnonzero(place % FANOUT == 0)
        both = np.bitwise_and.reduceat(below.pattern, first)
        some = np.bitwise_or.reduceat(below.pattern, first)
        shared = np.bitwise_and.reduceat(below.mask, first) & ~(both ^ some)
        out.append(Level(first, np.append(first[1:], len(group)), both & shared, shared))
        group = group[first]


def children(level: Level, a: np.ndarray, b: np.ndarray):
    """All pairs of children of each pair of nodes; of a node with itself, the upper half."""
    na, nb = level.last[a] - level.first[a], level.last[b] - level.first[b]
    count = na * nb
    pair = np.repeat(np.arange(len(a)), count)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    x = level.first[a][pair] + place // nb[pair]
    y = level.first[b][pair] + place % nb[pair]
    keep = (a[pair] != b[pair]) | (x <= y)
    return x[keep], y[keep]


def roots_of(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    up = parent[nodes]
    while True:
        further = parent[up]
        if np.array_equal(further, up):
            return up
        parent[nodes] = further
        up = further


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; the smaller root stays root."""
    while len(a):
        x, y = roots_of(parent, a), roots_of(parent, b)
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def local_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the place of its set's first, within the groups given.

    ``fps`` is sorted by group and Gray rank. ``side`` tells the two parts of a
    dealt group apart; pairs of one part are compared where that part is whole.
    """
    parent = np.arange(len(fps))
    levels = levels_of(fps, group)
    top = levels[-1]
    todo = [(len(levels) - 1, np.arange(len(top.first)), np.arange(len(top.first)))]
    while todo:
        depth, a, b = todo.pop()
        for at in range(0, len(a), PAIRS // FANOUT ** 2)[1:]:
            todo.append((depth, a[at:at + PAIRS // FANOUT ** 2], b[at:at + PAIRS // FANOUT ** 2]))
        x, y = children(levels[depth], a[:PAIRS // FANOUT ** 2], b[:PAIRS // FANOUT ** 2]) if depth else (a, b)
        if not depth:
            continue
        below = levels[depth - 1]
        apart = np.bitwise_count((below.pattern[x] ^ below.pattern[y]) & below.mask[x] & below.mask[y])
        near = apart <= distance
        x, y = x[near], y[near]
        if depth > 1:
            todo.append((depth - 1, x, y))
        else:
            other = (x != y) & ((side[x] != side[y]) | (side[x] < 0))
            merge(parent, x[other], y[other])
    return roots_of(parent, np.arange(len(fps)))


def links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints: of every group a spanning forest."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in block_masks(choose_blocks(n, distance), distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp"
    )
    hot = keyed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    hot = stage(hot.select("t", "bits", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "hot-groups")
    parts = F.coalesce("parts", F.lit(1))
    own = F.when(parts > 1, F.pmod(F.xxhash64("fp"), parts).cast("int")).otherwise(0)
    # A fingerprint of part p meets its own part in (p, p), and part q in (p, q) or (q, p).
    pairs = F.when(parts > 1, F.sequence(F.lit(0), (parts - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    dealt = (
        keyed.join(hot, ["t", "bits"], "left")
        .select("t", "bits", "fp", own.alias("own"), F.explode(pairs).alias("other"))
        .select(
            "t", "bits", "fp", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        )
    )

    def find(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            key = [rest.column(c).to_numpy() for c in ("t", "bits", "p", "q")]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if len(changes):  # all but the last group are whole
                yield from found(rest.slice(0, int(changes[-1])), changes[:-1])
                rest = rest.slice(int(changes[-1]))
        if rest is not None and rest.num_rows:
            yield from found(rest, np.zeros(0, np.int64))

    def found(batch, changes):
        fp = batch.column("fp").to_numpy().view(np.uint64)
        p, q, own = (batch.column(c).to_numpy() for c in ("p", "q", "own"))
        group = np.zeros(len(fp), np.int64)
        group[changes] = 1
        group = np.cumsum(group)
        order = np.lexsort((gray_rank(fp), group))
        fp, group, side = fp[order], group[order], np.where(p == q, -1, own)[order]
        root = local_links(fp, group, side, distance)
        other = np.flatnonzero(root != np.arange(len(fp)))
        if len(other):
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[other]), pa.array(signed[root[other]])], names=["a", "b"])

    together = dealt.repartition("t", "bits", "p", "q").sortWithinPartitions("t", "bits", "p", "q")
    return together.mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint (``fp``) and the smallest key of its component."""
    rows = stage(fingerprints(docs, key, text), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = stage(links(distinct.select("fp"), distinct.count(), distance), "links")
    label = connected(found)  # only fingerprints that have a link
    rooted = distinct.join(label, distinct.fp == label.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    rooted = stage(rooted, "rooted")
    smallest = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stage(rooted.join(stage(smallest, "smallest"), "label").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
