"""Alignment of the tokens of two tokenizers (operator 12).

Both tokenizers' tokens are spelled as bytes and laid over the same text. Where
tokens of both end, the text is cut: a dictionary for each side maps ends to
indexes, the keys that both hold are sorted, and they slice the two id lists into
groups. Within a group, tokens whose byte ranges overlap are linked.
``describe`` finds the same groups and links in one walk over both sides.

Both tokenizers put a space in front of a token and join nothing over it, so such a
place is a common end in any text. The groups of a segment between two of them are
found once and kept; a text's groups are those of its segments.

How many documents hold a pair of ids is counted over all of them. Tasks put
documents into blocks and count for each block the distinct pairs, so what is
shuffled are pairs of blocks, not links. Counts go back to the blocks the same way,
and sum up there. For that a block keeps which pairs each of its documents holds and
how often, as gaps in their order, which takes a small part of the text's own size.

Defined results: a text that is NULL or empty, or that one side's tokens do not
spell, has no tokens; rows with equal or NULL keys count as documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from struct import Struct, pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelkit.llm import bytepairs
from panelkit.llm.common import slices, texts
from panelkit.llm.pieces import SPACE
from panelkit.llm.segments import SegmentTable
from panelkit.session import stage

#: Most documents and bytes of text in a block, unless a single text has more.
BLOCK_ROWS, BLOCK_BYTES = 1024, 2 << 20
#: Most segments whose links are spread out at a time, unless a single text has more.
SPREAD = 1 << 16
#: Most segments of each of two generations that a worker keeps; each takes about 0.2 KB.
KEPT = 200_000
#: What is kept of a segment: numbers of A ids, B ids, groups and linked pairs, and whether both sides spell it; then the pairs, and the groups as text.
HEAD = np.dtype([("a", "<u4"), ("b", "<u4"), ("groups", "<u4"), ("links", "<u4"), ("spelled", "?")])
_head = Struct("<4I?")
DOCUMENT = "n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string"
_loaded: dict[tuple[str, str], "Aligner"] = {}
Group = tuple[list[int], list[int]]


class Aligner:
    """Groups and links of texts under a byte-level model (A) and a piece model (B)."""

    def __init__(self, byte_model: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor

        self.a = bytepairs.ByteEncoder(byte_model, plain=True)
        self.b = sp = SentencePieceProcessor(model_file=piece_model)
        if sp.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError(f"{piece_model}: changes white space")
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{piece_model}: pieces reach over spaces")
        byte_of = {s: b for b, s in enumerate(bytepairs.byte_signs())}
        library = self.a.library
        self.bytes_a = [bytes(byte_of[s] for s in library.id_to_token(i)) if all(s in byte_of for s in library.id_to_token(i)) else b""
                        for i in range(library.get_vocab_size())]
        self.bytes_b = [
            b"" if sp.is_unknown(i) or sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.shown_a, self.shown_b = ([*map(str, range(len(x)))] for x in (self.size_a, self.size_b))
        self.table = SegmentTable(self.segments, _head.pack(0, 0, 0, 0, True), leading=True, most=KEPT)

    def groups(self, a: list[int], b: list[int]) -> tuple[list[Group], list[int], list[int]]:
        """The id lists sliced where tokens of both sides end, and the ends of all tokens."""
        ends_a, ends_b = list(accumulate(map(self.size_a.__getitem__, a))), list(accumulate(map(self.size_b.__getitem__, b)))
        at_a, at_b = dict(zip(ends_a, range(1, len(a) + 1))), dict(zip(ends_b, range(1, len(b) + 1)))
        out, i, j = [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            k, m = at_a[end], at_b[end]
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out, ends_a, ends_b

    def spells(self, segment: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both sides are the segment's bytes."""
        spelled = segment.encode()
        return b"".join([self.bytes_a[i] for i in a]) == spelled and b"".join([self.bytes_b[i] for i in b]) == spelled

    def aligned(self, segment: str, a: list[int], b: list[int]) -> bytes:
        """A segment's head, linked pairs and groups as one string of bytes, which takes the least memory."""
        if not self.spells(segment, a, b):
            return _head.pack(0, 0, 0, 0, False)
        if not a:
            return _head.pack(0, 0, 0, 0, True)
        # One walk over both sides: the token that ends first is followed, and where both end a group does.
        size_a, size_b, shown_a, shown_b = self.size_a, self.size_b, self.shown_a, self.shown_b
        rest_a, rest_b = iter(a), iter(b)
        x, y = next(rest_a), next(rest_b)
        end_a, end_b, text = size_a[x], size_b[y], ""
        own, other, links, groups = shown_a[x], shown_b[y], [x << 32 | y], 1
        add = links.append
        while True:
            if end_a < end_b:
                x = next(rest_a)
                end_a += size_a[x]
                own += "," + shown_a[x]
            elif end_b < end_a:
                y = next(rest_b)
                end_b += size_b[y]
                other += "," + shown_b[y]
            else:
                text += own + "|" + other
                x = next(rest_a, None)
                if x is None:
                    break
                y = next(rest_b)
                end_a += size_a[x]
                end_b += size_b[y]
                text += ";"
                own, other = shown_a[x], shown_b[y]
                groups += 1
            add(x << 32 | y)
        return _head.pack(len(a), len(b), groups, len(links), True) + pack(f"<{len(links)}q", *links) + text.encode()

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for segments, each of which begins with a space."""
        a = [memoryview(i).cast("I").tolist() for i in self.a.segments(segments)]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1) if segments else []

    def segments(self, segments: list[str]) -> list[bytes]:
        return [self.aligned(s, x, y) for s, x, y in zip(segments, *self.ids(segments))]

    def block(self, rows: pa.RecordBatch) -> dict:
        """What is known of a block's documents, their segments, and the distinct pairs of its links."""
        values, which, ends = self.table.values(rows.column("text"))
        spelled = heads(values)["spelled"]
        if not spelled[which].all():
            # A text that is not spelled segment by segment may still be as a whole.
            row_of = np.repeat(np.arange(rows.num_rows), np.diff(ends))
            parts = [which[a:b] for a, b in zip(ends, ends[1:])]
            for row in np.unique(row_of[~spelled[which]]).tolist():
                value, = self.segments([" " + rows.column("text")[row].as_py()])
                parts[row] = np.array([len(values)] if heads([value])["spelled"][0] else [], np.int64)
                values.append(value)
            which, ends = np.concatenate(parts), np.r_[0, np.cumsum(list(map(len, parts)))]
        used, which = np.unique(which, return_inverse=True)
        values = [values[i] for i in used.tolist()]
        head = heads(values)
        size = head["links"].astype(np.int64)
        after = (HEAD.itemsize + 8 * size).tolist()
        codes, pair = np.unique(np.frombuffer(b"".join([v[HEAD.itemsize:n] for v, n in zip(values, after)]), "<i8"), return_inverse=True)
        total = lambda k: sums(head[k].astype(np.int64)[which], ends)
        texts_of = [v[n:] for v, n in zip(values, after)]
        shown, listed = [], which.tolist()
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            shown.append(hashlib.sha256(b";".join([texts_of[i] for i in listed[a:b]])).hexdigest() if b > a else "")
        own, times = held_pairs(pair, size, which, ends, len(codes))
        held = np.bincount(own % max(1, len(codes)), minlength=len(codes))
        columns = [rows.column("doc_id"), total("a"), total("b"), total("groups"), total("links"), shown]
        names = ["doc_id", *[f.split(":")[0] for f in DOCUMENT.split(",")]]
        docs = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
        return {
            "docs": docs.to_struct_array(), "gaps": packed(np.diff(own, prepend=0)), "times": packed(times), "codes": codes, "held": held,
        }


def heads(values: list[bytes]) -> np.ndarray:
    """The heads of what is known of segments."""
    return np.frombuffer(b"".join([v[:HEAD.itemsize] for v in values]), HEAD)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[ends[i]:ends[i + 1]]``."""
    upto = np.r_[0, np.cumsum(values)]
    return upto[ends[1:]] - upto[ends[:-1]]


def gathered(values: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` (of ``size`` each) that ``which`` names, one after the other."""
    own = size[which]
    upto = np.cumsum(own)
    shift = (np.cumsum(size) - size)[which] - (upto - own)
    return values[np.repeat(shift, own) + np.arange(own.sum())]


def held_pairs(pair: np.ndarray, size: np.ndarray, which: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of each document in order, as document * ``n`` + pair, and how many links each stands for."""
    own, times, at, last = [], [], 0, len(ends) - 1
    while at < last:
        upto = min(last, max(at + 1, int(np.searchsorted(ends, ends[at] + SPREAD, "right")) - 1))
        part = which[ends[at]:ends[upto]]
        if upto == at + 1:
            # A single text, which may be of any length: what it takes grows with its distinct segments.
            links = np.bincount(pair, np.repeat(np.bincount(part, minlength=len(size)), size), n).astype(np.int64)
            found = np.flatnonzero(links)
            own.append(at * n + found)
            times.append(links[found])
        else:
            row_of = np.repeat(np.repeat(np.arange(at, upto), np.diff(ends[at:upto + 1])), size[part])
            found = np.unique(row_of * n + gathered(pair, size, part), return_counts=True)
            own.append(found[0])
            times.append(found[1])
        at = upto
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (own, times))


def packed(values: np.ndarray) -> bytes:
    """Integers from 0, mostly small: how many, and a compressed plane of each of their bytes."""
    width = 4 if not len(values) or values.max() < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pack("<Q", len(values)) + bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = Struct("<QB").unpack_from(data)
    planes = pa.decompress(memoryview(data)[9:], n * width, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def loaded(byte_model: str, piece_model: str) -> Aligner:
    """The aligner of two files, made once a worker."""
    if (byte_model, piece_model) not in _loaded:
        _loaded[byte_model, piece_model] = Aligner(byte_model, piece_model)
    return _loaded[byte_model, piece_model]


def blocks(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in blocks, with the distinct pairs (``codes``) of each block and how many of its documents hold them."""
    kind = dict(docs.dtypes)[key]
    schema = f"block bigint, docs array<struct<doc_id:{kind},{DOCUMENT}>>, gaps binary, times binary, codes array<bigint>, held array<int>"
    own = texts(docs, key, text)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(byte_model, piece_model)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_ROWS, BLOCK_BYTES):
                found = {"block": block, **aligner.block(rows)}
                yield pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in fields], schema=fields)
                block += 1

    return own.mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """Per pair of ids (``code``: A id, then B id in the lower half) the documents that hold it, and whether its A id has no higher count."""
    each = found.select(F.explode(F.arrays_zip("codes", "held")).alias("e"))
    counts = stage(each.groupBy(F.col("e.codes").alias("code")).agg(F.sum("e.held").alias("n")), "pairs")
    a = F.shiftright("code", 32).alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(highest, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def describe(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids of both sides, groups, links, links whose count is the highest of their A id, and the sum of the counts."""
    found = stage(blocks(docs, byte_model, piece_model, key, text), "blocks")
    needed = found.select("block", F.posexplode("codes").alias("place", "code"))
    given = needed.join(pair_counts(found), "code").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("given"))
    joined = found.select("block", "docs", "gaps", "times").join(given, "block", "left").drop("block")
    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.column("docs")[at].values
                gaps, times = (unpacked(batch.column(c)[at].as_py()) for c in ("gaps", "times"))
                known = batch.column("given")[at].values
                n = 0 if known is None else len(known)
                row_of, pair = np.divmod(np.cumsum(gaps), max(1, n))
                ends = np.searchsorted(row_of, np.arange(len(own) + 1))
                out = {name: own.field(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                for name, column in (("n_best", "best"), ("count_sum", "n")):
                    value = np.zeros(n, np.int64)
                    if n:
                        value[known.field("place").to_numpy()] = known.field(column).to_numpy(zero_copy_only=False)
                    out[name] = pa.array(sums(value[pair] * times, ends))
                yield pa.RecordBatch.from_arrays([out[f.name] for f in fields], schema=fields)

    return joined.mapInArrow(run, schema)


def align(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and its ``groups``, each with the ids of both sides; none where a side does not spell the text."""
    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(byte_model, piece_model)
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_ROWS, BLOCK_BYTES):
                own = rows.column("text").to_pylist()
                out = []
                for text, a, b in zip(own, *aligner.ids([f" {t}" for t in own])):
                    fits = text and aligner.spells(f" {text}", a, b)
                    out.append([{"a": x, "b": y} for x, y in aligner.groups(a, b)[0]] if fits else [])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, fields.field("groups").type)], schema=fields)

    return texts(docs, key, text).mapInArrow(run, schema)
