"""SentencePiece encoding and decoding (operator 1).

A merge-type model joins, again and again, the adjacent pair whose union has the
best score, the leftmost first. Its result is the one sequence of pieces in which
each adjacent pair stays as it is when the two are merged anew. So a text can be
encoded from left to right: take the longest piece that starts here, test it
against the piece before it, try shorter ones, and step back where none fits,
remembering the position as failed.

Defined results: a NULL or empty text has no ids and decodes to an empty text;
rows with equal or NULL keys are encoded one by one; characters that no piece
holds become the bytes of their UTF-8 form.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import in_batches, texts

SPACE = "▁"
#: Most entries that a worker keeps of encoded segments, and of tested pairs.
KEPT = 300_000
_loaded: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Backtracking encoder over the vocabulary of one model file."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_file=model_path)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.score_of = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown_id = sp.unk_id()
        self.has_bytes = sp.is_byte(self.byte_ids[0])
        # Only pieces that merging gives back whole can occur in a result.
        self.found = ahocorasick.Automaton()
        reachable = set()
        for piece in self.id_of:
            if self.merged(piece) == [piece]:
                reachable.add(piece)
                self.found.add_word(piece, piece)
        self.found.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), None) for p in reachable}
        self.fits: dict[str, dict[str, bool]] = {}
        self.tested = 0
        self.segments: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # No piece crosses from another character to a space, so that place cuts a text into
        # segments which merging never joins. The same holds for a character in no piece.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            self.segment = re.compile(r"(?s).+")
        else:
            newline = "" if "\n" in self.id_of or any("\n" in p for p in self.id_of) else "\n"
            self.segment = re.compile(f"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+|{newline}+" if newline else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score and then leftmost first."""
        parts, score_of = list(text), self.score_of
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = score_of.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """True if merging the two pieces anew gives the same two pieces."""
        if self.tested >= KEPT:
            self.fits.clear()
            self.tested = 0
        self.tested += 1
        fits = self.fits.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
        return fits

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; characters in no piece stand alone."""
        longest = list(text)
        for end, piece in self.found.iter(text):
            longest[end + 1 - len(piece)] = piece  # ends ascend, so the longest comes last
        shorter, pairs, nothing = self.shorter.get, self.fits, {}
        failed = bytearray(len(text) // 8 + 1)  # a bit for each position
        out: list[str] = []
        pos, length = 0, len(text)
        piece = longest[0] if text else None
        while pos < length:
            end = pos + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = True
                if out:
                    fits = pairs.get(out[-1], nothing).get(piece)
                    if fits is None:
                        fits = self.compatible(out[-1], piece)
                if fits:
                    out.append(piece)
                    pos = end
                    if pos < length:
                        piece = longest[pos]
                    continue
            piece = shorter(piece)
            while piece is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                last = out.pop()
                pos -= len(last)
                piece = shorter(last)
        return out

    def segment_ids(self, segment: str) -> tuple[int, ...]:
        known = self.older.get(segment)
        if known is None:
            ids: list[int] = []
            for piece in self.pieces(segment):
                own = self.id_of.get(piece)
                if own is not None:
                    ids.append(own)
                elif self.has_bytes:
                    ids.extend(self.byte_ids[b] for b in piece.encode())
                else:
                    ids.append(self.unknown_id)
            known = tuple(ids)
        if len(segment) <= 64:
            if len(self.segments) >= KEPT:
                self.older, self.segments = self.segments, {}
            self.segments[segment] = known
        return known

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        segments = self.segment.findall(self.processor.normalize(text))
        found = list(map(self.segments.get, segments))
        if None in found:
            found = [self.segment_ids(s) if ids is None else ids for s, ids in zip(segments, found)]
        return list(chain.from_iterable(found))

    def decode(self, ids) -> str:
        return self.processor.decode(ids) if ids else ""


def loaded(model_path: str) -> PieceEncoder:
    """The encoder of a file, made once a worker."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceEncoder(model_path)
    return _loaded[model_path]


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids of the whole text, and the text decoded from them.

    One pass without a shuffle. The model file is public and must be at the same
    path on every machine; each worker loads it once.
    """
    kind = dict(docs.dtypes)[key]

    def encoded(columns: dict, encoder: PieceEncoder) -> dict:
        rows = [encoder.encode(t) for t in columns["text"].to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])
        return {
            "doc_id": columns["doc_id"],
            "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.field("element", pa.int32(), False))),
            "decoded": [encoder.decode(r) for r in rows],
        }

    return in_batches(texts(docs, key, text), f"doc_id {kind}, ids array<int>, decoded string", encoded, lambda: loaded(model_path))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Number of ids, digests of the ids and of the decoded text, and ``more`` columns."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more,
    )
