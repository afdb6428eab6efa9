"""Ids of whole texts by a byte-level model of the tokenizers library.

The library splits a text at word borders before it merges bytes, so texts are cut
into segments whose ids are kept; new words go to the library's model directly.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa

from panelkit.llm.segments import LATIN, SegmentTable

#: Signs that never belong to a word, nor begin a contraction.
SIGNS = ".,;:!?)]"
_word = re.compile(rf" ?[{LATIN}]{{1,64}}\Z|\n\Z|[{re.escape(SIGNS)}]{{1,8}}\Z")
_loaded: dict[tuple[str, bool], "ByteEncoder"] = {}


def byte_signs() -> list[str]:
    """The sign that a byte-level vocabulary writes for each byte: visible Latin-1 signs
    stand for themselves, the others for those from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteEncoder:
    """Ids by one vocabulary file, as the library gives them without special tokens added.

    ``plain``: the strings of special tokens inside texts are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError(f"{path}: not a byte-level model without normalizer and prefix")
        if any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in parts["added_tokens"]):
            raise ValueError(f"{path}: special tokens reach over spaces")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.model = self.library.model
        self.signs = str.maketrans({b: s for b, s in enumerate(byte_signs())})
        self.table = SegmentTable(self.segments, b"", signs=SIGNS)

    def segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment: words, signs and line breaks by the model itself, all else by the library's splitting first."""
        tokenize, signs, pack = self.model.tokenize, self.signs, [struct.Struct(f"<{n}I").pack for n in range(80)]
        out: list = []
        others: list[int] = []
        for segment in segments:
            if _word.match(segment):
                ids = [t.id for t in tokenize(segment.encode().decode("latin-1").translate(signs))]
                out.append(pack[len(ids)](*ids) if len(ids) < 80 else struct.pack(f"<{len(ids)}I", *ids))
            else:
                others.append(len(out))
                out.append(None)
        encoded = self.library.encode_batch_fast([segments[i] for i in others], add_special_tokens=False)
        for i, e in zip(others, encoded):
            ids = e.ids
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and where those of each text end."""
        values, which, ends = self.table.values(texts)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        own = size[which]
        upto = np.r_[0, np.cumsum(own)]
        # The id at place k of a segment that starts at s stands at begin[segment] + k - s.
        shift = (np.cumsum(size) - size)[which] - upto[:-1]
        return ids[np.repeat(shift, own) + np.arange(upto[-1])], upto[ends]


def loaded(path: str, plain: bool = False) -> ByteEncoder:
    """The encoder of a file, made once a worker."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = ByteEncoder(path, plain)
    return _loaded[path, plain]
