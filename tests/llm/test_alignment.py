"""Alignment against a search of all pairs of tokens, from the libraries' own ids."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import alignment
from panelkit.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES

DDL = "doc_id long, text string, groups string, block int"


@lru_cache(None)
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_MODEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def libraries():
    return both()


def tokens(libraries, text):
    """Both sides' (id, start, end) in bytes; none if a side does not spell the text."""
    a, b = libraries
    signs = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    signs |= dict(zip(map(chr, range(256, 512)), [x for x in range(256) if chr(x) not in signs]))
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(signs[s] for s in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    whole = f" {text}".encode()
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], []
    out = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, own = 0, []
        for i, part in zip(ids, parts):
            own.append((i, at, at + len(part)))
            at += len(part)
        out.append(own)
    return tuple(out)


def plain(libraries, rows):
    """What the query gives for rows of (key, text), every pair of tokens tried that is near."""
    kept, holders = [], Counter()
    for key, text in rows:
        a, b = tokens(libraries, text or "")
        links, j = [], 0
        for i, start, end in a:
            while j < len(b) and b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        common = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= high) for side in (a, b)) if len(a) < 3000 else None)
            low = high
        holders.update(set(links))
        kept.append((key, a, b, links, groups))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    out = []
    for key, a, b, links, groups in kept:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a and None not in groups else "" if not a else None
        out.append((key, len(a), len(b), len(groups), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), sha))
    return out


def shown(df):
    return [tuple(r) for r in df.collect()]


def same(got, expected):
    """Equal as multisets of rows; digests are compared where the plain version has one."""
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r[:7])))
    got, expected = order(got), order(expected)
    assert [g[:7] for g in got] == [e[:7] for e in expected]
    assert all(e[7] is None or g[7] == e[7] for g, e in zip(got, expected))


parts = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "é", "▁", "<|endoftext|>", "</s>", "<0x0A>", "1234", "。", "😀", "'s", ".", "\x00", "ſt", "İ"])
words = st.lists(parts, max_size=14).map("".join) | st.text(max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_a_block_holds_what_the_libraries_give(texts):
    rows = alignment.pa.RecordBatch.from_arrays([alignment.pa.array(range(len(texts))), alignment.pa.array(texts)], names=["doc_id", "text"])
    block = alignment.loaded(BYTE_MODEL, PIECE_MODEL).block(rows)
    found = [(d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["groups_sha256"]) for d in block["docs"].to_pylist()]
    assert found == [(*r[:5], r[7]) for r in plain(both(), list(enumerate(texts)))]


def test_rows_of_every_kind(spark, libraries, monkeypatch):
    text = "Unbelievable tokenizations, naïve — 12345 <|endoftext|> </s>"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, " "), (5, "▁ sign"), (6, "  two  spaces \n"), (7, "a" * 3000), (8, "é" * 500 + " the")]
    docs = spark.createDataFrame([(k, t, "g", 0) for k, t in rows], DDL)
    same(shown(alignment.describe(docs, BYTE_MODEL, PIECE_MODEL)), plain(libraries, rows))
    assert alignment.describe(docs.limit(0), BYTE_MODEL, PIECE_MODEL).collect() == []
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 1)  # workers are forked with it only by chance; results are the same
    same(shown(alignment.describe(docs.repartition(3), BYTE_MODEL, PIECE_MODEL)), plain(libraries, rows))


def test_groups_of_texts(spark, libraries):
    rows = [(1, "Unbelievable tokenizations"), (2, None), (3, "▁"), (4, "x  y")]
    docs = spark.createDataFrame([(k, t, "g", 0) for k, t in rows], DDL)
    found = {r.doc_id: r.groups for r in alignment.align(docs, BYTE_MODEL, PIECE_MODEL).collect()}
    for key, text in rows:
        said = ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in found[key])
        digest = hashlib.sha256(said.encode()).hexdigest() if said else ""
        assert (len(found[key]), digest) == (lambda r: (r[3], r[7]))(plain(libraries, [(key, text)])[0])


def test_full_tables_change_nothing(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 5)
    aligner = alignment.Aligner(BYTE_MODEL, PIECE_MODEL)
    texts = [" ".join(f"word{i * k % 17} tion{i % 5}," for i in range(40)) for k in range(1, 9)]
    for _ in range(2):
        for k, text in enumerate(texts):
            rows = alignment.pa.RecordBatch.from_arrays([alignment.pa.array([k]), alignment.pa.array([text])], names=["doc_id", "text"])
            d, = aligner.block(rows)["docs"].to_pylist()
            assert (d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["groups_sha256"]) == (lambda r: (*r[1:5], r[7]))(plain(libraries, [(k, text)])[0])


def test_counts_of_pairs(spark):
    docs = spark.createDataFrame([(k, t, "g", 0) for k, t in [(1, "the the"), (2, "the"), (3, "of")]], DDL)
    found = alignment.pair_counts(alignment.blocks(docs, BYTE_MODEL, PIECE_MODEL)).collect()
    assert sorted(r.n for r in found) == [1, 2] and all(r.best for r in found)


def rows_of(texts):
    return alignment.pa.RecordBatch.from_arrays([alignment.pa.array(range(len(texts))), alignment.pa.array(texts)], names=["doc_id", "text"])


def test_a_block_keeps_little_of_its_links():
    """What goes back to the counts is a small part of the text, though most segments are new ones."""
    texts = [" ".join(f"{w}{(7919 * k * i) % 9973}" for i, w in enumerate(["Reports", "of", "the", "markets,", "Tuesday's"] * 60)) for k in range(1, 60)]
    block = alignment.loaded(BYTE_MODEL, PIECE_MODEL).block(rows_of(texts))
    assert sum(len(v) for v in block.values() if isinstance(v, bytes)) < sum(map(len, texts)) / 3


@pytest.mark.parametrize("spread", [1, 40, 1 << 16])
def test_pairs_that_documents_hold(libraries, monkeypatch, spread):
    monkeypatch.setattr(alignment, "SPREAD", spread)
    texts = ["the cat, the cat", "", "tokenization " * 50 + "ends", "é", "", "the", "Unbelievable cat's " * 3, ""]
    block = alignment.loaded(BYTE_MODEL, PIECE_MODEL).block(rows_of(texts))
    codes = [int(c) for c in block["codes"]]
    found = {k: {} for k in range(len(texts))}
    for own, times in zip(alignment.np.cumsum(alignment.unpacked(block["gaps"])).tolist(), alignment.unpacked(block["times"]).tolist()):
        found[own // len(codes)][codes[own % len(codes)]] = times
    holders = Counter()
    for k, text in enumerate(texts):
        a, b = tokens(libraries, text)
        links = Counter(x << 32 | y for x, start, end in a for y, low, high in b if low < end and start < high)
        assert found[k] == links
        holders.update(links.keys())
    assert dict(zip(codes, block["held"].tolist())) == holders


def test_packed_integers():
    for values in ([], [0], [1, 300, 0, 70_000], [1 << 40, 5]):
        assert alignment.unpacked(alignment.packed(alignment.np.array(values, "i8"))).tolist() == values


def test_the_query_on_whole_documents(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    same(shown(QUERIES["op12_token_alignment"](spark, d)), plain(libraries, rows))


def test_a_segment_is_walked_once(monkeypatch):
    """Its groups and links are those of the sliced id lists, found without slicing them."""
    own = alignment.loaded(BYTE_MODEL, PIECE_MODEL)
    segments = [" a", " Überraschung,", " 北京大学", " tokenization's", " \t\n x", " é\U0001f600"]
    wanted = []
    for a, b in zip(*own.ids(segments)):
        groups = own.groups(a, b)[0]
        wanted.append((len(a), len(b), len(groups), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)))
    monkeypatch.setattr(own, "groups", None)
    got = []
    for value in own.segments(segments):
        head = alignment.heads([value])[0]
        assert head["spelled"]
        got.append((head["a"], head["b"], head["groups"], value[alignment.HEAD.itemsize + 8 * int(head["links"]):].decode()))
    assert got == wanted
