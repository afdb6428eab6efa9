"""Periodic runs against a search of all periods and places."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import periods
from panelkit.llm.queries import QUERIES, planted


def plain_runs(words, least, times):
    """All runs as (start, period, length), each period tried at each place."""
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q):
                if not any(all(words[k] == words[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                    out.add((i, q, size))
            i = max(j, i) + 1
    return sorted(out)


def found(rows):
    return [(int(s), int(q), int(n)) for s, n, q in rows]


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70)
repeated = st.tuples(words, st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(0, 12), words).map(
    lambda p: p[0] + p[1] * p[2] + p[3])


@settings(max_examples=400, deadline=None)
@given(words | repeated, st.sampled_from([(2, 2), (5, 2), (6, 3), (24, 3), (1, 4)]))
def test_all_runs_are_found(text, sizes):
    assert found(periods.find(text, *sizes)) == plain_runs(text, *sizes)


@settings(max_examples=100, deadline=None)
@given(words | repeated)
def test_trees_need_no_choice_of_stretches(text):
    number = {w: i for i, w in enumerate(sorted(set(text)))}
    assert found(periods.runs_of([number[w] for w in text], 6, 3)) == plain_runs(text, 6, 3)


def test_many_stretches_and_full_pools(monkeypatch):
    monkeypatch.setattr(periods, "POOL", 100)
    draw = random.Random(3)
    text = []
    for k in range(40):
        text += [b"x%d" % draw.randrange(10**9) for _ in range(draw.randrange(5))] + [b"w%d" % (k % 3), b"v%d" % k, b"u"][: 1 + k % 3] * 12
    assert found(periods.find(text)) == plain_runs(text, 24, 3)


def test_windows_that_a_run_must_repeat():
    for least, times in ((24, 3), (10, 2), (1, 2), (7, 5)):
        sizes = [(max(least, times * q) - q) for q in range(1, 400)]
        assert periods.window(least, times) == min(sizes)


def test_extensions_of_all_pairs():
    draw = random.Random(5)
    for alphabet in (1, 2, 4):
        word = [draw.randrange(alphabet) for _ in range(60)] + [9]
        ext = periods.Extensions(word)
        assert [word[i:] for i in ext.leaves] == sorted(word[i:] for i in range(61))
        for a in range(60):
            for b in range(a + 1, 61):
                k = 0
                while b + k < 61 and word[a + k] == word[b + k]:
                    k += 1
                assert ext.common(periods.np.array([a]), periods.np.array([b])).tolist() == [k]


def test_a_long_text_of_one_word():
    assert found(periods.find([b"w"] * 50_000)) == [(0, 1, 50_000)]


def described(rows):
    """What the query gives, from runs by the plain search."""
    out = []
    for key, text in rows:
        own = planted(key, (text or "").encode().split())
        runs = plain_runs(own, 24, 3)
        best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        top = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
        out.append((key, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_rows_of_every_kind(spark, tmp_path):
    again = "one two three " * 9
    rows = [(1, again), (1, again), (None, again), (2, None), (3, ""), (4, " \t\n\x0b"), (5, "a b " * 30), (6, "z " * 24), (7, "z " * 23), (8, "\x1c " * 40)]
    docs = spark.createDataFrame([(k, t, "r", 0) for k, t in rows], "doc_id long, text string, runs string, start int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == described(rows)
    assert periods.find_runs(docs.limit(0)).collect() == []


def test_planting_makes_periods():
    words = [b"%d" % i for i in range(200)]
    key = next(k for k in range(1000) if zlib.crc32(b"%d" % k) % 10 == 0 and zlib.crc32(b"%d" % k) // 10 % 200 < 50)
    changed = planted(key, words)
    (start, length, period), = periods.find(changed).tolist()
    assert start == zlib.crc32(b"%d" % key) // 10 % 200 and start + length == 200 and length >= 3 * period


@pytest.mark.parametrize("sf", ["0.01"])
def test_the_query_on_whole_documents(spark, sf):
    d = f"/root/testdata/sf{sf}"
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, d).collect()), key=lambda r: r[0])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    # The plain search takes the square of a text's length, so it is held against the shorter texts.
    short = {r[0] for r in rows if len((r[1] or "").split()) <= 400}
    assert [g for g in got if g[0] in short] == sorted(described([r for r in rows if r[0] in short]), key=lambda r: r[0])
