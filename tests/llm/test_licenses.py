"""Templates in texts; the query itself is held against its SQL."""

import re

import pytest

from panelkit.llm import licenses

WORDS = {"mit": "Released under the MIT License.", "long": " ".join(f"term{i}" for i in range(40))}


def plain(rows, templates):
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda t: [tuple(w[i:i + 5]) for w in [cut(t)] for i in range(len(w) - 4)]
    out = []
    for doc_id, text in rows:
        own = set(grams(text))
        for name, t in templates.items():
            sought = set(grams(t))
            if len(sought & own) >= 0.8 * len(sought):
                out.append((doc_id, name, len(sought & own), len(sought)))
    return sorted(out, key=str)


def scanned(spark, rows, templates):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, at int")
    return sorted(((r.doc_id, r.license, r.n_found, r.n_shingles) for r in licenses.scan(docs, templates).collect()), key=str)


def test_texts_of_every_kind(spark):
    long = WORDS["long"].split()
    edited = [*long[:20], "other", *long[21:]]
    rows = [
        (1, "Some words before. RELEASED under the*** mit--license!! and after"), (2, "Released under the BSD License."), (3, None), (4, ""),
        (5, WORDS["long"]), (6, " ".join(edited)), (7, " ".join(long[:10])), (8, "under the MIT License."), (9, "Released under the MIT License. " * 500),
        (10, "filler " * 100_001 + WORDS["mit"] + " " + WORDS["long"]), (1, "Released under the MIT License."), (None, WORDS["mit"]),
    ]
    mine = scanned(spark, rows, WORDS)
    assert mine == plain(rows, WORDS)
    assert {(1, "mit"), (5, "long"), (6, "long"), (9, "mit"), (10, "mit"), (10, "long")} <= {r[:2] for r in mine}
    assert scanned(spark, [], WORDS) == []


def test_every_place_of_a_template_is_found(spark):
    rows = [(i, "w " * i + WORDS["mit"] + " z" * (i % 7)) for i in range(300)]
    assert scanned(spark, rows, WORDS) == plain(rows, WORDS) and len(plain(rows, WORDS)) == 300


def test_rows_that_share_a_key_are_documents_of_their_own(spark):
    words = WORDS["long"].split()
    rows = [(None, " ".join(words[:20])), (None, " ".join(words[16:])), (3, " ".join(words[:20])), (3, " ".join(words[16:])), (4, WORDS["mit"]), (4, WORDS["mit"]), (None, WORDS["mit"])]
    assert scanned(spark, rows, WORDS) == plain(rows, WORDS) == [(4, "mit", 1, 1), (4, "mit", 1, 1), (None, "mit", 1, 1)]


def test_full_license_texts(spark):
    body = {"full": " ".join(f"clause{i} says{i % 7} that" for i in range(900))}
    rows = [(1, "intro " + body["full"].upper() + " outro"), (2, body["full"][:9000]), (3, body["full"].replace("clause5 ", "point "))]
    assert scanned(spark, rows, body) == plain(rows, body) and [r[0] for r in plain(rows, body)] == [1, 3]


def test_templates_out_of_bounds(spark):
    for wrong, what in (({str(i): "one two three four five" for i in range(licenses.MAX_TEMPLATES + 1)}, "templates"),
                        ({"long": "w " * (licenses.MAX_WORDS + 1)}, "words"), ({"short": "MIT License -- only_x"}, "fewer than 5")):
        with pytest.raises(ValueError, match=what):
            licenses.template_rows(spark, wrong)
