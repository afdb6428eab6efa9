"""Spans against plain patterns."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import pii
from panelkit.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """(start, kind, end) of the base kinds, by scanning with each pattern."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


def base(text):
    return [s for s in pii.spans(text) if s[1] in pii.BASE]


parts = st.sampled_from([
    "a@b.c", "@", ".", "+", "1", "25", "256", "4539578763621486", " ", "-", "(", ")", "x.y", "b.co", "a@b", "é", "\n", "1.2.3.4", "+1 (017) 555-7713",
    "00255", "4539 5787-6362 1486", "http://u:p@h.de/x?y=1.", "token = \"abc123def\"", "IBAN: DE89 3704 0044 0532 0130 00", "_", "%", "0",
])


@settings(max_examples=1500, deadline=None)
@given(st.lists(parts, max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.-+@a ()", max_size=80))
def test_base_spans_in_dense_text(text):
    assert base(text) == plain(text)


@pytest.mark.parametrize("text, expected", [
    ("see https://example.org/a?b=1.", [("url", "https://example.org/a?b=1")]),
    ("FTP://x.de", [("url", "FTP://x.de")]),
    ('token = "908038b7daaf91e7"', [("account", "908038b7daaf91e7")]),
    ("IBAN DE89 3704 0044 0532 0130 00 ok", [("account", "DE89 3704 0044 0532 0130 00")]),
    ("Account no. 1234-5678.", [("account", "1234-5678")]),
    ("my accounts are many, tokens too; secretary", []),
    ("password: hunter", []),
])
def test_added_spans(text, expected):
    assert [(k, text[a:b]) for a, k, b in pii.spans(text) if k not in pii.BASE] == expected


@pytest.mark.parametrize("text, value", [
    ('access_token = "9f8e7d6c5b4a"', "9f8e7d6c5b4a"),
    ("DB_PASSWORD=hunter2xyz", "hunter2xyz"),
    ("client_secret: ab12cd34ef", "ab12cd34ef"),
    ("accessToken: 9f8e7d6c5b4a", "9f8e7d6c5b4a"),
    ("APIToken=9f8e7d6c5b4a", "9f8e7d6c5b4a"),
    ("Account Number: 12345678", "12345678"),
    ("ACCOUNT NO: 12345678", "12345678"),
    ("accountNumber=12345678", "12345678"),
    ("apiKey: 9f8e7d6c5b4a", "9f8e7d6c5b4a"),
    ("API Key: 9f8e7d6c5b4a", "9f8e7d6c5b4a"),
    ("X-Api-Key: 9f8e7d6c5b4a", "9f8e7d6c5b4a"),
    ('{"token": "9f8e7d6c5b4a"}', "9f8e7d6c5b4a"),
    ("{'account_id' : '12345678'}", "12345678"),
    ("É token: 9f8e7d6c5b4a İ", "9f8e7d6c5b4a"),
    ("token CODE-12345", "CODE-12345"),
])
def test_forms_of_announced_values(text, value):
    assert [(k, text[a:b]) for a, k, b in pii.spans(text)] == [("account", value)]
    assert pii.redacted(text) == text.replace(value, "<account>")


@pytest.mark.parametrize("text", ["mytoken 9f8e7d6c5b4a", "DBPASSWORD=hunter2xyz", 'the "token" 9f8e7d6c5b4a', "subaccounts 12345678"])
def test_words_that_announce_nothing(text):
    assert pii.spans(text) == []


def test_a_cue_within_a_value():
    assert pii.redacted("my_token: abc123-password: hunter22") == "my_token: <account>: <account>"


def test_long_texts():
    for text in ("9" * 50_000, "a@" * 20_000, "1." * 20_000, "+1" * 20_000, "x" * 10_000 + "@y.z", "1 2-3 " * 20_000):
        assert base(text) == plain(text)


def test_redacted():
    assert pii.redacted("mail a.b@c.de or +1 (017) 555-7713, ip 10.0.0.1!") == "mail <email> or <phone>, ip <ip>!"
    assert pii.redacted("https://a@b.de/x end") == "<url> end"
    assert pii.redacted("none") == "none"


def test_rows_of_every_kind(spark):
    rows = [(1, "a@b.de", "x"), (1, "a@b.de", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted((tuple(r) for r in pii.listed(pii.find(docs)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one, none = (1, 0, 0, 0, sha("email:0:6"), "email:0:6"), (0, 0, 0, 0, sha(""), "")
    assert out == sorted([(1, *one), (1, *one), (None, *none), (2, *none)], key=str)
    assert pii.find(docs.limit(0)).collect() == []
    masked = sorted((tuple(r) for r in pii.redact(docs).collect()), key=str)
    assert masked == sorted([(1, "<email>", "x")] * 2 + [(None, None, None), (2, "", "y")], key=str)


def test_the_query_on_whole_documents(spark):
    d = "/root/testdata/sf0.01"
    mine = {r.doc_id: r for r in QUERIES["op6_pii"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(mine) == len(docs)
    for doc in docs:
        found = plain(doc.text or "")
        r = mine[doc.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in found) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE) == joined
