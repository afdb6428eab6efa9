"""Personal data (operator 6) by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
address schemes and words that announce an identifier. From each anchor a local
parser grows the span, left and right, and validates it. A parser takes the
leftmost spans of its kind and none that overlaps the one before.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``. The method adds ``url``
(an address with a scheme) and ``account`` (the value after an announcing word, if
it has a digit and at least six characters, or a valid IBAN after its cue). Words
and schemes are found in any casing; a word starts at a word's start, after ``_`` or
at a camel-case boundary.

Defined results: a NULL or empty text has no spans; positions are code points,
the end exclusive; equal rows give equal results; spans of different kinds may
overlap, and ``redact`` replaces what overlaps as one span, under its first kind.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import in_batches, texts

#: In the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
CUES = ("account", "acct", "iban", "ssn", "passport", "token", "secret", "password", "api_key", "apikey", "api key", "api-key")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_ADDRESS = re.compile(r"[^\s<>\"'`|\\]+")
_UNTIL_VALUE = r"(?:[\"'](?=[ \t]*[:=#]))?[ \t]*[:=#]?[ \t]*[\"']?"
#: What may stand between a cue and its value; the second, where the first finds none, takes a follow-up word as a part of the value.
_AFTER_CUE = (re.compile(r"(?:[ _-]?(?:no|number|num|id|code|key)\b\.?)?" + _UNTIL_VALUE, re.IGNORECASE | re.ASCII), re.compile(_UNTIL_VALUE))
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}  # keeps the length
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_\-./+=]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _starts_word(text: str, at: int) -> bool:
    """Whether a word may start here: not inside another, but after ``_`` or at a camel-case boundary."""
    if not at or not text[at - 1].isalnum():
        return True
    return text[at].isupper() and (not text[at - 1].isupper() or text[at + 1].islower())


def _account(text: str, cue_start: int, cue_end: int, least: int) -> tuple[int, int] | None:
    """The value that an announcing word points to, if it starts at ``least`` or later."""
    if not _starts_word(text, cue_start):
        return None
    for lead in _AFTER_CUE:
        at = lead.match(text, cue_end).end()
        if at > cue_end and at >= least and (found := _value(text, at)):
            return found
    return None


def _value(text: str, at: int) -> tuple[int, int] | None:
    """The IBAN or other identifier that starts here."""
    if iban := _IBAN.match(text, at):
        for end in range(iban.end(), at + 14, -1):
            if valid_iban(text[at:end]):
                return at, end
    value = _VALUE.match(text, at)
    if value is None:
        return None
    word = value.group().rstrip("./=-+")
    if len(word) < 6 or not any("0" <= c <= "9" for c in word):
        return None
    return at, at + len(word)


def spans(text: str) -> list[tuple[int, str, int]]:
    """All spans as (start, kind, end), by start and then in the order of the kinds."""
    out: list[tuple[int, str, int]] = []
    email = ip = card = phone = url = account = 0  # where each kind goes on
    for last, (kind, size) in ANCHORS.iter(text.translate(_LOWER)):
        at = last + 1 - size
        if kind == "digit":
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, "card", card))
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(map(_byte, m.groups())):
                        out.append((at, "ip", ip))
                else:
                    ip = _DIGITS.match(text, at).end()  # no later digit of this run can start one
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, "email", email))
        elif kind == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    out.append((at, "phone", phone))
        elif kind == "scheme":
            if at >= url and (not at or not text[at - 1].isalnum()) and (m := _ADDRESS.match(text, last + 1)):
                end = last + 1 + len(m.group().rstrip(".,;:!?)]}"))
                if end > last + 1:
                    url = end
                    out.append((at, "url", end))
        elif found := _account(text, at, last + 1, account):
            account = found[1]
            out.append((found[0], "account", found[1]))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and ``spans``, an array of (kind, start, end). No shuffle."""
    kind = dict(docs.dtypes)[key]

    def found(columns: dict) -> dict:
        rows = [[{"kind": k, "start": a, "end": b} for a, k, b in spans(t)] for t in columns["text"].to_pylist()]
        return {"doc_id": columns["doc_id"], "spans": rows}

    return in_batches(texts(docs, key, text), f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>", found)


def listed(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the list of all spans and a digest of the base ones."""
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, end = [], 0
    for start, kind, stop in spans(text):
        if start >= end:
            out += [text[end:start], f"<{kind}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of ``docs`` with personal data replaced in the text, and its new length.

    A NULL text stays NULL.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def replaced(columns: dict) -> dict:
        new = [None if t is None else redacted(t) for t in columns[text].to_pylist()]
        out = {**columns, text: new}
        if length in columns:
            out[length] = [old if t is None else len(t) for t, old in zip(new, columns[length].to_pylist())]
        return out

    return in_batches(docs, fields, replaced)
