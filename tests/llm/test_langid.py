"""Languages of pages: evidence one at a time, a plain version, and held-out accuracy."""

import math
from collections import defaultdict

import numpy as np
import pytest

from panelkit.llm import langid
from panelkit.llm.queries import QUERIES

LANGUAGES = ("de", "en", "es", "fr")
SCHEMA = "page_id long, url string, html string, lang string, declared string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def sample(docs, lang, n=1, words=400):
    rows = docs.where(f"lang = '{lang}' and n_chars > 2000").orderBy("doc_id").limit(n).collect()
    return [" ".join(r.text.split()[:words]) for r in rows]


def plain(rows, model, languages=LANGUAGES):
    """The same rule, page by page."""
    import re

    k, n_lang, s = [], len(languages), langid.SMOOTHING
    for _, url, html in rows:
        found = langid.buckets_of(langid.visible(html or ""))
        ll = model[:, found].mean(axis=1) * min(len(found), langid.EVIDENCE) if len(found) else np.zeros(n_lang)
        host = (m.group(1).lower() if (m := re.match(langid.HOST, url or "")) else None)
        stated = (m.group(1).lower() if (m := re.search(langid.DECLARED, html or "")) else None)
        p = np.exp(ll - ll.max())
        k.append((ll - ll.max(), p / p.sum(), host, stated if stated in languages else "other" if stated else None))
    share = (sum(x[1] for x in k) + 1) / (len(k) + n_lang)
    total = lambda key: {v: (sum(x[1] for x in k if key(x) == v), sum(key(x) == v for x in k)) for v in {key(x) for x in k}}
    hosts, domains = total(lambda x: x[2]), total(lambda x: x[2] and ".".join(x[2].split(".")[-2:]))
    suffixes, stated = total(lambda x: x[2] and x[2].split(".")[-1]), total(lambda x: x[3])
    given = sum((v[0] for d, v in stated.items() if d), np.zeros(n_lang))
    hosted = sum((v[0] for d, v in suffixes.items() if d), np.zeros(n_lang))
    n_hosted = sum(v[1] for d, v in suffixes.items() if d)
    out = []
    for ll, p, host, d in k:
        logs = ll.copy()
        if d:
            assumed = np.array([langid.HONEST if d == x else (1 - langid.HONEST) / n_lang for x in languages])
            logs += np.log((stated[d][0] + s * assumed) / (given + s))
        if host:
            c, n = suffixes[host.split(".")[-1]]
            if n > 1:
                logs += np.log((np.maximum(c - p, 0) + s * (n - 1) / (n_hosted - 1)) / (np.maximum(hosted - p, 0) + s))
            (hc, hn), (dc, dn) = hosts[host], domains[".".join(host.split(".")[-2:])]
            prior = (np.maximum(dc - p, 0) + s * share) / (dn - 1 + s)
            logs += np.log((np.maximum(hc - p, 0) + s * prior) / (hn - 1 + s))
        else:
            logs += np.log(share)
        q = np.exp(logs - logs.max())
        out.append((languages[int(np.argmax(logs))], float((q / q.sum()).max())))
    return out


def test_equals_a_plain_version(spark, docs):
    rng = np.random.default_rng(1)
    bodies = [t for x in LANGUAGES for t in sample(docs, x, 3, 12)] + ["", "?", "x1"]
    rows = []
    for i in range(150):
        body = bodies[rng.integers(len(bodies))]
        lang = rng.choice(["", ' lang="de"', " lang='FR-ca'", ' lang="xx"', ' class="a" lang=es'])
        url = rng.choice(["http://a.de/x", "https://b.a.de:80/?q", "http://c.fr/", "bad", "ftp://u@d.com/"])
        rows.append((i, str(url), f"<!doctype html><html{lang}><body><p>{body}</p></body></html>"))
    rows += [(201, "http://only.one/", f'<html lang="fr">{bodies[0]}</html>'), (200, None, None), (None, "http://a.de/", ""), (7, "http://a.de/x", "<p>the the</p>")]
    model = langid.log_model(langid.sequence_counts(docs, LANGUAGES), LANGUAGES)
    mine = sorted(((r.page_id, r.lang, round(r.probability, 6)) for r in langid.identify(pages_of(spark, rows), docs).collect()), key=str)
    assert mine == sorted(((r[0], lang, round(p, 6)) for r, (lang, p) in zip(rows, plain(rows, model))), key=str)


def test_evidence_beyond_the_text(spark, docs):
    fr = [(i, "http://only.fr/", f'<html lang="fr">{t}</html>') for i, t in enumerate(sample(docs, "fr", 12))]
    en = [(i + 50, "http://other.com/", f'<html lang="en">{t}</html>') for i, t in enumerate(sample(docs, "en", 12))]
    asked = [(100, "http://only.fr/", "<p>ok</p>"), (101, "http://other.com/", "<p>ok</p>"), (102, "x", '<html lang="fr">ok</html>'), (103, "x", '<html lang="en">ok</html>')]
    out = {r.page_id: r.lang for r in langid.identify(pages_of(spark, fr + en + asked), docs).collect()}
    assert [out[i] for i in (100, 101, 102, 103)] == ["fr", "en", "fr", "en"]


def test_languages_are_those_of_the_documents(spark, docs):
    """A fifth language, in its own letters, is told apart without being named; too many are an error."""
    fifth = spark.createDataFrame([(10**6 + i, f"новое слово номер {i} и ещё слова", "ru") for i in range(50)], "doc_id long, text string, lang string")
    more = docs.select("doc_id", "text", "lang").unionByName(fifth)
    assert langid.languages_of(more) == (*LANGUAGES, "ru")
    rows = [(1, "http://a.ru/", '<html lang="ru">слова и ещё слово</html>'), (2, "http://b.ru/", "<p>ещё слово</p>"), (3, "http://c.de/", sample(docs, "de")[0])]
    assert {r.page_id: r.lang for r in langid.identify(pages_of(spark, rows), more).collect()} == {1: "ru", 2: "ru", 3: "de"}
    with pytest.raises(ValueError, match="more than 4"):
        langid.languages_of(more, most=4)


def test_a_page_alone_on_its_suffix_does_not_speak_twice(spark, docs):
    text = sample(docs, "fr")[0][:40]
    rows = [(1, "http://x.alone/", f"<p>{text}</p>"), (2, "http://x.com/", "<p>the of and</p>"), (3, "http://y.com/", "<p>the of and</p>")]
    alone = {r.page_id: r.probability for r in langid.identify(pages_of(spark, rows), docs).collect()}[1]
    none = {r.page_id: r.probability for r in langid.identify(pages_of(spark, [(1, "no address", rows[0][2]), *rows[1:]]), docs).collect()}[1]
    assert alone == pytest.approx(none, abs=0.02)


def test_nothing_to_learn_from(spark, docs):
    rows = [(1, "http://a.de/", "<p>und der die</p>"), (2, None, None)]
    assert langid.identify(pages_of(spark, []), docs).collect() == []
    assert len(langid.identify(pages_of(spark, rows), docs.limit(0)).collect()) == 2
    assert langid.visible("a<script>no</script>b<!-- no -->c<style>x") == "a b c "


def test_a_long_page(spark, docs):
    text = sample(docs, "es")[0]
    out = langid.identify(pages_of(spark, [(1, "u", "<div>" * 50_000 + text * 200)]), docs).collect()
    assert out[0].lang == "es" and math.isclose(out[0].probability, 1.0, abs_tol=1e-3)


def test_accuracy_on_pages(spark):
    """The markup of these pages tells the truth; the text alone must agree."""
    d = "/root/testdata/sf0.01"
    out = QUERIES["op2_language_id"](spark, d).collect()
    n = defaultdict(int)
    for r in out:
        n["all"] += 1
        n["text"] += r.text_lang == r.declared
        n["fused"] += r.lang == r.declared
    assert n["all"] == spark.read.parquet(f"{d}/pages.parquet").count()
    assert n["text"] >= 0.98 * n["all"] and n["fused"] >= 0.99 * n["all"]
