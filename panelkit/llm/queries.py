"""One query per operator over the whole of its table, with SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import (
    alignment, fingerprints, langid, licenses, mixing, periods, pieces, pii, preference, quality, records, simhash, warc,
)
from panelkit.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_sentencepiece")
def op1_sentencepiece(spark, d):
    return pieces.digests(pieces.encode_decode(table(spark, d, "documents"), PIECE_MODEL))


WHITE = r"[\x20\x09-\x0D]"
#: Documents with their words, and the counts of the base rules.
BASE_SQL = rf"""docs AS (SELECT doc_id, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}+'), lambda w: w <> '') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
trigram AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (SELECT doc_id, i FROM trigram WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM line
  WHERE regexp_replace(l, '{WHITE}', '', 'g') <> '' GROUP BY doc_id),
base AS (SELECT doc_id, words, len(words) AS n_words, length(regexp_replace(text, '{WHITE}', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))"""
QUALITY_SQL = rf"""WITH {BASE_SQL},
trusted AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 32, 1))::INTEGER % 2 = 0 AS fit FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {quality.MAX_TRUSTED}),
code AS (SELECT doc_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM word),
texts AS (SELECT min(d.doc_id) AS doc_id, bool_or(coalesce(t.fit, false)) AS good FROM docs d LEFT JOIN trusted t USING (doc_id) GROUP BY d.text),
gram AS (SELECT doc_id, h & {quality.BUCKETS - 1} AS bucket FROM code UNION ALL
  SELECT doc_id, (h * 31 + h2) & {quality.BUCKETS - 1} FROM (SELECT doc_id, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM code)
  WHERE h2 IS NOT NULL),
counts AS (SELECT b.bucket, count(g.doc_id) + 1.0 AS n_raw, count(g.doc_id) FILTER (WHERE g.good) + 1.0 AS n_trusted
  FROM (SELECT unnest(range({quality.BUCKETS})) AS bucket) b LEFT JOIN (SELECT * FROM gram JOIN texts USING (doc_id)) g USING (bucket)
  GROUP BY b.bucket),
weight AS (SELECT bucket, ln(n_trusted / sum(n_trusted) OVER ()) - ln(n_raw / sum(n_raw) OVER ()) AS w FROM counts),
scored AS (SELECT doc_id, avg(w) AS score FROM gram JOIN weight USING (bucket) GROUP BY doc_id),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM base LEFT JOIN scored USING (doc_id)),
bar AS (SELECT CASE WHEN count(score) = 0 THEN '-Infinity'::DOUBLE ELSE least(0.0::DOUBLE, quantile_cont(score, {quality.LOST})) - {quality.SLACK}::DOUBLE END AS threshold
  FROM scored JOIN trusted USING (doc_id) WHERE NOT fit)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(score >= threshold, false) AS kept, round(score, 6) AS score FROM judged, bar"""


@query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark, d):
    judged = quality.judge(table(spark, d, "documents"), table(spark, d, "labels"))
    return judged.withColumn("score", F.round("score", 6))


@query("op5_simhash_neardup")
def op5_simhash_neardup(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op6_pii")
def op6_pii(spark, d):
    return pii.listed(pii.find(table(spark, d, "documents")))


#: Rates, counts by inverting the distribution, and copies; the hashes are MD5 in both engines.
_TERMS = int(mixing.PART + 12 * mixing.PART ** 0.5 + 40)
MIXING_SQL = f"""WITH RECURSIVE sizes AS (SELECT coalesce(source, '{mixing.NO_SOURCE}') AS src, count(*) AS n,
  count(*)::DOUBLE ^ {mixing.FLATTENING} AS w FROM documents GROUP BY 1),
rates AS (SELECT src, w * (SELECT sum(n) FROM sizes) / (SELECT sum(w) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT src, rate, greatest(ceil(rate / {mixing.PART}), 1)::INTEGER AS m FROM rates),
cdf AS (SELECT src, m, rate / m AS r, 0 AS k, exp(-(rate / m)) AS p, exp(-(rate / m)) AS below FROM parts
  UNION ALL SELECT src, m, r, k + 1, p * r / (k + 1), below + p * r / (k + 1) FROM cdf WHERE k + 1 < {_TERMS}),
docs AS (SELECT d.*, p.rate, p.m, coalesce(source, '{mixing.NO_SOURCE}') AS src FROM documents d JOIN parts p ON p.src = coalesce(d.source, '{mixing.NO_SOURCE}')),
draws AS (SELECT doc_id, src, (('0x' || substr(md5('{mixing.SEED}|' || doc_id || '|' || md5(coalesce(text, '')) || '|' || i), 1, 13))::BIGINT + 0.5::DOUBLE)
  / 4503599627370496 AS u FROM (SELECT doc_id, src, text, unnest(range(1, m + 1)) AS i FROM docs)),
counts AS (SELECT doc_id, count(c.k) AS n FROM draws d LEFT JOIN cdf c ON c.src = d.src AND d.u >= c.below GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copy,
  md5('{mixing.SEED} order|' || doc_id || '|' || md5(coalesce(text, '')) || '|' || copy) AS shuffle_key
FROM (SELECT docs.*, unnest(range(1, n + 1)) AS copy FROM docs JOIN counts USING (doc_id))"""


@query("op7_source_mixing", MIXING_SQL)
def op7_source_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents")).withColumn("rate", F.round("rate", 9))


def _base32_sql(digest: str) -> str:
    bits = f"('0x' || substr({digest}, 5 * (i // 4) + 1, 5))::BIGINT"
    return f"list_aggregate(list_transform(range(32), lambda i: substr('{warc.BASE32}', ((({bits}) >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), 'string_agg', '')"


WARC_SQL = f"""WITH own AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY digest, payload_bytes) AS last FROM own)
SELECT page_id, payload_bytes, {_base32_sql('digest')} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM last"""


@query("op8_warc", WARC_SQL)
def op8_warc(spark, d):
    return warc.roundtrip(table(spark, d, "pages"))


@query("op10_document_fingerprints")
def op10_document_fingerprints(spark, d):
    out = fingerprints.compare_edited(table(spark, d, "documents"))
    return out.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


@query("op2_language_id")
def op2_language_id(spark, d):
    found = langid.identify(table(spark, d, "pages"), table(spark, d, "documents"))
    return found.withColumn("probability", F.round("probability", 6))


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(licenses.TEMPLATES.items()))


def _shingles_sql(name: str, source: str, key: str) -> str:
    n = licenses.SHINGLE
    return f"""{name}_words AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w
  FROM {source}),
{name}_at AS (SELECT {key}, w, unnest(range(0, len(w) - {n - 1})) AS i FROM {name}_words WHERE len(w) >= {n}),
{name} AS (SELECT {key}, i, array_to_string(w[i + 1:i + {n}], ' ') AS s FROM {name}_at)"""


LICENSE_SQL = f"""WITH template(license, text) AS (VALUES {_TEMPLATE_ROWS}),
{_shingles_sql('sought', 'template', 'license')}, {_shingles_sql('own', 'documents', 'doc_id')},
sizes AS (SELECT license, count(DISTINCT s) AS n_shingles FROM sought GROUP BY license),
found AS (SELECT doc_id, license, count(DISTINCT own.s) AS n_found, min(own.i) AS first_word FROM own
  JOIN (SELECT DISTINCT license, s FROM sought) t ON t.s = own.s GROUP BY doc_id, license)
SELECT doc_id, license, n_found, n_shingles, n_found / n_shingles AS containment, first_word FROM found JOIN sizes USING (license)
WHERE n_found / n_shingles >= {licenses.CONTAINED}"""


@query("op4_license_scan", LICENSE_SQL)
def op4_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


_SAID = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
PREFERENCE_SQL = f"""WITH safe AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[<|>\\r\\n]', '_', 'g') AS role,
  replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM safe),
sizes AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM said GROUP BY pair_id),
apart AS (SELECT pair_id, min(i) AS i FROM (SELECT a.pair_id, a.i FROM said a JOIN said b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE a.side = 0 AND b.side = 1 AND (a.role <> b.role OR a.text <> b.text)) GROUP BY pair_id),
common AS (SELECT pair_id, n0, n1, coalesce(i - 1, least(n0, n1)) AS n_common FROM sizes LEFT JOIN apart USING (pair_id)),
prompts AS (SELECT pair_id, string_agg({_SAID}, '' ORDER BY i) AS prompt FROM said JOIN common USING (pair_id)
  WHERE side = 0 AND i <= n_common GROUP BY pair_id),
rest AS (SELECT pair_id, side, string_agg({_SAID}, '' ORDER BY i) AS body,
  string_agg((length(role) + 5) || ':0,' || (length(text) + 8) || ':' || (role = '{preference.TRAINED}')::INTEGER, ',' ORDER BY i) AS mask
  FROM said JOIN common USING (pair_id) WHERE i > n_common GROUP BY pair_id, side)
SELECT pair_id, n_common, coalesce(prompt, '') AS prompt,
  CASE WHEN n0 > 0 THEN coalesce(c.body, '') END AS chosen, CASE WHEN n0 > 0 THEN coalesce(c.mask, '') END AS chosen_mask,
  CASE WHEN n1 > 0 THEN coalesce(r.body, '') END AS rejected, CASE WHEN n1 > 0 THEN coalesce(r.mask, '') END AS rejected_mask
FROM common LEFT JOIN prompts USING (pair_id) LEFT JOIN (SELECT * FROM rest WHERE side = 0) c USING (pair_id)
LEFT JOIN (SELECT * FROM rest WHERE side = 1) r USING (pair_id)"""


@query("op9_preference_format", PREFERENCE_SQL)
def op9_preference_format(spark, d):
    return preference.flattened(preference.format_pairs(table(spark, d, "conversations")))


@query("op11_token_records")
def op11_token_records(spark, d):
    back = records.roundtrip(table(spark, d, "documents"), BYTE_MODEL, END_ID)
    return back.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op12_token_alignment")
def op12_token_alignment(spark, d):
    return alignment.describe(table(spark, d, "documents"), BYTE_MODEL, PIECE_MODEL)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a tenth of the documents, chosen by a hash of the key, with a stretch up to the end made periodic."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op13_periodic_runs")
def op13_periodic_runs(spark, d):
    found = periods.find_runs(table(spark, d, "documents"), change=planted)
    top = found.withColumn("top", periods.strongest("runs"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(periods.listed("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
