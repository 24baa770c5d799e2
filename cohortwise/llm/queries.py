"""Registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortwise.llm import collocations, decontaminate, exact_dedup, license_scan, lm_score, mixing, near_dedup, quality, secret_scan, simhash, spelling, tool_calls, toxicity
from cohortwise.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_rows(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("content")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_rows(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_rows(table(spark, sf_dir, "documents"))


def op9_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.formatted(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_classifier, op3_decontamination, op4_exact_dedup, op5_lm_scoring, op6_source_mixing,
                                   op7_near_dedup, op8_license_scan, op9_chat_tool_calls, op10_toxicity, op11_simhash_near_dedup,
                                   op12_spelling_variants, op13_collocations)}

OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT s, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY s)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256 FROM d JOIN g USING (s)
"""

OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce('v' || source, 'n') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'none')), 1, 8))::BIGINT AS deal FROM documents),
s AS (SELECT key, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM t GROUP BY key),
p AS (SELECT ln(tokens / (SELECT sum(tokens) FROM s)::DOUBLE) AS lp FROM s WHERE tokens > 0),
b(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN wide THEN mid ELSE low END, CASE WHEN wide THEN high ELSE mid END FROM (
    SELECT step, low, high, (low + high) / 2 AS mid,
           exp((1 - (low + high) / 2) * ((SELECT max(lp) FROM p) - (SELECT min(lp) FROM p))) > 3.0 AS wide FROM b WHERE step < 45)),
a AS (SELECT CASE WHEN exp((SELECT max(lp) - min(lp) FROM p)) > 3.0 THEN round(high, 9) ELSE 0.0 END AS a FROM b WHERE step = 45),
z AS (SELECT sum(pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE, a)) AS z, max(tokens / pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE, a)) AS m FROM s, a WHERE tokens > 0),
w AS (SELECT key, tokens, docs, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE, a) / z ELSE 0.0 END AS weight,
             CASE WHEN tokens > 0 THEN round(pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE, a) / z * (z * m) / tokens, 9) ELSE 1.0 END AS epochs FROM s, a, z),
d AS (SELECT t.*, w.tokens, w.weight, w.epochs, deal % ceil(docs / 8.0)::BIGINT AS block FROM t JOIN w USING (key)),
k AS (SELECT key, block, sum(n_tokens) AS n, any_value(tokens) AS tokens, any_value(epochs) AS epochs,
             ('0x' || substr(md5(key || '|' || block || '|' || (floor(any_value(epochs))::BIGINT + 1)), 1, 8))::BIGINT AS place FROM d GROUP BY key, block),
c AS (SELECT key, block, floor(epochs)::BIGINT + (sum(n) OVER (PARTITION BY key ORDER BY place, block ROWS UNBOUNDED PRECEDING) - n / 2.0
             <= round((epochs - floor(epochs)) * tokens))::BIGINT AS copies FROM k)
SELECT d.doc_id, d.source, d.n_tokens, d.block, round(d.weight, 9) AS weight, round(d.epochs, 6) AS epochs, c.copies FROM d JOIN c USING (key, block)
"""

# The sixteen entries of the reflected CRC-32 table for half a byte.
CRC_TABLE = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
             0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]

OP12_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT d, run, count(*) AS n, hex(d || ':' || run) AS h FROM r GROUP BY d, run),
k AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(len(h)), lambda i: instr('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1),
        lambda s, x: xor(s >> 4, {CRC_TABLE}[(xor(s, x) & 15) + 1]), 4294967295)) AS digest FROM c),
v AS (SELECT CASE WHEN digest % 97 = 0 THEN left(run, (digest % len(run))::BIGINT) || substr(run, (digest % len(run))::BIGINT + 2) ELSE run END AS word, n FROM k),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(len(word))) AS i FROM w),
y AS (SELECT word, n, i, left(word, i) || '|' || substr(word, i + 2) AS skipped, left(word, i) || substr(word, i + 2) AS shorter FROM x),
e AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM y a JOIN y b ON a.skipped = b.skipped AND a.word <> b.word
      UNION SELECT y.word, y.n, w.word, w.n FROM y JOIN w ON y.shorter = w.word
      UNION SELECT w.word, w.n, y.word, y.n FROM y JOIN w ON y.shorter = w.word),
b AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM e GROUP BY word, n),
f AS (SELECT word, form, form_n FROM b WHERE form_n >= 2 * n),
g(word, root, step) AS (SELECT word, form, 1 FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON g.root = f.word),
t AS (SELECT word, arg_max(root, step) AS root FROM g GROUP BY word)
SELECT w.word, f.form, coalesce(t.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM w LEFT JOIN b USING (word) LEFT JOIN f USING (word) LEFT JOIN t USING (word)
"""

OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
o AS (SELECT lang, unnest(w) AS phrase, 1 AS size FROM p
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM p
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM p),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM o GROUP BY lang, phrase, size),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
h AS MATERIALIZED (SELECT lang, phrase AS p, f AS h FROM f WHERE f >= 10),
v AS MATERIALIZED (SELECT k.*, h AS l FROM k JOIN h ON k.lang = h.lang AND k.p1 = h.p),
u AS (SELECT v.*, h AS r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * h))::BIGINT AS score FROM v JOIN h ON v.lang = h.lang AND v.p2 = h.p),
s AS (SELECT lang, phrase, any_value(size) AS size, any_value(a) AS a, arg_min({'l': l, 'r': r, 'score': score}, (score, k)) AS b FROM u GROUP BY lang, phrase),
i AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3),
d AS (SELECT s.* FROM s LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase) m ON s.size = 2 AND m.lang = s.lang AND m.phrase = s.phrase
      WHERE coalesce(100 * longer < 50 * s.a, true)),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, b.score AS score FROM d)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n USING (lang) WHERE q.rank <= 2000
"""

ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op6_source_mixing": OP6_SQL, "op12_spelling_variants": OP12_SQL,
              "op13_collocations": OP13_SQL}
