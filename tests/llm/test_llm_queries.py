import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import assert_same  # noqa: E402

from loomkit.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in queries.QUERIES


def columns_equal_sql(spark, query, columns, sql):
    """The columns of a query that SQL can express, where it can't express the others."""
    assert_same(spark, lambda session, sf: query(session, sf).select(*columns), sql)


def test_quality_figures_equal_sql(spark):
    sql = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(p)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM again, unnest(range(p, p + 3)) AS u(q) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) AS base_failed FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
"""
    columns_equal_sql(spark, queries.op7_quality, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], sql)


def test_license_phrases_equal_sql(spark):
    sql = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
phrases AS (SELECT * FROM (VALUES ('mit license', 'mit', 2), ('apache license', 'apache', 2), ('general public license', 'gpl', 3)) AS t(phrase, label, n)),
places AS (SELECT doc_id, p - 1 AS p, label FROM w, unnest(range(1, len(ws) + 1)) AS u(p), phrases WHERE array_to_string(ws[p:p + n - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""
    columns_equal_sql(spark, queries.op8_licenses, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], sql)


def test_url_rules_equal_sql(spark):
    sql = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('net/', 'net', '/'), ('example.net/en/', 'example.net', '/en/'), ('example.com/de/', 'example.com', '/de/'), ('org/fr/', 'org', '/fr/')) AS t(rule, name, start)),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM h, rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule FROM h LEFT JOIN fit USING (page_id)
"""
    columns_equal_sql(spark, queries.op10_urls, ["page_id", "host", "path", "rule"], sql)
