"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.functions import arithmetic, strings
from loomkit.functions.html import decode_body, unwrap_redirect
from loomkit.operators import commands, files, messages, pages, search, settings, tasks
from loomkit.plans import sql
from loomkit.plans.dispatch import Captured, run_tool_calls
from loomkit.policy import Policy
from loomkit.schemas import TOOL_CALL
from loomkit.sources.files import directory_entries, whole_files, write_text
from loomkit.streaming.tasks import queue_answers, run_to_end, working_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A small table given as SQL values, which the oracle shares."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


# Pages

PAGE_SQL = r"""
norm AS (SELECT page_id, url, html, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base FROM pages),
a AS (SELECT page_id, base, unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2)) AS label,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1), 1) AS i FROM norm),
links AS (SELECT page_id, label, href, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position
  FROM (SELECT page_id, label, base || href AS href, min(i) AS i FROM a GROUP BY ALL)),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
parts AS (SELECT page_id, url, regexp_extract(h, '<title>(.*?)</title>', 1, 's') AS title,
  regexp_replace(regexp_replace(regexp_replace(h, '<title>.*?</title>', '', 'gs'), '<(p|div|section|article|header|footer|li|br|h1|h2|h3)(\s[^>]*)?/?>', chr(10), 'g'), '</?a(\s[^>]*)?>', ' ', 'g') AS b FROM plain),
clean AS (SELECT page_id, url, title, regexp_replace(b, '<[^>]*>', '', 'g') AS b FROM parts),
decoded AS (SELECT page_id, url, replace(replace(replace(regexp_replace(title, '&amp;?', '&', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©') AS title,
  replace(replace(replace(regexp_replace(b, '&amp;?', '&', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©') AS b FROM clean),
texts AS (SELECT page_id, url, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title,
  trim(regexp_replace(array_to_string(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM decoded)
"""


@query(f"WITH {PAGE_SQL} SELECT page_id, position, label, href FROM links WHERE position <= 30")
def page_links(spark, sf_dir):
    return pages.page_links(table(spark, sf_dir, "pages"))


@query(f"WITH {PAGE_SQL} SELECT page_id, position, label, href FROM links WHERE position <= 3")
def page_links_top3(spark, sf_dir):
    return pages.page_links(table(spark, sf_dir, "pages"), max_links=3)


@query(f"WITH {PAGE_SQL} SELECT page_id, CASE WHEN title = '' THEN '(no title)' ELSE title END AS title FROM texts")
def page_titles(spark, sf_dir):
    return pages.page_texts(table(spark, sf_dir, "pages")).select("page_id", "title")


@query(f"WITH {PAGE_SQL} SELECT page_id, text FROM texts")
def page_text(spark, sf_dir):
    return pages.page_texts(table(spark, sf_dir, "pages")).select("page_id", "text")


@query(f"""WITH {PAGE_SQL}, out AS (SELECT page_id, 'URL: ' || url || chr(10) || 'Title: ' || title || chr(10) || chr(10) || text AS o FROM texts)
SELECT page_id, CASE WHEN length(o) > 200 THEN left(o, 200) || chr(10) || chr(10) || '[truncated after 200 characters]' ELSE o END AS output FROM out""")
def page_render_truncated(spark, sf_dir):
    return pages.opened_pages(table(spark, sf_dir, "pages"), max_chars=F.lit(200)).select("page_id", "output")


@query(f"""WITH {PAGE_SQL}, n AS (SELECT page_id, string_agg(position || '. ' || label || chr(10) || '   ' || href, chr(10) ORDER BY position) AS t FROM links WHERE position <= 30 GROUP BY page_id)
SELECT page_id, CASE WHEN t IS NULL THEN 'No links found on ' || url || '.' ELSE 'Links found on ' || url || ':' || chr(10) || t END AS output FROM pages LEFT JOIN n USING (page_id)""")
def page_links_rendered(spark, sf_dir):
    return pages.listed_links(table(spark, sf_dir, "pages")).select("page_id", "output")


@query("SELECT page_id, regexp_matches(url, '^https?:') AS is_web FROM pages")
def page_scheme_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(strings.is_web_url(F.col("url")), F.lit(False)).alias("is_web"))


@query("SELECT page_id, md5(html) AS utf8, md5(regexp_replace(html, '[^\\x01-\\xFF]', '?', 'g')) AS latin FROM pages")
def page_decode(spark, sf_dir):
    body = lambda name: F.encode(F.regexp_replace("html", r"[^\x01-\xFF]", "?"), name)
    text = lambda b, kind: F.md5(decode_body(b, F.lit(kind)).cast("binary"))
    pages_ = table(spark, sf_dir, "pages")
    return pages_.select("page_id", text(F.encode("html", "UTF-8"), "text/html").alias("utf8"), text(body("ISO-8859-1"), 'text/html; charset="latin-1"').alias("latin"))


@query("""SELECT page_id, 'Browser tools are disabled by AGENT_ENABLE_BROWSER_TOOLS.' AS off, 'Fetched non-HTML content from ' || url || '. Content-Type: application/PDF' AS other,
'Browser open error: Only http and https URLs are supported.' AS scheme, 'Browser link extraction error: timed out' AS failed FROM pages""")
def page_refusals(spark, sf_dir):
    """What switched-off tools, other content, other schemes and failed fetches answer."""
    stored = table(spark, sf_dir, "pages")
    shown = lambda df, name, **options: df.select("page_id", F.col("output").alias(name))
    off = shown(pages.opened_pages(stored, policy=Policy(browser_enabled=False)), "off")
    other = shown(pages.opened_pages(stored.withColumn("content_type", F.lit("application/PDF"))), "other")
    scheme = shown(pages.opened_pages(stored.withColumn("url", F.lit("ftp://h.org/"))), "scheme")
    failed = shown(pages.listed_links(stored.withColumn("fetch_error", F.lit("timed out"))), "failed")
    return off.join(other, "page_id").join(scheme, "page_id").join(failed, "page_id")


@query(f"WITH {PAGE_SQL} SELECT page_id, CASE WHEN title = '' THEN NULL ELSE title END AS title, (SELECT count(*) FROM links WHERE links.page_id = texts.page_id)::BIGINT AS n_links, (page_id * 2)::VARCHAR AS doubled FROM texts")
def sql_functions(spark, sf_dir):
    """The scalar and table functions, called in SQL."""
    sql.register(spark)
    stored = table(spark, sf_dir, "pages")
    return spark.sql(
        """WITH l AS (SELECT p.page_id, count(*) AS n FROM {stored} AS p, LATERAL page_links(p.url, p.html) AS k GROUP BY p.page_id)
        SELECT p.page_id, nullif(parse_page(p.url, p.html).title, '') AS title, coalesce(l.n, 0L) AS n_links, calculate(concat(p.page_id, ' * 2')).value AS doubled FROM {stored} AS p LEFT JOIN l ON p.page_id = l.page_id""",
        stored=stored,
    )


# Search results

WRAPPED = "concat('https://duckduckgo.com/l/?uddg=', url_encode(url_encode(url)))"


@query("SELECT page_id, 1::BIGINT AS position, 'Page ' || page_id AS title, url FROM pages UNION ALL SELECT page_id, 2::BIGINT, 'Plain ' || page_id, 'https://example.org/' || page_id FROM pages")
def search_results(spark, sf_dir):
    made = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"""concat('<a class="x result__a" href="', replace({WRAPPED}, 'https:', ''), '"> Page  ', page_id, '</a><a class="result-link" href="https://example.org/', page_id, '">Plain ', page_id,
            '</a><a class="result-link" href="https://duckduckgo.com/about">About</a><a href="https://other.org">Other</a>') AS html""",
    )
    return search.search_results(made)


@query("SELECT page_id, url AS target FROM pages")
def search_redirect_unwrap(spark, sf_dir):
    made = table(spark, sf_dir, "pages").selectExpr("page_id", f"replace({WRAPPED}, 'https://duckduckgo.com', if(page_id % 2 = 0, '', '//duckduckgo.com')) AS href")
    return made.select("page_id", unwrap_redirect(F.col("href")).alias("target"))


@query("SELECT doc_id, 'https://lite.duckduckgo.com/lite/?q=' || replace(url_encode(text || ' ~*'), '%20', '+') AS url FROM documents")
def search_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.search_url(F.concat("text", F.lit(" ~*"))).alias("url"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Web search error: search provider returned an anti-bot challenge.' WHEN page_id % 3 = 1 THEN 'No web search results found.'
ELSE 'Search results for: q' || page_id || chr(10) || '1. T' || chr(10) || '   ' || url END AS output FROM pages""")
def search_rendered(spark, sf_dir):
    made = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('q', page_id) AS query", "CASE page_id % 3 WHEN 0 THEN '<script src=anomaly.js>' WHEN 1 THEN '<p>none</p>' ELSE concat('<a class=result-link href=\"', replace(url, '&', '&amp;'), '\">T</a>') END AS html"
    )
    return search.searched(made).select("page_id", "output")


# Arithmetic

CALC = """(1, '1 + 2 * 3', true, 7.0, '7'), (2, '7 // -2', true, -4.0, '-4'), (3, '-7 % 3', true, 2.0, '2'), (4, '2 ** -1', true, 0.5, '0.5'), (5, '7 % -3', true, -2.0, '-2'), (6, '10 / 4', true, 2.5, '2.5'),
(7, '1 / 0', false, NULL, 'Calculation error: division by zero'), (8, 'x + 1', false, NULL, 'Calculation error: Only numeric arithmetic expressions are allowed.'), (9, '2 ** 100', true, 1267650600228229401496703205376.0, '1267650600228229401496703205376'),
(10, 'True + 1', true, 2.0, '2'), (11, '0x10', true, 16.0, '16'), (12, '1e16', true, 1e16, '1e+16'), (13, '__import__(1)', false, NULL, 'Calculation error: Only numeric arithmetic expressions are allowed.'), (14, '+-3', true, -3.0, '-3'), (15, '2.0 ** 5000', false, NULL, 'Calculation error: (34, ''Numerical result out of range'')')"""


@query(f"SELECT id, ok, CAST(number AS DOUBLE) AS number, display FROM (VALUES {CALC}) AS t(id, expression, ok, number, display)")
def calc_literal(spark, sf_dir):
    values = CALC.replace("''Numerical result out of range''", "\\'Numerical result out of range\\'").replace("1267650600228229401496703205376.0", "1267650600228229401496703205376D")
    r = rows(spark, values, "id, expression, e_ok, e_number, e_display").withColumn("r", arithmetic.calculate(F.col("expression")))
    return r.select("id", "r.ok", "r.number", "r.display")


@query("""WITH v AS (SELECT o_orderkey, (o_orderkey % 41 - 20)::BIGINT AS a, (o_custkey % 13 - 6)::BIGINT AS b FROM orders)
SELECT o_orderkey, CASE WHEN b <> 0 THEN floor(a::DOUBLE / b)::BIGINT END AS quotient, CASE WHEN b <> 0 THEN (a - b * floor(a::DOUBLE / b))::BIGINT END AS remainder, -a AS negated, power(a::DOUBLE, 2::DOUBLE) AS squared FROM v""")
def calc_floor_ops(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 41 - 20 AS a", "o_custkey % 13 - 6 AS b")
    a, b = F.col("a"), F.col("b")
    return v.select("o_orderkey", arithmetic.floor_div(a, b).alias("quotient"), arithmetic.py_mod(a, b).alias("remainder"), (-a).alias("negated"), arithmetic.py_power(a, F.lit(2)).alias("squared"))


@query("""SELECT o_orderkey, (o_orderkey * 3 + o_custkey)::BIGINT::VARCHAR AS value FROM orders""")
def calc_expressions(spark, sf_dir):
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(o_orderkey, ' * 3 + ', o_custkey) AS e")
    return made.select("o_orderkey", arithmetic.calculate(F.col("e"))["value"].alias("value"))


# Task queues: conversations are queues, their turns steps; updates follow from conv_id and turn.


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id"))
    made = talk.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    create = made.select(
        F.col("conv_id").alias("seq"), at.alias("ts"), F.lit("create").alias("op"), F.concat(F.lit("q"), F.col("conv_id")).alias("queue_id"), F.concat(F.lit(" Conversation "), F.col("conv_id")).alias("title"),
        F.concat(F.transform("t", lambda s: s["text"]), F.array(F.lit(" "))).alias("steps"),
    )
    status = F.element_at(F.array(*map(F.lit, ["completed", " In_Progress ", "done", "blocked"])), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    update = lambda k: talk.select(
        (F.lit(10_000_000 * (k + 1)) + F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), at.alias("ts"), F.lit("update").alias("op"),
        F.concat(F.when(F.col("conv_id") % 7 == 3, "none").otherwise("q"), F.col("conv_id")).alias("queue_id"), (F.col("turn") * (2 - k) + k).cast("int").alias("step_index"),
        (status if k == 0 else F.lit("completed")).alias("status"), (F.concat(F.lit(" note "), F.col("turn")) if k == 0 else F.lit(None).cast("string")).alias("note"),
    )
    second = update(1).filter("conv_id % 5 = 1")
    return create.unionByName(update(0), allowMissingColumns=True).unionByName(second, allowMissingColumns=True)


TASK_SQL = """
steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step_index, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS description FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
sizes AS (SELECT conv_id, count(*) AS n FROM steps GROUP BY conv_id),
up AS (SELECT 10000000 + conv_id * 1000 + turn AS seq, conv_id, conv_id % 7 = 3 AS lost, turn * 2 AS step_index, ['completed', 'in_progress', 'done', 'blocked'][(conv_id + turn) % 4 + 1] AS status, 'note ' || turn AS note FROM conversations
  UNION ALL SELECT 20000000 + conv_id * 1000 + turn, conv_id, conv_id % 7 = 3, turn + 1, 'completed', '' FROM conversations WHERE conv_id % 5 = 1),
checked AS (SELECT seq, conv_id, step_index, status, note, CASE WHEN lost THEN 'Task queue not found: none' || conv_id WHEN status = 'done' THEN 'Invalid status. Use one of: blocked, completed, in_progress, pending.'
  WHEN step_index < 1 OR step_index > n THEN 'Invalid step_index. Use a value from 1 to ' || n || '.' END AS message FROM up JOIN sizes USING (conv_id)),
latest AS (SELECT conv_id, step_index, arg_max(status, seq) AS status, arg_max(note, seq) AS note FROM checked WHERE message IS NULL GROUP BY ALL),
state AS (SELECT 'q' || conv_id AS queue_id, conv_id, step_index::BIGINT AS step_index, description, coalesce(status, 'pending') AS status, coalesce(note, '') AS note FROM steps LEFT JOIN latest USING (conv_id, step_index))
"""


@query(f"WITH {TASK_SQL} SELECT 'q' || conv_id AS queue_id, 'Conversation ' || conv_id AS title, step_index::BIGINT AS step_index, description, 'pending' AS status FROM steps")
def task_create(spark, sf_dir):
    s = tasks.created_steps(task_log(spark, sf_dir))
    return s.select("queue_id", "title", F.col("step_index").cast("long").alias("step_index"), "description", F.lit("pending").alias("status"))


@query(f"WITH {TASK_SQL} SELECT queue_id, step_index, status, note FROM state")
def task_updates_applied(spark, sf_dir):
    return tasks.step_states(task_log(spark, sf_dir)).select("queue_id", F.col("step_index").cast("long").alias("step_index"), "status", "note")


@query(f"WITH {TASK_SQL} SELECT seq::BIGINT AS seq, message IS NULL AS ok, message FROM checked")
def task_update_messages(spark, sf_dir):
    return tasks.checked_updates(task_log(spark, sf_dir)).select("seq", "ok", "message")


@query(f"""WITH {TASK_SQL} SELECT queue_id, 'Queue ' || queue_id || ': Conversation ' || conv_id || chr(10) || 'Created: ' || strftime(make_timestamp((1700000000 + conv_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || chr(10)
|| string_agg(step_index || '. [' || status || '] ' || description || CASE WHEN note <> '' THEN ' | note: ' || note ELSE '' END, chr(10) ORDER BY step_index) AS output FROM state GROUP BY queue_id, conv_id""")
def task_queue_render(spark, sf_dir):
    return tasks.queue_texts(task_log(spark, sf_dir)).select("queue_id", "output")


@query(f"""WITH {TASK_SQL} SELECT queue_id, queue_id || ': Conversation ' || conv_id || ' (' || count(*) FILTER (status = 'completed') || '/' || count(*) || ' completed)' AS output FROM state GROUP BY queue_id, conv_id""")
def task_queue_list(spark, sf_dir):
    return tasks.queue_progress(task_log(spark, sf_dir)).select("queue_id", "output")


ANSWERS_SQL = """
q AS (SELECT DISTINCT conv_id, 'q' || conv_id AS id FROM conversations),
head AS (SELECT *, 'Queue ' || id || ': T' || conv_id || chr(10) || 'Created: 2023-11-14T22:13:20+00:00' || chr(10) AS h FROM q)
SELECT conv_id * 100 + 5 AS seq, true AS ok, h || '1. [pending] one' || chr(10) || '2. [pending] two' AS output FROM head UNION ALL
SELECT conv_id * 100 + 1, true, h || '1. [pending] one' || chr(10) || '2. [pending] two' FROM head UNION ALL
SELECT conv_id * 100 + 10, true, h || '1. [pending] one' || chr(10) || '2. [completed] two | note: n' FROM head UNION ALL
SELECT conv_id * 100 + 20, true, h || '1. [pending] one' || chr(10) || '2. [completed] two | note: n' FROM head UNION ALL
SELECT conv_id * 100 + 30, true, h || '1. [pending] one' || chr(10) || '2. [blocked] two' FROM head UNION ALL
SELECT -conv_id * 100 - 5, false, 'Task queue not found: ' || id FROM head UNION ALL
SELECT -1000000000, true, 'No task queues exist in this process.' UNION ALL
SELECT 2050, true, string_agg(id || ': T' || conv_id || ' (' || CASE WHEN conv_id < 20 THEN 0 ELSE 1 END || '/2 completed)', chr(10) ORDER BY conv_id) FROM head WHERE conv_id <= 20
"""


@query(f"WITH {ANSWERS_SQL}")
def task_answers(spark, sf_dir):
    """What each command is answered when it is its turn: queues asked for before, between and after changes, and lists."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    command = lambda seq, op, index=None, status=None, note=None: ids.select(
        F.expr(seq).cast("long").alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.lit(op).alias("op"), F.concat(F.lit("q"), F.col("conv_id")).alias("queue_id"),
        F.concat(F.lit("T"), F.col("conv_id")).alias("title"), F.array(F.lit("one"), F.lit(" two")).alias("steps"), F.lit(index).cast("int").alias("step_index"), F.lit(status).cast("string").alias("status"), F.lit(note).cast("string").alias("note"),
    )
    log = command("conv_id * 100 + 1", "create").unionByName(command("conv_id * 100 + 5", "get")).unionByName(command("conv_id * 100 + 10", "update", 2, "Completed", " n "))
    log = log.unionByName(command("conv_id * 100 + 20", "get")).unionByName(command("conv_id * 100 + 30", "update", 2, "blocked")).unionByName(command("-conv_id * 100 - 5", "get"))
    lists = rows(spark, "(-1000000000L, 'list'), (2015L + 35L, 'list')", "seq, op")
    return tasks.command_outputs(log.unionByName(lists, allowMissingColumns=True)).select("seq", "ok", "output")


@query("SELECT o_orderkey, count(*) FILTER (l_linestatus = 'F') AS completed, count(l_orderkey) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def task_progress(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return tasks.progress(joined, ["o_orderkey"], step="l_orderkey")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def task_events_latest(spark, sf_dir):
    rank = F.row_number().over(tasks.Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("k", rank).filter("k = 1").select("user_id", "event_type", "event_id", "value")


@query("""WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS seq, turn % 4 AS step FROM conversations), f AS (SELECT conv_id, min(seq) FILTER (turn = 0) AS first FROM c GROUP BY conv_id)
SELECT seq, 'q' || conv_id AS queue_id, turn = 0 OR coalesce(first < seq, false) AND step BETWEEN 1 AND 2 AS ok FROM c JOIN f USING (conv_id)""")
def task_stream(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(talk.schema).parquet(f"{sf_dir}/conversations.parquet*")
    log = stream.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.timestamp_seconds(F.col("conv_id")).alias("ts"), F.when(F.col("turn") == 0, "create").otherwise("update").alias("op"), F.concat(F.lit("q"), F.col("conv_id")).alias("queue_id"),
        F.lit("t").alias("title"), F.array("text", F.lit("second")).alias("steps"), (F.col("turn") % 4).cast("int").alias("step_index"), F.lit("blocked").alias("status"), F.col("role").alias("note"),
    )
    return run_to_end(queue_answers(log), spark).select("seq", "queue_id", "ok")


# Documents and files


@query("""SELECT doc_id, CASE WHEN length(text) > 20000 THEN left(text, 20000) || chr(10) || chr(10) || '[truncated after 20000 characters]' ELSE text END AS long_cut,
CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || chr(10) || '[truncated after 100 characters]' ELSE text END AS short_cut FROM documents""")
def doc_truncate(spark, sf_dir):
    cut = lambda n: strings.truncated(F.col("text"), F.lit(n))
    return table(spark, sf_dir, "documents").select("doc_id", cut(20000).alias("long_cut"), cut(100).alias("short_cut"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, regexp_replace(replace(text, '.', chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS squeezed FROM documents")
def doc_collapse_ws(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", strings.collapse_space(text).alias("collapsed"), strings.squeeze_newlines(F.translate(text, ".", "\n")).alias("squeezed"))


TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(f"SELECT n::BIGINT AS position, name || '.parquet' AS name FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TABLES, start=1))}) AS t(n, name)")
def dir_listing(spark, sf_dir):
    """The files of the data directory, through the directory source and the tool's listing."""
    entries = directory_entries(spark, sf_dir).select("directory", "name", F.lit(False).alias("is_dir"))
    texts = files.listing_texts(entries, entries.select("directory").distinct())
    return texts.select(F.posexplode(F.split("output", "\n")).alias("at", "name")).select((F.col("at") + 1).cast("long").alias("position"), "name")


@query("""SELECT n_name AS line, 2::BIGINT AS times, (SELECT sum(length(n_name) + 1) * 2 FROM nation)::BIGINT AS bytes FROM nation""")
def file_round_trip(spark, sf_dir):
    """Lines written, appended, and read back as lines and as whole files."""
    folder = f"{working_folder(spark, 'text')}/lines"
    names = table(spark, sf_dir, "nation").select("n_name")
    for mode in ("overwrite", "append"):
        write_text(names, folder, mode)
    held = whole_files(spark, f"{folder}/part-*").select(files.decoded_text(F.col("content")).alias("text"), F.length("content").alias("n"))
    lines = held.select(F.explode(strings.split_lines(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    return lines.crossJoin(F.broadcast(held.agg(F.sum("n").alias("bytes"))))


@query("SELECT n::BIGINT AS n, output FROM (VALUES (1, 'abc'), (2, 'Could not decode as UTF-8 text file: /f'), (3, 'a' || chr(10) || 'b' || chr(10) || 'c'), (4, 'abcd' || chr(10) || chr(10) || '[truncated after 4 characters]')) AS t(n, output)")
def file_decode_check(spark, sf_dir):
    made = rows(spark, "(1L, '/f', X'616263', 0), (2L, '/f', X'61FF', 0), (3L, '/f', X'610D0A620D63', -1), (4L, '/f', X'6162636465', 4)", "n, path, content, max_chars")
    return files.read_texts(made, F.col("max_chars")).select("n", "output")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Invalid mode. Use overwrite or append.' WHEN doc_id % 2 = 0 THEN 'Write denied: write operations require explicit human approval'
ELSE 'Wrote ' || length(text) || ' characters to /w/' || doc_id || ' with mode=append.' END AS output FROM documents""")
def file_write_outcomes(spark, sf_dir):
    made = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('/w/', doc_id) AS path", "text AS content", "if(doc_id % 3 = 0, 'add', 'append') AS mode", "if(doc_id % 2 = 0, 'y', ' YES ') AS answer")
    return files.write_outcomes(made, "/w").select("doc_id", "output")


POLICY_ROWS = "(1, '/a/bc', '/a/b', 'yes'), (2, '/a/b', '/a/b', NULL), (3, '/a/b/c', '/a/b', 'no'), (4, '/x', '/', NULL), (5, '/x', '/a', ' YES '), (6, '/x', '/a', 'y')"


@query(f"""SELECT id, inside OR coalesce(lower(trim(answer)) = 'yes', false) AS may_read, coalesce(lower(trim(answer)) = 'yes', false) AS may_write,
CASE WHEN inside OR coalesce(lower(trim(answer)) = 'yes', false) THEN '' ELSE 'Read denied: path is outside AGENT_WORKSPACE_ROOT=' || root END AS message
FROM (SELECT *, root = '/' OR path = root OR starts_with(path, root || '/') AS inside FROM (VALUES {POLICY_ROWS}) AS t(id, path, root, answer))""")
def path_policy(spark, sf_dir):
    made = rows(spark, POLICY_ROWS, "id, path, root, answer")
    args = (F.col("path"), F.col("root"), F.col("answer"), F.lit(True))
    read, write = files.read_decision(*args), files.write_decision(*args)
    return made.select("id", read["allowed"].alias("may_read"), write["allowed"].alias("may_write"), read["message"].alias("message"))


# Command results

COMMANDS = "(1, true, true, 0, 'out', '', false, 30, 0, 'yes'), (2, true, true, 2, '', 'err', false, 30, 0, 'yes'), (3, true, true, 0, 'out', 'err', true, 500, 0, 'yes'), (4, true, true, 0, '', '', true, 0, 0, 'yes'), (5, false, false, 0, '', '', false, 30, 0, 'yes'), (6, true, true, 0, 'abcdefghij', '', false, 30, 12, 'yes'), (7, true, true, 0, '', '', false, 30, 0, NULL), (8, true, false, 0, '', '', false, 30, 0, 'yes')"


@query("""SELECT id, replace(output, '~', chr(10)) AS output FROM (VALUES (1, 'exit_code: 0~stdout:~out'), (2, 'exit_code: 2~stderr:~err'), (3, 'Command timed out after 120 seconds.~stdout:~out~stderr:~err'), (4, 'Command timed out after 1 seconds.'),
(5, 'Working directory does not exist: /w'), (6, 'exit_code: 0~~[truncated after 12 characters]'), (7, 'Shell command denied: shell commands require explicit human approval'), (8, 'Working directory is not a directory: /w')) AS t(id, output)""")
def command_format(spark, sf_dir):
    made = rows(spark, COMMANDS, "id, cwd_exists, cwd_is_dir, exit_code, stdout, stderr, timed_out, timeout_seconds, max_chars, answer").withColumn("cwd", F.lit("/w"))
    return commands.command_outputs(made, Policy(root="/w")).select("id", "output")


# Messages and conversations


@query("SELECT conv_id, turn, text, 'x' || chr(10) || text AS listed FROM conversations")
def msg_flatten(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("text")).alias("one"), F.to_json(F.array(F.struct(F.lit("x").alias("text")), F.struct(F.lit("").alias("text")), F.struct("text"))).alias("many"))
    return made.select("conv_id", "turn", messages.flatten_content(F.col("one")).alias("text"), messages.flatten_content(F.col("many")).alias("listed"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def conv_last_message(spark, sf_dir):
    return messages.last_message(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def conv_last_assistant(spark, sf_dir):
    return messages.last_message(table(spark, sf_dir, "conversations"), "assistant")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn = conv_id % 5 + 1 THEN ' EXIT ' WHEN turn % 3 = 1 THEN '  ' ELSE text END AS text FROM conversations)
SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS text FROM t WHERE turn < conv_id % 5 + 1 AND trim(text) <> ''""")
def conv_take_until_exit(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").withColumn("text", F.expr("CASE WHEN turn = conv_id % 5 + 1 THEN ' EXIT ' WHEN turn % 3 = 1 THEN '  ' ELSE text END"))
    return messages.until_exit(made).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, count(*) OVER w AS n_turns, sum(length(text)) OVER w AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def conv_history_size(spark, sf_dir):
    return messages.history_sizes(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS reply, arg_max(text, turn) FILTER (role = 'user') AS state FROM conversations GROUP BY conv_id""")
def chat_replies(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), F.when(F.col("role") == "user", "values").otherwise("messages").alias("mode"),
        F.when(F.col("role") == "assistant", "AIMessageChunk").otherwise("SystemMessage").alias("type"), F.when(F.col("role") == "user", F.col("text")).otherwise(F.to_json(F.struct("text"))).alias("content"),
    )
    return messages.streamed_replies(made)


@query("SELECT conv_id, turn AS seq, text FROM conversations WHERE role = 'assistant' AND text <> ''")
def chat_stream(spark, sf_dir):
    """As a stream: the chunks a reader sees."""
    talk = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parquet*")
    kind = F.when(F.col("role") == "assistant", "AIMessageChunk").otherwise("HumanMessage").alias("type")
    chunks = talk.select("conv_id", F.col("turn").alias("seq"), F.lit("messages").alias("mode"), kind, F.to_json(F.array(F.struct("text"))).alias("content"))
    return run_to_end(messages.printed_chunks(chunks), spark)


# Settings

ROUTES = "(1, 'openai', NULL), (2, 'google', ''), (3, 'anthropic', NULL), (4, 'openai-compatible', NULL), (5, 'openai-compatible', 'http://h'), (6, 'dashscope', NULL), (7, 'bailian', 'http://b'), (8, 'aliyun', ''), (9, 'other', NULL)"


@query("""SELECT * FROM (VALUES (1, 'openai', NULL, NULL), (2, 'google', NULL, NULL), (3, 'anthropic', NULL, NULL), (4, NULL, NULL, 'OPENAI_COMPATIBLE_BASE_URL is required for openai-compatible provider.'), (5, 'openai-compatible', 'http://h', NULL),
(6, 'openai-compatible', 'https://dashscope.aliyuncs.com/compatible-mode/v1', NULL), (7, 'openai-compatible', 'http://b', NULL), (8, 'openai-compatible', 'https://dashscope.aliyuncs.com/compatible-mode/v1', NULL),
(9, NULL, NULL, 'Unsupported MODEL_PROVIDER=''other''. Supported providers: openai, google, anthropic, openai-compatible, dashscope, bailian, aliyun')) AS t(id, client, base_url, error)""")
def provider_route(spark, sf_dir):
    made = rows(spark, ROUTES, "id, provider, base_url")
    return made.select("id", settings.route(F.col("provider"), F.col("base_url")).alias("r")).select("id", "r.*")


@query("""SELECT * FROM (VALUES ('a', 'google', 0.5::DOUBLE, 'gemini-1.5-flash', 'k2', true, false), ('b', 'openai', 0.2::DOUBLE, 'g', NULL, false, true)) AS t(profile, model_provider, model_temperature, google_model, api_key, shell, search)""")
def settings_resolve(spark, sf_dir):
    kv = rows(spark, "('a', 'MODEL_PROVIDER', ' Google '), ('a', 'MODEL_TEMPERATURE', '0.5'), ('a', 'OPENAI_COMPATIBLE_API_KEY', ''), ('a', 'DASHSCOPE_API_KEY', 'k2'), ('a', 'AGENT_ENABLE_WEB_SEARCH', 'nope'), ('b', 'GOOGLE_MODEL', 'g'), ('b', 'AGENT_ENABLE_SHELL_COMMANDS', 'off'), ('b', 'AGENT_ENABLE_WEB_SEARCH', ' ON ')", "profile, key, value")
    s = settings.settings_from_rows(kv)
    return s.select("profile", "model_provider", "model_temperature", "google_model", F.col("openai_compatible_api_key").alias("api_key"), F.col("agent_enable_shell_commands").alias("shell"), F.col("agent_enable_web_search").alias("search"))


@query("""SELECT * FROM (VALUES ('a', 'google', 'g1'), ('b', 'openai', 'gpt-4o-mini'), ('c', 'openai-compatible', 'qwen-plus'), ('d', NULL, NULL), ('e', 'anthropic', 'claude-3-5-haiku-latest')) AS t(profile, client, model)""")
def settings_routed(spark, sf_dir):
    kv = rows(spark, "('a', 'MODEL_PROVIDER', 'google'), ('a', 'GOOGLE_MODEL', 'g1'), ('b', 'GOOGLE_MODEL', 'x'), ('c', 'MODEL_PROVIDER', ' BAILIAN'), ('d', 'MODEL_PROVIDER', 'other'), ('e', 'MODEL_PROVIDER', 'anthropic')", "profile, key, value")
    return settings.routed(settings.settings_from_rows(kv)).select("profile", "client", "model")


@query("SELECT 'env' AS profile, 'aliyun' AS model_provider, 'k' AS openai_compatible_api_key, 'https://dashscope.aliyuncs.com/compatible-mode/v1' AS base_url, false AS agent_enable_browser_tools")
def settings_environment(spark, sf_dir):
    env = {"MODEL_PROVIDER": "Aliyun ", "DASHSCOPE_API_KEY": "k", "AGENT_ENABLE_BROWSER_TOOLS": "0"}
    return settings.routed(settings.settings_from_env(spark, env)).select("profile", "model_provider", "openai_compatible_api_key", "base_url", "agent_enable_browser_tools")


FLAGS = "(1, 'TRUE'), (2, ' yes '), (3, 'on'), (4, '1'), (5, '0'), (6, ''), (7, 'y'), (8, NULL)"


@query(f"SELECT id, lower(trim(coalesce(v, 'true'))) IN ('1', 'true', 'yes', 'on') AS flag FROM (VALUES {FLAGS}) AS t(id, v)")
def flag_truthy(spark, sf_dir):
    return rows(spark, FLAGS, "id, v").select("id", strings.is_truthy(F.col("v")).alias("flag"))


@query("SELECT o_orderkey, greatest(1, least(o_orderkey % 200 - 50, 100))::BIGINT AS links, greatest(1, least(o_orderkey % 200 - 50, 10))::BIGINT AS results, greatest(1, least(o_orderkey % 200 - 50, 120))::BIGINT AS seconds FROM orders")
def clamp_params(spark, sf_dir):
    n = F.col("o_orderkey") % 200 - 50
    return table(spark, sf_dir, "orders").select("o_orderkey", *[strings.clamped(n, 1, high).cast("long").alias(name) for name, high in (("links", 100), ("results", 10), ("seconds", 120))])


# A table of tool calls


@query(f"""WITH {PAGE_SQL}
SELECT page_id AS call_id, 'open_web_page' AS tool, true AS ok, left('URL: ' || url || chr(10) || 'Title: ' || title || chr(10) || chr(10) || text, 50) || chr(10) || chr(10) || '[truncated after 50 characters]' AS output FROM texts
UNION ALL SELECT 1000000 + page_id, 'calculator', true, (page_id + 2)::VARCHAR FROM pages UNION ALL SELECT 2000000 + page_id, 'unheard_of', false, 'Unknown tool: unheard_of' FROM pages
UNION ALL SELECT 3000000 + page_id, 'create_task_queue', false, 'Cannot create a task queue without at least one step.' FROM pages
UNION ALL SELECT 4000000 + page_id, 'update_task_step', false, 'Task queue not found: q' || page_id FROM pages""")
def tool_dispatch(spark, sf_dir):
    stored = table(spark, sf_dir, "pages").withColumn("content_type", F.lit("text/html"))
    call = lambda k, tool, args: stored.select((F.lit(k * 1_000_000) + F.col("page_id")).alias("call_id"), F.lit(tool).alias("tool"), F.to_json(args).alias("args"))
    calls = (
        call(0, "open_web_page", F.struct("url", F.lit(50).alias("max_chars")))
        .unionByName(call(1, "calculator", F.struct(F.concat("page_id", F.lit(" + 2")).alias("expression"))))
        .unionByName(call(2, "unheard_of", F.struct("url")))
        .unionByName(call(3, "create_task_queue", F.struct(F.lit("t").alias("title"), F.array(F.lit(" ")).alias("steps"))))
        .unionByName(call(4, "update_task_step", F.struct(F.concat(F.lit("q"), F.col("page_id")).alias("queue_id"), F.lit(1).alias("step_index"), F.lit("pending").alias("status"))))
        .withColumn("seq", F.col("call_id"))
    )
    return run_tool_calls(calls, Captured(pages=stored)).select("call_id", "tool", "ok", "output")


# Calls of all tools, answered well and badly: (call, tool, arguments, ok, answer).
CALLS = [
    ("calculator", {"expression": "2**3"}, True, "8"),
    ("calculator", {"expression": "1/0"}, False, "Calculation error: division by zero"),
    ("calculator", None, False, "Calculation error: no expression"),
    ("configured_provider", {}, True, "p"),
    ("list_local_directory", {}, True, "sub/\nf"),
    ("list_local_directory", {"path": "sub/."}, True, "(empty directory)"),
    ("list_local_directory", {"path": "f"}, False, "Path is not a directory: /w/f"),
    ("list_local_directory", {"path": "gone"}, False, "Path does not exist: /w/gone"),
    ("list_local_directory", {"path": ".."}, False, "Read denied: path is outside AGENT_WORKSPACE_ROOT=/w"),
    ("read_local_file", {"path": "f", "max_chars": 2}, True, "ab\n\n[truncated after 2 characters]"),
    ("read_local_file", {"path": "/w//sub/../f"}, True, "abc"),
    ("read_local_file", {"path": "/w/../etc/passwd"}, False, "Read denied: path is outside AGENT_WORKSPACE_ROOT=/w"),
    ("read_local_file", {"path": "/w/../etc/passwd", "answer": " Yes"}, True, "secret"),
    ("read_local_file", {"path": "sub"}, False, "Path is not a file: /w/sub"),
    ("read_local_file", {"path": "~/x"}, False, "Read denied: path is outside AGENT_WORKSPACE_ROOT=/w"),
    ("read_local_file", {"path": "gone"}, False, "File does not exist: /w/gone"),
    ("read_local_file", {"path": "bytes"}, False, "Could not decode as UTF-8 text file: /w/bytes"),
    ("write_local_file", {"path": "sub/../g", "content": "hey", "answer": "yes"}, True, "Wrote 3 characters to /w/g with mode=overwrite."),
    ("write_local_file", {"path": "g", "content": "hey"}, False, "Write denied: write operations require explicit human approval"),
    ("write_local_file", {"path": "../g", "content": "hey"}, False, "Write denied: path is outside AGENT_WORKSPACE_ROOT=/w and write operations require approval"),
    ("write_local_file", {"path": "g", "content": "hey", "mode": "add"}, False, "Invalid mode. Use overwrite or append."),
    ("execute_shell_command", {"command": "ls"}, True, "exit_code: 0\nstdout:\nf"),
    ("execute_shell_command", {"command": "rm", "cwd": "sub/.."}, False, "Shell command denied: shell commands require explicit human approval"),
    ("execute_shell_command", {"command": "ls", "cwd": "/o/../o"}, False, "Shell command denied: cwd is outside AGENT_WORKSPACE_ROOT=/w and shell commands require approval"),
    ("execute_shell_command", {"command": "cat"}, False, "Not captured."),
    ("execute_shell_command", {"command": "sleep", "timeout_seconds": 0}, False, "Command timed out after 1 seconds."),
    ("execute_shell_command", {"command": "ls", "cwd": "gone"}, False, "Working directory does not exist: /w/gone"),
    ("web_search", {"query": "q"}, True, "Search results for: q\n1. E\n   https://e.org"),
    ("web_search", {"query": "robot"}, False, "Web search error: search provider returned an anti-bot challenge."),
    ("web_search", {"query": "none"}, True, "No web search results found."),
    ("web_search", {"query": "unknown"}, False, "Web search error: Not captured."),
    ("open_web_page", {"url": "https://h.org"}, True, "URL: https://h.org\nTitle: New\n\nX"),
    ("open_web_page", {"url": "https://pdf.org"}, False, "Fetched non-HTML content from https://pdf.org. Content-Type: application/pdf"),
    ("open_web_page", {"url": "ftp://h.org"}, False, "Browser open error: Only http and https URLs are supported."),
    ("open_web_page", {}, False, "Browser open error: Only http and https URLs are supported."),
    ("list_web_page_links", {"url": "https://h.org"}, True, "Links found on https://h.org:\n1. X\n   https://h.org/x"),
    ("list_web_page_links", {"url": "https://gone.org"}, False, "Browser link extraction error: Not captured."),
    ("list_task_queues", {}, True, "No task queues exist in this process."),
    ("create_task_queue", {"title": "t", "steps": ["s", " "], "queue_id": "k"}, True, "Queue k: t\nCreated: 2023-11-14T22:13:20+00:00\n1. [pending] s"),
    ("update_task_step", {"queue_id": "k", "step_index": 1, "status": "completed"}, True, "Queue k: t\nCreated: 2023-11-14T22:13:20+00:00\n1. [completed] s"),
    ("update_task_step", {"queue_id": "k", "step_index": 2, "status": "completed"}, False, "Invalid step_index. Use a value from 1 to 1."),
    ("get_task_queue", {"queue_id": "k"}, True, "Queue k: t\nCreated: 2023-11-14T22:13:20+00:00\n1. [completed] s"),
    ("get_task_queue", {"queue_id": "other"}, False, "Task queue not found: other"),
    ("list_task_queues", {}, True, "k: t (1/1 completed)"),
    ("nothing", {}, False, "Unknown tool: nothing"),
    (None, {}, False, "Unknown tool: None"),
    ("current_time", {}, True, "now"),
]


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query(f"SELECT id::BIGINT AS call_id, tool, ok, replace(output, '~', chr(10)) AS output FROM (VALUES {', '.join(f'({i}, {quoted(t)}, {str(ok).lower()}, {quoted(o.replace(chr(10), chr(126)))})' for i, (t, _, ok, o) in enumerate(CALLS))}) AS t(id, tool, ok, output)")
def tool_calls(spark, sf_dir):
    """Each of the tools, with its successes and refusals."""
    made = [(i, i, t, None if a is None else json.dumps(a)) for i, (t, a, _, _) in enumerate(CALLS)]
    calls = spark.createDataFrame(made, TOOL_CALL).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    frame = spark.createDataFrame
    kept = Captured(
        pages=frame([("https://h.org", "<title>Old</title>", "text/html", 1), ("https://h.org", "<title>New</title><a href='/x'>X</a>", "text/html", 2), ("https://pdf.org", "%PDF", "application/pdf", 1), ("ftp://h.org", "x", "", 1)], "url string, html string, content_type string, captured_at long"),
        results=frame([("q", "<a class='result-link' href='https://e.org'>E</a>"), ("robot", "<form id='challenge-form'>"), ("none", "<p>")], "query string, html string"),
        files=frame([("/w/f", b"abc"), ("/w/bytes", b"\xff"), ("/etc/passwd", b"secret")], "path string, content binary"),
        entries=frame([("/w", "f", False), ("/w", "sub", True)], "directory string, name string, is_dir boolean"),
        directories=frame([("/w/sub",)], "path string"),
        commands=frame(
            [("ls", "/w", True, True, 0, "f", "", False, "yes"), ("rm", "/w", True, True, None, None, None, None, "no"), ("ls", "/o", True, True, 0, "", "", False, None), ("sleep", "/w", True, True, None, None, None, True, "yes"), ("ls", "/w/gone", False, False, None, None, None, None, "yes")],
            "command string, cwd string, cwd_exists boolean, cwd_is_dir boolean, exit_code int, stdout string, stderr string, timed_out boolean, answer string",
        ),
    )
    out = run_tool_calls(calls, kept, Policy(root="/w"), provider="p")
    now = F.regexp_like("output", F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$"))
    return out.select("call_id", "tool", "ok", F.when((F.col("tool") == "current_time") & now, "now").otherwise(F.col("output")).alias("output"))
