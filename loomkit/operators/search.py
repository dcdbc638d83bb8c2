"""Stored search-result pages to ranked titles and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.html import parse_results
from loomkit.functions.strings import clamped, quote_plus, rendered_pairs
from loomkit.policy import Policy

MAX_RESULTS = 5
SEARCH_PAGE = "https://lite.duckduckgo.com/lite/?q="  # fixed value


def search_url(query: Column) -> Column:
    """Where the result page of a query is found, for whoever fetches it."""
    return F.concat(F.lit(SEARCH_PAGE), quote_plus(query))


def fetch_timeout(seconds: Column) -> Column:
    return clamped(seconds, 1, 30)


def is_challenge(html: Column) -> Column:
    """Whether the page asks the visitor to prove not to be a robot."""
    return F.contains(html, F.lit("anomaly.js")) | F.contains(html, F.lit("challenge-form"))


def ranked(max_results: Column) -> Column:
    """The first results, between 1 and 10; pages that ask for proof aren't parsed."""
    found = parse_results(F.when(~is_challenge(F.col("html")), F.col("html")))
    return F.slice(found, 1, clamped(max_results, 1, 10))


def search_results(pages: DataFrame, max_results: int = MAX_RESULTS, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each result: the keys, position from 1, title, url. Takes html."""
    rows = pages.select(*keys, F.posexplode(ranked(F.lit(max_results))).alias("at", "hit"))
    return rows.select(*keys, (F.col("at") + 1).cast("long").alias("position"), "hit.title", "hit.url")


def searched(pages: DataFrame, max_results: Column | None = None, policy: Policy = Policy()) -> DataFrame:
    """Adds `ok` and `output` from query and html (and fetch_error, if there is one): the numbered results or why there are none."""
    if not policy.search_enabled:
        return pages.withColumn("ok", F.lit(False)).withColumn("output", F.lit("Web search is disabled by AGENT_ENABLE_WEB_SEARCH."))
    problem = F.col("fetch_error") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    problem = F.coalesce(problem, F.when(is_challenge(F.col("html")), F.lit("search provider returned an anti-bot challenge.")))
    hits = pages.withColumn("hits", ranked(F.lit(MAX_RESULTS) if max_results is None else max_results))
    output = (
        F.when(problem.isNotNull(), F.concat(F.lit("Web search error: "), problem))
        .when(F.size("hits") == 0, F.lit("No web search results found."))
        .otherwise(F.concat(F.lit("Search results for: "), F.col("query"), F.lit("\n"), rendered_pairs(F.col("hits"), "title", "url")))
    )
    return hits.withColumn("ok", problem.isNull()).withColumn("output", output).drop("hits")
