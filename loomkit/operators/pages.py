"""Stored pages to titles, readable text and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.html import parse_page
from loomkit.functions.strings import clamped, is_web_url, or_default, rendered_pairs, truncated
from loomkit.policy import Policy

MAX_CHARS, MAX_LINKS = 20000, 30


def parsed_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds `page`: title, text and links of each row. Each page is parsed once, whatever is derived from it."""
    return pages.withColumn("page", parse_page(F.col(url), F.col(html)))


def display_title(page: Column) -> Column:
    return or_default(page["title"], "(no title)")


def first_links(page: Column, max_links: Column) -> Column:
    """The first links after repetitions are gone: between 1 and 100, whatever is asked for."""
    return F.slice(page["links"], 1, clamped(max_links, 1, 100))


def page_links(pages: DataFrame, max_links: int = MAX_LINKS, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each of a page's first links: the keys, position from 1, label, href."""
    links = first_links(F.col("page"), F.lit(max_links))
    rows = parsed_pages(pages).select(*keys, F.posexplode(links).alias("at", "link"))
    return rows.select(*keys, (F.col("at") + 1).cast("long").alias("position"), "link.label", "link.href")


def page_texts(pages: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return parsed_pages(pages).select(*keys, display_title(F.col("page")).alias("title"), "page.text")


def fetch_problem(pages: DataFrame) -> Column:
    """Why a row has no page: what the fetch reported (column fetch_error, if there is one) or a scheme that isn't http or https."""
    reported = F.col("fetch_error") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    return F.coalesce(F.when(~F.coalesce(is_web_url(F.col("url")), F.lit(False)), F.lit("Only http and https URLs are supported.")), reported)


def opened_pages(pages: DataFrame, max_chars: Column | None = None, policy: Policy = Policy()) -> DataFrame:
    """Adds `ok` and `output`: address, title and text of each page, or why there is none. The limit counts the whole output."""
    limit = F.lit(MAX_CHARS) if max_chars is None else max_chars
    if not policy.browser_enabled:
        return pages.withColumn("ok", F.lit(False)).withColumn("output", F.lit("Browser tools are disabled by AGENT_ENABLE_BROWSER_TOOLS."))
    kind = F.coalesce(F.col("content_type"), F.lit("")) if "content_type" in pages.columns else F.lit("")
    problem = fetch_problem(pages)
    other = (kind != "") & ~F.contains(F.lower(kind), F.lit("html"))
    text = or_default(F.col("page.text"), "(no readable text found)")
    shown = F.concat(F.lit("URL: "), F.col("url"), F.lit("\nTitle: "), display_title(F.col("page")), F.lit("\n\n"), text)
    output = (
        F.when(problem.isNotNull(), F.concat(F.lit("Browser open error: "), problem))
        .when(other, F.concat(F.lit("Fetched non-HTML content from "), F.col("url"), F.lit(". Content-Type: "), kind))
        .otherwise(truncated(shown, limit))
    )
    return parsed_pages(pages).withColumn("ok", problem.isNull() & ~other).withColumn("output", output).drop("page")


def listed_links(pages: DataFrame, max_links: Column | None = None, policy: Policy = Policy()) -> DataFrame:
    """Adds `ok` and `output`: the numbered links of each page, or why there are none. The content type doesn't matter here."""
    limit = F.lit(MAX_LINKS) if max_links is None else max_links
    if not policy.browser_enabled:
        return pages.withColumn("ok", F.lit(False)).withColumn("output", F.lit("Browser tools are disabled by AGENT_ENABLE_BROWSER_TOOLS."))
    problem = fetch_problem(pages)
    links = first_links(F.col("page"), limit)
    output = (
        F.when(problem.isNotNull(), F.concat(F.lit("Browser link extraction error: "), problem))
        .when(F.size("page.links") == 0, F.concat(F.lit("No links found on "), F.col("url"), F.lit(".")))
        .otherwise(F.concat(F.lit("Links found on "), F.col("url"), F.lit(":\n"), rendered_pairs(links, "label", "href")))
    )
    return parsed_pages(pages).withColumn("ok", problem.isNull()).withColumn("output", output).drop("page")
