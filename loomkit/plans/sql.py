"""The scalar operators as SQL functions, and page links and search results as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomkit.functions import html
from loomkit.functions.arithmetic import calculate
from loomkit.operators.messages import flatten_in_python


@F.udtf(returnType="position int, label string, href string")
class PageLinks:
    def eval(self, url: str, page: str):
        for i, link in enumerate(html.read_page(url, page)[2] or [], start=1):
            yield i, link["label"], link["href"]


@F.udtf(returnType="position int, title string, url string")
class SearchResults:
    def eval(self, page: str):
        for i, hit in enumerate(html.read_results(page) or [], start=1):
            yield i, hit["title"], hit["url"]


def register(spark: SparkSession) -> None:
    """calculate(text), parse_page(url, html), parse_results(html), decode_body(bytes, content_type),
    unwrap_redirect(url), flatten_content(json); tables page_links(url, html), search_results(html)."""
    scalars = {
        "calculate": calculate,
        "parse_page": html.parse_page,
        "parse_results": html.parse_results,
        "decode_body": html.decode_body,
        "unwrap_redirect": html.unwrap_redirect,
        "flatten_content": flatten_in_python,
    }
    for name, function in scalars.items():
        spark.udf.register(name, function.made())
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("search_results", SearchResults)
