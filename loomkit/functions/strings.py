"""Column functions with Python's string semantics, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomkit.policy import TRUTHY

# The characters Python counts as white space, and its line ends.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def py_strip(text: Column) -> Column:
    """str.strip(): all Unicode white space, where trim() would take spaces only."""
    return F.btrim(text, F.lit(SPACES))


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def squeeze_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def split_lines(text: Column) -> Column:
    """str.splitlines(): a line end at the end of the text starts no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truncated(text: Column, max_chars: Column) -> Column:
    """The first max_chars characters and a notice, if the text is longer; a limit of 0 or less is none."""
    notice = F.concat(F.lit("\n\n[truncated after "), max_chars.cast("string"), F.lit(" characters]"))
    return F.when((max_chars > 0) & (F.length(text) > max_chars), F.concat(F.left(text, max_chars), notice)).otherwise(text)


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def is_truthy(value: Column, default: str = "true") -> Column:
    """1, true, yes or on, whatever the case and the space around; a missing value is the default."""
    return F.lower(py_strip(F.coalesce(value, F.lit(default)))).isin(*TRUTHY)


def is_approved(answer: Column, approval_enabled: Column) -> Column:
    """Only `yes` approves, whatever the case and the space around; nobody can approve if approval is off."""
    return approval_enabled & F.coalesce(F.lower(py_strip(answer)) == "yes", F.lit(False))


def or_default(text: Column, default: str | Column) -> Column:
    """The text, or the default if it is empty or null."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def rendered_pairs(pairs: Column, first: str, second: str) -> Column:
    """Numbered two-line items from an array of structs: `1. first`, then `   second`."""
    item = lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p[first], F.lit("\n   "), p[second])
    return F.array_join(F.transform(pairs, item), "\n")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def is_web_url(url: Column) -> Column:
    return url_scheme(url).isin("http", "https")


def utc_seconds(ts: Column) -> Column:
    """ISO 8601 to the second with the session's offset, as +00:00."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def quote_plus(text: Column) -> Column:
    """Percent-encoding with + for a space, as Python does it: ~ stays, * doesn't, other than in url_encode."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
