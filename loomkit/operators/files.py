"""Files behind a path policy: decisions, listings, reads and write requests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.paths import inside
from loomkit.functions.strings import is_approved, truncated

MODES = ("overwrite", "append")
BAD_MODE = "Invalid mode. Use overwrite or append."


def decision(allowed: Column, refusal: Column) -> Column:
    return F.struct(allowed.alias("allowed"), F.when(allowed, "").otherwise(refusal).alias("message"))


def read_decision(path: Column, root: Column, answer: Column, approval_enabled: Column) -> Column:
    """Inside the root reading needs no approval; elsewhere only an approved read is allowed."""
    reason = F.concat(F.lit("Read denied: path is outside AGENT_WORKSPACE_ROOT="), root)
    return decision(inside(path, root) | is_approved(answer, approval_enabled), reason)


def write_decision(path: Column, root: Column, answer: Column, approval_enabled: Column) -> Column:
    """Every write needs approval."""
    outside = F.concat(F.lit("path is outside AGENT_WORKSPACE_ROOT="), root, F.lit(" and write operations require approval"))
    reason = F.when(inside(path, root), F.lit("write operations require explicit human approval")).otherwise(outside)
    return decision(is_approved(answer, approval_enabled), F.concat(F.lit("Write denied: "), reason))


def entry_name() -> Column:
    return F.concat(F.col("name"), F.when(F.col("is_dir"), "/").otherwise(""))


def ordered_entries(entries: DataFrame) -> DataFrame:
    """Directories first, then by name without regard to case; names that differ only in case by the name itself."""
    return entries.orderBy(~F.col("is_dir"), F.lower("name"), "name")


def listing_texts(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """A row for each directory: directory, output. Takes entries (schemas.DIRECTORY_ENTRY) and the directories asked for."""
    key = F.struct(~F.col("is_dir"), F.lower("name"), F.col("name"), entry_name().alias("shown"))
    names = entries.groupBy("directory").agg(F.sort_array(F.collect_list(key)).alias("names"))
    text = F.array_join(F.transform("names", lambda n: n["shown"]), "\n")
    return directories.join(names, "directory", "left").select("directory", F.coalesce(text, F.lit("(empty directory)")).alias("output"))


def decoded_text(content: Column) -> Column:
    """UTF-8 text with line ends as \\n; null if the bytes aren't UTF-8."""
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "\r\n?", "\n")


def read_texts(files: DataFrame, max_chars: Column | None = None) -> DataFrame:
    """Adds `ok` and `output` to files (path, content): the text, cut at the limit, or that it isn't UTF-8."""
    text = decoded_text(F.col("content"))
    refusal = F.concat(F.lit("Could not decode as UTF-8 text file: "), F.col("path"))
    limit = F.lit(20000) if max_chars is None else max_chars
    return files.withColumn("ok", text.isNotNull()).withColumn("output", F.when(text.isNull(), refusal).otherwise(truncated(text, limit)))


def known_paths(files: DataFrame | None, entries: DataFrame | None, directories: DataFrame | None = None) -> DataFrame | None:
    """(target, is_dir) of each path that captured tables tell of: files (path), entries of directories, and
    directories (path), among them empty ones. A path that is told of as both counts as a directory."""
    tables = []
    if files is not None:
        tables.append(files.select(F.col("path").alias("target"), F.lit(False).alias("is_dir")))
    if entries is not None:
        tables.append(entries.select(F.col("directory").alias("target"), F.lit(True).alias("is_dir")))
        own = F.concat(F.when(F.col("directory") == "/", "").otherwise(F.col("directory")), F.lit("/"), F.col("name"))
        tables.append(entries.select(own.alias("target"), "is_dir"))
    if directories is not None:
        tables.append(directories.select(F.col("path").alias("target"), F.lit(True).alias("is_dir")))
    if not tables:
        return None
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("target").agg(F.max("is_dir").alias("is_dir"))


def write_outcomes(requests: DataFrame, root: str, approval_enabled: bool = True) -> DataFrame:
    """Adds `ok` and `output` to write requests (path, content, mode, answer): the mode is checked first, then the policy."""
    allowed = write_decision(F.col("path"), F.lit(root), F.col("answer"), F.lit(approval_enabled))
    bad_mode = ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    wrote = F.concat(F.lit("Wrote "), F.length("content").cast("string"), F.lit(" characters to "), F.col("path"), F.lit(" with mode="), F.col("mode"), F.lit("."))
    output = F.when(bad_mode, F.lit(BAD_MODE)).when(~allowed["allowed"], allowed["message"]).otherwise(wrote)
    return requests.withColumn("ok", ~bad_mode & allowed["allowed"]).withColumn("output", output)


def final_contents(requests: DataFrame, root: str, approval_enabled: bool = True) -> DataFrame:
    """What each file holds after all requests, in the order of seq: path, content. An overwrite starts afresh; appends
    add their text as it is. Files that no allowed request names don't appear."""
    done = write_outcomes(requests, root, approval_enabled).filter("ok")
    starts = done.filter("mode = 'overwrite'").groupBy("path").agg(F.max("seq").alias("first"))
    kept = done.join(starts, "path", "left").filter("first IS NULL OR seq >= first")
    parts = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("parts"))
    return parts.select("path", F.array_join(F.transform("parts", lambda p: p["content"]), "").alias("content"))
