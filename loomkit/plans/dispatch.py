"""A table of tool calls, answered in sets: calls are split by tool, each family's operator answers its own, and the
answers are put together again. Arguments are JSON texts.

Live fetches, searches and commands have no place here: calls on pages, search results, files and commands are
joined to tables of what was captured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.arithmetic import calculate
from loomkit.functions.paths import normalise
from loomkit.functions.strings import utc_seconds
from loomkit.operators import commands, files, pages, search, tasks
from loomkit.policy import Policy

# The tools, in their order of registration.
TOOLS = [
    "calculator",
    "current_time",
    "configured_provider",
    "list_local_directory",
    "read_local_file",
    "write_local_file",
    "execute_shell_command",
    "web_search",
    "open_web_page",
    "list_web_page_links",
    "create_task_queue",
    "update_task_step",
    "get_task_queue",
    "list_task_queues",
]


@dataclass
class Captured:
    """Tables that calls are joined to. A family without its table answers that the resource isn't captured.

    pages: url, html, content_type. results: query, html. files: path, content. entries: directory, name, is_dir.
    directories: path (only needed for empty ones). commands: command, cwd and the rest of schemas.COMMAND_RESULT,
    answer. Paths are absolute and normal. If a table has several rows for a key, the one of the greatest captured_at
    counts (a column a table may have), then the greatest by its other columns: a call has one answer.
    """

    pages: DataFrame | None = None
    results: DataFrame | None = None
    files: DataFrame | None = None
    entries: DataFrame | None = None
    commands: DataFrame | None = None
    directories: DataFrame | None = None


def latest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key (see Captured)."""
    order = [c for c in ("captured_at",) if c in df.columns]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("kept")).select(*keys, *[f"kept.{c}" for c in columns])


def argument(name: str, kind: str = "string", default=None) -> Column:
    value = F.try_variant_get(F.col("args"), f"$.{name}", kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def run_tool_calls(calls: DataFrame, captured: Captured = Captured(), policy: Policy = Policy(), provider: str = "openai") -> DataFrame:
    """call_id, seq, tool, ok, output of each call (schemas.TOOL_CALL, and ts if calls have it)."""
    stamped = calls if "ts" in calls.columns else calls.withColumn("ts", F.current_timestamp())
    parsed = stamped.withColumn("args", F.try_parse_json(F.coalesce("args", F.lit("{}"))))
    of = lambda *names: parsed.filter(F.col("tool").isin(*names))
    answer = lambda df: df.select("call_id", "seq", "tool", "ok", "output")
    absent = lambda df: answer(df.withColumn("ok", F.lit(False)).withColumn("output", F.lit(commands.NOT_CAPTURED)))
    resolved = lambda name: normalise(argument(name, default="."), policy.cwd or policy.root, policy.home)
    said = argument("answer")

    parts = [
        answer(plain_answers(parsed, provider)),
        answer(files.write_outcomes(of("write_local_file").withColumns({"path": resolved("path"), "content": argument("content", default=""), "mode": argument("mode", default="overwrite"), "answer": said}), policy.root, policy.approval_enabled)),
        *task_answers(of("create_task_queue", "update_task_step", "get_task_queue", "list_task_queues")),
    ]

    page_calls = of("open_web_page", "list_web_page_links").withColumn("url", argument("url"))
    if captured.pages is not None:
        stored = page_calls.join(latest(captured.pages, ["url"], ["html", "content_type"]), "url", "left")
        stored = stored.withColumn("fetch_error", F.when(F.col("html").isNull(), commands.NOT_CAPTURED))
        parts.append(answer(pages.opened_pages(stored.filter("tool = 'open_web_page'"), argument("max_chars", "int", pages.MAX_CHARS), policy)))
        parts.append(answer(pages.listed_links(stored.filter("tool = 'list_web_page_links'"), argument("max_links", "int", pages.MAX_LINKS), policy)))
    else:
        parts.append(absent(page_calls))

    search_calls = of("web_search").withColumn("query", argument("query"))
    if captured.results is not None:
        stored = search_calls.join(latest(captured.results, ["query"], ["html"]), "query", "left")
        stored = stored.withColumn("fetch_error", F.when(F.col("html").isNull(), commands.NOT_CAPTURED))
        parts.append(answer(search.searched(stored, argument("max_results", "int", search.MAX_RESULTS), policy)))
    else:
        parts.append(absent(search_calls))

    reads = of("read_local_file", "list_local_directory").withColumn("path", resolved("path"))
    reads = reads.withColumn("may", files.read_decision(F.col("path"), F.lit(policy.root), said, F.lit(policy.approval_enabled)))
    known = files.known_paths(captured.files, captured.entries, captured.directories)
    if known is not None:
        reads = reads.join(known.withColumnRenamed("target", "path"), "path", "left")
        parts += [answer(read_answers(reads.filter("tool = 'read_local_file'"), captured)), answer(list_answers(reads.filter("tool = 'list_local_directory'"), captured))]
    else:
        denied = reads.withColumn("ok", F.lit(False)).withColumn("output", F.when(F.col("may.allowed"), commands.NOT_CAPTURED).otherwise(F.col("may.message")))
        parts.append(answer(denied))

    shells = of("execute_shell_command").withColumns({"command": argument("command"), "cwd": resolved("cwd"), "said": said})
    if captured.commands is not None:
        columns = ["cwd_exists", "cwd_is_dir", "exit_code", "stdout", "stderr", "timed_out", "answer"]
        ran = shells.join(latest(captured.commands, ["command", "cwd"], columns), ["command", "cwd"], "left")
        ran = ran.withColumns({"answer": F.coalesce("said", "answer"), "timeout_seconds": argument("timeout_seconds", "int", 30), "max_chars": argument("max_chars", "int", 20000)})
        parts.append(answer(commands.command_outputs(ran, policy)))
    elif not policy.shell_enabled:
        parts.append(answer(shells.withColumn("ok", F.lit(False)).withColumn("output", F.lit(commands.SHELL_OFF))))
    else:
        parts.append(absent(shells))

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def plain_answers(parsed: DataFrame, provider: str) -> DataFrame:
    """Calls that need no table: the calculator, the time, the provider, and tools nobody knows."""
    plain = ["calculator", "current_time", "configured_provider"]
    tool = F.coalesce("tool", F.lit("None"))
    calls = parsed.filter(tool.isin(*plain) | ~tool.isin(*TOOLS))
    counted = calls.withColumn("r", calculate(F.when(F.col("tool") == "calculator", argument("expression"))))
    output = (
        F.when(tool == "calculator", F.coalesce("r.display", F.lit("Calculation error: no expression")))
        .when(tool == "current_time", utc_seconds(F.current_timestamp()))
        .when(tool == "configured_provider", F.lit(provider))
        .otherwise(F.concat(F.lit("Unknown tool: "), tool))
    )
    ok = F.when(tool == "calculator", F.coalesce("r.ok", F.lit(False))).otherwise(tool.isin(*plain))
    return counted.withColumn("ok", ok).withColumn("output", output)


def checked(calls: DataFrame, problem: Column, ok: Column, output: Column) -> DataFrame:
    """The policy's refusal first, then the problem if there is one, then what the tool found."""
    fine = F.col("may.allowed") & problem.isNull()
    shown = F.when(~F.col("may.allowed"), F.col("may.message")).when(problem.isNotNull(), problem).otherwise(output)
    return calls.withColumn("shown", shown).withColumn("fine", fine & F.coalesce(ok, F.lit(False))).withColumns({"ok": F.col("fine"), "output": F.col("shown")})


def read_answers(calls: DataFrame, captured: Captured) -> DataFrame:
    """Takes calls with path, may and is_dir (null for a path nobody told of)."""
    held = calls.withColumn("content", F.lit(None).cast("binary"))
    if captured.files is not None:
        held = calls.join(latest(captured.files, ["path"], ["content"]), "path", "left")
    problem = F.when(F.col("is_dir").isNull(), F.concat(F.lit("File does not exist: "), F.col("path"))).when(F.col("is_dir"), F.concat(F.lit("Path is not a file: "), F.col("path")))
    problem = problem.when(F.col("content").isNull(), F.lit(commands.NOT_CAPTURED))
    return checked(files.read_texts(held, argument("max_chars", "int", 20000)), problem, F.col("ok"), F.col("output"))


def list_answers(calls: DataFrame, captured: Captured) -> DataFrame:
    """Takes calls with path, may and is_dir; a directory without entries is empty."""
    listed = calls.withColumn("output", F.lit(None).cast("string"))
    if captured.entries is not None:
        entries = captured.entries.select("directory", "name", "is_dir").distinct()
        texts = files.listing_texts(entries, entries.select("directory").distinct())
        listed = calls.join(texts.withColumnRenamed("directory", "path"), "path", "left")
    problem = F.when(F.col("is_dir").isNull(), F.concat(F.lit("Path does not exist: "), F.col("path"))).when(~F.col("is_dir"), F.concat(F.lit("Path is not a directory: "), F.col("path")))
    return checked(listed, problem, F.lit(True), F.coalesce("output", F.lit("(empty directory)")))


def task_answers(calls: DataFrame) -> list[DataFrame]:
    """Task calls are a command log; its answers are joined to the calls by seq."""
    op = F.element_at(F.create_map(*[F.lit(x) for pair in (("create_task_queue", "create"), ("update_task_step", "update"), ("get_task_queue", "get"), ("list_task_queues", "list")) for x in pair]), F.col("tool"))
    log = calls.select(
        "seq", "ts", op.alias("op"), argument("queue_id").alias("queue_id"), argument("title").alias("title"), argument("steps", "array<string>").alias("steps"),
        argument("step_index", "int").alias("step_index"), argument("status").alias("status"), argument("note").alias("note"),
    )
    return [calls.select("call_id", "seq", "tool").join(tasks.command_outputs(log), "seq").select("call_id", "seq", "tool", "ok", "output")]
