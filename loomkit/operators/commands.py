"""Captured command results as text. Commands are never run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.paths import inside
from loomkit.functions.strings import clamped, is_approved, py_strip, truncated
from loomkit.policy import Policy

SHELL_OFF = "Shell command execution is disabled by AGENT_ENABLE_SHELL_COMMANDS."
NOT_CAPTURED = "Not captured."


def section(name: str, text: Column) -> Column:
    """A named section, or null for an empty one."""
    return F.when(text != "", F.concat(F.lit(f"{name}:\n"), text))


def formatted_result(exit_code: Column, stdout: Column, stderr: Column, max_chars: Column) -> Column:
    text = F.concat_ws("\n", F.concat(F.lit("exit_code: "), exit_code.cast("string")), section("stdout", stdout), section("stderr", stderr))
    return truncated(text, max_chars)


def formatted_timeout(seconds: Column, stdout: Column, stderr: Column, max_chars: Column) -> Column:
    """Output is cut before the notice goes in front. Captured bytes are shown as text."""
    ended = lambda name, text: F.coalesce(F.concat(section(name, text), F.lit("\n")), F.lit(""))
    body = truncated(F.concat(ended("stdout", stdout), ended("stderr", stderr)), max_chars)
    return py_strip(F.concat(F.lit("Command timed out after "), seconds.cast("string"), F.lit(" seconds.\n"), body))


def shell_reason(cwd: Column, root: Column) -> Column:
    outside = F.concat(F.lit("cwd is outside AGENT_WORKSPACE_ROOT="), root, F.lit(" and shell commands require approval"))
    return F.when(inside(cwd, root), F.lit("shell commands require explicit human approval")).otherwise(outside)


def command_outputs(results: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds `ok` and `output` to captured results (schemas.COMMAND_RESULT, with cwd and answer): checks first, then the
    result. Refused and timed-out commands aren't ok; one that ended is, whatever its exit code. A row without a
    result (cwd_exists or exit_code null where they are needed) wasn't captured."""
    if not policy.shell_enabled:
        return results.withColumn("ok", F.lit(False)).withColumn("output", F.lit(SHELL_OFF))
    c, root = F.col, F.lit(policy.root)
    seconds = clamped(c("timeout_seconds"), 1, 120)
    text = lambda name: F.coalesce(c(name), F.lit(""))
    said = lambda ok, message: F.struct(F.lit(ok).alias("ok"), message.alias("output"))
    outcome = (
        F.when(c("cwd_exists").isNull(), said(False, F.lit(NOT_CAPTURED)))
        .when(~c("cwd_exists"), said(False, F.concat(F.lit("Working directory does not exist: "), c("cwd"))))
        .when(~F.coalesce(c("cwd_is_dir"), F.lit(True)), said(False, F.concat(F.lit("Working directory is not a directory: "), c("cwd"))))
        .when(~is_approved(c("answer"), F.lit(policy.approval_enabled)), said(False, F.concat(F.lit("Shell command denied: "), shell_reason(c("cwd"), root))))
        .when(c("timed_out"), said(False, formatted_timeout(seconds, text("stdout"), text("stderr"), c("max_chars"))))
        .when(c("exit_code").isNull(), said(False, F.lit(NOT_CAPTURED)))
        .otherwise(said(True, formatted_result(c("exit_code"), text("stdout"), text("stderr"), c("max_chars"))))
    )
    return results.withColumn("outcome", outcome).select(*results.columns, "outcome.ok", "outcome.output")
