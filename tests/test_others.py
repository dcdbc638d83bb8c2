import json

from pyspark.sql import functions as F

from loomkit.functions import paths, strings
from loomkit.operators import commands, files, messages, settings
from loomkit.plans import sql
from loomkit.plans.dispatch import TOOLS, Captured, run_tool_calls
from loomkit.policy import Policy
from loomkit.sources.files import directory_entries, whole_files, write_text
from loomkit.streaming.chat import latest_states


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def test_strings(spark):
    t = f"{SPACES}a{SPACES}b​{SPACES}"
    assert one(spark, strings.py_strip(F.col("t")), t=t) == t.strip()
    assert one(spark, strings.collapse_space(F.col("t")), t=t) == " ".join(t.split())
    for lines in ("a\r\nb\rc\n", "a\x0bb\x85c d", "", "\n", "a\n\n"):
        assert one(spark, strings.split_lines(F.col("t")), t=lines) == lines.splitlines()
    cut = lambda n: one(spark, strings.truncated(F.col("t"), F.lit(n)), t="ab\U0001f600d")
    assert cut(3) == "ab\U0001f600\n\n[truncated after 3 characters]" and cut(4) == cut(0) == cut(-1) == "ab\U0001f600d"


def test_paths(spark):
    norm = lambda p: one(spark, paths.normalise(F.col("p"), "/w", "/home/u"), p=p)
    assert [norm(p) for p in ("a/../b", "~/x", "~", "/a//b/.", "../..", "//x", "", "a/./b", "~x", "...")] == ["/w/b", "/home/u/x", "/home/u", "/a/b", "/", "/x", "/w", "/w/a/b", "/w/~x", "/w/..."]
    assert [one(spark, paths.inside(F.lit(p), F.lit("/a"))) for p in ("/a/../b", "/a/b", "/a/.", "a", "/a/..b", "/a/..")] == [False, True, False, False, True, False]
    assert one(spark, paths.inside(F.lit("/a/bc"), F.lit("/a/b"))) is False


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("B.txt", b"x\r\ny"), ("a.txt", b"\xff"), ("b.txt", "é".encode())):
        (tmp_path / name).write_bytes(body)
    entries = directory_entries(spark, str(tmp_path), str(tmp_path / "sub"))
    asked = spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "sub"),)], "directory string")
    out = {r.directory: r.output for r in files.listing_texts(entries, asked).collect()}
    assert out == {str(tmp_path): "sub/\na.txt\nB.txt\nb.txt", str(tmp_path / "sub"): "(empty directory)"}
    texts = {r.path.rsplit("/", 1)[1]: r.output for r in files.read_texts(whole_files(spark, *(str(tmp_path / n) for n in ("B.txt", "a.txt", "b.txt")))).collect()}
    assert texts["B.txt"] == "x\ny" and texts["b.txt"] == "é" and texts["a.txt"].startswith("Could not decode as UTF-8 text file: ")
    target = str(tmp_path / "deep" / "er" / "out")
    for mode in ("overwrite", "append"):
        write_text(spark.createDataFrame([("l",)], "value string"), target, mode)
    assert [r.value for r in spark.read.text(target).collect()] == ["l", "l"]


def test_writes(spark):
    rows = [(1, "/w/a", "x", "overwrite", "yes"), (2, "/w/a", "y", "append", "YES "), (3, "/w/a", "z", "append", None), (4, "/w/b", "q", "append", "yes"), (5, "/o", "q", "append", "no"), (6, "/w/b", "q", "add", "yes")]
    df = spark.createDataFrame(rows, "seq long, path string, content string, mode string, answer string")
    assert {r.path: r.content for r in files.final_contents(df, "/w").collect()} == {"/w/a": "xy", "/w/b": "q"}
    out = {r.seq: r.output for r in files.write_outcomes(df, "/w").collect()}
    assert out[1] == "Wrote 1 characters to /w/a with mode=overwrite."
    assert out[5] == "Write denied: path is outside AGENT_WORKSPACE_ROOT=/w and write operations require approval"
    assert out[6] == "Invalid mode. Use overwrite or append."
    assert files.final_contents(df, "/w", approval_enabled=False).count() == 0


def test_messages(spark):
    cases = ['"a"', '["a", "", "b"]', '[{"text": "a"}, {"x": 1}, "b", 5]', "[]", '{"text": "t"}', '{"text": null}', '[{"text": null}, {"text": 3}, {"text": true}]', '{"a": [1, null]}', "null", "3.5", "not json", '[{"text": ""}]']
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string")
    got = [r.t for r in df.select(messages.flatten_content(F.col("c")).alias("t")).collect()]
    assert got == ["a", "a\nb", "a\nb", "", "t", "None", "None\n3\nTrue", "{'a': [1, None]}", "None", "3.5", "not json", "", None]
    assert got[:-1] == [messages.flattened(c) for c in cases]


def test_history_and_states(spark):
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [len(r.history) for r in messages.with_history(talk).orderBy("turn").collect()] == [1, 2]
    chunks = spark.createDataFrame([(1, 0, "values", None, "s0"), (1, 1, "messages", "AIMessageChunk", '"x"'), (1, 2, "messages", "ToolMessage", '"y"'), (1, 3, "values", None, "s1"), (2, 0, "messages", "AIMessageChunk", '""')], "conv_id long, seq long, mode string, type string, content string")
    assert {tuple(r) for r in messages.streamed_replies(chunks).collect()} == {(1, "x", "s1"), (2, "", None)}
    assert [tuple(r) for r in latest_states(chunks).collect()] == [(1, "s1")]


def test_chat_stream(spark, tmp_path):
    chunks = [(1, i, "messages", "AIMessageChunk", json.dumps(f"t{i}" if i % 2 else "")) for i in range(6)]
    spark.createDataFrame(chunks, "conv_id long, seq long, mode string, type string, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, seq long, mode string, type string, content string").parquet(str(tmp_path / "in"))
    query = messages.printed_chunks(stream).writeStream.format("memory").queryName("printed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.text for r in spark.table("printed").collect()) == ["t1", "t3", "t5"]


def test_settings(spark):
    kv = spark.createDataFrame([("a", "MODEL_PROVIDER", " Aliyun "), ("a", "MODEL_TEMPERATURE", "warm"), ("b", "MODEL_PROVIDER", "nobody")], "profile string, key string, value string")
    out = {r.profile: r for r in settings.routed(settings.settings_from_rows(kv)).collect()}
    assert (out["a"].client, out["a"].model, out["a"].base_url, out["a"].model_temperature) == ("openai-compatible", "qwen-plus", settings.HOSTED_URL, None)
    assert out["b"].error.startswith("Unsupported MODEL_PROVIDER='nobody'. Supported providers: openai,") and out["b"].model is None
    assert out["a"].agent_enable_human_approval is True


def test_policy():
    p = Policy.from_env({"AGENT_WORKSPACE_ROOT": "/tmp", "AGENT_ENABLE_SHELL_COMMANDS": " Off", "AGENT_ENABLE_WEB_SEARCH": "ON "})
    assert (p.shell_enabled, p.search_enabled, p.browser_enabled) == (False, True, True)


def test_long_runs_of_spaces(spark):
    t = " " * 500_000 + "a" + " " * 500_000 + "b" + "\u2003" * 500_000
    assert one(spark, strings.py_strip(F.col("t")), t=t) == t.strip()
    assert one(spark, strings.collapse_space(F.col("t")), t=t) == "a b"


def test_commands_off(spark):
    df = spark.createDataFrame([("c",)], "command string")
    assert commands.command_outputs(df, Policy(shell_enabled=False)).first().output == commands.SHELL_OFF


def test_dispatch(spark):
    page = spark.createDataFrame([("https://h.org", "<title>T</title><a href='/x'>X</a>", "text/html")], "url string, html string, content_type string")
    hits = spark.createDataFrame([("q", "<a class='result-link' href='https://e.org'>E</a>")], "query string, html string")
    held = spark.createDataFrame([("/w/f", b"abc")], "path string, content binary")
    entries = spark.createDataFrame([("/w", "f", False)], "directory string, name string, is_dir boolean")
    ran = spark.createDataFrame([("ls", "/w", True, True, 0, "f", "", False, "yes")], "command string, cwd string, cwd_exists boolean, cwd_is_dir boolean, exit_code int, stdout string, stderr string, timed_out boolean, answer string")
    calls = [
        ("calculator", {"expression": "2**3"}), ("current_time", {}), ("configured_provider", {}), ("list_local_directory", {"path": "/w"}), ("read_local_file", {"path": "/w/f", "max_chars": 2}),
        ("write_local_file", {"path": "/w/g", "content": "hey", "answer": "yes"}), ("execute_shell_command", {"command": "ls", "cwd": "/w"}), ("web_search", {"query": "q"}), ("open_web_page", {"url": "https://h.org"}),
        ("list_web_page_links", {"url": "https://h.org"}), ("create_task_queue", {"title": "t", "steps": ["s"], "queue_id": "k"}), ("update_task_step", {"queue_id": "k", "step_index": 1, "status": "completed"}),
        ("get_task_queue", {"queue_id": "k"}), ("list_task_queues", {}), ("nothing", {}), ("open_web_page", {"url": "https://gone.org"}), ("calculator", None),
    ]
    df = spark.createDataFrame([(i, i, t, None if a is None else json.dumps(a)) for i, (t, a) in enumerate(calls)], "call_id long, seq long, tool string, args string")
    out = {r.call_id: (r.ok, r.output) for r in run_tool_calls(df, Captured(page, hits, held, entries, ran), Policy(root="/w"), provider="p").collect()}
    assert [t for t, _ in calls[:14]] == TOOLS and len(out) == len(calls)
    assert out[0] == (True, "8") and out[2] == (True, "p") and out[3] == (True, "f") and out[4] == (True, "ab\n\n[truncated after 2 characters]")
    assert out[5] == (True, "Wrote 3 characters to /w/g with mode=overwrite.") and out[6] == (True, "exit_code: 0\nstdout:\nf")
    assert out[7][1] == "Search results for: q\n1. E\n   https://e.org" and out[9][1] == "Links found on https://h.org:\n1. X\n   https://h.org/x"
    assert out[8][1] == "URL: https://h.org\nTitle: T\n\nX"
    assert out[12][1].endswith("\n1. [completed] s") and out[13][1] == "k: t (1/1 completed)"
    assert out[14] == (False, "Unknown tool: nothing") and out[15] == (False, "Browser open error: Not captured.") and out[16][0] is False


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT calculate('1+1').display AS a, parse_page('https://h.org', '<title>T</title>').title AS b, flatten_content('\"x\"') AS c").first()
    assert tuple(r) == ("2", "T", "x")
    rows = spark.sql("SELECT l.* FROM VALUES ('https://h.org', '<a href=\"/x\">X</a>') AS p(url, html), LATERAL page_links(p.url, p.html) AS l").collect()
    assert [tuple(x) for x in rows] == [(1, "X", "https://h.org/x")]


def test_urls_and_environment(spark):
    import urllib.parse

    from loomkit.operators import search

    t = "a b&c=~*é/%+-_."
    assert one(spark, strings.quote_plus(F.col("t")), t=t) == urllib.parse.quote_plus(t)
    assert one(spark, search.search_url(F.lit("x y"))).endswith("?q=x+y")
    assert [one(spark, search.fetch_timeout(F.lit(n))) for n in (0, 12, 99)] == [1, 12, 30]
    s = settings.settings_from_env(spark, {"MODEL_PROVIDER": " OpenAI ", "DASHSCOPE_API_KEY": "k"}).first()
    assert (s.model_provider, s.openai_compatible_api_key, s.model_temperature, s.agent_enable_browser_tools) == ("openai", "k", 0.2, True)
