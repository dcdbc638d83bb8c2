"""Types of the library's rows; readers and writers declare them and never infer."""

from __future__ import annotations

LINK = "struct<label:string,href:string>"
PAGE = f"struct<title:string,text:string,links:array<{LINK}>>"
RESULTS = "array<struct<title:string,url:string>>"
ARITHMETIC = "struct<ok:boolean,value:string,number:double,display:string>"
STEP = "struct<description:string,status:string,note:string>"
POLICY = "struct<allowed:boolean,message:string>"
TASK_COMMAND = "seq long, ts timestamp, op string, queue_id string, title string, steps array<string>, step_index int, status string, note string"
COMMAND_RESULT = "command string, cwd_exists boolean, cwd_is_dir boolean, exit_code int, stdout string, stderr string, timed_out boolean, timeout_seconds int, max_chars int"
DIRECTORY_ENTRY = "directory string, name string, is_dir boolean"
STREAM_CHUNK = "conv_id long, seq long, mode string, type string, content string"
TOOL_CALL = "call_id long, seq long, tool string, args string"
SETTINGS = (
    "model_provider string, model_temperature double, openai_model string, google_model string, anthropic_model string, "
    "openai_compatible_api_key string, openai_compatible_base_url string, openai_compatible_model string, agent_workspace_root string, "
    "agent_enable_human_approval boolean, agent_enable_shell_commands boolean, agent_enable_web_search boolean, agent_enable_browser_tools boolean"
)
