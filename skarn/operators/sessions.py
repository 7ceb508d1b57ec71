"""Session events: derived from tool calls, gathered in snapshots and guides, read for intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priority and category of event types, and the tools that tell an intent.
EVENTS = {
    "file_read": (1, "files"), "file_edit": (1, "files"), "file_write": (1, "files"), "task_create": (1, "tasks"), "task_update": (1, "tasks"),
    "task_complete": (1, "tasks"), "user_prompt": (1, "context"), "plan_enter": (1, "context"), "plan_exit": (1, "context"), "git_commit": (2, "git"),
    "git_checkout": (2, "git"), "git_merge": (2, "git"), "git_push": (2, "git"), "git_pull": (2, "git"), "git_diff": (2, "git"), "git_status": (2, "git"),
    "error": (2, "errors"), "error_fix": (2, "errors"), "constraint": (2, "context"), "blocker": (2, "context"), "mcp_tool_use": (3, "tools"),
    "subagent_complete": (3, "tools"), "env_change": (3, "environment"),
}
INTENT_TOOLS = {
    "reviewing": ["detect_changes", "get_review_context", "get_affected_flows", "get_impact_radius"],
    "debugging": ["query_graph", "get_flow", "semantic_search_nodes"],
    "refactoring": ["refactor", "find_dead_code", "suggest_refactorings"],
    "exploring": ["list_flows", "list_communities", "get_architecture_overview", "list_graph_stats"],
}
GIT_KINDS = ["commit", "checkout", "merge", "push", "pull", "diff", "status"]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match; an empty text if there is none."""
    return F.coalesce(F.regexp_extract(text, pattern, group), F.lit(""))


def _lines(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?m)" + pattern)).cast("string")


def shell_events(calls: DataFrame) -> DataFrame:
    """(call_id, event_type, priority, category, data) of shell calls (call_id, command, stdout, stderr, exit_code).

    A failed call gives an error; a version-control command its kind with what its texts tell; a
    command that prints a file a file_read; and each call a mcp_tool_use.  data is a map of texts.
    """
    cmd, out = F.btrim("command"), F.coalesce("stdout", F.lit(""))
    fields = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    remote, branch = _found(cmd, r"push\s+(\S+)(?:\s+(\S+))?"), _found(cmd, r"push\s+(\S+)(?:\s+(\S+))?", 2)
    data = {
        "commit": fields(hash=_found(out, r"\[[\w/]+\s+([a-f0-9]{7,})\]"), message=F.substring(_found(out, r"\]\s+(.+)"), 1, 200), command=F.substring(cmd, 1, 200)),
        "checkout": fields(branch=_found(cmd, r"(?:checkout|switch)\s+(?:-b\s+)?(\S+)")),
        "merge": fields(branch=_found(cmd, r"merge\s+(\S+)"), result=F.when(out.contains("CONFLICT"), "conflict").otherwise("clean")),
        "push": fields(remote=F.when(remote == "", "origin").otherwise(remote), branch=branch),
        "pull": fields(remote=F.when(_found(cmd, r"pull\s+(\S+)") == "", "origin").otherwise(_found(cmd, r"pull\s+(\S+)")), branch=_found(cmd, r"pull\s+(\S+)(?:\s+(\S+))?", 2)),
        "diff": fields(file_count=F.size(F.array_distinct(F.regexp_extract_all(out, F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1)))).cast("string"), insertions=_lines(out, r"^\+"), deletions=_lines(out, "^-")),
        "status": fields(modified=_lines(out, r"^\s*M\s"), added=_lines(out, r"^\s*A\s"), deleted=_lines(out, r"^\s*D\s"), untracked=_lines(out, r"^\?\?\s")),
    }
    event = lambda kind, values: F.struct(F.lit(kind).alias("event_type"), values.alias("data"))
    failed = F.when(F.col("exit_code") != 0, event("error", fields(command=F.substring(cmd, 1, 200), exit_code=F.col("exit_code").cast("string"), stderr=F.substring(F.coalesce("stderr", F.lit("")), 1, 500))))
    read = cmd.rlike(r"^(cat|less|head|tail|bat|more)\s+")
    told = F.when(read, event("file_read", fields(file_path=F.regexp_replace(F.btrim(F.regexp_extract(cmd, r"^\S+\s+(.*)$", 1)), r"^['\"]+|['\"]+$", ""))))
    for kind in reversed(GIT_KINDS):
        told = F.when(cmd.rlike(rf"^git\s+{kind}\b"), event("git_" + kind, data[kind])).otherwise(told)
    used = event("mcp_tool_use", fields(tool_name=F.lit("Bash")))
    rows = calls.select("call_id", F.explode(F.array_compact(F.array(failed, told, used))).alias("e")).select("call_id", "e.*")
    return with_priority(rows)


def with_priority(rows: DataFrame) -> DataFrame:
    """Events (event_type) with their priority and category; unknown types are normal and general."""
    priority = F.create_map(*[F.lit(x) for k, v in EVENTS.items() for x in (k, v[0])])[F.col("event_type")]
    category = F.create_map(*[F.lit(x) for k, v in EVENTS.items() for x in (k, v[1])])[F.col("event_type")]
    return rows.withColumns({"priority": F.coalesce(priority, F.lit(3)), "category": F.coalesce(category, F.lit("general"))})


def edit_events(edits: DataFrame) -> DataFrame:
    """(call_id, event_type, data) of file edits (call_id, file_path, old, new): lines more and less."""
    breaks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    more = breaks("new") - breaks("old")
    text = lambda x: x.cast("string")
    data = F.create_map(
        F.lit("file_path"), F.col("file_path"), F.lit("lines_changed"), text(F.abs(more)), F.lit("lines_added"), text(F.greatest(more, F.lit(0))),
        F.lit("lines_removed"), text(F.abs(F.least(more, F.lit(0)))),
    )
    return edits.select("call_id", F.lit("file_edit").alias("event_type"), data.alias("data"))


def intents(calls: DataFrame, last: int = 10) -> DataFrame:
    """What each session is up to: the intent that most of its last tool calls (session_id, at, tool) tell, exploring if none does.

    Of equal counts the first in the order of INTENT_TOOLS counts.
    """
    order = Window.partitionBy("session_id").orderBy(F.desc("at"))
    recent = calls.withColumn("place", F.row_number().over(order)).where(F.col("place") <= last)
    counts = [F.count_if(F.col("tool").isin(tools)).alias(intent) for intent, tools in INTENT_TOOLS.items()]
    scores = recent.groupBy("session_id").agg(*counts)
    most = F.greatest(*INTENT_TOOLS)
    out = F.lit("exploring")
    for intent in reversed(INTENT_TOOLS):
        out = F.when(F.col(intent) == most, intent).otherwise(out)
    return scores.select("session_id", F.when(most == 0, "exploring").otherwise(out).alias("intent"))


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def _last(events: DataFrame, rule: Column, n: int, keep: str | None = None) -> DataFrame:
    """Each session's last n events of a rule (the last of each `keep`, if given), with their place from the end."""
    rows = events.where(rule)
    newest = [F.desc("created_at"), F.desc("id")]
    if keep:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("session_id", keep).orderBy(*newest))).where("k = 1").drop("k")
    return rows.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(*newest))).where(F.col("back") <= n)


def _section(rows: DataFrame, tier: int, tag: str, line: Column, newest_first: bool) -> DataFrame:
    """(session_id, tier, section): lines of a session between tags, a section a session."""
    at = F.col("back") if newest_first else -F.col("back")
    lines = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line")))).alias("x"))
    body = F.concat(F.lit(f"  <{tag}>\n"), F.array_join("x.line", "\n"), F.lit(f"\n  </{tag}>\n"))
    return lines.select("session_id", F.lit(tier).alias("tier"), body.alias("section"))


def snapshots(events: DataFrame, most: int = 2_048) -> DataFrame:
    """(session_id, snapshot, n_bytes): the session's sections in the order of their importance, within a number of bytes.

    Events are (id, session_id, event_type, text, created_at).  Sections: the last prompt, the last
    five errors, the last file of each name, the last ten version-control events, and tool counts.
    The first section that does not fit is cut at a line and marked, and later ones are left out.
    """
    said = xml_escaped(F.substring("text", 1, 200))
    e = with_priority(events)
    prompt = _last(e, F.col("event_type") == "user_prompt", 1).select("session_id", F.lit(1).alias("tier"), F.concat(F.lit("  <last-prompt>"), xml_escaped(F.substring("text", 1, 500)), F.lit("</last-prompt>\n")).alias("section"))
    errors = _section(_last(e, F.col("event_type") == "error", 5), 2, "errors", F.concat(F.lit("    <unresolved>"), said, F.lit("</unresolved>")), False)
    files = _section(_last(e, F.col("event_type").isin("file_edit", "file_write"), 1 << 30, "text"), 3, "files-modified", F.concat(F.lit("    <file>"), said, F.lit("</file>")), True)
    git = _section(_last(e, F.col("category") == "git", 10), 4, "git-ops", F.concat(F.lit("    <op>"), said, F.lit("</op>")), False)
    counts = e.where(F.col("event_type") == "mcp_tool_use").groupBy("session_id", "text").agg(F.count("*").alias("n"))
    used = counts.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "text")))
    tools = _section(used, 5, "tools", F.concat(F.lit('    <tool name="'), said, F.lit('" calls="'), F.col("n").cast("string"), F.lit('"/>')), True)
    parts = prompt.unionByName(errors).unionByName(files).unionByName(git).unionByName(tools)
    head, tail = "<session-snapshot>\n", "</session-snapshot>\n"
    room = most - len(head) - len(tail)
    before = F.coalesce(F.sum(F.octet_length("section")).over(Window.partitionBy("session_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("left", F.lit(room) - before)
    fits = F.octet_length("section") <= F.col("left")
    # The first that does not fit has room left when all before it fitted; $ would match before a last line break too.
    cut = F.regexp_replace(F.decode(F.substring(F.encode("section", "UTF-8"), F.lit(1), F.col("left") - 15), "UTF-8"), r"\n[^\n]*\z", "")
    shown = F.when(fits, F.col("section")).when(F.col("left") > 20, F.concat(cut, F.lit("\n  <!-- truncated -->\n"))).otherwise("")
    whole = rows.withColumn("shown", shown).where(F.col("left") > 0)
    text = whole.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("tier", "shown"))).alias("x"))
    snapshot = F.concat(F.lit(head), F.array_join("x.shown", ""), F.lit(tail))
    sessions = events.select("session_id").distinct().join(text.select("session_id", snapshot.alias("s")), "session_id", "left")
    out = F.coalesce("s", F.lit(head + tail))
    return sessions.select("session_id", out.alias("snapshot"), F.octet_length(out).alias("n_bytes"))


def open_errors(events: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, back, text): each session's last n errors (event_type error, text) without a fix (error_fix) of the same text in it."""
    fixed = events.where(F.col("event_type") == "error_fix").select("session_id", "text").distinct()
    left = events.where(F.col("event_type") == "error").join(fixed, ["session_id", "text"], "left_anti")
    return _last(left, F.lit(True), n).select("session_id", "back", "text")


def last_tools(calls: DataFrame, n: int = 100) -> DataFrame:
    """(session_id, tools): each session's last n tools (session_id, at, tool), oldest first, joined by blanks."""
    order = Window.partitionBy("session_id").orderBy(F.desc("at"))
    some = calls.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)
    listed = some.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "tool"))).alias("x"))
    return listed.select("session_id", F.array_join("x.tool", " ").alias("tools"))


def unexpired(rows: DataFrame, as_of: str, seconds: int, at: str = "created_at") -> DataFrame:
    """Rows made within so many seconds before a time."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return rows.where(age.between(0, seconds))
