"""Recorded transcripts: Markdown of role blocks with tool blocks, as messages, events and a rendered view.

A recording is one row (raw_id, text). Nothing is null after parsing: a null text is an empty one, which
has no blocks. CRLF and CR count as line ends. Rows are told apart by raw_id, which names one recording;
repeated rows of one raw_id parse as two copies of the same blocks. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.operators.transcripts import redacted
from notewell.sources.scratch import Scratch

# The format of recordings, and what marks a failed tool call.
USER, ASSISTANT = "👤 User", "🤖 Assistant"
HEADING = r"## (👤 User|🤖 Assistant|⚙️ System)(?: — [0-9: \-]+)?(?: · .+)?"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n"
DETAILS = r"(?s)<details><summary>(.*?)</summary>\n(.*?)\n</details>"
THINKING = r"(?s)<details><summary>💭.*?</summary>.*?</details>"
FENCED = r"(?s)\A(`{3,})[^\n]*\n(.*?)\n\1\s*\z"
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"
RUNTIME = r"(?s)<(recommended_plugins|environment_context|INSTRUCTIONS|user_instructions|plugins|available_tools|command-message|command-name)>.*?</\1>"
ENVELOPE = r"(?dm)^Message Type: \w+\n(?:Task name: .*\n|Sender: .*\n|Payload:[ \t]*\n?)*"
ARGUMENTS = r"</?command-args>"
ERROR, RESULT = "**Erreur**", "**Résultat** :"
FAILED = r"Traceback \(most recent call last\)|command not found|Permission denied|No such file|fatal:|ERROR|Exception"
FAILED_TOO = (
    r"n[’']est pas reconnu|is not recognized as|not found on PATH|CommandNotFoundException"
    r"|Access is denied|Accès refusé|\bintrouvable\b|Impossible de (?:trouver|charger|se connecter)"
    r"|(?im:^\s*(?:error|erreur)\s*[:\[])"
    r"|(?i:\bexit (?:code|status))[ :=]+[1-9]|returned non-zero exit status"
    r"|Connection refused|\[31;1m"
)
LOW_SIGNAL = ("read", "glob", "grep", "ls", "find", "cat", "head", "tail", "todowrite", "listmcpresources", "notebookread", "webfetch", "websearch", "toolsearch")
RESUMED = "reprise réussie après l'échec précédent"
TRUNCATED = "\n[… message tronqué …]"
TITLE, SUMMARY, EVENTS = "# Conversation", "# Résumé des appels d'outils (calculé, non déclaratif)", "# Technical events relevant to analysis"

MESSAGE_CHARS, EVENT_CHARS, TRACE_LINES, SUMMARY_ERRORS, SUMMARY_LINE = 6000, 400, 12, 6, 160
SPACES = " \t\n\r\f\x0b"


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def after(x: Column, mark: str) -> Column:
    """What follows the first ``mark``, or all of ``x``."""
    at = F.instr(x, mark)
    return F.when(at > 0, F.substring(x, at + len(mark), F.length(x))).otherwise(x)


def clean_prose(x: Column) -> Column:
    """Text without thinking, reminders, runtime blocks, envelopes, argument tags and tool blocks."""
    for pattern in (THINKING, REMINDER, RUNTIME, ENVELOPE, ARGUMENTS, DETAILS):
        x = F.regexp_replace(x, pattern, "")
    return stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def is_error(body: Column) -> Column:
    """Whether a tool block failed: it says so, or its result holds a failure's marks."""
    result = F.when(F.instr(body, RESULT) > 0, after(body, RESULT)).otherwise("")
    return F.contains(body, F.lit(ERROR)) | result.rlike(FAILED) | result.rlike(FAILED_TOO)


def fence_body(x: Column) -> Column:
    x = stripped(x)
    return F.when(x.rlike(FENCED), F.regexp_extract(x, FENCED, 2)).otherwise(x)


def truncated_trace(x: Column) -> Column:
    """At most 12 lines with text (the first 8, a count, the last 3) and 400 characters."""
    lines = F.filter(F.split(x, "\n"), lambda line: stripped(line) != "")
    n, head, tail = F.size(lines), TRACE_LINES - 4, 3
    middle = F.array(F.concat(F.lit("[… "), (n - head - tail).cast("string"), F.lit(" lignes omises …]")))
    cut = F.when(n <= TRACE_LINES, lines).otherwise(F.concat(F.slice(lines, 1, head), middle, F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), tail)))
    out = F.array_join(cut, "\n")
    return F.when(F.length(out) > EVENT_CHARS, F.concat(F.substring(out, 1, EVENT_CHARS), F.lit(" […]"))).otherwise(out)


def first_line(x: Column) -> Column:
    line = F.coalesce(F.get(F.filter(F.transform(F.split(x, "\n"), stripped), lambda part: part != ""), F.lit(0)), F.lit(""))
    line = F.regexp_replace(line, r"\[\d+(?:;\d+)*m", "")
    return F.when(F.length(line) > SUMMARY_LINE, F.concat(F.substring(line, 1, SUMMARY_LINE), F.lit(" […]"))).otherwise(line)


def body_of(text: Column) -> Column:
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(folded, FRONTMATTER, "")


def blocks(raws: DataFrame) -> DataFrame:
    """(raw_id, title, block, role, chunk) of each user and assistant block, in order; system blocks go."""
    body = raws.select("raw_id", body_of(F.col("text")).alias("body"))
    title = stripped(F.regexp_extract("body", r"(?dm)^# (.*)$", 1))
    parts = body.select("raw_id", title.alias("title"), F.posexplode(F.split("body", rf"(?dm)^(?={HEADING}$)")).alias("block", "part"))
    found = parts.select("raw_id", "title", "block", F.regexp_extract("part", rf"\A{HEADING}(?=\n|\z)", 1).alias("heading"), "part")
    role = F.when(F.col("heading") == USER, "User").when(F.col("heading") == ASSISTANT, "Assistant")
    lines = F.filter(F.split(F.regexp_replace("part", r"\A[^\n]*\n?", ""), "\n"), lambda line: ~line.startswith("# "))
    return found.select("raw_id", "title", "block", role.alias("role"), F.array_join(lines, "\n").alias("chunk")).where("role IS NOT NULL")


def recorded_messages(held: DataFrame) -> DataFrame:
    """(raw_id, block, role, text) of the blocks that say something; over 6,000 characters are cut, and say so."""
    text = F.col("prose")
    cut = F.when(F.length(text) > MESSAGE_CHARS, F.concat(F.substring(text, 1, MESSAGE_CHARS), F.lit(TRUNCATED))).otherwise(text)
    return held.select("raw_id", "block", "role", clean_prose(F.col("chunk")).alias("prose")).where("prose <> ''").select("raw_id", "block", "role", cut.alias("text"))


def tool_calls(held: DataFrame) -> DataFrame:
    """(raw_id, block, place, tool, body, is_error) of every tool block, thinking excepted."""
    pairs = F.arrays_zip(F.regexp_extract_all("chunk", F.lit(DETAILS), F.lit(1)).alias("summary"), F.regexp_extract_all("chunk", F.lit(DETAILS), F.lit(2)).alias("body"))
    called = held.where(F.contains("chunk", F.lit("<details>"))).select("raw_id", "block", F.posexplode(pairs).alias("place", "call"))
    called = called.select("raw_id", "block", "place", F.col("call.summary").alias("summary"), F.col("call.body").alias("body")).where(~F.col("summary").startswith("💭"))
    named = F.regexp_extract("summary", r"🔧\s*(.+)", 1)
    tool = stripped(F.when(named != "", named).otherwise(F.col("summary")))
    return called.select("raw_id", "block", "place", tool.alias("tool"), "body", is_error(F.col("body")).alias("is_error"))


def recorded_events(calls: DataFrame) -> DataFrame:
    """(raw_id, block, place, tool, is_error, detail): failures, and each tool's first success after one.

    A success of a low-signal tool is never an event. Windows sort by (raw_id, tool) and spill.
    """
    before = F.lag("is_error").over(Window.partitionBy("raw_id", "tool").orderBy("block", "place"))
    kept = calls.withColumn("failed", F.coalesce(before, F.lit(False))).where(F.col("is_error") | (F.col("failed") & ~F.lower("tool").isin(*LOW_SIGNAL)))
    payload = after(after(F.col("body"), f"{ERROR} :"), RESULT)
    detail = F.when(F.col("is_error"), truncated_trace(fence_body(payload))).otherwise(RESUMED)
    return kept.select("raw_id", "block", "place", "tool", "is_error", detail.alias("detail"))


def _summary(calls: DataFrame, events: DataFrame) -> DataFrame:
    """(raw_id, summary): counts, failing tools, up to six different failures, the last call."""
    by_tool = calls.groupBy("raw_id", "tool").agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("failed"), F.max(F.struct("block", "place", "is_error")).alias("last")
    )
    failing = F.array_sort(F.collect_list(F.when(F.col("failed") > 0, F.struct((-F.col("failed")).alias("less"), "tool"))))
    last = F.max(F.struct("last.block", "last.place", "tool", F.col("last.is_error").alias("bad")))
    totals = by_tool.groupBy("raw_id").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), failing.alias("failing"), last.alias("last"))
    said = events.where("is_error").withColumn("line", first_line(F.col("detail"))).where("line <> ''")
    said = said.groupBy("raw_id", "line").agg(F.min(F.struct("block", "place", "tool")).alias("at"))
    order = Window.partitionBy("raw_id").orderBy("at.block", "at.place")
    said = said.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SUMMARY_ERRORS)
    said = said.groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("- échec "), "at.tool", F.lit(" — "), "line").alias("line")))).alias("said"))
    resumed = events.groupBy("raw_id").agg(F.count_if(~F.col("is_error")).alias("resumed"))
    held = totals.join(said, "raw_id", "left").join(resumed, "raw_id", "left")
    names = F.array_join(F.transform("failing", lambda f: F.concat(f["tool"], F.lit(" ×"), (-f["less"]).cast("string"))), ", ")
    resumed_n = F.coalesce("resumed", F.lit(0)).cast("string")
    lines = F.concat(
        F.array(F.lit(SUMMARY), F.lit(""), F.concat(F.lit("- appels : "), F.col("n").cast("string"), F.lit(" ; en échec : "), F.col("failed").cast("string"), F.lit(" ; reprises réussies après échec : "), resumed_n)),
        F.when(F.size("failing") > 0, F.array(F.concat(F.lit("- outils en échec : "), names))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("said", lambda s: s["line"]), F.array().cast("array<string>")),
        F.array(F.concat(F.lit("- dernier appel d'outil : "), "last.tool", F.lit(" — "), F.when(F.col("last.bad"), "échec").otherwise("succès")), F.lit("")),
    )
    return held.select("raw_id", F.array_join(lines, "\n").alias("summary"))


def rendered(raws: DataFrame) -> DataFrame:
    """(raw_id, markdown): title, summary of tool calls, messages, events; redacted. A row per recording.

    Parts regroup by raw_id, so a group is no larger than the row that it came from. Recordings are made, and
    parsed, once: blocks, calls and events are written for the six readings that follow.
    """
    space = Scratch(raws.sparkSession)
    raws = space.save(raws.select("raw_id", "text"), "raws")
    held = space.save(blocks(raws), "blocks")
    calls = space.save(tool_calls(held), "calls")
    events = space.save(recorded_events(calls), "events")
    texts = recorded_messages(held).groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("block", F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n")).alias("part")))).alias("m"))
    label = F.when(F.col("is_error"), "erreur").otherwise("suite")
    line = F.concat(F.lit("- outil "), "tool", F.lit(" — "), label, F.lit(" : "), F.replace("detail", F.lit("\n"), F.lit("\n  ")))
    facts = events.groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("block", "place", line.alias("part")))).alias("e"))
    titled = raws.select("raw_id", stripped(F.regexp_extract(body_of(F.col("text")), r"(?dm)^# (.*)$", 1)).alias("title"))
    joined = titled.join(_summary(calls, events), "raw_id", "left").join(texts, "raw_id", "left").join(facts, "raw_id", "left")
    head = F.when(F.col("title") != "", F.concat(F.lit(f"{TITLE} — "), "title")).otherwise(TITLE)
    told = F.array_join(F.transform("e", lambda x: x["part"]), "\n")
    parts = F.concat_ws("\n", head, F.lit(""), "summary", F.array_join(F.transform("m", lambda x: x["part"]), "\n"), F.when(told.isNotNull(), F.concat(F.lit(f"{EVENTS}\n\n"), told)))
    return joined.select("raw_id", redacted(F.concat(F.rtrim(F.regexp_replace(parts, r"\s+\z", "")), F.lit("\n")), extra=False).alias("markdown"))
