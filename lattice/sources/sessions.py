"""Assistant chat logs: line-delimited JSON to session nodes, file edges and summaries, in aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions.strings import project_of_dashed, relative_path

# The tools that name a file, where, and what it means; line kinds that are skipped; limits of the summary.
TOOLS = {"Read": ("file_path", "TOUCHED"), "Edit": ("file_path", "EDITED"), "Write": ("file_path", "CREATED"), "Grep": ("path", "TOUCHED"), "Glob": ("path", "TOUCHED")}
SKIPPED = ("progress", "file-history-snapshot")
PRIORITY = {"TOUCHED": 1, "EDITED": 2, "CREATED": 3}
PROMPT_MOST, TEXT_MOST, THINKING_MOST, SUMMARY_MOST = 300, 200, 100, 2000
LINE = "type STRING, subtype STRING, cwd STRING, timestamp STRING, gitBranch STRING, slug STRING, durationMs BIGINT, message STRUCT<model: STRING, content: STRING>"
_BLOCKS = "ARRAY<STRUCT<type: STRING, text: STRING, thinking: STRING, name: STRING, input: STRUCT<file_path: STRING, path: STRING>>>"


def read_lines(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """session_id, dir, line_no and line of every log below ``root`` (directory/session.jsonl), whole files in order.

    ``project`` keeps directories whose name holds it, whatever the case.
    """
    f = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("p"), "value")
    parts = F.split("p", "/")
    out = f.select(F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("session_id"), F.element_at(parts, -2).alias("dir"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return out if project is None else out.where(F.contains(F.lower("dir"), F.lit(project.lower())))


def parse(lines: DataFrame) -> DataFrame:
    """One row for each line that is JSON and not skipped, with its content as text or blocks."""
    x = lines.where(F.trim("line") != "").withColumn("j", F.from_json("line", LINE)).where(F.col("j").isNotNull() & (F.try_parse_json("line").isNotNull()))
    x = x.where(~F.coalesce(F.col("j.type"), F.lit("")).isin(*SKIPPED))
    content = F.col("j.message.content")
    blocks = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, _BLOCKS))
    own = F.get_json_object("line", "$.message.content")
    return x.select("session_id", "dir", "line_no", "j.*", own.alias("content"), blocks.alias("blocks"))


def _first(c: str) -> Column:
    return F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("line_no", F.col(c).alias("v"))))["v"]


def _said(text: Column) -> Column:
    """A prompt of a person: neither a marker nor a few characters."""
    return ~F.startswith(text, F.lit("<")) & (F.length(text) > 5)


def _spoken(rows: DataFrame) -> DataFrame:
    """prompt, text, thinking and tool events in order: session_id, line_no, at, what, value, path."""
    plain = rows.where((F.col("type") == "user") & F.col("blocks").isNull() & F.col("content").isNotNull()).select("session_id", "dir", "line_no", F.lit(0).alias("at"), F.lit("prompt").alias("what"), F.col("content").alias("value"), F.lit(None).cast("string").alias("path"))
    b = rows.where(F.col("blocks").isNotNull()).select("session_id", "dir", "line_no", "type", F.posexplode("blocks").alias("at", "b"))
    table = F.create_map(*[F.lit(x) for k, (key, _) in TOOLS.items() for x in (k, key)])
    path = F.when(F.get(F.array(table[F.col("b.name")]), F.lit(0)) == "file_path", F.col("b.input.file_path")).when(table[F.col("b.name")] == "path", F.col("b.input.path"))
    kind, text = F.col("type"), F.col("b.text")
    what = F.when((kind == "user") & (F.col("b.type") == "text"), "prompt").when((kind == "assistant") & (F.col("b.type") == "tool_use"), "tool").when((kind == "assistant") & (F.col("b.type") == "text"), "text").when((kind == "assistant") & (F.col("b.type") == "thinking"), "thinking")
    value = F.when(what == "tool", F.col("b.name")).when(what == "thinking", F.col("b.thinking")).otherwise(text)
    deep = b.select("session_id", "dir", "line_no", "at", what.alias("what"), value.alias("value"), F.when(what == "tool", path).alias("path")).where(F.col("what").isNotNull())
    both = plain.unionByName(deep)
    return both.where(((F.col("what") != "prompt") | _said(F.col("value"))) & (~F.col("what").isin("text", "thinking") | (F.length("value") > 10)))


def sessions(rows: DataFrame) -> DataFrame:
    """Session nodes: the first values that are not empty, first and last times in file order, sums and counts; sessions of no prompt and no tool are left out."""
    meta = rows.groupBy("session_id", "dir").agg(
        _first("cwd").alias("project_path"), _first("timestamp").alias("started_at"), F.max(F.when(F.coalesce("timestamp", F.lit("")) != "", F.struct("line_no", F.col("timestamp").alias("v"))))["v"].alias("ended_at"),
        F.coalesce(F.sum(F.when((F.col("type") == "system") & (F.col("subtype") == "turn_duration"), F.col("durationMs"))), F.lit(0)).alias("duration_ms"),
        F.min(F.when((F.col("type") == "assistant") & (F.coalesce("message.model", F.lit("")) != ""), F.struct("line_no", F.col("message.model").alias("v"))))["v"].alias("model"), _first("gitBranch").alias("git_branch"), _first("slug").alias("slug"),
    )
    n = _spoken(rows).groupBy("session_id").agg(F.count_if(F.col("what") == "prompt").alias("user_prompts"), F.count_if(F.col("what") == "tool").alias("tool_uses")).where((F.col("user_prompts") > 0) | (F.col("tool_uses") > 0))
    out = meta.join(n, "session_id")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select(F.col("session_id").alias("id"), "session_id", project_of_dashed(F.col("dir")).alias("project_name"), text("project_path"), text("started_at"), text("ended_at"), "duration_ms", "user_prompts", "tool_uses", text("model"), text("git_branch"), text("slug"))


def file_actions(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """session_id, path, project, action, count: the strongest action on a file and how many there were; first_at orders them."""
    table = F.create_map(*[F.lit(x) for k, (_, a) in TOOLS.items() for x in (k, a)])
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    t = _spoken(rows).where((F.col("what") == "tool") & (F.coalesce("path", F.lit("")) != "")).select("session_id", "line_no", "at", "path", table[F.col("value")].alias("action"))
    t = t.join(nodes.select("session_id", "project_path", F.col("project_name").alias("project")), "session_id")
    rel = F.when(F.col("project_path") == "", F.col("path")).otherwise(relative_path(F.col("path"), F.col("project_path")))
    out = t.withColumn("path", rel).groupBy("session_id", "path", "project").agg(F.max_by("action", rank[F.col("action")]).alias("action"), F.count("*").alias("count"), F.min(F.struct("line_no", "at")).alias("first_at"))
    return out


def session_edges(actions: DataFrame) -> dict[str, DataFrame]:
    """An edge frame (src, dst, count) for each action."""
    own = actions.select(F.col("session_id").alias("src"), F.concat_ws("|", "project", "path").alias("dst"), "action", "count")
    return {a: own.where(F.col("action") == a).select("src", "dst", "count") for a in PRIORITY}


def in_project(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    return nodes.join(projects.select(F.col("name").alias("__p")), F.col("project_name") == F.col("__p")).select(F.col("session_id").alias("src"), F.col("__p").alias("dst"))


def summaries(rows: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """session_id, project_name, started_at, tags and the text to index: header, first prompts, files, answers."""
    w = Window.partitionBy("session_id", "what").orderBy("line_no", "at")
    said = _spoken(rows).where(F.col("what").isin("prompt", "text", "thinking")).withColumn("k", F.row_number().over(w))
    most = {"prompt": (5, PROMPT_MOST), "text": (3, TEXT_MOST), "thinking": (3, THINKING_MOST)}
    lists = said.groupBy("session_id").agg(*[F.array_sort(F.collect_list(F.when((F.col("what") == k) & (F.col("k") <= n), F.struct("k", F.substring("value", 1, m).alias("v"))))).alias(k) for k, (n, m) in most.items()])
    files = actions.groupBy("session_id").agg(*[F.array_sort(F.collect_list(F.when(c, F.struct("first_at", "path")))).alias(k) for k, c in (("edited", F.col("action") != "TOUCHED"), ("touched", F.col("action") == "TOUCHED"))])
    x = nodes.join(lists, "session_id", "left").join(files, "session_id", "left")
    head = F.concat(F.lit("[Project: "), "project_name", F.when(F.col("git_branch") != "", F.concat(F.lit(" | Branch: "), "git_branch")).otherwise(""), F.when(F.col("started_at") != "", F.concat(F.lit(" | "), F.substring("started_at", 1, 10))).otherwise(""), F.lit("]"))
    flat = lambda c: F.transform(c, lambda v: F.trim(F.replace(v["v"], F.lit("\n"), F.lit(" "))))
    prompts = F.when(F.size("prompt") > 0, F.concat(F.lit("\nPrompts:\n"), F.array_join(F.transform("prompt", lambda v: F.concat(v["k"].cast("string"), F.lit(". "), F.trim(F.replace(v["v"], F.lit("\n"), F.lit(" "))))), "\n")))
    some = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}: "), F.array_join(F.slice(F.transform(c, lambda v: v["path"]), 1, 10), ", ")))
    answers = F.when(F.size("text") > 0, F.concat(F.lit("\n"), F.array_join(flat("text"), "\n")))
    text = F.substring(F.concat_ws("\n", head, prompts, some("edited", "Edited"), some("touched", "Touched"), answers), 1, SUMMARY_MOST)
    return x.select("session_id", "project_name", "started_at", F.filter(F.array("project_name", "git_branch"), lambda t: t != "").alias("tags"), text.alias("summary"))
