"""Source trees as tables, and what follows from paths alone: languages, stacks, descriptions, registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file ending.
LANGUAGES = {".py": "python", ".swift": "swift", ".ts": "typescript", ".tsx": "tsx", ".kt": "kotlin", ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp"}
DOCUMENTS = {".md": "markdown", ".mdx": "markdown", ".rst": "markdown", ".txt": "markdown"}
# Directories and files that are never scanned.
SKIP_DIRS = """.git .venv venv env node_modules __pycache__ .build DerivedData build .next dist .output .gradle Pods .eggs .tox .turbo .vercel .wrangler coverage .nyc_output htmlcov .pytest_cache
samples Samples examples Examples react-samples vendor third_party third-party generated .cache .parcel-cache .swc .idea .vscode""".split()
SKIP_FILES = (".DS_Store", "package-lock.json", "yarn.lock", "uv.lock")
# Fixed values: (file pattern, greatest depth, stack).
STACK_RULES = ((r".*\.xcodeproj", 3, "ios-swift"), (r"project\.yml", 2, "ios-swift"), (r"build\.gradle\.kts", 3, "kotlin-android"), (r"astro\.config\..*", 2, "astro-static"), (r"wrangler\.toml", 2, "cloudflare-workers"), (r"wrangler\.jsonc", 2, "cloudflare-workers"), (r"pyproject\.toml", 2, "python-ml"))
_STACK_SKIP = ("node_modules", ".next", "dist", "build")
MAX_DESCRIPTION = 120


def read_tree(spark: SparkSession, roots: Mapping[str, str], pattern: str = "*") -> DataFrame:
    """project, path (below the project's root) and text of every file; one file listing for all roots."""
    out: DataFrame | None = None
    for project, root in roots.items():
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        rel = F.regexp_extract("path", r"^[a-z]+:/*(/.*)$", 1)
        base = root.rstrip("/") + "/"
        part = f.select(F.lit(project).alias("project"), F.substr(rel, F.lit(len(base) + 1)).alias("path"), F.decode("content", "UTF-8").alias("text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "project STRING, path STRING, text STRING")
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column, documents: bool = False) -> Column:
    """By the ending; null for files that are not scanned."""
    known = {**LANGUAGES, **(DOCUMENTS if documents else {})}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.get(F.array(table[F.regexp_extract(path, r"(\.[^./]+)$", 1)]), F.lit(0))


def scannable(path: Column) -> Column:
    """Not below a skipped directory, by whole parts of the relative path, and not a skipped file."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIP_DIRS))) & ~file_name(path).isin(*SKIP_FILES)


def line_count(text: Column) -> Column:
    """Newlines and one; 0 for an unreadable file."""
    return F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def scan_files(tree: DataFrame, documents: bool = False) -> DataFrame:
    """id, path, project, lang, lines of the source files; with ``documents`` also markdown and text."""
    own = tree.withColumn("lang", language(F.col("path"), documents)).where(F.col("lang").isNotNull() & scannable(F.col("path")))
    return own.select(F.concat_ws("|", "project", "path").alias("id"), "path", "project", "lang", line_count(F.col("text")).alias("lines"))


def stacks(tree: DataFrame) -> DataFrame:
    """project and its sorted stacks, by files at limited depth and by dependencies.

    next in package.json: nextjs-supabase, with ai also nextjs-ai-agents; fastapi in a
    pyproject turns python-ml into python-api.
    """
    parts = F.split("path", "/")
    depth = F.size(parts)
    dirs = F.slice(parts, 1, depth - 1)
    inside = ~F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(*_STACK_SKIP))
    found: DataFrame | None = None
    for pattern, most, stack in STACK_RULES:
        # an .xcodeproj is a directory: its files lie one level deeper
        hit = F.exists(parts, lambda p: F.rlike(p, F.lit(f"^{pattern}$"))) if "xcodeproj" in pattern else F.rlike(file_name(F.col("path")), F.lit(f"^{pattern}$"))
        at = depth <= most + ("xcodeproj" in pattern)
        part = tree.where(hit & at & inside).select("project", F.lit(stack).alias("stack"))
        found = part if found is None else found.unionByName(part)
    near = tree.where((depth <= 2) & ~F.exists(dirs, lambda d: d.isin("node_modules", ".next", "dist")))
    deps = near.where(file_name(F.col("path")) == "package.json").select("project", F.from_json("text", "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>").alias("p"))
    names = F.concat(F.coalesce(F.map_keys("p.dependencies"), F.array()), F.coalesce(F.map_keys("p.devDependencies"), F.array()))
    npm = deps.groupBy("project").agg(F.flatten(F.collect_list(names)).alias("n"))
    next_ = npm.where(F.array_contains("n", "next"))
    found = found.unionByName(next_.select("project", F.lit("nextjs-supabase").alias("stack"))).unionByName(next_.where(F.array_contains("n", "ai")).select("project", F.lit("nextjs-ai-agents").alias("stack")))
    fast = near.where((file_name(F.col("path")) == "pyproject.toml") & F.contains(F.lower("text"), F.lit("fastapi"))).select("project").distinct().withColumn("fast", F.lit(True))
    found = found.join(fast, "project", "left").withColumn("stack", F.when(F.col("fast") & (F.col("stack") == "python-ml"), "python-api").otherwise(F.col("stack")))
    return found.groupBy("project").agg(F.array_sort(F.collect_set("stack")).alias("stacks"))


def descriptions(tree: DataFrame) -> DataFrame:
    """project and the first line of CLAUDE.md, else README.md, that is not empty, a heading or a rule."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", ""))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("---")))
    own = tree.where(F.col("path").isin("CLAUDE.md", "README.md")).select("project", "path", F.substring(F.get(lines, F.lit(0)), 1, MAX_DESCRIPTION).alias("line")).where(F.col("line").isNotNull())
    return own.groupBy("project").agg(F.min_by("line", "path").alias("description"))


def registry(tree: DataFrame, status: str = "active") -> DataFrame:
    """project, status, stacks, has_claude_md, description: a row for each directory of the tree."""
    base = tree.groupBy("project").agg(F.bool_or(F.col("path") == "CLAUDE.md").alias("has_claude_md"))
    out = base.join(stacks(tree), "project", "left").join(descriptions(tree), "project", "left")
    return out.select("project", F.lit(status).alias("status"), F.coalesce("stacks", F.array().cast("array<string>")).alias("stacks"), "has_claude_md", F.coalesce("description", F.lit("")).alias("description"))


def read_registry(spark: SparkSession, text: str) -> DataFrame:
    """Project nodes of a registry in YAML; stacks joined by commas, the description cut at 200."""
    import yaml

    rows = []
    for p in (yaml.safe_load(text) or {}).get("projects") or []:
        rows.append((p["name"], p["name"], ",".join(p.get("stacks") or []), p.get("path") or "", p.get("status") or "active", bool(p.get("has_claude_md")), (p.get("description") or "")[:200]))
    return spark.createDataFrame(rows, "id STRING, name STRING, stack STRING, path STRING, status STRING, has_claude_md BOOLEAN, description STRING")


def write_registry(projects: DataFrame, scan_path: str = "", last_scan: str = "") -> str:
    """The same in YAML; statuses but active, paused, idea and archived are refused."""
    import yaml

    rows = [r.asDict() for r in projects.orderBy("project").collect()]
    if bad := [r for r in rows if r["status"] not in ("active", "paused", "idea", "archived")]:
        raise ValueError(f"no status {bad[0]['status']}")
    items = [{"name": r["project"], **{k: v for k, v in r.items() if k != "project"}} for r in rows]
    return yaml.safe_dump({"projects": items, "scan_path": scan_path, "last_scan": last_scan}, sort_keys=False, allow_unicode=True)


def file_status(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, bytes and lines of the files in a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return f.select(file_name(F.col("path")).alias("name"), F.col("length").alias("bytes"), (line_count(F.decode("content", "UTF-8")) - 1).alias("lines")).orderBy("name")


def json_lines(spark: SparkSession, path: str | Sequence[str], ddl: str, strict: bool = False) -> DataFrame:
    """Line-delimited JSON under a fixed schema; bad lines are dropped, or end the read if ``strict``."""
    return spark.read.schema(ddl).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header. For reports, which have a line for each person."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
