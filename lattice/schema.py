"""Logical schemas of the code and session graph, the content tables and the sources, as DDL."""

from __future__ import annotations

NODES = {
    "Project": "id STRING, name STRING, stack STRING, path STRING, status STRING, has_claude_md BOOLEAN, description STRING",
    "File": "id STRING, path STRING, project STRING, lang STRING, lines BIGINT",
    "Symbol": "id STRING, name STRING, project STRING, file STRING, kind STRING, line BIGINT",
    "Package": "id STRING, name STRING, version STRING, source STRING",
    "Session": "id STRING, session_id STRING, project_name STRING, project_path STRING, started_at STRING, ended_at STRING, duration_ms BIGINT, user_prompts BIGINT, tool_uses BIGINT, model STRING, git_branch STRING, slug STRING",
}

EDGES = {
    ("Project", "HAS_FILE", "File"): "src STRING, dst STRING",
    ("File", "DEFINES", "Symbol"): "src STRING, dst STRING",
    ("Project", "DEPENDS_ON", "Package"): "src STRING, dst STRING",
    ("File", "MODIFIED", "File"): "src STRING, dst STRING, author STRING, date STRING, lines_added BIGINT, lines_removed BIGINT, commit STRING",
    ("File", "IMPORTS", "File"): "src STRING, dst STRING",
    ("File", "IMPORTS", "Package"): "src STRING, dst STRING",
    ("File", "CALLS", "Symbol"): "src STRING, dst STRING",
    ("Symbol", "INHERITS", "Symbol"): "src STRING, dst STRING",
    ("Session", "TOUCHED", "File"): "src STRING, dst STRING, count BIGINT",
    ("Session", "EDITED", "File"): "src STRING, dst STRING, count BIGINT",
    ("Session", "CREATED", "File"): "src STRING, dst STRING, count BIGINT",
    ("Session", "IN_PROJECT", "Project"): "src STRING, dst STRING",
}

#: Edges of which equal ones may lie side by side; where they are stored each has a number, ``eid``.
NUMBERED = (("File", "MODIFIED", "File"),)

#: What identifies a node of each label; ``id`` is these columns joined by a bar.
KEYS = {"Project": ["name"], "File": ["project", "path"], "Symbol": ["project", "file", "name"], "Package": ["name"], "Session": ["session_id"]}

PRODUCT = (
    "slug STRING, name STRING, tagline STRING, description STRING, topics STRING, upvotes BIGINT, comments BIGINT, comments_count BIGINT, reviews_count BIGINT, rating DOUBLE, "
    "daily_rank BIGINT, weekly_rank BIGINT, featured BOOLEAN, featured_at STRING, created_at STRING, website STRING, url STRING, launch_date STRING, product_status STRING, "
    "makers ARRAY<STRUCT<username: STRING, name: STRING, url: STRING, followers: BIGINT, role: STRING>>, product_links MAP<STRING, STRING>, thumbnail STRING, _source STRING"
)
PROFILE = "username STRING, profile_url STRING, headline STRING, about STRING, linkedin STRING, twitter STRING, github STRING, website STRING, is_maker BOOLEAN, streak BIGINT, points BIGINT, followers BIGINT"
VECTOR = "id STRING, embedding ARRAY<FLOAT>, norm DOUBLE, kind STRING, source STRING, popularity BIGINT"
