"""Markdown notes with front matter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of a path that keep a note out.
SKIPPED = ("README.md", "INDEX.md", ".archive_old", "archive/", ".venv/", "node_modules/", ".git/")
TEXT_MOST, STORED_MOST = 3000, 500
_META = T.StructType([*[T.StructField(c, T.StringType()) for c in ("title", "type", "status", "tags", "created", "updated")], T.StructField("opportunity_score", T.DoubleType()), T.StructField("body", T.StringType())])


def front_matter(text: str | None) -> dict:
    """The fields of a note; what is missing or malformed is null, and the body is what follows."""
    import yaml

    text = text or ""
    meta: dict = {}
    if text.startswith("---\n"):
        head, sep, rest = text[4:].partition("\n---")
        if sep:
            try:
                loaded = yaml.safe_load(head)
                meta = loaded if isinstance(loaded, dict) else {}
            except yaml.YAMLError:
                meta = {}
            text = rest.split("\n", 1)[1] if "\n" in rest else ""
    get = lambda k: None if meta.get(k) is None else str(meta[k])
    tags = meta.get("tags") or []
    score = meta.get("opportunity_score")
    return {
        "title": get("title"), "type": get("type"), "status": get("status"), "tags": ",".join(map(str, tags)) if isinstance(tags, list) else str(tags), "created": get("created"), "updated": get("updated"),
        "opportunity_score": float(score) if isinstance(score, (int, float)) else None, "body": text.strip(),
    }


@F.pandas_udf(_META)
def _front(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([front_matter(t) for t in texts], columns=["title", "type", "status", "tags", "created", "updated", "opportunity_score", "body"])


def scan_notes(tree: DataFrame, today: str) -> DataFrame:
    """doc_id, file, title, doc_type, status, tags, created, updated, content, content_hash, opportunity_score and the text to index."""
    out = F.endswith("path", F.lit(".md"))
    for p in SKIPPED:
        out = out & ~F.contains("path", F.lit(p))
    x = tree.where(out).select("path", _front("text").alias("m"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    title = F.coalesce("m.title", stem)
    text = F.concat(title, F.lit("\n\n"), F.substring("m.body", 1, TEXT_MOST))
    return x.select(
        F.md5(F.col("path").cast("binary")).alias("doc_id"), F.col("path").alias("file"), title.alias("title"), F.coalesce("m.type", F.lit("unknown")).alias("doc_type"), F.coalesce("m.status", F.lit("active")).alias("status"), F.col("m.tags").alias("tags"),
        F.coalesce("m.created", F.lit("")).alias("created"), F.coalesce("m.updated", F.lit(today)).alias("updated"), F.substring("m.body", 1, STORED_MOST).alias("content"), F.sha2(text, 256).alias("content_hash"), F.col("m.opportunity_score").alias("opportunity_score"), text.alias("text"),
    )


def note_stats(notes: DataFrame) -> DataFrame:
    """section (total, type, tags), name, n."""
    total = notes.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("documents").alias("name"), "n")
    kinds = notes.groupBy(F.col("doc_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), "name", "n")
    tags = notes.select(F.explode(F.split("tags", ",")).alias("t")).where(F.trim("t") != "").agg(F.countDistinct(F.trim("t")).alias("n")).select(F.lit("tags").alias("section"), F.lit("unique").alias("name"), "n")
    return total.unionByName(kinds).unionByName(tags)
