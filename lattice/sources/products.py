"""Product and startup listings: records, documents to index, enrichment, people and their roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions.strings import doc_id, product_status
from lattice.operators.joins import dedupe_by_priority, merge_by_key

EMBED_MOST, DESCRIPTION_MOST, CONTENT_MOST = 3000, 500, 500
#: What a redacted maker is called, and edge types by role.
REDACTED = "[REDACTED]"
ROLE_EDGES = {"maker": "MADE", "commenter": "COMMENTED"}
OTHER_EDGE = "PARTICIPATED"


def _part(label: str, value: Column) -> Column:
    """label and value where there is a value."""
    text = value.cast("string")
    return F.when(value.isNotNull() & ~text.isin("", "0", "0.0"), F.concat(F.lit(label), text))


def product_docs(items: DataFrame, source: str, prefix: str, home: str) -> DataFrame:
    """Documents of products with a slug and a name: id, type, title, content, tags, text to index, popularity, status."""
    c = F.col
    names = F.array_join(F.filter(F.transform("makers", lambda m: F.coalesce(m["name"], m["username"])), lambda x: x.isNotNull()), ", ")
    month = F.when(F.length("launch_date") >= 7, F.substring("launch_date", 1, 7))
    tags = F.concat(F.array(F.lit(source)), F.transform(F.slice(F.filter(F.split(F.coalesce("topics", F.lit("")), ", "), lambda x: x != ""), 1, 4), lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("-"))), F.filter(F.array(month), lambda x: x.isNotNull()))
    text = F.concat_ws(". ", "name", _part("", c("tagline")), _part("", F.substring("description", 1, DESCRIPTION_MOST)), _part("Topics: ", c("topics")), _part("Upvotes: ", c("upvotes")), _part("Makers: ", names), _part("Launched: ", c("launch_date")))
    upvotes = F.coalesce("upvotes", F.lit(0))
    content = F.concat_ws(" | ", _part("", c("tagline")), F.concat(_part("", c("upvotes")), F.lit("↑")), F.concat(_part("", c("comments")), F.lit(" comments")), _part("★", c("rating")), _part("", c("topics")), _part("", c("website")))
    return _named(items).select(
        doc_id(prefix, c("slug")).alias("doc_id"), F.lit(f"{source}-product").alias("source_type"), F.lit(source).alias("source_name"), F.concat("name", F.lit(" — "), upvotes.cast("string"), F.lit("↑")).alias("title"), content.alias("content"),
        F.coalesce("url", F.concat(F.lit(home), "slug")).alias("url"), F.coalesce("launch_date", F.lit("")).alias("created"), F.array_join(tags, ",").alias("tags"), F.substring(text, 1, EMBED_MOST).alias("text"), upvotes.alias("popularity"),
        product_status(c("featured_at"), c("daily_rank")).alias("product_status"),
    )


def startup_docs(items: DataFrame, source: str, prefix: str, home: str) -> DataFrame:
    c = F.col
    text = F.concat_ws(". ", "name", _part("", c("description")), F.concat(_part("Revenue: ", c("revenue_30d")), F.lit("/month")), _part("Category: ", c("category")), _part("Stack: ", c("tech_stack")), _part("Country: ", c("country")))
    content = F.concat_ws(" | ", F.concat(_part("Revenue: ", c("revenue_30d")), F.lit("/30d")), _part("Stack: ", c("tech_stack")), _part("Founder: @", c("founder_x")), _part("Country: ", c("country")))
    tags = F.concat(F.array(F.lit(source)), F.filter(F.array(F.nullif("category", F.lit(""))), lambda x: x.isNotNull()), F.transform(F.slice(F.filter(F.split(F.coalesce("tech_stack", F.lit("")), ", "), lambda x: x != ""), 1, 3), lambda x: F.replace(F.lower(x), F.lit("."), F.lit(""))))
    return _named(items).select(
        doc_id(prefix, c("slug")).alias("doc_id"), F.lit(f"{source}-startup").alias("source_type"), F.lit(source).alias("source_name"), F.concat("name", F.lit(" — "), F.coalesce("revenue_30d", F.lit("N/A")), F.lit("/mo")).alias("title"),
        F.coalesce(F.nullif(content, F.lit("")), F.substring("description", 1, CONTENT_MOST), F.lit("")).alias("content"), F.coalesce("url", F.concat(F.lit(home), "slug")).alias("url"), F.lit("").alias("created"), F.array_join(tags, ",").alias("tags"), F.substring(text, 1, EMBED_MOST).alias("text"),
    )


def _named(items: DataFrame) -> DataFrame:
    return items.where((F.coalesce("slug", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))


def rejected(items: DataFrame) -> DataFrame:
    """The number of items without slug or name."""
    return items.agg(F.count_if((F.coalesce("slug", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")).alias("rejected"))


def visible_makers(makers: Column) -> Column:
    """Whether some maker is not redacted."""
    return F.exists(makers, lambda m: (F.coalesce(m["username"], F.lit("")) != "") & (F.coalesce(m["username"], F.lit("")) != REDACTED) & (F.coalesce(m["name"], F.lit("")) != REDACTED))


def enrich(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with what a closer look found: redacted makers replaced, the higher upvotes, empty fields filled, unknown slugs added."""
    shared = [c for c in items.columns if c in found.columns and c != "slug"]
    rules = {c: "greatest" if c == "upvotes" else "left" for c in shared if c != "makers"}
    merged = merge_by_key(items, found, "slug", rules)
    if "makers" in shared:
        a, b = items.select(F.col("slug").alias("__a"), F.col("makers").alias("__ma")), found.select(F.col("slug").alias("__b"), F.col("makers").alias("__mb"))
        merged = merged.join(a, merged["slug"] == a["__a"], "left").join(b, merged["slug"] == b["__b"], "left")
        makers = F.when(visible_makers(F.col("__ma")), F.col("__ma")).otherwise(F.coalesce("__mb", "__ma"))
        merged = merged.withColumn("makers", makers).drop("__a", "__b", "__ma", "__mb")
    rest = [c for c in items.columns if c not in shared and c != "slug"]
    if rest:
        merged = merged.join(items.select("slug", *rest), "slug", "left")
    return merged.select(*items.columns)


def merge_dumps(dumps: Sequence[DataFrame]) -> DataFrame:
    """One row for each slug of several dumps, that of the first dump that has it (the newest comes first)."""
    out: DataFrame | None = None
    for k, df in enumerate(dumps):
        part = df.withColumn("__dump", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dumps")
    rest = [F.xxhash64(*[F.to_json(F.struct(*[F.col(c) for c in out.columns]))])]
    return dedupe_by_priority(out, ["slug"], [F.col("__dump"), *rest]).drop("__dump")


def usernames(items: DataFrame) -> DataFrame:
    return items.select(F.explode("makers.username").alias("username")).where(F.coalesce("username", F.lit("")) != "").distinct().orderBy("username")


def user_graph(items: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """User nodes (name first seen by slug, roles, number of products) and an edge frame for each kind of part taken."""
    m = items.where(F.coalesce("slug", F.lit("")) != "").select("slug", F.explode("makers").alias("m")).where(F.coalesce("m.username", F.lit("")) != "")
    m = m.select("slug", "m.username", "m.name", "m.url", F.coalesce(F.nullif(F.col("m.role"), F.lit("")), F.lit("maker")).alias("role"))
    users = m.groupBy("username").agg(F.min_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.struct("slug", "name"))).alias("name"), F.min_by("url", F.struct("slug", "url")).alias("url"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("product_count"))
    kind = F.coalesce(F.get(F.array(F.create_map(*[F.lit(x) for kv in ROLE_EDGES.items() for x in kv])[F.col("role")]), F.lit(0)), F.lit(OTHER_EDGE))
    e = m.select(F.col("username").alias("src"), doc_id(prefix, F.col("slug")).alias("dst"), kind.alias("type")).distinct()
    return users, {k: e.where(F.col("type") == k).select("src", "dst") for k in (*ROLE_EDGES.values(), OTHER_EDGE)}


def maker_text(profiles: DataFrame) -> Column:
    """What of a profile is indexed: name, headline and biography, else the username."""
    parts = F.concat_ws(". ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "headline", "about") if c in profiles.columns])
    return F.coalesce(F.nullif(parts, F.lit("")), F.col("username"))


def maker_content(profiles: DataFrame) -> Column:
    labels = {"headline": "", "points": "Points: ", "followers": "Followers: ", "streak": "Streak: ", "twitter": "Twitter: ", "linkedin": "LinkedIn: ", "website": ""}
    return F.concat_ws(" | ", *[_part(label, F.col(c)) for c, label in labels.items() if c in profiles.columns])


def startup_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Fields of startup pages: name and revenue from the title of the page's card, the rest from links."""
    title = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)""", 1)
    link = lambda kind: F.regexp_extract_all(html, F.lit(rf"""(?is)<a[^>]+href=["'][^"']*/{kind}/[^"']+["'][^>]*>([^<]+)<"""), 1)
    slug = F.element_at(F.split(F.rtrim(F.col(url), F.lit("/")), "/"), -1)
    return pages.select(
        F.col(url).alias("url"), slug.alias("slug"), F.trim(F.regexp_extract(title, r"^(.*?)(?:\s+[-—|]\s+|$)", 1)).alias("name"), F.nullif(F.regexp_extract(title, r"(\$[\d.,]+[kKmM]?)", 1), F.lit("")).alias("revenue_30d"),
        F.get(link("category"), F.lit(0)).alias("category"), F.get(link("country"), F.lit(0)).alias("country"), F.array_join(F.slice(F.array_distinct(link("tech")), 1, 10), ", ").alias("tech_stack"),
    )


def node_items(nodes: DataFrame) -> DataFrame:
    """Items of an interface's product nodes (slug, name, topics, makers, links and counts as it nests them)."""
    c = F.col
    topics = F.array_join(F.transform("topics.edges", lambda e: e["node"]["name"]), ", ")
    links = F.map_from_entries(F.transform(F.filter("productLinks", lambda x: x["type"].isNotNull()), lambda x: F.struct(x["type"], x["url"])))
    makers = F.transform("makers", lambda m: F.struct(m["username"].alias("username"), m["name"].alias("name"), m["url"].alias("url"), F.lit(None).cast("bigint").alias("followers"), F.lit("maker").alias("role")))
    return nodes.select("slug", "name", "tagline", "description", topics.alias("topics"), c("votesCount").alias("upvotes"), c("commentsCount").alias("comments"), makers.alias("makers"), links.alias("product_links"), c("featuredAt").alias("featured_at"), c("createdAt").alias("created_at"), product_status(c("featuredAt"), F.lit(None).cast("bigint")).alias("product_status"))
