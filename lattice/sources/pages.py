"""Stored pages of listings: site maps, product pages with linked data, lists of makers; and small folders of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.strings import product_status, slug_of

#: What a page is called while it is checked, lengths of texts, and the order of roles.
CHALLENGE = "just a moment..."
TAGLINE_MOST, DESCRIPTION_MOST = 500, 1000
ROLE_ORDER = {"maker": 0, "hunter": 1, "commenter": 2}
OTHER_ROLE = 9
_LINKED = "name STRING, description STRING, datePublished STRING, author STRING, offers STRUCT<url: STRING>, interactionStatistic STRING"
_PERSON = "STRUCT<name: STRING, url: STRING>"
_COUNTER = "STRUCT<interactionType: STRING, userInteractionCount: STRING>"
_MAKERS = "ARRAY<STRUCT<username: STRING, name: STRING, url: STRING, role: STRING>>"


def sitemap_urls(maps: DataFrame, pattern: str, known: DataFrame | None = None, xml: str = "xml", limit: int | None = None) -> DataFrame:
    """url and slug of the pages of site maps whose address fits ``pattern``, once each, without the known slugs."""
    found = maps.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url")).where(F.rlike("url", F.lit(pattern)))
    out = found.withColumn("slug", slug_of(F.col("url"))).dropDuplicates(["url"])
    if known is not None:
        out = out.join(known.select("slug").distinct(), "slug", "left_anti").select("url", "slug")
    return out if limit is None else out.orderBy("url").limit(limit)


def _meta(html: Column, key: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?is)<meta[^>]+{key}=["']{name}["'][^>]+content=["']([^"']*)""", 1), F.lit(""))


def _one_or_many(raw: Column, kind: str) -> Column:
    """A list of what a field holds, which may be one object or several."""
    many = F.startswith(F.ltrim(raw), F.lit("["))
    return F.when(many, F.from_json(raw, f"ARRAY<{kind}>")).otherwise(F.filter(F.array(F.from_json(raw, kind)), lambda x: x.isNotNull()))


def _before(text: Column, mark: str) -> Column:
    return F.trim(F.substring_index(text, mark, 1))


def product_pages(pages: DataFrame, site: str, *, slug: str = "slug", html: str = "html") -> DataFrame:
    """Records of product pages: name, tagline, description, upvotes, dates, website, status and the makers that linked data confirms.

    The name comes from the linked data, else from the title for sharing, else from the page's, less
    what follows `` | site`` or a dash; pages without one, or still being checked, give no row.
    """
    h = F.col(html)
    raw = F.regexp_extract(h, r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script\s*>""", 1)
    x = pages.select(slug, h.alias("__html"), F.from_json(F.nullif(raw, F.lit("")), _LINKED).alias("d"))
    h, d = F.col("__html"), F.col("d")
    mark = f" | {site}"
    page = F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title", 1)), F.lit(""))
    name = F.coalesce(F.nullif(d["name"], F.lit("")), _before(_meta(h, "property", "og:title"), mark), _before(_before(page, mark), " - "))
    people = F.filter(_one_or_many(d["author"], _PERSON), lambda a: F.rlike(F.coalesce(a["url"], F.lit("")), F.lit("/@[^/]+")))
    user = lambda a: F.regexp_extract(a["url"], "/@([^/?#]+)", 1)
    makers = F.transform(F.coalesce(people, F.array().cast(f"ARRAY<{_PERSON}>")), lambda a: F.struct(user(a).alias("username"), F.coalesce(F.nullif(a["name"], F.lit("")), user(a)).alias("name"), a["url"].alias("url"), F.lit("maker").alias("role")))
    likes = F.filter(_one_or_many(d["interactionStatistic"], _COUNTER), lambda s: F.contains(F.coalesce(s["interactionType"], F.lit("")), F.lit("UserLikes")))
    featured = F.coalesce(F.nullif(F.regexp_extract(h, r'"featuredAt"\s*:\s*"([^"]*)"', 1), F.lit("")), F.lit(""))
    number = lambda key: F.coalesce(F.regexp_extract(h, rf'"{key}"\s*:\s*(\d+)', 1).try_cast("bigint"), F.lit(0))
    date = F.coalesce(F.nullif(F.substring(d["datePublished"], 1, 10), F.lit("")), F.substring(featured, 1, 10))
    upvotes = F.coalesce(F.nullif(number("votesCount"), F.lit(0)), F.get(likes, F.lit(0))["userInteractionCount"].try_cast("bigint"), F.lit(0))
    text = lambda c, most: F.substring(F.coalesce(c, F.lit("")), 1, most)
    out = x.select(
        slug, name.alias("name"), text(_meta(h, "name", "description"), TAGLINE_MOST).alias("tagline"), text(F.coalesce(d["description"], _meta(h, "property", "og:description")), DESCRIPTION_MOST).alias("description"), upvotes.alias("upvotes"),
        date.alias("launch_date"), featured.alias("featured_at"), number("dailyRank").alias("daily_rank"), F.coalesce(d["offers"]["url"], F.lit("")).alias("website"), makers.cast(_MAKERS).alias("makers"),
    )
    return out.where((F.coalesce("name", F.lit("")) != "") & (F.lower("name") != CHALLENGE)).withColumn("product_status", product_status(F.col("featured_at"), F.col("daily_rank")))


def confirmed_makers(makers: Column, listed: Column) -> Column:
    """A product's people with the roles that its list of makers confirms, in order of role.

    Who is listed is a maker; a maker who is not listed has only commented; others keep their role.
    Listed people who are missing are added. Without a list nothing changes but the order.
    """
    names = F.transform(listed, lambda m: m["username"])
    role = lambda m: F.when(F.size(names) <= 0, m["role"]).when(F.array_contains(names, m["username"]), "maker").when(m["role"] == "maker", "commenter").otherwise(m["role"])
    own = F.transform(makers, lambda m: F.struct(m["username"].alias("username"), m["name"].alias("name"), m["url"].alias("url"), role(m).alias("role")))
    new = F.filter(listed, lambda m: ~F.array_contains(F.transform(makers, lambda x: x["username"]), m["username"]))
    every = F.concat(own.cast(_MAKERS), F.transform(new, lambda m: F.struct(m["username"].alias("username"), m["name"].alias("name"), m["url"].alias("url"), F.lit("maker").alias("role"))).cast(_MAKERS))
    return by_role(every)


def by_role(makers: Column) -> Column:
    """Makers first, then hunters, commenters and others; within a role as they were."""
    order = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])
    rank = lambda m: F.coalesce(order[F.coalesce(m["role"], F.lit("commenter"))], F.lit(OTHER_ROLE))
    numbered = F.transform(makers, lambda m, i: F.struct(rank(m).alias("r"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(numbered), lambda x: x["m"])


def channels(text: str) -> list[str]:
    """The handles of a list of channels in YAML."""
    import yaml

    return [str(h) for h in (yaml.safe_load(text) or {}).get("channels") or []]


def subtitle_cache(spark: SparkSession, folder: str) -> DataFrame:
    """video_id and vtt of the subtitle files that are kept in a folder as ``id.vtt``."""
    f = spark.read.option("pathGlobFilter", "*.vtt").text(folder, wholetext=True)
    return f.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.vtt$", 1).alias("video_id"), F.col("value").alias("vtt"))


def keep_subtitles(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """What is kept and what was fetched of videos that are not kept yet; empty files are left out."""
    new = fetched.where(F.coalesce("vtt", F.lit("")) != "").dropDuplicates(["video_id"])
    return cache.unionByName(new.join(cache.select("video_id"), "video_id", "left_anti").select("video_id", "vtt"))


def stack_templates(spark: SparkSession, folder: str, packages: int = 5) -> DataFrame:
    """file, name, platform, language, deploy and the first packages of the templates in a folder of settings; empty files are none."""
    import yaml

    out = []
    for r in spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.yaml$", 1).alias("f"), "value").collect():
        t = yaml.safe_load(r["value"]) or {}
        out.append((r["f"], str(t.get("name", r["f"])), *(str(t.get(k, "?")) for k in ("platform", "language", "deploy")), ", ".join(map(str, (t.get("key_packages") or [])[:packages]))))
    return spark.createDataFrame(out, "file STRING, name STRING, platform STRING, language STRING, deploy STRING, packages STRING").orderBy("file")
