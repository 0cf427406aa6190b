"""Profiles of people: the rows that are stored, their links to products, and their search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.operators.fragments import fragments_held, listed
from lattice.operators.joins import contains_join
from lattice.operators.vectors import knn

#: Greatest lengths of the indexed text and of the stored biography.
INDEXED_MOST, ABOUT_MOST = 3000, 500
MAKER = "username STRING, name STRING, headline STRING, about STRING, twitter STRING, linkedin STRING, website STRING, points BIGINT, streak BIGINT, followers BIGINT"
_COUNTS = ("points", "streak", "followers")


def stored_profiles(profiles: DataFrame) -> DataFrame:
    """The columns of MAKER, one row for each username that is not empty, and ``text`` to index.

    Absent columns are empty texts and zeros; of rows of one username the first by all columns counts.
    """
    fields = [f.split(" ") for f in MAKER.split(", ")]
    given = {n: F.col(n).cast(t) if n in profiles.columns else F.lit(None).cast(t) for n, t in fields}
    rows = profiles.select(*[F.coalesce(c, F.lit(0) if n in _COUNTS else F.lit("")).alias(n) for n, c in given.items()]).where(F.col("username") != "")
    one = rows.groupBy("username").agg(F.min(F.struct(*[n for n, _ in fields if n != "username"])).alias("x")).select("username", "x.*")
    parts = F.concat_ws(". ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "headline", "about")])
    text = F.substring(F.coalesce(F.nullif(parts, F.lit("")), F.col("username")), 1, INDEXED_MOST)
    return one.withColumn("text", text).withColumn("about", F.substring("about", 1, ABOUT_MOST))


def product_links(makers: DataFrame, docs: DataFrame, source_type: str, *, username: str = "username", key: str = "doc_id", content: str = "content") -> DataFrame:
    """src and dst of each profile whose name occurs in the content of a document of the type.

    Names that fit a list are searched for in the tasks, in all contents of a document at once, so that no link is found twice. More
    are joined by pieces of the texts and then verified, without a nested loop.
    """
    own = docs.where(F.col("source_type") == source_type).select(F.col(key).alias("dst"), F.col(content).alias("__content"))
    names = makers.select(F.col(username).alias("src")).where(F.col("src") != "").distinct()
    if (few := listed(names, "src")) is None:
        return contains_join(own, "__content", names, "src").select("src", "dst").distinct()
    # a character that is in no name keeps the contents apart
    used = set("".join(few[0].to_pylist()))
    apart = next(c for c in map(chr, range(1, 0x10000)) if c not in used)
    whole = own.groupBy("dst").agg(F.array_join(F.collect_set("__content"), apart).alias("__content"))
    return fragments_held(whole, "__content", few[0], "__held").select(F.explode("__held").alias("src"), "dst")


def profile_content() -> Column:
    """Headline, points, streak and followers, of those that there are."""
    some = lambda c, form: F.when(F.col(c) > 0, F.concat(*[F.col(c).cast("string") if x == "#" else F.lit(x) for x in form]))
    return F.concat_ws(" | ", F.nullif(F.col("headline"), F.lit("")), some("points", ("#", " pts")), some("streak", ("#", "d streak")), some("followers", ("#", " followers")))


def profile_search(makers: DataFrame, query: Sequence[float] | Column, n: int, *, source: str = "", home: str = "", where: Column | None = None) -> DataFrame:
    """The n nearest profiles as search results: id, source_type, source_name, title, url, content, created, tags, relevance."""
    near = knn(makers, query, n, key="username", where=where)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("username"))
    of = F.col("source_name") if "source_name" in makers.columns else F.lit(source)
    return near.select(
        F.concat(F.lit("maker:"), "username").alias("id"), F.concat(of, F.lit("-maker")).alias("source_type"), of.alias("source_name"), F.concat(name, F.lit(" (@"), "username", F.lit(")")).alias("title"), F.concat(F.lit(home + "@"), "username").alias("url"),
        profile_content().alias("content"), F.lit("").alias("created"), F.lit("").alias("tags"), F.col("score").alias("relevance"),
    )
