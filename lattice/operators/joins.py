"""Joins that a plain equality does not express, and merges by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.operators.fragments import fragments_held, listed


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters; ``text`` is an array of characters."""
    if n == 1:
        return F.array_distinct(text)
    pieces = F.transform(text, lambda c, i: F.concat(c, *[F.get(text, i + k) for k in range(1, n)]))
    return F.array_distinct(F.filter(pieces, lambda g: g.isNotNull()))


def contains_join(texts: DataFrame, text: str, fragments: DataFrame, fragment: str, gram: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides that agree in ``by`` and whose ``text`` holds ``fragment`` literally; empty and null fragments match nothing.

    Without ``by`` and ``gram``, fragments that fit a list (``fragments.listed``) go to the tasks, and texts are searched where they are,
    without an exchange. Others are keyed (``gram`` is 3 then): a fragment meets only the texts that hold its rarest piece of ``gram`` characters (of its own length, if it is
    shorter), by counts of the texts that hold each piece; the whole is verified after. Pieces travel with the
    text's digest, and the text joins again when the candidates are known. No nested loop.
    """
    by = list(by)
    if not by and gram is None and (few := listed(fragments, fragment)) is not None:
        return _listed_join(texts, text, fragments, fragment, *few)
    gram = gram or 3
    digest = [F.xxhash64(F.col(text)).alias("__h1"), F.xxhash64(F.col(text), F.lit(1)).alias("__h2")]
    f = fragments.where(F.length(fragment) > 0).select(*by, F.col(fragment).alias("__f")).distinct()
    f = f.withColumn("__chars", F.split("__f", "")).withColumn("__chars", F.filter("__chars", lambda c: c != ""))
    t = texts.where(F.length(text) > 0).select(*by, *digest, F.filter(F.split(text, ""), lambda c: c != "").alias("__chars"))
    own: DataFrame | None = None
    for n in range(1, gram + 1):
        long = (F.length("__f") >= n) if n == gram else (F.length("__f") == n)
        part = f.where(long).select(*by, "__f", F.explode(_grams(F.col("__chars"), n)).alias("__gram"))
        own = part if own is None else own.unionByName(part)
    # all lengths in one pass over the texts; a piece of a length is no piece of another
    held = t.select(*by, "__h1", "__h2", F.explode(F.flatten(F.array(*[_grams(F.col("__chars"), n) for n in range(1, gram + 1)]))).alias("__gram"))
    wanted = held.join(own.select(*by, "__gram").distinct(), [*by, "__gram"], "left_semi")
    counted = wanted.groupBy(*by, "__gram").agg(F.count("*").alias("__n"))
    # a piece that no text holds rules its fragment out
    rarest = own.join(counted, [*by, "__gram"], "left").groupBy(*by, "__f").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), F.col("__gram"))).alias("__gram"), F.min(F.coalesce("__n", F.lit(0))).alias("__n"))
    keys = rarest.where("__n > 0").drop("__n")
    candidates = held.join(keys, [*by, "__gram"]).select(*by, "__h1", "__h2", "__f").distinct()
    # columns of both sides go by number until the end, so that equal names do not meet
    named = lambda df, mark: [F.col(c).alias(f"{mark}{i}") for i, c in enumerate(df.columns)]
    whole = texts.select(*by, *digest, F.col(text).alias("__t"), *named(texts, "__left"))
    found = whole.join(candidates, [*by, "__h1", "__h2"]).where(F.contains("__t", F.col("__f")))
    both = found.join(fragments.select(*by, F.col(fragment).alias("__f"), *named(fragments, "__right")), [*by, "__f"])
    out = both.select(*[F.col(f"__left{i}").alias(c) for i, c in enumerate(texts.columns)], *[F.col(f"__right{i}").alias(c) for i, c in enumerate(fragments.columns) if c not in by])
    return out


def _listed_join(texts: DataFrame, text: str, fragments: DataFrame, fragment: str, few: pa.Array, once: bool) -> DataFrame:
    # columns of both sides go by number until the end, so that equal names do not meet
    left = texts.select(*[F.col(c).alias(f"__left{i}") for i, c in enumerate(texts.columns)])
    own = [f"__left{i}" for i in range(len(texts.columns))]
    found = fragments_held(left, own[texts.columns.index(text)], few, "__held").select(*own, F.explode("__held").alias("__f"))
    if once and fragments.columns == [fragment]:
        found = found.withColumn("__right0", F.col("__f"))
    else:
        found = found.join(fragments.select(F.col(fragment).alias("__f"), *[F.col(c).alias(f"__right{i}") for i, c in enumerate(fragments.columns)]), "__f")
    return found.select(*[F.col(f"__left{i}").alias(c) for i, c in enumerate(texts.columns)], *[F.col(f"__right{i}").alias(c) for i, c in enumerate(fragments.columns)])


def interval_assign(points: DataFrame, at: str, marks: DataFrame, start: str, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Each point with ``carry`` of the last mark at or before it (null before the first), per ``by``.

    An as-of join as one sort: both sides are unioned and the mark carried forward, so that the
    cost is a window, not a range join. Of marks at one place the last in order of ``carry`` counts.
    """
    order = F.struct(*[F.col(c) for c in carry])
    m = marks.select(*by, F.col(start).alias("__at"), F.lit(0).alias("__side"), order.alias("__mark"), *[F.lit(None).cast(points.schema[c].dataType).alias(f"__p_{c}") for c in points.columns])
    p = points.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(m.schema["__mark"].dataType).alias("__mark"), *[F.col(c).alias(f"__p_{c}") for c in points.columns])
    w = Window.partitionBy(*by).orderBy("__at", "__side", F.col("__mark").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = m.unionByName(p).withColumn("__last", F.last("__mark", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    return out.select(*[F.col(f"__p_{c}").alias(c) for c in points.columns], *[F.col(f"__last.{c}").alias(f"mark_{c}" if c in points.columns else c) for c in carry])


def missing(new: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """The new rows whose key is not known yet."""
    return new.join(known.select(*on).distinct(), list(on), "left_anti")


def dedupe_by_priority(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the rows of a key the first in ``order``, which must be total for a defined result."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def merge_by_key(left: DataFrame, right: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """Full outer merge with a rule for each column: ``left`` or ``right`` first, or the ``greatest``.

    Empty strings count as absent. Keys of either side are kept.
    """
    a = left.select(F.col(key).alias("__a"), *[F.col(c).alias(f"__l_{c}") for c in rules])
    b = right.select(F.col(key).alias("__b"), *[F.col(c).alias(f"__r_{c}") for c in rules])
    joined = a.join(b, F.col("__a") == F.col("__b"), "full_outer")

    def value(c: str, rule: str) -> Column:
        text = left.schema[c].dataType.typeName() == "string"
        x, y = (F.nullif(F.col(f"__{s}_{c}"), F.lit("")) if text else F.col(f"__{s}_{c}") for s in "lr")
        if rule == "greatest":
            return F.greatest(x, y)
        return F.coalesce(x, y) if rule == "left" else F.coalesce(y, x)

    return joined.select(F.coalesce("__a", "__b").alias(key), *[value(c, r).alias(c) for c, r in rules.items()])


def in_order(ids: DataFrame, rows: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """The rows of the ids, in the order of ``rank``."""
    return ids.join(rows, key).orderBy(rank)


def with_siblings(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the previous and next row's ``columns`` where their ``order`` differs by one."""
    w = Window.partitionBy(*by).orderBy(order)
    for c in columns:
        df = df.withColumn(f"prev_{c}", F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag(c).over(w)))
        df = df.withColumn(f"next_{c}", F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead(c).over(w)))
    return df


def related_by_tag(tagged: DataFrame, item: str, tag: str, weight: str, seed: object | None = None) -> DataFrame:
    """Pairs of items with a common tag: a, b, shared_tags (sorted), overlap and relevance (half the sum of both weights)."""
    a = tagged.select(F.col(item).alias("a"), F.col(tag).alias("tag"), F.col(weight).alias("wa"))
    if seed is not None:
        a = a.where(F.col("a") == F.lit(seed))
    b = tagged.select(F.col(item).alias("b"), F.col(tag).alias("tag"), F.col(weight).alias("wb"))
    both = a.join(b, "tag").where(F.col("a") != F.col("b"))
    return both.groupBy("a", "b").agg(F.array_sort(F.collect_set("tag")).alias("shared_tags"), F.count("*").alias("overlap"), (F.sum(F.col("wa") + F.col("wb")) / 2).alias("relevance"))
