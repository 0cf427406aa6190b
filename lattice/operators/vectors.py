"""Vector search and ranking in DataFrame functions: cosine, top-k, re-ranking, fusion, tagging.

Vectors are arrays of float; products are summed in double. A zero vector has cosine 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of ranking: weight of the cosine, the boost's scale and bound, the constant of fusion, the tag threshold.
COSINE_WEIGHT, BOOST_SCALE, BOOST_MOST, FUSION_K, TAG_LEAST = 0.85, 25.0, 0.15, 60, 0.3


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(df: DataFrame, query: Sequence[float] | Column, k: int, *, embedding: str = "embedding", key: str = "id", where: Column | None = None, postfilter: bool = False) -> DataFrame:
    """The k rows of greatest cosine, ties by ``key``: score and the row's columns.

    A filter is applied before ranking, exactly; with ``postfilter`` after it, so that fewer than k
    rows may be left, as an index that filters its hits would.
    """
    q = query if isinstance(query, Column) else vector(query)
    source = df if where is None or postfilter else df.where(where)
    out = source.withColumn("score", cosine(F.col(embedding), q)).orderBy(F.desc("score"), key).limit(k)
    return out.where(where) if where is not None and postfilter else out


def knn_lsh(df: DataFrame, query: Sequence[float], k: int, *, embedding: str = "embedding", key: str = "id", bucket: float = 0.6, tables: int = 8) -> DataFrame:
    """Approximate top k by random projections of unit vectors, opt-in; scores are exact cosines."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = Normalizer(inputCol="__v", outputCol="__u").transform(df.withColumn("__v", array_to_vector(F.transform(embedding, lambda x: x.cast("double")))))
    model = BucketedRandomProjectionLSH(inputCol="__u", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=7).fit(unit)
    size = sum(x * x for x in query) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), k, distCol="__d")
    return near.withColumn("score", cosine(F.col(embedding), vector(query))).drop("__v", "__u", "__h", "__d").orderBy(F.desc("score"), key)


def boost(popularity: Column) -> Column:
    return F.when(popularity > 0, F.least(F.log10(popularity + 1) / BOOST_SCALE, F.lit(BOOST_MOST))).otherwise(F.lit(0.0))


def rerank(df: DataFrame, query: Sequence[float] | Column, n: int, *, popularity: str = "popularity", embedding: str = "embedding", key: str = "id", over: int = 3) -> DataFrame:
    """Top n of the 3 n nearest by cosine and popularity: ``relevance``. Null or no popularity gives no boost but the weight."""
    near = knn(df, query, over * n, embedding=embedding, key=key)
    out = near.withColumn("relevance", F.col("score") * COSINE_WEIGHT + F.coalesce(boost(F.col(popularity)), F.lit(0.0)))
    return out.orderBy(F.desc("relevance"), key).limit(n)


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Position from 1 within ``by``. Without ``by`` all rows are sorted in one task: only for frames that a limit has bounded."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows of every group: one windowed scan in place of a query for each namespace."""
    return ranked(df, order, by, "__rank").where(F.col("__rank") <= n).drop("__rank")


def fuse(lists: DataFrame, *, list_col: str = "list_id", key: str = "id", rank: str = "rank", k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (rank from 1): id and score, ties by the first list and rank it stood at.

    Terms are added in order of (list, rank), so that equal inputs give equal sums.
    """
    terms = lists.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(list_col), F.col(rank)))).alias("__t"))
    scored = terms.withColumn("score", F.aggregate("__t", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (x[rank] + k)))
    return scored.withColumn("__first", F.col("__t")[0]).orderBy(F.desc("score"), "__first", key).select(key, "score")


def merge_kinds(kinds: Sequence[DataFrame], n: int, score: str = "relevance", key: str = "id") -> DataFrame:
    """Each kind's top n, then the top n of all; equal scores in the order of the kinds."""
    out: DataFrame | None = None
    for k, df in enumerate(kinds):
        part = df.orderBy(F.desc(score), key).limit(n).withColumn("__kind", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no kinds to merge")
    return out.orderBy(F.desc(score), "__kind", key).limit(n).drop("__kind")


def merge_kinds_by(rows: DataFrame, kind: str, n: int, score: str = "relevance", key: str = "id") -> DataFrame:
    """The same for rows of one frame with a column for the kind: one scan, each kind's top n, then that of all."""
    top = top_per(rows, [kind], [F.desc(score), F.col(key)], n)
    return top.orderBy(F.desc(score), kind, key).limit(n)


def tags(docs: DataFrame, topics: DataFrame, *, key: str = "id", topic: str = "topic", embedding: str = "embedding", least: float = TAG_LEAST) -> DataFrame:
    """Zero-shot tags: (id, topic, confidence) of every topic whose vector is close enough.

    ``topics`` is a fixed list of a few dozen vectors, held to 4096 by a check, and is broadcast.
    """
    count = topics.count()
    if count > 4096:
        raise ValueError(f"{count} topics; tagging is for a short fixed list")
    t = topics.select(F.col(topic).alias("__topic"), F.col(embedding).alias("__tv"))
    both = docs.select(F.col(key), F.col(embedding).alias("__dv")).crossJoin(F.broadcast(t))
    out = both.select(key, F.col("__topic").alias(topic), cosine(F.col("__dv"), F.col("__tv")).alias("confidence"))
    return out.where(F.col("confidence") >= least)
