"""Full-text scoring, hybrid search and chunking.

The inverted index is a frame (bucket, term, doc, tf), stored by bucket of the term's hash; a query's
terms select from it, so that scoring reads the buckets of those terms alone. Without an index
the texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.operators.vectors import fuse, knn, ranked

_TERM = "[^a-z0-9]+"
#: A chunk's least and greatest length in characters.
CHUNK_LEAST, CHUNK_MOST = 200, 1500
#: Folders of a stored index.
BUCKETS = 64
#: Characters that make the full-text index drop a query word.
_OPERATORS = r"[(){}\[\]+\-~*\"\\]"


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), _TERM), lambda t: t != "")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, term, key, tf; to be stored by bucket."""
    counted = docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return counted.select(bucket_of(F.col("term")).alias("bucket"), "term", key, "tf")


def postings(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """term, key and tf of some terms; of a stored index only their buckets are read."""
    spark = index.sparkSession
    buckets = sorted({r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket_of(F.col("t"))).collect()})
    return index.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(wanted))).drop("bucket")


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, in order, less the words that hold an index operator."""
    words = [w for w in query.split() if not re.search(_OPERATORS, w)]
    return list(dict.fromkeys(t for w in words for t in re.split(_TERM, w.lower()) if t))


def score_terms(index: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """key and score: the sum of tf * ln((N + 1) / (df + 1)) over ``index`` (term, key, tf); ``total`` is one row with N as ``__docs``."""
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = frequency.crossJoin(total).select("term", F.log((F.col("__docs") + 1) / (F.col("df") + 1)).alias("idf"))
    weights = F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))))
    return index.join(F.broadcast(idf), "term").groupBy(key).agg(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x["w"]).alias("score"))


def tfidf(docs: DataFrame, query: str, n: int, *, key: str = "id", text: str = "text", where: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """The n documents of greatest sum of tf * ln((N + 1) / (df + 1)) over the query's terms; filtered before the limit."""
    wanted = query_terms(query)
    source = docs if where is None else docs.where(where)
    if not wanted:
        return source.select(key).limit(0).withColumn("score", F.lit(0.0))
    index = docs.select(key, F.explode(terms(F.col(text))).alias("term")).where(F.col("term").isin(wanted)).groupBy("term", key).agg(F.count("*").alias("tf")) if index is None else postings(index, wanted)
    scored = score_terms(index, docs.agg(F.count("*").alias("__docs")), key)
    if where is not None:
        scored = scored.join(source.select(key), key, "left_semi")
    return scored.orderBy(F.desc("score"), key).limit(n)


def hybrid(docs: DataFrame, query: str, query_vector: Sequence[float], n: int, *, key: str = "id", text: str = "text", embedding: str = "embedding", where: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """Vector and full-text top 3 n, fused; the vector list alone where no word matches. id, rank, score."""
    near = knn(docs.select(key, embedding) if where is None else docs.where(where).select(key, embedding), query_vector, 3 * n, embedding=embedding, key=key)
    found = tfidf(docs, query, 3 * n, key=key, text=text, where=where, index=index)
    v = ranked(near, [F.desc("score"), F.col(key)]).select(F.lit(0).alias("list_id"), key, "rank")
    t = ranked(found, [F.desc("score"), F.col(key)]).select(F.lit(1).alias("list_id"), key, "rank")
    both = fuse(v.unionByName(t), key=key).limit(n)
    return ranked(both, [F.desc("score"), F.col(key)])


def split_text(text: str | None, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> list[str]:
    """Chunks of at most ``most`` characters, of at least ``least`` where that is possible.

    Cut after a paragraph, else a line, a sentence, a word, else anywhere; no character but white
    space at the cuts is lost.
    """
    out: list[str] = []
    rest = (text or "").strip()
    while len(rest) > most:
        cut = -1
        for mark in ("\n\n", "\n", ". ", " "):
            at = rest.rfind(mark, least, most - len(mark.strip()))
            if at >= least:
                cut = at + len(mark.strip() and ".")
                break
        if cut <= 0:
            cut = most
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    if rest:
        out.append(rest)
    return [c for c in out if c]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_column(texts: pd.Series) -> pd.Series:
    return texts.map(split_text)


def chunks(docs: DataFrame, key: str, text: str, prefix: str = "chunk_") -> DataFrame:
    """key, chunk_index, chunk_id (``{key}::chunk_{i}``), text and total_chunks of every document."""
    parts = docs.select(key, split_column(F.col(text)).alias("__parts"))
    out = parts.select(key, F.size("__parts").cast("bigint").alias("total_chunks"), F.posexplode("__parts").alias("chunk_index", "text"))
    return out.select(key, F.col("chunk_index").cast("bigint"), F.concat(F.col(key).cast("string"), F.lit(f"::{prefix}"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "total_chunks")


def proportional_spans(docs: DataFrame, key: str, length: str, chapters: DataFrame, start: str, duration: str) -> DataFrame:
    """For each chapter the character span that its time span has of the text: begin, end (exclusive)."""
    from pyspark.sql.window import Window

    both = chapters.join(docs.select(key, length, duration), key)
    w = Window.partitionBy(key).orderBy(start)
    nxt = F.coalesce(F.lead(start).over(w), F.col(duration))
    at = lambda x: F.least(F.greatest((x / F.col(duration) * F.col(length)).cast("bigint"), F.lit(0)), F.col(length))
    return both.where(F.col(duration) > 0).withColumn("begin", at(F.col(start))).withColumn("end", at(nxt))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _embed(texts: pd.Series) -> pd.Series:
    return texts.map(hash_embedding)


def hash_embedding(text: str | None, dim: int = 384) -> list[float]:
    """A deterministic unit vector of hashed words and word pairs; zero for a text without words."""
    import zlib

    import numpy as np

    out = np.zeros(dim)
    words = [w for w in re.split(_TERM, (text or "").lower()) if w]
    for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
        h = zlib.crc32(w.encode())
        out[h % dim] += 1 if h >> 31 else -1
    size = float(np.sqrt((out * out).sum()))
    return (out / size if size else out).astype("float32").tolist()


def embed(docs: DataFrame, text: str, into: str = "embedding") -> DataFrame:
    """The offline embedder. Any pandas UDF from text to array<float> can stand in its place."""
    return docs.withColumn(into, _embed(F.col(text)))
