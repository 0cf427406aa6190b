"""Queries over stored indexes: each builds its index from whole tables below the checkpoint folder, changes it, and searches it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators import ann, chunking
from lattice.operators.postings import Postings
from lattice.plans.star import load
from lattice.plans.workload import Query, _floor6
from lattice.session import scratch

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


# --- vectors ----------------------------------------------------------------------------------------


def _index(spark: SparkSession, d: str) -> tuple[ann.VectorIndex, DataFrame]:
    """An index fitted on the even ids, to which the odd ones were added, and all vectors."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    index = ann.VectorIndex(spark, scratch(spark, "vectors")).build(e.where("vec_id % 2 = 0"), key="vec_id")
    index.add(e.where("vec_id % 2 = 1"), key="vec_id")
    return index, e


_NEAREST = """SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"""


@query(f"SELECT query_id, rank::INTEGER AS rank, vec_id, floor(s * 1e6 + 0.5) / 1e6 AS score FROM ({_NEAREST}) WHERE rank <= 10")
def knn_stored_all_lists(spark: SparkSession, d: str) -> DataFrame:
    """The stored index probed in all its lists: the exact neighbours of every id divisible by 50."""
    index, e = _index(spark, d)
    found = index.search(e.where("vec_id % 50 = 0"), 10, key="vec_id", probes=ann.MOST_LISTS)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), _floor6(F.col("score")).alias("score"))


@query()
def knn_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same with the calibrated number of lists: approximate neighbours."""
    index, e = _index(spark, d)
    found = index.search(e.where("vec_id % 50 = 0"), 10, key="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), _floor6(F.col("score")).alias("score"))


@query("SELECT vec_id AS query_id, 10::BIGINT AS neighbours, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def knn_stored_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the calibrated search finds 0.9 or more of the exact neighbours over all queries, beside each query's number of neighbours."""
    index, e = _index(spark, d)
    asked = e.where("vec_id % 50 = 0")
    found, exact = index.search(asked, 10, key="vec_id"), index.search(asked, 10, key="vec_id", probes=ann.MOST_LISTS)
    each = exact.groupBy("query_id").agg(F.count("*").alias("neighbours"))
    return each.crossJoin(F.broadcast(ann.recall(found, exact).select((F.col("recall") >= 0.9).alias("recall_reached"))))  # one row


# --- full text --------------------------------------------------------------------------------------


_TERMS = """t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM {docs}), p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('the', 'nation', 'der', 'la') GROUP BY 1, 2),
f AS (SELECT term, ln(((SELECT count(*) FROM {docs}) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM p GROUP BY 1) SELECT doc_id, floor(sum(tf * idf) * 1e6 + 0.5) / 1e6 AS score FROM p JOIN f USING (term) GROUP BY 1"""


def _postings(spark: SparkSession, d: str) -> Postings:
    """All documents, added in four changes and merged by tiers."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    p = Postings(spark, scratch(spark, "postings"))
    for k in range(4):
        p.add(docs.where(f"pmod(doc_id, 4) = {k}"), key="doc_id")
    p.compact(keep=1)
    return p


@query(f"WITH {_TERMS.format(docs='documents')}")
def fulltext_stored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every document that holds a query's term, from stored and merged postings."""
    return _postings(spark, d).scores("the nation der la", key="doc_id").select("doc_id", _floor6(F.col("score")).alias("score"))


@query(f"WITH kept AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'the ' || text ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src1'), {_TERMS.format(docs='kept')}")
def fulltext_stored_changed(spark: SparkSession, d: str) -> DataFrame:
    """The same after a source's documents were deleted and those of a language rewritten: tombstones and newer segments decide."""
    p = _postings(spark, d)
    docs = load(spark, d, "documents")
    p.delete(docs.where("source = 'src1'"), key="doc_id")
    new = docs.where("lang = 'en' AND NOT (source <=> 'src1')").select("doc_id", F.concat(F.lit("the "), "text").alias("text"))
    p.add(new, key="doc_id")
    return p.scores("the nation der la", key="doc_id").select("doc_id", _floor6(F.col("score")).alias("score"))


# --- chunks -----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, role, chr(10) || text AS body, 2 + length(text) - length(replace(text, chr(10), '')) AS n FROM conversations)
SELECT conv_id, turn::INTEGER + 1 AS raw_index, 'Conversation ' || conv_id || ' > ' || role AS heading, (2 + coalesce(sum(n) OVER w, 0))::INTEGER AS start_line, (1 + n + coalesce(sum(n) OVER w, 0))::INTEGER AS end_line,
'## ' || role || body AS text, (count(*) OVER (PARTITION BY conv_id) + 1)::INTEGER AS total FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
UNION ALL SELECT DISTINCT conv_id, 0, 'Conversation ' || conv_id, 1, 1, '# Conversation ' || conv_id, (count(*) OVER (PARTITION BY conv_id) + 1)::INTEGER FROM t""")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as markdown, a heading for each turn, cut at the headings: path, raw index and lines of every section."""
    c = load(spark, d, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n"), t["text"]))
    docs = c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.concat_ws("\n", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string")), F.array_join("turns", "\n")).alias("text"))
    return chunking.chunked(docs, "text", chunking.MARKDOWN, least=0, most=1 << 30)
