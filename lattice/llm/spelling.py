"""Spelling variants: words that differ by one letter, found in a trie over letter-group counts.

Letters are dealt to GROUPS groups by code point; a word's counts by group, in order, are its path in
the trie. One inserted, deleted or replaced letter is at most one surplus and one deficit along that
path, so a search carries a budget of one each and leaves every branch that would overspend it.

The upper trie is walked as joins of the words with the table of its nodes, down to nodes of at most
NODE words; nodes that do not exist end a walk. Below, one task holds one node: its words sorted by
path and the words that arrived as queries, which go depth first through the ranges together. What
is left at a leaf is verified letter by letter. Nodes with more words than NODE at the last level, and nodes
that more than QUERIES words arrive at, are dealt to several tasks.

Defined results: null texts have no words; a null id is the empty text in the digest; repeated rows
count again. ``variants`` wants each word once and drops null words and rows without a count. Words of any
length and any letters are compared whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import prepare, scratch, table

#: Groups of letters, in the order of the trie's levels: code points by their remainder; the frequent Latin ones lead.
GROUPS = 13
ORDER = (10, 6, 1, 12, 11, 7, 4, 8, 9, 5, 3, 2, 0)
#: Words of a node that is searched in one task, queries that a task takes to it, words of a range that is compared directly, pairs verified at once.
NODE, QUERIES, LEAF, PAIRS = 8192, 65536, 12, 1 << 17
#: Letters up to which words are compared in a matrix.
WIDTH = 64
#: A form has at least this many times the word's occurrences.
MORE = 5

_LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", letters: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word and n: runs of Latin letters with A to Z in lower case, of some length and frequency.

    A run whose digest with its document's id is divisible by ``every`` loses one letter, as a slip of the pen would.
    """
    # long enough runs alone leave the text; those without accents are lower-cased as bytes
    found = F.regexp_extract_all(F.col(text), F.lit(f"{_LETTERS}{{{letters},}}+"), F.lit(0))
    own = F.when(F.octet_length("raw") == F.length("raw"), F.lower("raw")).otherwise(F.translate("raw", _UPPER, _LOWER))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.explode(found).alias("raw")).select("d", own.alias("run"))
    digest = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = digest.select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def paths(word: Column) -> Column:
    """The counts of a word's letters by group, in the order of the trie's levels."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c) % GROUPS)
    return F.transform(F.array(*map(F.lit, ORDER)), lambda g: F.size(F.filter(codes, lambda c: c == g)))


def _nodes(words: DataFrame) -> DataFrame:
    """level, node and n of all prefixes of paths; the root is the empty node at level 0."""
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(GROUPS)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice("path", 1, k), ".").alias("node")))
    return words.select(F.explode(prefixes).alias("p")).groupBy("p.level", "p.node").agg(F.count("*").alias("n"))


def _walk(words: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """word, n, node, level, up and down: each word at each node of at most NODE words that its budget reaches; up and down are what it has spent."""
    inner = nodes.where((F.col("n") > NODE) & (F.col("level") < GROUPS)).select(F.col("level").alias("l"), F.col("node").alias("at"))
    now = words.select("word", "n", "path", F.lit("").alias("node"), F.lit(0).alias("level"), F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(deepest < 0).alias("done"))
    for k in range(deepest + 1):
        own = F.col("path")[k]
        step = lambda by, up, down: F.struct((own + by).alias("count"), (F.col("up") + up).alias("up"), (F.col("down") + down).alias("down"))
        steps = F.filter(F.array(step(0, 0, 0), step(1, 1, 0), step(-1, 0, 1)), lambda s: (s["up"] <= 1) & (s["down"] <= 1) & (s["count"] >= 0))
        stay = F.array(F.struct(F.lit(0).alias("count"), "up", "down"))
        out = now.withColumn("s", F.explode(F.when(F.col("done"), stay).otherwise(steps)))
        child = F.when(F.col("done"), F.col("node")).when(F.lit(k == 0), F.col("s.count").cast("string")).otherwise(F.concat_ws(".", "node", F.col("s.count").cast("string")))
        out = out.select("word", "n", "path", child.alias("node"), F.when(F.col("done"), F.col("level")).otherwise(k + 1).alias("level"), "s.up", "s.down", "done")
        # children that exist; walks that are done keep keys of their own, that match nothing and lie apart
        there = nodes.where(F.col("level") == k + 1).select(F.col("node").alias("at"), ((F.col("n") <= NODE) | (F.lit(k + 1) == GROUPS)).alias("small"))
        parents = inner.where(F.col("l") == k).select("at")
        there = there.join(parents, F.substring_index(there["at"], ".", k) == parents["at"], "left_semi") if k else there
        out = out.withColumn("k", F.when(F.col("done"), F.concat(F.lit("#"), "word")).otherwise(F.col("node")))
        both = out.join(there, out["k"] == there["at"], "left").where(F.col("done") | F.col("at").isNotNull())
        now = both.select("word", "n", "path", "node", "level", "up", "down", (F.col("done") | F.col("small")).alias("done"))
    return now.drop("path", "done")


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, offsets)."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])


class _Words:
    """Words as a padded matrix, their lengths and their paths."""

    def __init__(self, words: pa.Array, width: int) -> None:
        self.words, (flat, off) = words, _codes(words)
        n, self.length = len(words), np.diff(off)
        row = np.repeat(np.arange(n), self.length)
        place = np.argsort(ORDER)
        self.path = np.bincount(row * GROUPS + place[flat % GROUPS], minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)
        self.matrix = np.zeros((n, width + 2), np.uint8 if not len(flat) or flat.max() < 256 else np.uint32)
        col = np.arange(len(flat)) - off[row]
        self.matrix[row[col < width], col[col < width]] = flat[col < width]


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def _verified(q: _Words, w: _Words, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Which of the pairs (a of q, b of w) are near."""
    la, lb = q.length[a], w.length[b]
    out = np.zeros(len(a), bool)
    short = np.minimum(la, lb) < width - 1
    for i in np.flatnonzero(~short & (np.abs(la - lb) <= 1)):
        out[i] = near(q.words[int(a[i])].as_py(), w.words[int(b[i])].as_py())
    i = np.flatnonzero(short & (la == lb))
    out[i] = (q.matrix[a[i]] != w.matrix[b[i]]).sum(1) == 1
    i = np.flatnonzero(short & (np.abs(la - lb) == 1))
    x, y = q.matrix[a[i]], w.matrix[b[i]]
    swap = (la > lb)[i][:, None]
    less, more = np.where(swap, y, x), np.where(swap, x, y)
    first = np.argmax(less != more, axis=1)
    moved = less[:, :-1] != more[:, 1:]
    out[i] = ~(moved & (np.arange(moved.shape[1]) >= first[:, None])).any(1)
    return out


def _descend(w: np.ndarray, q: np.ndarray, up: np.ndarray, down: np.ndarray, level: int, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Depth first through the trie of the sorted paths ``w``, all queries at once; ``emit`` gets pairs (query, word) within the budget."""

    def go(lo: int, hi: int, at: int, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        if hi - lo <= LEAF or at == GROUPS:
            step = max(1, PAIRS // (hi - lo))
            for k in range(0, len(rows), step):
                part = slice(k, k + step)
                more = w[None, lo:hi, at:] - q[rows[part], None, at:]
                fits = (np.maximum(more, 0).sum(2) + up[part, None] <= 1) & (np.maximum(-more, 0).sum(2) + down[part, None] <= 1)
                i, j = np.nonzero(fits)
                emit(rows[part][i], j + lo)
            return
        counts = w[lo:hi, at]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1, [hi - lo]])
        own = q[rows, at]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            by = counts[a] - own
            keep = (by == 0) | ((by == 1) & (up == 0)) | ((by == -1) & (down == 0))
            if keep.any():
                go(lo + a, lo + b, at + 1, rows[keep], up[keep] + (by[keep] == 1), down[keep] + (by[keep] == -1))

    if len(w):
        go(0, len(w), level, np.arange(len(q)), up, down)


_FOUND = "word string, n_near bigint, near string, near_n bigint"


def _search(group: pa.Table) -> pa.Table:
    """One node: for each query its number of near words there and the most frequent of them."""
    own = group.filter(group.column("own"))
    asked = group.filter(group.column("asks"))
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
    if not own.num_rows or not asked.num_rows:
        return empty
    text = lambda t: t.column("word").combine_chunks().cast(pa.string())
    width = int(min(WIDTH, max(pc.max(pc.utf8_length(text(own))).as_py(), pc.max(pc.utf8_length(text(asked))).as_py()) + 2))
    w, q = _Words(text(own), width), _Words(text(asked), width)
    order = np.lexsort(w.path.T[::-1])
    up, down = (asked.column(c).to_numpy().astype(np.int16) for c in ("up", "down"))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(i: np.ndarray, j: np.ndarray) -> None:
        j = order[j]
        ok = _verified(q, w, i, j, width)
        found.append((i[ok], j[ok]))

    _descend(w.path[order], q.path, up, down, int(group.column("level")[0].as_py()), emit)
    i, j = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
    if not len(i):
        return empty
    n = own.column("n").to_numpy()
    # ranks in code-point order, which is the order of the bytes
    rank = np.empty(len(n), np.int64)
    rank[np.array(sorted(range(len(n)), key=w.words.to_pylist().__getitem__))] = np.arange(len(n))
    by = np.lexsort((rank[j], -n[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    counts = np.diff(np.concatenate([first, [len(i)]]))
    return pa.table({"word": q.words.take(pa.array(i[first])), "n_near": pa.array(counts, pa.int64()), "near": w.words.take(pa.array(j[first])), "near_n": pa.array(n[j[first]], pa.int64())})


def near_words(words: DataFrame, root: str) -> DataFrame:
    """word, n_near, near and near_n, for words (word, n; stored below ``root``) that have a near word: how many, and the most frequent (ties: the least in code-point order)."""
    spark = words.sparkSession
    words.select("word", "n", paths(F.col("word")).alias("path")).write.parquet(f"{root}/paths")
    words = spark.read.parquet(f"{root}/paths")
    _nodes(words).write.parquet(f"{root}/nodes")
    nodes = spark.read.parquet(f"{root}/nodes")
    deepest = nodes.where((F.col("n") > NODE) & (F.col("level") < GROUPS)).agg(F.max("level")).first()[0]
    _walk(words, nodes, -1 if deepest is None else deepest).write.parquet(f"{root}/walks")
    walks = spark.read.parquet(f"{root}/walks")
    mine = (F.col("up") == 0) & (F.col("down") == 0)
    size = walks.groupBy("node").agg(F.ceil(F.count_if(mine) / NODE).cast("int").alias("blocks"), F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    # a node's words lie in one block each and in all parts; queries lie in one part each and in all blocks
    both = walks.join(size, "node")
    block, part = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts")).cast("int")
    cell = lambda b, p: F.struct(b.alias("block"), p.alias("part"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cells = F.transform(upto("blocks"), lambda b: cell(b, part))
    cells = F.when(mine, F.array_union(cells, F.transform(upto("parts"), lambda p: cell(block, p)))).otherwise(cells)
    dealt = both.withColumn("c", F.explode(cells)).select("node", "level", "word", "n", "up", "down", "c.block", "c.part", (mine & (F.col("c.block") == block)).alias("own"), (F.col("c.part") == part).alias("asks"))
    found = dealt.groupBy("node", "block", "part").applyInArrow(_search, _FOUND)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", "best.near_n")


def roots(forms: DataFrame, most: int, root: str) -> DataFrame:
    """word and root of words (word, form) that have a form: chains are followed by doubling, which ends since each form has MORE times the occurrences, of which ``most`` is the largest."""
    spark, steps = forms.sparkSession, math.ceil(math.log2(max(1.0, math.log(max(most, 2), MORE))))
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{root}/forms-0")
    for k in range(steps):
        now = spark.read.parquet(f"{root}/forms-{k}")
        on = now.select(F.col("word").alias("mid"), F.col("root").alias("further"))
        now.join(on, now["root"] == on["mid"], "left").select("word", F.coalesce("further", "root").alias("root")).write.parquet(f"{root}/forms-{k + 1}")
    return spark.read.parquet(f"{root}/forms-{steps}")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all ``words`` (word, n), each there once."""
    spark = words.sparkSession
    prepare(spark)
    root = scratch(spark, "spelling")
    words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("bigint")).write.parquet(f"{root}/words")
    words = spark.read.parquet(f"{root}/words")
    near_words(words, root).write.parquet(f"{root}/near")
    found = words.join(spark.read.parquet(f"{root}/near"), "word", "left")
    enough = F.col("near_n") >= MORE * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(found.where("form IS NOT NULL"), most, root)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: The digest is the checksum of the bytes, by eight shifts for each; pairs of near words share what is left when one letter goes.
SQL = """
WITH RECURSIVE docs AS (SELECT DISTINCT doc_id, lower_run AS run, count(*) OVER (PARTITION BY doc_id, lower_run) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_run FROM documents) WHERE length(lower_run) >= 6),
shifts AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM range(0, 256) r(b)),
digests AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(doc_id || ':' || run))), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT)) AS h FROM docs, shifts),
slips AS (SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM digests),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.at WHERE e.form IS NULL
"""
