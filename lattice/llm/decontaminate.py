"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are folded as for near duplicates. Every SEED consecutive words of a test item are a seed
(an item of fewer words is one seed). One pass over the texts finds all seeds and keeps, of each
text, the passages around them; a seed's document frequency follows from those. A seed is rare if
at most RARE of all documents have it; of COVER seeds in a row the rarest one is kept in any case,
so that an item copied into half the corpus is found as well: any unchanged stretch of
SEED + COVER - 1 words has a seed.

Copies with an edit in every few words have no such stretch. Three words of an item, in a row or with
one word between them left out, are a triple; a triple of the item that is also one of the text, with
or without a word between, is a weak hit, so that a word changed, added or lost within it does
no harm. Two weak hits of one item that do not overlap and lie on nearly one diagonal are
followed as a kept seed is, whatever their frequency.

A passage that holds a kept seed or two such hits of an item is aligned with the item by words: 2
for a match, -1 for another word or a gap. The score is that of the best local alignment by that
of the item with itself. A row for each (document, item) whose best passage scores LEAST or more.

Test items are read in blocks of at most BLOCK_BYTES of text by a hash; only a block's seeds are
broadcast, and there are as many passes as blocks. Items without words and null texts match
nothing; rows that share an id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import blocks, prepare, scratch, table, text_bytes, utf8
from lattice.llm.kernels import fold_case, gram_hashes, gram_starts, mix, span_hashes, word_spans

SEED, COVER, RARE, LEAST = 4, 4, 1e-3, 0.5
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22
#: The places, from a word on, of the triples that begin with it; how far two weak hits may be off one diagonal.
TRIPLES, DRIFT = ((0, 1, 2), (0, 1, 3), (0, 2, 3)), 3


@dataclass(frozen=True)
class Items:
    """A block's items: word hashes, every seed with the items that have it, every triple with its (item, place) pairs."""

    ids: list[object]
    words: list[np.ndarray]
    seeds: np.ndarray
    sizes: tuple[int, ...]
    owners: np.ndarray
    owner_at: np.ndarray
    triples: np.ndarray
    triple_at: np.ndarray
    triple_item: np.ndarray
    triple_place: np.ndarray

    def items_of(self, seed: int) -> np.ndarray:
        return self.owners[self.owner_at[seed] : self.owner_at[seed + 1]]


def folded_words(batch: pa.RecordBatch | pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the words before each text, and the words' first and last bytes in the column's buffer."""
    data, off = utf8(batch.column(column))
    data = fold_case(data)
    starts, ends, doc_words = word_spans(data, off)
    return span_hashes(data, starts, ends), doc_words, starts, ends


def triple_hashes(words: np.ndarray, doc_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all triples within texts, and the word each begins with; the hash is that of the three words alone."""
    found, at = [], []
    for pattern in TRIPLES:
        first, _ = gram_starts(doc_words, pattern[-1] + 1)
        h = words[first]
        for k in pattern[1:]:
            h = mix(h * np.uint64(0xD1342543DE82EF95) + words[first + k])
        found.append(h)
        at.append(first)
    return np.concatenate(found), np.concatenate(at)


def make_items(ids: list[object], texts: list[str | None]) -> Items:
    words, doc_words, _, _ = folded_words(pa.table({"t": pa.array(texts, pa.large_string())}), "t")
    own = [words[doc_words[i] : doc_words[i + 1]] for i in range(len(texts))]
    found, who = [], []
    for k, w in enumerate(own):
        if len(w):
            g = gram_hashes(w, min(SEED, len(w)))
            found.append(g)
            who.append(np.full(len(g), k))
    every, item = (np.concatenate(found), np.concatenate(who)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
    seeds, at = np.unique(every, return_inverse=True)
    order = np.lexsort((item, at))
    t, first = triple_hashes(words, doc_words)
    owner = np.searchsorted(doc_words, first, side="right") - 1
    triples, which = np.unique(t, return_inverse=True)
    by = np.lexsort((first, which))
    ends = lambda x, n: np.append(0, np.cumsum(np.bincount(x, minlength=n)))
    return Items(
        ids, own, seeds, tuple(sorted({min(SEED, len(w)) for w in own if len(w)})), item[order], ends(at, len(seeds)),
        triples, ends(which, len(triples)), owner[by].astype(np.int32), (first - doc_words[owner])[by].astype(np.int32),
    )


def weak_pairs(items: Items, words: np.ndarray, doc_words: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a weak hit lies that has a second one, and the item of each."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    t, at = triple_hashes(words, doc_words)
    hit = np.flatnonzero(may[t & np.uint64(len(may) - 1)])
    if not len(hit) or not len(items.triples):
        return none
    k = np.minimum(np.searchsorted(items.triples, t[hit]), len(items.triples) - 1)
    real = items.triples[k] == t[hit]
    k, at = k[real], at[hit][real]
    per = items.triple_at[k + 1] - items.triple_at[k]
    if not per.sum():
        return none
    row = np.repeat(np.arange(len(k)), per)
    entry = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(items.triple_at[k], per)
    word, item, place = at[row], items.triple_item[entry].astype(np.int64), items.triple_place[entry].astype(np.int64)
    doc = np.searchsorted(doc_words, word, side="right") - 1
    longest = np.fromiter(map(len, items.words), np.int64, len(items.words))
    # hits of one text and item by their places: with those up to a few ranks on
    order = np.lexsort((word, item, doc))
    word, item, place, doc = word[order], item[order], place[order], doc[order]
    good = np.zeros(len(word), bool)
    step = 1
    open_ = np.arange(len(word))
    while len(open_):
        open_ = open_[open_ + step < len(word)]
        other = open_ + step
        near = (doc[open_] == doc[other]) & (item[open_] == item[other]) & (word[other] - word[open_] <= longest[item[open_]] + DRIFT)
        open_, other = open_[near], other[near]
        ok = (word[other] - word[open_] >= 3) & (place[other] - place[open_] >= 3) & (np.abs((word[other] - place[other]) - (word[open_] - place[open_])) <= DRIFT)
        good[open_[ok]] = good[other[ok]] = True
        open_ = open_[~ok]
        step += 1
    return word[good], item[good]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """The best local alignment's share of the item's own score, and the place in the passage at which it ends."""
    best, end = 0, 0
    row = np.zeros(len(passage) + 1, np.int64)
    at = np.arange(len(passage) + 1)
    for w in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == w, 2, -1), row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + at) - at
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k
        row = new
    return best / (2 * len(item)), end


def find_passages(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """__id, __start (in words), __text of a passage, the __seeds in it and the __items with two weak hits in it."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        low = np.uint64((1 << _FILTER_BITS) - 1)
        may = np.zeros(1 << _FILTER_BITS, bool)
        may[it.seeds & low] = True
        weak = np.zeros(1 << _FILTER_BITS, bool)
        weak[it.triples & low] = True
        margin = max((len(w) for w in it.words), default=0) + 8
        for batch in batches:
            for b in blocks(batch, "__text"):
                words, doc_words, starts, ends = folded_words(b, "__text")
                where, which = [], []
                for n in it.sizes:
                    first, _ = gram_starts(doc_words, n)
                    if len(first):
                        g = gram_hashes(words, n)[first]
                        hit = np.flatnonzero(may[g & low])
                        k = np.minimum(np.searchsorted(it.seeds, g[hit]), len(it.seeds) - 1)
                        real = it.seeds[k] == g[hit]
                        where.append(first[hit][real])
                        which.append(k[real])
                at, item = weak_pairs(it, words, doc_words, weak)
                # seeds by their number, items of weak hits below zero
                w, s = np.concatenate([*where, at]), np.concatenate([*which, -1 - item])
                if not len(w):
                    continue
                order = np.argsort(w, kind="stable")
                w, s = w[order], s[order]
                doc = np.searchsorted(doc_words, w, side="right") - 1
                # passages: hits of one text no further apart than the margin
                new = np.append(True, (doc[1:] != doc[:-1]) | (w[1:] - w[:-1] > margin))
                cut = np.append(np.flatnonzero(new), len(w))
                data, off = utf8(b.column("__text"))
                raw = data.tobytes()
                rows = []
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    d = int(doc[a])
                    i, j = max(int(w[a]) - margin, int(doc_words[d])), min(int(w[z - 1]) + margin + SEED, int(doc_words[d + 1]))
                    found = np.unique(s[a:z])
                    rows.append((d, i - int(doc_words[d]), raw[starts[i] : ends[j - 1]].decode("utf-8", "replace"), found[found >= 0].tolist(), (-1 - found[found < 0]).tolist()))
                at = pa.array([r[0] for r in rows], pa.int64())
                lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), *lists], ["__id", "__start", "__text", "__seeds", "__items"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, f"__id {kind}, __start long, __text string, __seeds array<int>, __items array<int>")


def kept_seeds(items: Items, frequency: np.ndarray, docs: int) -> np.ndarray:
    """Which seeds lead to an alignment: the rare ones, and of COVER in a row the rarest."""
    keep = frequency <= max(1.0, RARE * docs)
    for w in items.words:
        if len(w):
            s = np.searchsorted(items.seeds, gram_hashes(w, min(SEED, len(w))))
            f = frequency[s]
            for at in range(max(1, len(s) - COVER + 1)):
                keep[s[at + int(f[at : at + COVER].argmin())]] = True
    return keep


def scored(passages: DataFrame, items: Items, keep: np.ndarray, least: float) -> DataFrame:
    """__id, __item (its place in ``items``), score and the words of the passage that it covers."""
    shared = passages.sparkSession.sparkContext.broadcast((items, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, ok = shared.value
        for b in batches:
            words, doc_words, _, _ = folded_words(b, "__text")
            rows = []
            for i, (seeds, more) in enumerate(zip(b.column("__seeds").to_pylist(), b.column("__items").to_pylist(), strict=True)):
                start = b.column("__start")[i].as_py()
                passage = words[doc_words[i] : doc_words[i + 1]]
                for k in sorted({int(x) for s in seeds if ok[s] for x in it.items_of(s)}.union(more)):
                    score, end = align(it.words[k], passage)
                    if score >= least:
                        rows.append((i, k, score, start + end))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int32()), (2, pa.float64()), (3, pa.int64())))], ["__id", "__item", "score", "end_word"])

    kind = passages.schema["__id"].dataType.simpleString()
    return passages.select("__id", "__start", "__text", "__seeds", "__items").mapInArrow(run, f"__id {kind}, __item int, score double, end_word long")


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score and end_word (where the copy ends, in words) of each leaked item."""
    spark = docs.sparkSession
    root = scratch(spark, "leaks")
    total = docs.count()
    tests = bench.select(F.col(item_col).alias("__item_id"), F.col(item_text).alias("__t"))
    n = max(1, math.ceil(text_bytes(tests, "__t") / block_bytes))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, score double, end_word long")
    for k in range(n):
        rows = tests.where(F.pmod(F.xxhash64("__item_id", "__t"), F.lit(n)) == k).orderBy("__item_id", "__t").toArrow()
        items = make_items(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        if not len(items.seeds):
            continue
        where = f"{root}/passages-{k}"
        find_passages(docs, items, id_col, text_col).write.mode("overwrite").parquet(where)
        found = spark.read.parquet(where)
        counted = found.select("__id", F.explode("__seeds").alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n")).toArrow()
        frequency = np.zeros(len(items.seeds), np.int64)
        frequency[counted.column("s").to_numpy()] = counted.column("n").to_numpy()
        hits = scored(found, items, kept_seeds(items, frequency, total), least)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], f"__item int, item_id {item_kind}")
        best = hits.groupBy("__id", "__item").agg(F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("b"))
        out = out.unionByName(best.join(F.broadcast(names), "__item").select(F.col("__id").alias("doc_id"), "item_id", F.col("b.score").alias("score"), (-F.col("b.e")).alias("end_word")))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("b")).select("doc_id", "item_id", "b.score", "b.end_word") if n > 1 else out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
