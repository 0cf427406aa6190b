"""Line dedup by prefix doubling over line ids.

A text's lines that are not blank form a sequence; a suffix of it begins at every line. A
suffix's name at depth n is a 128-bit digest of its first n lines: at depth 1 that of the line, at
depth n, for h < n <= 2h, that of n and of the names at depth h of the suffix itself and of the
one n - h lines on, two blocks that overlap and cover all n lines. Suffixes that share a name are
an interval of the suffix array whose common prefix has n lines or more; its first member, in the
order of (id, line), is the earliest copy. Each round names the suffixes whose blocks are both in
intervals of the round before, all others being unique, and one shuffle finds the intervals of 2h
lines, on which the next round builds, together with those of the lengths between.

The result: a run of consecutive lines with at least MIN_WORDS words in all, of any length, which
also starts earlier is a later copy, and its lines go; a short line goes only within a run. It is
enough to name runs of up to MIN_WORDS lines: a line has a word at least, so that every line of
a longer repeated run lies in a repeated run of MIN_WORDS lines. Rounds end there.

Lines are hashed once and stored. Common names are joined by broadcast, the others by a shuffle, so
that no task gets all copies of a line.

Blank lines stay. Null texts have no lines and stay null. Rows without id come last in the order.
Rows with one id are told apart by their text; rows that repeat both get one and the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import blocks, join_groups, prepare, scratch, table, utf8
from lattice.llm.kernels import split_spans

MIN_WORDS = 8
_KEY = ["__id", "__h"]
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.md5(p).digest() for p in parts), np.int64).reshape(-1, 2)


def _lists(flat: np.ndarray, per: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(flat, kind))


def _named_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (third column): words, words before it and both halves of the name of each line that is not blank."""
    for batch in batches:
        for b in blocks(batch, "__text"):
            data, off = utf8(b.column("__text"))
            breaks = np.flatnonzero(data == 10)
            starts, ends = np.sort(np.append(off[:-1], breaks + 1)), np.sort(np.append(breaks, off[1:]))
            owner = np.repeat(np.arange(b.num_rows), 1 + np.diff(np.searchsorted(breaks, off)))
            first, _, _ = split_spans(data, off, _BREAK)
            words = np.searchsorted(first, ends) - np.searchsorted(first, starts)
            ink = np.flatnonzero(words)
            raw = data.tobytes()
            names = _digests(raw[i:j] for i, j in zip(starts[ink].tolist(), ends[ink].tolist(), strict=True))
            before = np.searchsorted(first, starts[ink]) - np.searchsorted(first, off[owner[ink]])
            per = np.bincount(owner[ink], minlength=b.num_rows)
            some = pa.array(np.flatnonzero(per))
            per = per[per > 0]
            cols = [_lists(words[ink], per, pa.int32()), _lists(before, per, pa.int64()), _lists(names[:, 0], per, pa.int64()), _lists(names[:, 1], per, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), *cols], [*_KEY, "__words", "__before", "__a", "__b"])


def _longer(h: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text's suffixes that share a name at depth h: the names at depths h + 1 to 2h, of runs that a line with too few words is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, bool]] = []
            names: list[bytes] = []
            for k, suffixes in enumerate(b.column(2).to_pylist()):
                at = {s["__seq"]: s for s in suffixes}
                for p, s in at.items():
                    for n in range(h + 1, 2 * h + 1):
                        t = at.get(p + n - h)
                        if t is None or not (s["__short"] or t["__short"]):
                            continue
                        words = t["__before"] + t["__words"] - s["__before"]
                        if n == 2 * h or words >= least:
                            rows.append((k, p, n, words, s["__before"]))
                            names.append(np.array([n, s["__a"], s["__b"], t["__a"], t["__b"]], np.int64).tobytes())
            own = np.array(rows, np.int64).reshape(-1, 5)
            name, at_ = _digests(iter(names)), pa.array(own[:, 0])
            cols = [pa.array(own[:, 1], pa.int32()), pa.array(own[:, 2], pa.int32()), pa.array(own[:, 3], pa.int32()), pa.array(own[:, 4], pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at_), b.column(1).take(at_), *cols], [*_KEY, "__seq", "__n", "__words", "__before", "__a", "__b"])

    return run


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """__id, __h (the text's hash), __seq and __n: the later copies of runs of __n lines, from line __seq of those that are not blank."""
    spark = docs.sparkSession
    root = scratch(spark, "lines")
    kind = docs.schema[id_col].dataType.simpleString()
    place = F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("b"), F.col("__h").alias("c"), F.col("__seq").alias("d"))

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def intervals(suffixes: DataFrame, name: str) -> DataFrame:
        """The suffixes whose name another has too, and __later: whether an earlier one has it."""
        found = suffixes.groupBy("__a", "__b").agg(F.min(place).alias("__first"), F.count("*").alias("__size")).where("__size > 1")
        both = join_groups(suffixes, saved(found, f"intervals-{name}"), ["__a", "__b"])
        return both.withColumn("__later", ~place.eqNullSafe(F.col("__first"))).drop("__first")

    source = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), F.col(text_col).alias("__text"))
    stored = saved(source.mapInArrow(_named_lines, f"__id {kind}, __h long, __words array<int>, __before array<long>, __a array<long>, __b array<long>"), "named")
    lines = stored.select(*_KEY, F.posexplode(F.arrays_zip("__words", "__before", "__a", "__b")).alias("__seq", "__x")).select(*_KEY, "__seq", "__x.*")
    shared = saved(intervals(lines, "1"), "shared-1")
    gone = [shared.where(F.col("__later") & (F.col("__words") >= min_words)).select(*_KEY, "__seq", F.lit(1).alias("__n"))]
    # suffixes of the texts in which a line with too few words is shared
    brief = shared.where(F.col("__words") < min_words).select(*_KEY).distinct().withColumnsRenamed({"__id": "__i", "__h": "__g"})
    suffixes = shared.join(brief, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g")), "left_semi")
    suffixes = suffixes.withColumn("__short", F.col("__words") < min_words)
    h = 1
    while h < min_words:
        texts = suffixes.groupBy(*_KEY).agg(F.collect_set(F.struct("__seq", "__words", "__before", "__short", "__a", "__b")).alias("__s"))
        named = saved(texts.mapInArrow(_longer(h, min_words), f"__id {kind}, __h long, __seq int, __n int, __words int, __before long, __a long, __b long"), f"named-{2 * h}")
        shared = saved(intervals(named, str(2 * h)), f"shared-{2 * h}")
        gone.append(shared.where(F.col("__later") & (F.col("__words") >= min_words)).select(*_KEY, "__seq", "__n"))
        suffixes = shared.where(F.col("__n") == 2 * h).withColumn("__short", F.lit(True))
        h *= 2
    out = gone[0]
    for part in gone[1:]:
        out = out.unionByName(part)
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies taken out of the text, and __n_lines and __n_removed (of an input column of that name, the new one stays)."""
    names = docs.columns
    plain = [f"__c{k}" for k in range(len(names))]
    source = docs.toDF(*plain)
    own_id, own_text = plain[names.index(id_col)], plain[names.index(text_col)]
    at = names.index(text_col)
    gone = repeated_runs(source, own_id, own_text, min_words).groupBy(*_KEY).agg(F.collect_set(F.struct("__seq", "__n")).alias("__runs"))
    keyed = source.withColumn("__key", F.xxhash64(own_text))
    both = keyed.join(gone, keyed[own_id].eqNullSafe(gone["__id"]) & (F.col("__key") == F.col("__h")), "left").select(*plain, "__runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, removed = [], [], []
            for text, out in zip(b.column(at).to_pylist(), b.column(len(plain)).to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                inked = [k for k, p in enumerate(parts) if p.strip(" \t\x0b\f\r")]
                drop = {inked[k] for x in out or () for k in range(x["__seq"], x["__seq"] + x["__n"])}
                lines.append(len(inked))
                removed.append(len(drop))
                texts.append("\n".join(p for k, p in enumerate(parts) if k not in drop) if drop else text)
            cols = [b.column(k) for k in range(len(plain))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*plain, "__n_lines", "__n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    done = both.mapInArrow(run, f"{schema}, __n_lines long, __n_removed long")
    stay = [F.col(p).alias(n) for p, n in zip(plain, names, strict=True) if n not in ("__n_lines", "__n_removed")]
    return done.select(*stay, "__n_lines", "__n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def kept_sql(docs: str = "documents", min_words: int = MIN_WORDS) -> str:
    """CTEs ending in kept(doc_id, n_lines, n_removed, text), for ids that are unique and not null.

    From the definition, for any length: pairs of equal lines, the later of which follow one another
    at one distance, are a maximal common run; with enough words the later copy goes.
    """
    return f"""
every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {docs}),
counted AS (SELECT doc_id, line, no, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS words FROM every),
inked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM counted WHERE words > 0),
pairs AS (SELECT x.doc_id, x.i, x.words, y.doc_id AS other, x.i - y.i AS shift FROM inked x JOIN inked y ON x.line = y.line AND (y.doc_id, y.i) < (x.doc_id, x.i)),
stretches AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS stretch FROM pairs),
runs AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM stretches GROUP BY doc_id, other, shift, stretch HAVING sum(words) >= {min_words}),
later AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM runs),
marked AS (SELECT c.doc_id, c.no, c.line, c.words > 0 AS ink, l.i IS NOT NULL AS gone FROM counted c LEFT JOIN inked k ON c.doc_id = k.doc_id AND c.no = k.no LEFT JOIN later l ON k.doc_id = l.doc_id AND k.i = l.i),
summed AS (SELECT doc_id, count(*) FILTER (ink) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id),
kept AS (SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text FROM {docs} d LEFT JOIN summed s ON d.doc_id = s.doc_id)"""


SQL = f"WITH {kept_sql()} SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept"
