"""Quality classifier: zstandard dictionaries of good and bad labelled text.

A text is cut into blocks of BLOCK bytes; each block is compressed plainly, with
the dictionary of good text and with that of bad text. The difference of the two sizes,
divided by the plain size, says which kind the text resembles; so does the ratio of the plain
size to the length, for text that compresses better than either dictionary can show. A
logistic curve, fitted on labelled rows that the dictionaries have not seen, turns these
normalised sizes into a probability of label 1. Blocks make the measure independent of length.

Learning reads at most TRAIN_ROWS labelled rows of each label, drawn by a hash of the id, whole, as
many as fit TRAIN_BYTES for each label (the documented bound of the training sample: a text that
does not fit is left out, none is cut). Of rows that share an id, one is learnt, that of the least
text hash. Scores read whole texts. Empty and null texts get the score of zero evidence (the label's base rate, within 0
to 1). With labels of one kind only, every score is that label; with none, 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import blocks, held_out, prepare, table, utf8

BLOCK, DICT_BYTES, LEVEL = 1024, 112_000, 3
TRAIN_ROWS, TRAIN_BYTES = 3000, 16 << 20
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of (bias, difference, plain ratio, size of the difference)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    base: float


def _sizes(pieces: list[bytes], how: list[zstandard.ZstdCompressor]) -> np.ndarray:
    return np.array([[len(c.compress(p)) for c in how] for p in pieces], np.float64).reshape(len(pieces), len(how))


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    args = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    kinds = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
    for k in kinds:
        k.precompute_compress(level=LEVEL)
    return [zstandard.ZstdCompressor(**args), *(zstandard.ZstdCompressor(dict_data=k, **args) for k in kinds)]


def features(texts: list[bytes], how: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """[texts, 3]: bytes, normalised difference (good's size less bad's), plain ratio; zeros for an empty text."""
    pieces, owner = [], []
    for k, t in enumerate(texts):
        for at in range(0, len(t), BLOCK):
            pieces.append(t[at : at + BLOCK])
            owner.append(k)
    out = np.zeros((len(texts), 3))
    if not pieces:
        return out
    s = _sizes(pieces, how)
    total = np.zeros((len(texts), 3))
    np.add.at(total, owner, s)
    n = np.array([len(t) for t in texts], np.float64)
    some = n > 0
    out[some, 0] = n[some]
    out[some, 1] = (total[some, 2] - total[some, 1]) / total[some, 0]
    out[some, 2] = np.log(total[some, 0] / (n[some] + 16))
    return out


def _design(x: np.ndarray) -> np.ndarray:
    d, r = x[:, 1] * 10, x[:, 2]
    some = x[:, 0] > 0
    return np.column_stack([np.ones(len(x)), d, np.where(some, np.minimum(r + 1.5, 0), 0), np.abs(d) * 0.1])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for a lightly penalised logistic regression."""
    a = _design(x)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = _logistic(a @ w)
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary (content and entropy tables); with too little text, the text itself."""
    pieces = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICT_BYTES:]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Learns from the texts of ``docs`` whose id ``labels`` marks 0 or 1 (of repeated marks the largest counts)."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    counts = {r["__y"]: r["n"] for r in marks.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    keep = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    bound = F.when(F.col("__y") == 0, _share(rows, counts.get(0, 0))).otherwise(_share(rows, counts.get(1, 0)))
    chosen = marks.where(keep < bound)
    part = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.xxhash64(text_col).alias("__x")).where(F.col("__t").isNotNull() & (F.col("__t") != ""))
    # about 2 x rows ids, whatever the tables' sizes
    sizes = part.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min(F.struct("__x", F.octet_length("__t").alias("n"))).alias("m"))
    drawn = sizes.select("__id", "__y", "m.*", F.xxhash64("__id", F.lit(7)).alias("h")).orderBy("h", "__id").collect()
    left = {0: size, 1: size}
    fits = []
    for r in drawn:
        if r["n"] <= left[r["__y"]]:
            left[r["__y"]] -= r["n"]
            fits.append((r["__id"], r["__x"], r["__y"], r["h"]))
    kind, label_kind = labels.schema[id_col].dataType.simpleString(), labels.schema[label_col].dataType.simpleString()
    named = docs.sparkSession.createDataFrame(fits, f"__id {kind}, __x long, __y {label_kind}, h long")
    got = part.join(F.broadcast(named), ["__id", "__x"]).dropDuplicates(["__id"]).select("__y", F.encode("__t", "utf-8").alias("t"), "h").toArrow()
    y = np.array(got.column("__y").to_pylist(), np.int64)
    texts = got.column("t").to_pylist()
    order = np.argsort(np.array(got.column("h").to_pylist(), np.int64), kind="stable")
    y, texts = y[order], [texts[k] for k in order]
    base = float((counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", (), float(y[0]) if len(y) else 0.5)
    seen = {0: 0, 1: 0}
    first = np.zeros(len(y), bool)
    for k, v in enumerate(y.tolist()):
        first[k] = seen[v] % 2 == 0
        seen[v] += 1
    good, bad = (_dictionary([t for t, f, v in zip(texts, first, y, strict=True) if f and v == want]) for want in (1, 0))
    rest = [k for k in range(len(y)) if not first[k]] or list(range(len(y)))
    x = features([texts[k] for k in rest], _compressors(good, bad))
    weights = _fit_curve(x, y[rest])
    # the sample holds each label to its own bound: back to the labels' true shares
    share = y[rest].mean()
    weights[0] += np.log(base / (1 - base)) - np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return Model(good, bad, tuple(weights.tolist()), base)


def _share(rows: int, n: int) -> int:
    return int((1 << 30) * min(1.0, rows / max(n, 1)))


def score_texts(texts: list[bytes], model: Model, how: list[zstandard.ZstdCompressor] | None) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.base)
    x = features(texts, how)
    p = _logistic(_design(x) @ np.array(model.weights))
    return np.where(x[:, 0] > 0, p, model.base)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, a probability of label 1, for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        how = _compressors(m.good, m.bad) if m.weights else None
        for batch in batches:
            for b in blocks(batch):
                data, off = utf8(b.column("text"))
                raw = data.tobytes()
                texts = [raw[off[k] : off[k + 1]] for k in range(len(off) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(texts, m, how))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
