"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-cased letters for each language, partially in
every task, so that only a (language, bucket) table of fixed size leaves the executors. Its
log probabilities are broadcast: buckets x languages, at most MAX_LANGS of them. Scoring
gathers the rows of a text's n-grams and sums them, in blocks of texts.

At most TRAIN_ROWS labelled rows, drawn by a hash of the id, are learnt from (the documented
bound of the training sample); every text is scored whole. A text that is null or has no
letter gets ``und`` and score 0. Ties go to the first language in sorted order. Without any
labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import blocks, held_out, prepare, table
from lattice.llm.kernels import mix

BUCKETS = 1 << 15
#: Bytes of text scored at once, for up to 8 languages; fewer for more.
BLOCK = 1 << 18
MAX_LANGS = 256
TRAIN_ROWS = 40_000
UNDETERMINED = "und"
#: A gram's weight in the posterior: n-grams overlap, so the plain sum is overconfident.
EVIDENCE = 0.35


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and the number of each text's.

    Runs of anything but letters count as one space; a text without letters has none.
    """
    lower = [t.lower() for t in texts]
    joined = "".join(t + "\n" for t in lower)  # every text ends alike, wherever it stands
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in lower), np.int64, len(lower))
    ends = np.cumsum(lengths + 1) - 1
    letter = _letter_mask(code)
    sep = np.zeros(len(code), bool)
    sep[ends] = True
    keep = letter | sep
    keep[1:] |= letter[:-1]  # one space after a run of letters
    doc = np.zeros(len(code), np.int64)
    doc[1:] = np.cumsum(sep)[:-1]
    c = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    d, real = doc[keep], letter[keep]
    if not len(c):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    out, owner = [], []
    one = np.flatnonzero(real)
    out.append(mix(c[one]))
    owner.append(d[one])
    for n in (2, 3):
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = c[:m].copy()
        for k in range(1, n):
            h = h * np.uint64(0x1FFFFF) + c[k : k + m]
        same = (d[:m] == d[n - 1 :]) & (real[:m] | real[n - 1 :])
        at = np.flatnonzero(same)
        out.append(mix(h[at], n))
        owner.append(d[at])
    hashed, who = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return (hashed[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(who, minlength=len(texts))


_letters = np.zeros(0, bool)


def _letter_mask(code: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[code]


def train(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages in order, float32 log probabilities [BUCKETS, languages], the prior in a last row)."""
    labelled = docs.where(usable & F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("__h"))
    n = labelled.count()
    sample = labelled.where(F.col("__h") < int((1 << 30) * min(1.0, rows / max(n, 1)))).select("lang", "text") if n > rows else labelled.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for b in blocks(batch, "text", BLOCK):
                langs = b.column("lang").to_pylist()
                g, per = grams([t or "" for t in b.column("text").to_pylist()])
                names = sorted(set(langs))
                index = np.fromiter((names.index(x) for x in langs), np.int64, len(langs))
                both = np.bincount(np.repeat(index, per) * BUCKETS + g, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, x in enumerate(names):
                    held[x] = held.get(x, 0) + both[k]
                    seen[x] = seen.get(x, 0) + langs.count(x)
        for x, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(c[at], seen[x]), pa.int64())], ["lang", "bucket", "n"])

    got = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if len(names) > MAX_LANGS:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGS} fit the broadcast table")
    if not names:
        return names, np.zeros((BUCKETS + 1, 0), np.float32)
    table_ = np.zeros((BUCKETS + 1, len(names)))
    at = {x: k for k, x in enumerate(names)}
    rows_ = got.column("bucket").to_numpy()
    table_[np.where(rows_ < 0, BUCKETS, rows_), [at[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams_, prior = table_[:BUCKETS] + 0.5, table_[BUCKETS] + 1
    out = np.vstack([np.log(grams_) - np.log(grams_.sum(0)), np.log(prior) - np.log(prior.sum())])
    return names, out.astype(np.float32)


def score_texts(texts: list[str], names: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior."""
    g, per = grams(texts)
    total = np.zeros((len(texts), len(names)))
    some = np.flatnonzero(per)
    if len(some) and names:
        first = (np.cumsum(per) - per)[some]
        total[some] = np.add.reduceat(logp[g], first, axis=0, dtype=np.float64)
        total = total * EVIDENCE + logp[BUCKETS]
    if not names:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [names[k] if n else UNDETERMINED for k, n in zip(best, per, strict=True)], np.where(per > 0, p.max(1), 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score; ``keep`` names the columns carried along (default: the id)."""
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    keep = keep if keep is not None else [id_col]
    # the text goes to the workers once, whether it is kept or not
    sent = [*keep, *([] if text_col in keep else [text_col])]
    source = docs.select(*sent)
    at = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BLOCK * 8 // max(8, len(names))
        for batch in batches:
            for b in blocks(batch, text_col, size):
                lang, score = score_texts([t or "" for t in b.column(at).to_pylist()], names, shared.value)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
