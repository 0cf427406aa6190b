"""Token counts: batch encoding that returns lengths only.

Texts are cut at safe boundaries into pieces of bounded size and the pieces dealt into
batches of equal bytes; each batch is encoded and only its lengths are kept. A boundary
is safe where no token of the byte-level pattern spans it, so that the counts of the pieces add up
to the text's: before a white-space character between two visible ones, and between letters,
digits and marks, for ASCII and for ideographs with their marks, but not after an apostrophe, which
begins a contraction. No boundary lies within a special token's string.

Null and empty texts have 0 tokens. Equal texts of a batch are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattice.llm.common import prepare, table, utf8

#: Bytes of one encoding call, and the length beyond which a text is cut.
BATCH_BYTES, PIECE_CHARS = 1 << 18, 1 << 15
LIMIT = 1024

_MARKS = r"!-/:-@\[-`{-~"
_AFTER_MARKS = r"!-&(-/:-@\[-`{-~"  # without the apostrophe
_SAFE = re.compile(
    r"(?<=\S)(?=\s\S)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    rf"|(?<=[A-Za-z0-9])(?=[{_MARKS}])|(?<=[{_AFTER_MARKS}])(?=[A-Za-z0-9])"
    r"|(?<=[\u4e00-\u9fa5])(?=[\u3001\u3002\uff0c\uff1f])|(?<=[\u3001\u3002\uff0c\uff1f])(?=[\u4e00-\u9fa5])"
)

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def safe_pieces(text: str, size: int = PIECE_CHARS, special: tuple[str, ...] = ()) -> list[str]:
    """Parts of at least ``size`` characters, cut at safe boundaries alone; without one a part is longer."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        while m and any(text.find(x, max(m.start() - len(x) + 1, 0), m.start() + len(x) - 1) >= 0 for x in special):
            m = _SAFE.search(text, m.start() + 1)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def count_texts(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text."""
    encode = tokenizer(path).encode_batch_fast
    special = tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    unique: dict[str, int] = {}
    which = [unique.setdefault(t, len(unique)) for t in texts]
    counts = np.zeros(len(unique), np.int64)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for k, e in zip(owner, encode(batch, add_special_tokens=False), strict=True):
            counts[k] += len(e)
        batch.clear()
        owner.clear()
        held = 0

    for text, k in unique.items():
        for piece in safe_pieces(text, special=special) if text else ():
            batch.append(piece)
            owner.append(k)
            held += len(piece.encode())
            if held >= batch_bytes:
                flush()
    if batch:
        flush()
    return counts[np.asarray(which, np.int64)] if which else counts


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            _, off = utf8(b.column(1))
            n = count_texts([t or "" for t in b.column(1).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark, "4m")
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
