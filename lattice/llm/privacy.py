"""Personal data: base patterns, and terms that reveal what the patterns protect.

An entity is the value of an e-mail address, an address of a machine, a card or a phone number. Words
beside an entity are counted over the whole corpus, and set against the same words' counts everywhere:
the pointwise mutual information of term and entity, as a part of the entity's own information,
is what the term discloses of it. A term that discloses DISCLOSED or more, in contexts that are
not copies of each other, is generalised to its first letters if those disclose less, and removed otherwise.

A word beside an entity is one of the WINDOW words before it or after it. Contexts count by their
least word hash, so that copies and near copies of a passage are one context, and a term needs
CONTEXTS of them in effect ((sum n)^2 / sum n^2), so that a few edited copies do not make it two.

Defined results: null is the empty text and has no spans; rows of one id and repeated rows are found each
by itself and counted each; other columns are ignored. Spans are code points, ends exclusive; a
term's spans never overlap base spans. Every search is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import prepare, scratch, table

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity, effective contexts that a term needs, and the part of an entity's information from which a term discloses it.
WINDOW, CONTEXTS, DISCLOSED = 10, 2.5, 0.9
#: Letters that a generalised term keeps.
KEPT = 3
#: Terms that are sent to every task at once; more are joined.
TERMS = 1 << 18
#: Terms that are looked for one by one before a text is split into words.
FEW = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}+")
_LETTERS = re.compile(r"[a-z]{3,}+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, index of the kind, end) of the base patterns, by start and kind."""
    out: list[Span] = []
    done = 0
    if "@" in text:
        # the name before an @ is the whole run of its letters since the last address
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > done and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                done = m.end()
                out.append((at, 0, done))
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out.extend((m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15)
    return sorted(out)


def value(text: str, span: Span) -> str:
    """What a span stands for, whatever way it is written."""
    found = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{found.lower() if span[1] == 0 else found if span[1] == 1 else _NOT_DIGIT.sub('', found)}"


def words_outside(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, lower-case word) of the words that overlap no span."""
    out, k, reach = [], 0, -1
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def contexts(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(entity, context, term, n) of the words beside each entity of a text; windows of one entity that meet are one context."""
    spans = base_spans(text)
    if not spans:
        return
    words = words_outside(text, spans)
    starts = [w[0] for w in words]
    beside: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for s in spans:
        before, after = bisect_left(starts, s[0]), bisect_left(starts, s[2])
        beside[value(text, s)].append((max(0, before - WINDOW), min(len(words), after + WINDOW)))
    for entity, windows in beside.items():
        joined: list[list[int]] = []
        for a, b in sorted(windows):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        own = _hash(entity)
        for a, b in joined:
            counts = Counter(w[2] for w in words[a:b])
            if counts:
                least = min(map(_hash, counts))
                for term, n in counts.items():
                    yield own, least, term, n


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        for v in b.column("text"):
            yield v.as_py() or ""


def _rows(found: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in found:
        held.append(r)
        if len(held) >= most:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_PAIRS = pa.schema([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string()), ("n", pa.int64())])
_COUNTS = pa.schema([("general", pa.bool_()), ("term", pa.string()), ("n", pa.int64())])


def _beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rows((r for t in _texts(batches) for r in contexts(t)), _PAIRS)


def _everywhere(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """general, term and n: counts over all texts of ``wanted`` terms (None: all) and of the first letters of such; the null term counts all words."""
    heads = None if wanted is None else frozenset(t[:KEPT] for t in wanted)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        own, general, total = Counter(), Counter(), 0

        def held() -> Iterator[tuple]:
            yield from ((False, t, n) for t, n in own.items())
            yield from ((True, t, n) for t, n in general.items())

        for b in batches:
            found: Counter[str] = Counter()
            for text in _texts([b]):
                spans = base_spans(text)
                words = [w[2] for w in words_outside(text, spans)] if spans else _lowered(text)
                total += len(words)
                # a wanted term has a wanted head
                found.update(words if heads is None else [w for w in words if w[:KEPT] in heads])
            # a batch's distinct words, not each text's, are looked up
            for t, n in found.items():
                if wanted is None or t in wanted:
                    own[t] += n
                if heads is None or t[:KEPT] in heads:
                    general[t[:KEPT]] += n
            if len(own) > 1 << 18:
                yield from held()
                own, general = Counter(), Counter()
        yield from held()
        yield False, None, total

    return texts.mapInArrow(lambda batches: _rows(count(batches), _COUNTS), "general boolean, term string, n bigint")


def _bounded(terms: DataFrame) -> frozenset[str] | None:
    """The terms, if there are at most TERMS of them."""
    found = terms.select("term").distinct().limit(TERMS + 1).collect()
    return frozenset(r[0] for r in found) if len(found) <= TERMS else None


def disclosing_terms(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """term, disclosure (the most it discloses of any entity), entities (how many it discloses) and action: generalise or remove.

    Stored below scratch. The pass over all words is left out if no term has contexts enough.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = scratch(spark, "privacy")
    texts = docs.select(F.col(text).alias("text"))
    texts.where(F.col("text").rlike("[0-9@]")).mapInArrow(_beside, "entity bigint, context bigint, term string, n bigint").groupBy("entity", "term", "context").agg(F.sum("n").alias("n")).write.parquet(f"{root}/beside")
    beside = spark.read.parquet(f"{root}/beside")
    effective = F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))
    pairs = beside.groupBy("entity", "term").agg(F.sum("n").alias("n"), effective.alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    pairs.write.parquet(f"{root}/pairs")
    pairs = spark.read.parquet(f"{root}/pairs")
    shape = "term string, disclosure double, entities bigint, action string"
    if pairs.isEmpty():
        return spark.createDataFrame([], shape)
    _everywhere(texts, _bounded(pairs)).groupBy("general", "term").agg(F.sum("n").alias("total")).write.parquet(f"{root}/everywhere")
    everywhere = spark.read.parquet(f"{root}/everywhere")
    words = everywhere.where("term IS NULL").agg(F.sum("total")).first()[0]
    entity = beside.groupBy("entity").agg((-F.log2(F.sum("n") / F.lit(words))).alias("information"))
    share = lambda n: 1 + F.log2(F.least(n / F.col("total"), F.lit(1.0))) / F.col("information")
    told = pairs.join(everywhere.where(~F.col("general")).drop("general"), "term").join(entity, "entity").select("entity", "term", share(F.col("n")).alias("disclosure")).where(F.col("disclosure") >= DISCLOSED)
    head = F.substring("term", 1, KEPT)
    heads = told.select("entity", head.alias("head")).distinct()
    near = beside.select("entity", head.alias("head"), "n").groupBy("entity", "head").agg(F.sum("n").alias("n"))
    general = heads.join(near, ["entity", "head"]).join(everywhere.where("general").select(F.col("term").alias("head"), "total"), "head").join(entity, "entity").select("entity", "head", share(F.col("n")).alias("general"))
    both = told.withColumn("head", head).join(general, ["entity", "head"]).groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.count("*").alias("entities"), F.max("general").alias("general"))
    hidden = (F.col("general") < DISCLOSED) & (F.length("term") > KEPT)
    both.select("term", "disclosure", "entities", F.when(hidden, "generalise").otherwise("remove").alias("action")).write.parquet(f"{root}/terms")
    return spark.read.parquet(f"{root}/terms")


def all_spans(text: str, terms: Mapping[str, str]) -> list[Span]:
    """Base spans and those of ``terms``, by start and kind."""
    base = base_spans(text)
    if not terms or len(terms) <= FEW and not _may_hold(text, terms) or terms.keys().isdisjoint(_lowered(text)):
        return base
    return sorted(base + [(a, 4, b) for a, b, w in words_outside(text, base) if w in terms])


def _whole(text: str) -> bool:
    """Whether the text can be lower-cased as a whole: a sigma depends on what is beside it, and the dotted I becomes two characters."""
    return text.isascii() or "\u03a3" not in text and "\u0130" not in text


def _may_hold(text: str, terms: Iterable[str]) -> bool:
    """False only if none of ``terms`` is a lower-case word of the text."""
    if not _whole(text):
        return True
    low = text.lower()
    return any(t in low for t in terms)


def _lowered(text: str) -> list[str]:
    """The lower-case words."""
    if text.isascii():
        return _LETTERS.findall(text.lower())
    return _WORD.findall(text.lower()) if _whole(text) else [w.lower() for w in _WORD.findall(text)]


def _lower_words(text: str) -> set[str]:
    return set(_lowered(text))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sanitised(text: str, spans: list[Span], terms: Mapping[str, str]) -> str:
    """The text with base spans replaced by their kind, generalised terms cut to their first letters, and other terms left out for a mark."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a < at:  # within what is replaced already, or beyond its end
            at = max(at, b)
            continue
        word = text[a:b]
        out.append(text[at:a] + (f"[{KINDS[k].upper()}]" if k < 4 or terms.get(word.lower()) != "generalise" else word[:KEPT] + "…"))
        at = b
    return "".join(out) + text[at:]


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_term bigint, base_sha256 string, spans string"


def _with_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """text and its disclosing terms as a map, for more terms than a task can hold: texts meet them by a join on each word, keyed by the text's digest."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((h.as_py(), w) for b in batches for h, t in zip(b.column("h"), b.column("text"), strict=True) for w in _lower_words(t.as_py() or ""))
        return _rows(pairs, pa.schema([("h", pa.string()), ("term", pa.string())]))

    keyed = docs.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    words = keyed.select("h", "text").mapInArrow(split, "h string, term string")
    hits = words.join(terms.select("term", "action"), "term").distinct().groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("terms"))
    return keyed.join(hits, "h", "left").drop("h")


def find(docs: DataFrame, terms: DataFrame, *, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """key, counts by kind, base_sha256, spans and, if wanted, the sanitised text of every row, with ``terms`` (term, action) as ``disclosing_terms`` gives them."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known: dict[str, str] | None = None
    if _bounded(terms) is None:
        rows = _with_terms(rows, terms)
    else:
        known = {r["term"]: r["action"] for r in terms.select("term", "action").collect()}
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(_FOUND + (", sanitised string" if texts else "")).fields])
    types = [pa.int64()] * 5 + [pa.string()] * (3 if texts else 2)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            own = b.column("terms") if known is None else None
            for i, v in enumerate(b.column("text")):
                t = v.as_py() or ""
                marks = known if own is None else dict(own[i].as_py() or ())
                spans = all_spans(t, marks)
                counts = Counter(s[1] for s in spans)
                base = joined(s for s in spans if s[1] < 4)
                row = (*(counts[k] for k in range(5)), sha256(base.encode()).hexdigest(), joined(spans))
                out.append((*row, sanitised(t, spans, marks)) if texts else row)
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.record_batch([b.column("key"), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans and all spans of all documents."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, disclosing_terms(docs), texts=False)
