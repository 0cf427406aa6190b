"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.llm import kernels as K
from lattice.llm import language_id, licenses, lines, media, near, pieces, quality, substring, token_counts
from lattice.llm.components import components
from lattice.llm.decontaminate import align, contamination

P = pytest.importorskip("public_tokenizers")
DDL = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=60, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}x{seed % 7}" for _ in range(n))


def table(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


ODD = [None, "", " ", "one", "\n\n", "é ñ 日本 🙂", "a " * 5000, prose(1), prose(1), "tab\tand\x0bvertical\x0cfeed\rreturn"]


@pytest.fixture(scope="module")
def odd(spark):
    base = table(spark, ODD)
    return base.unionByName(base.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, prose(1), None, None, None), (None, None, None, None, None)], DDL)).withColumn("__text", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("c", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


# --- kernels


def test_word_hashes_depend_on_bytes_alone():
    import pyarrow as pa

    texts = ["ab cd  ab", "", "cd", None, "x ab"]
    from lattice.llm.common import utf8

    data, off = utf8(pa.array(texts))
    s, e, at = K.word_spans(data, off)
    h = K.span_hashes(data, s, e)
    assert list(np.diff(at)) == [3, 0, 1, 0, 2] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
    v = np.unique(K.mix(np.arange(1000, dtype=np.uint64)))
    assert (K.unpack(K.pack(v)) == v).all() and (K.unpack_raw(K.pack_raw(np.array([5, 0, 70000]))) == [5, 0, 70000]).all()
    assert len(K.unpack(K.pack(np.empty(0, np.uint64)))) == 0


# --- 1 licenses


def test_licenses(spark, odd, empty):
    filler = prose(3, 90)
    names = list(licenses.TEMPLATES)
    docs = table(spark, [f"{filler} {licenses.TEMPLATES[k]} {filler}" for k in names] + [filler, "license license license", None, ""])
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    # each text reports its own license and no other one; a clause that several licenses share is a family of its own
    for k, name in enumerate(names):
        assert found[k][licenses.license_of(name)] == 1.0, name
        assert set(found[k]) == {licenses.license_of(name)}, (name, found[k])
    assert not {k for k in found if k >= len(names)}
    assert licenses.scan(odd).count() == 0 == licenses.scan(empty).count()
    assert licenses.scan(docs, {}).count() == 0
    own = licenses.scan(table(spark, ["x y quux corge grault garply z", "quux corge"]), {"mine": "Quux corge grault, garply!"}).collect()
    assert [(r["doc_id"], r["license"], r["containment"]) for r in own] == [(0, "mine", 1.0)]
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "three words only"})


def test_licenses_of_edited_and_joined_notices(spark):
    gpl2, gpl3 = (licenses.TEMPLATES[f"GPL-{v}.0/header"] for v in (2, 3))
    texts = [f"{prose(1, 40)} {gpl2} {gpl3} {prose(2, 40)}", gpl3.replace("redistribute", "share"), gpl3.replace("version 3", "version 9"), " ".join(licenses.TEMPLATES["MIT/text"].split()[:60])]
    got = {}
    for r in licenses.scan(table(spark, texts)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {0: {"GPL-2.0", "GPL-3.0"}, 1: {"GPL-3.0"}, 3: {"MIT"}}


def test_license_anchors_cover_every_template():
    words = licenses.anchors(licenses.TEMPLATES)
    for s in licenses.shingle_sets(licenses.TEMPLATES).values():
        assert sum(not set(g) & set(words) for g in s) < licenses.CONTAINMENT * len(s)
    held = set(licenses.anchor_shingles(licenses.TEMPLATES))
    for s in licenses.shingle_sets(licenses.TEMPLATES).values():
        assert sum(" ".join(g) not in held for g in s) < licenses.CONTAINMENT * len(s)


# --- 2 media


def test_media_round_trip(spark, odd, empty, tmp_path):
    root = str(tmp_path / "m")
    media.write_archives(odd, root, shard_bytes=2000)
    back = media.describe(media.read_media(spark, root, splitBytes="700")).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, hashlib.sha256(media.padded((r["text"] or "").encode())).hexdigest(), len((r["text"] or "").encode())) for r in odd.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["payload_sha256"], r["n_bytes"]) for r in back) == want
    one = next(r for r in back if r["doc_id"] == 1)
    assert one["payload_bytes"] == 64 and one["tail_crc32"] == zlib.crc32(bytes(64))
    features = {r["doc_id"]: r for r in back if r["doc_id"] is not None}
    for r in odd.where("doc_id IS NOT NULL").collect():
        raw = (r["text"] or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        lines_ = [raw[k : k + 64] for k in range(0, len(raw), 64)]
        bins, bands, per, extra, at = [sum(x // 32 == k for x in raw) for k in range(8)], [], len(lines_) // 8, len(lines_) % 8, 0
        for k in range(8):
            own = b"".join(lines_[at : at + per + (k < extra)])
            at += per + (k < extra)
            bands.append(sum(own) // max(len(own), 1))
        got = features[r["doc_id"]]
        assert got["feature"] == f"64x{len(lines_)};sum={sum(raw)};hist={','.join(map(str, bins))};bands={','.join(map(str, bands))}"
        stored = media.encode_png(raw)
        assert (got["media_bytes"], got["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    media.write_archives(empty, root + "e")
    assert media.read_media(spark, root + "e").count() == 0


def test_media_member_is_read_again_by_offset(tmp_path):
    import io
    import zipfile

    from pyarrow import fs

    path = tmp_path / "a.zip"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x", b"payload")
    path.write_bytes(buf.getvalue())
    r = media.MediaReader({"path": str(tmp_path), "retries": "2"})
    with zipfile.ZipFile(path) as z:
        m = z.infolist()[0]

    class Torn(io.BytesIO):
        def read(self, *a):
            raise OSError("lost")

    assert r._member(fs.LocalFileSystem(), str(path), Torn(), m) == b"payload"
    path.write_bytes(buf.getvalue().replace(b"payload", b"PAYLOAD"))
    with pytest.raises(OSError):
        r._member(fs.LocalFileSystem(), str(path), Torn(), m)


@pytest.mark.parametrize("raw", [b"", b"x", bytes(range(256)), b"a" * 64, b"b" * 65])
def test_png(raw):
    p = media.padded(raw)
    assert len(p) % 64 == 0 and len(p) > 0 and media.decode_png(media.encode_png(p)).tobytes() == p


# --- 3 near duplicates


def test_near_classes(spark, odd, empty):
    r = random.Random(4)
    base = [prose(k, 80) for k in range(6)]
    texts = list(base)
    for k in range(12):  # a few words of a hundred changed
        w = base[k % 3].split()
        w[r.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    texts += [base[4], base[4], "short text", "short text", "", None, "", base[0] + " " + base[1]]
    got = {r_["doc_id"]: r_["class_id"] for r_ in near.near_classes(table(spark, texts)).collect()}
    for k in range(12):
        assert got[6 + k] == k % 3
    assert got[18] == got[19] == 4 and got[21] == got[20] == 20
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 22, 23, 24, 25)] == [0, 1, 2, 3, 4, 5, 22, 23, 24, 25]
    out = near.near_classes(odd).collect()
    assert len(out) == odd.count() and {x["class_id"] for x in out if x["doc_id"] in (7, 8)} == {7}
    assert near.near_classes(empty).count() == 0


def test_near_classes_against_all_pairs(spark):
    r = random.Random(11)
    hot = prose(77, 40)  # a passage in half of the texts
    texts = []
    for k in range(40):
        w = (f"{hot} " if k % 2 else "").split() + prose(500 + k // 4, 70).split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    import pyarrow as pa

    _, _, words, at = near.kmers(pa.table({"t": texts}), "t")
    seq = [words[at[k] : at[k + 1]] for k in range(len(texts))]
    parent = list(range(len(texts)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            if near.similarity(seq[i], seq[j]) > 0:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {x["doc_id"]: x["class_id"] for x in near.near_classes(table(spark, texts)).collect()} == {k: find(k) for k in range(len(texts))}


@pytest.mark.parametrize("spokes", [10, 100, 1000])
def test_near_classes_of_a_hub_of_the_largest_id(spark, spokes):
    body = [f"b{k}" for k in range(200)]
    texts = [" ".join([*body, *(f"s{k}x{i}" for i in range(40))]) for k in range(spokes)] + [" ".join(body)]
    assert {x["class_id"] for x in near.near_classes(table(spark, texts)).collect()} == {0}


def test_alignment_is_the_banded_lcs():
    r = random.Random(1)

    def lcs(a, b, band):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + (a[i] == b[j] and abs(i - j) <= band))
        return t[-1][-1]

    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(0, 14))] for _ in range(2))
        band = r.randrange(0, 6)
        assert near._banded(a, b, band) == lcs(a, b, band)
    x = np.arange(100, dtype=np.uint64)
    assert near.similarity(x, x) == 1.0 and near.similarity(x, x[::-1].copy()) == 0.0
    assert near.similarity(x, np.append(x[:95], x[:5] + np.uint64(500))) == pytest.approx(95 / 105)


def test_alignment_of_long_texts():
    r = random.Random(5)
    x = [r.randrange(20_000) for _ in range(200_000)]
    y = [w for w in x if r.random() > 0.002]
    for _ in range(400):
        y[r.randrange(len(y))] = -1
    started = time.process_time()
    s = near.similarity(np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64))
    assert 0.98 < s < 1 and time.process_time() - started < 8
    for _ in range(20):
        a = [r.randrange(30) for _ in range(r.randrange(900, 1500))]
        b = [w for w in a if r.random() > 0.1]
        assert near.longest_common(a, b, 2000) == near._banded(a, b, 2000) and near._banded(a, b, 300) <= near._banded(a, b, 2000)


def test_near_classes_of_rows_that_share_an_id(spark):
    texts, ids = [prose(1, 80), prose(2, 80), prose(3, 80), prose(2, 80), prose(1, 80)], [5, 5, 6, 7, 5]
    out = near.near_members(table(spark, texts, ids)).collect()
    assert sorted((x["doc_id"], x["class_id"], x["__first"]) for x in out) == [(5, 5, True)] * 3 + [(6, 6, True), (7, 5, False)]
    named = table(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert {x["doc_id"]: x["class_id"] for x in near.near_classes(named).collect()} == {"d0": "d0", "d1": "d1", "d2": "d2", "d3": "d1", "d4": "d0"}


def test_components(spark, tmp_path):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40) if k % 9] + [(r.randrange(60, 90), r.randrange(60, 90)) for _ in range(30)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    out = {x["v"]: x["label"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), str(tmp_path / "c")).collect()}
    assert out == {v: find(v) for e in edges if e[0] != e[1] for v in e}


# --- 4 quality


def test_quality(spark, odd, empty):
    good, bad = [prose(k, 80) for k in range(40)], [("BUY!! NOW!! " * 30 + prose(k, 5)).upper() for k in range(40)]
    docs = table(spark, [*good, *bad])
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80) if k % 4], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    s = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((s[k] >= quality.THRESHOLD) == (k < 40) for k in range(0, 80, 4))
    assert s == {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    out = [r["score"] for r in quality.score(odd, model).collect()]
    assert len(out) == odd.count() and all(0 <= x <= 1 for x in out)
    assert quality.score(empty, model).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_features_and_fit_by_brute_force():
    import zstandard

    r = random.Random(8)
    texts = [(" ".join(r.choice(["alpha", "beta", "gamma", "x9"]) for _ in range(r.randrange(0, 900)))).encode() for _ in range(30)] + [b"", b"a"]
    good, bad = quality._dictionary([t for t in texts[:15] if t]), quality._dictionary([t.upper() for t in texts[15:] if t])
    got = quality.features(texts, quality._compressors(good, bad))
    args = {"level": quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    for k, t in enumerate(texts):
        size = [0, 0, 0]
        for at in range(0, len(t), quality.BLOCK):
            for j, d in enumerate((None, good, bad)):
                c = zstandard.ZstdCompressor(**args) if d is None else zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **args)
                size[j] += len(c.compress(t[at : at + quality.BLOCK]))
        want = (len(t), (size[2] - size[1]) / size[0], np.log(size[0] / (len(t) + 16))) if t else (0, 0, 0)
        assert got[k] == pytest.approx(want)
    y = np.array([int(r.random() < 0.5) for _ in texts], float)
    w = quality._fit_curve(got, y)

    def loss(v):
        z = quality._design(got) @ v
        return float(np.sum(np.log1p(np.exp(z)) - y * z) + 0.005 * v @ v)

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in 0.01 * np.random.default_rng(0).normal(size=(200, len(w))))


def test_quality_learns_whole_texts_within_its_bound(spark):
    docs = table(spark, [("good words in a row " * 300) + "END" for _ in range(10)] + ["BAD!! " * 900 for _ in range(10)] + ["other text"], [*range(20), 3])
    labels = spark.createDataFrame([(k, int(k < 10)) for k in range(20)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, size=20_000)
    s = {(r["doc_id"]): r["score"] for r in quality.score(docs, model).collect() if r["doc_id"] != 3}
    assert all((v > 0.5) == (k < 10) for k, v in s.items())
    assert quality.train(docs, labels, size=5).base == 0.5  # no text fits: nothing learnt


def test_quality_held_out_on_the_given_tables(spark):
    from lattice.llm.common import held_out

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.op4_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert docs.where(held_out()).count() >= len(rows) > 50 and auc > 0.98


# --- 5 decontamination


def test_contamination(spark, odd, empty):
    items = [prose(100 + k, 30) for k in range(4)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(9, ""), (10, None), (11, "tiny one")], "item_id bigint, text string")
    edited = items[1].split()
    for k in (4, 11, 19, 26):
        edited[k] = "edit"
    shared = [f"{prose(200 + k, 40)} {items[2]} {prose(300 + k, 40)}" for k in range(30)]  # one item in most documents
    texts = [f"{prose(5, 50)} {items[0].upper().replace(' ', ', ')} {prose(6, 50)}", f"{prose(7, 50)} {' '.join(edited)} {prose(8, 50)}", prose(9, 120), None, "", "a tiny one here", *shared]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(table(spark, texts), bench).collect()}
    assert got.keys() == {(0, 0), (1, 1), (5, 11), *((k, 2) for k in range(6, 36))}
    assert got[(0, 0)] == 1.0 and 0.5 < got[(1, 1)] < 1.0
    small = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(table(spark, texts), bench, block_bytes=100).collect()}
    assert small == got
    assert contamination(odd, bench).count() == 0 == contamination(empty, bench).count() == contamination(odd, bench.where("false")).count()


def test_smith_waterman():
    r = random.Random(3)

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = max(0, t[i][j] + (2 if a[i] == b[j] else -1), t[i][j + 1] - 1, t[i + 1][j] - 1)
        return max(map(max, t))

    for _ in range(100):
        a, b = (np.array([r.randrange(4) for _ in range(r.randrange(1, 12))], np.uint64) for _ in range(2))
        assert align(a, b)[0] * 2 * len(a) == pytest.approx(brute(a.tolist(), b.tolist()))


def edited(words, r, rate, kinds=3):
    out = []
    for w in words:
        if r.random() >= rate:
            out.append(w)
        else:
            kind = r.randrange(kinds)
            out += [f"e{r.randrange(10**6)}"] if kind == 0 else [w, f"e{r.randrange(10**6)}"] if kind == 1 else []
    return out


def leaks_by_brute_force(texts, items, least=0.5):
    """Every item against every whole text, with no seeds."""
    import pyarrow as pa

    from lattice.llm.decontaminate import folded_words

    a, b = (folded_words(pa.table({"t": pa.array(x, pa.large_string())}), "t") for x in (texts, items))
    cut = lambda f, k: f[0][f[1][k] : f[1][k + 1]]
    return {(d, k): s for d in range(len(texts)) for k in range(len(items)) if len(cut(b, k)) and (s := align(cut(b, k), cut(a, d))[0]) >= least}


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3])
def test_contamination_recall_by_edit_rate(spark, rate):
    r = random.Random(int(rate * 100))
    items = [prose(1000 + k, 40, 3000) for k in range(60)]
    texts = [f"{prose(2000 + k, 30, 3000)} {' '.join(edited(items[k].split(), r, rate))} {prose(3000 + k, 30, 3000)}" for k in range(60)]
    want = leaks_by_brute_force(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in contamination(table(spark, texts), bench).collect()}
    assert got.keys() <= want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("every", [3, 4, 5, 6])
@pytest.mark.parametrize("kind", [0, 1, 2])
def test_contamination_of_regular_edits(spark, every, kind):
    items = [prose(4000 + k, 40, 3000) for k in range(10)]
    one = [lambda w: ["x"], lambda w: [w, "x"], lambda w: []][kind]
    texts = [" ".join(x for i, w in enumerate(t.split()) for x in (one(w) if i % every == every - 1 else [w])) for t in items]
    want = leaks_by_brute_force(texts, items)
    got = contamination(table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want.keys()
    assert len(want) == 10 or (every, kind) == (3, 2)


# --- 6 substrings


def removed(texts, window=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = []
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def passages(seed, n=60):
    r = random.Random(seed)
    shared = [prose(900 + k, 25) for k in range(5)]
    return [" ".join(r.choice([prose(seed * 100 + k * 9 + j, 10), r.choice(shared), "\n"]) for j in range(r.randrange(0, 7))) for k in range(n)] + [ODD[6], None, "", ODD[6]]


def test_substring_dedup(spark, odd, empty):
    texts = passages(1)
    want = removed(texts)
    for chunk in (1 << 20, 3000):
        got = {r["doc_id"]: r for r in substring.dedup(table(spark, texts), chunk_bytes=chunk).collect()}
        assert [got[k]["kept"] for k in range(len(texts))] == want
        assert all(got[k]["n_words"] - got[k]["n_removed"] == len(want[k].split()) for k in got)
    out = substring.dedup(odd).collect()
    assert len(out) == odd.count() and all(r["n_removed"] == 0 for r in out if r["doc_id"] in (None, 7)) and {r["n_removed"] for r in out if r["doc_id"] == 8} == {60}
    assert substring.dedup(empty).count() == 0


def test_index_in_batches_equals_one_batch(spark, tmp_path):
    texts = passages(2)
    want, docs = removed(texts), table(spark, texts)
    got = {}
    for a, b in ((0, 20), (20, 21), (21, 45), (45, 50), (50, 99)):
        index = substring.FingerprintIndex(spark, str(tmp_path / "ix"), ranges=3, fanout=2)  # another process goes on
        got |= {r["doc_id"]: r["kept"] for r in index.add(docs.where(f"doc_id >= {a} and doc_id < {b}"), chunk_bytes=4000).collect()}
    assert [x for _, x in index.runs] == [2, 0]
    index.compact()
    assert len(index.runs) == 1
    assert [got[k] for k in range(len(texts))] == want
    # a row of an id that history has is judged against smaller ids alone
    assert {r["doc_id"]: r["kept"] for r in index.add(docs.where("doc_id < 20")).collect()} == dict(enumerate(want[:20]))
    index.compact()
    index.add(docs.where("doc_id < 5"))
    index.compact()
    assert len(index.runs) == 1 and index.history().count() == 3
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, str(tmp_path / "ix"), ranges=5)


# --- 7 pieces


def test_pieces_are_the_librarys(spark, odd, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, voc = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    hard = [" a  b\n c", "日本ⅷ", "a\tb", "x  ", " ", "\n\n", "é ﬁ", " " * 40 + "x", "ab\x00c", "<0x0A> <s>", "🙂🙂 x", "a" * 300, "word" * 200, prose(1), "Ünïcode straße", "\r\n x"]
    for t in hard:
        ids = pieces.encode_texts([t], voc)[0].tolist()
        assert ids == sp.encode(t), t
        assert pieces.decode_ids(ids, voc) == sp.decode(ids)
    out = pieces.decode(pieces.encode(odd, path, keep=("doc_id", "c")), path, keep=("doc_id", "c")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in out) == sorted(((r["doc_id"] or 0), r["text"] or "") for r in odd.collect())
    assert all(r["round_trip"] for r in pieces.digests(odd, path).collect()) and pieces.digests(empty, path).count() == 0


def test_pieces_of_long_texts_without_spaces():
    import base64

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, voc = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    r = random.Random(3)
    letters = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    kinds = [letters, base64.b64encode(r.randbytes(150_000)).decode(), "a" * 50_000, "ab" * 30_000, "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(50_000)), prose(3, 40_000).replace(" ", "")]
    for t in kinds:
        assert pieces.encode_texts([t], voc)[0].tolist() == sp.encode(t)
    started = time.process_time()
    million = letters * 5
    assert len(pieces.encode_texts([million], voc)[0]) > 0 and time.process_time() - started < 20


# --- 8 token counts


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, "end <|endoftext|> of <|endoftext|>", "  two  spaces ", "x" * 90_000, prose(1, 30_000), "a 'll b's " * 9000, "nbsp  x " * 9000]
    out = {r["doc_id"]: r for r in token_counts.token_counts(table(spark, texts), path).collect()}
    for k, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (out[k]["n_tokens"], out[k]["n_bytes"], out[k]["over_limit"]) == (n, len((x or "").encode()), n > 1024), k
    for x in texts:  # cut as finely as can be, the counts still add up
        parts = token_counts.safe_pieces((x or "")[:20_000], 1, ("<|endoftext|>",))
        assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in parts) == len(t.encode((x or "")[:20_000], add_special_tokens=False).ids)
    r = random.Random(6)
    for _ in range(2000):
        x = "".join(r.choice("aZ9 '\n\t.-s漢、é\u00a0t<|") for _ in range(30))
        assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in token_counts.safe_pieces(x, 1)) == len(t.encode(x, add_special_tokens=False).ids), x
    assert len(token_counts.safe_pieces("abc123" * 9000)) > 1 < len(token_counts.safe_pieces("line\n" * 30_000))
    assert token_counts.token_counts(odd, path).count() == odd.count() and token_counts.token_counts(empty, path).count() == 0
    assert all("".join(token_counts.safe_pieces(x, 50)) == x for x in texts if x)


# --- 9 lines


def kept_lines(texts, least=lines.MIN_WORDS):
    """From the definition: each run of lines, of any length, with enough words that starts earlier too goes."""
    split = [(t or "").split("\n") for t in texts]
    inked = [[(no, x) for no, x in enumerate(s) if x.strip(" \t\x0b\f\r")] for s in split]
    n = lambda x: len(re.findall(r"[^ \t\x0B\f\r]+", x))
    places = [(d, i) for d, seq in enumerate(inked) for i in range(len(seq))]
    gone = set()
    for p, (d, i) in enumerate(places):
        for e, j in places[:p]:
            size = 0
            while i + size < len(inked[d]) and j + size < len(inked[e]) and inked[d][i + size][1] == inked[e][j + size][1]:
                size += 1
            run = inked[d][i : i + size]
            if sum(n(x) for _, x in run) >= least:
                gone |= {(d, no) for no, _ in run}
    return [None if t is None else "\n".join(x for no, x in enumerate(s) if (d, no) not in gone) for d, (t, s) in enumerate(zip(texts, split, strict=True))]


def test_line_dedup(spark, odd, empty):
    r = random.Random(7)
    some = [prose(k, r.randrange(1, 12)) for k in range(14)] + ["", "  ", "end"]
    texts = ["\n".join(r.choice(some) for _ in range(r.randrange(0, 12))) for _ in range(50)] + [None, ""]
    docs = table(spark, texts)
    got = {x["doc_id"]: x["text"] for x in lines.dedup(docs).collect()}
    assert [got[k] for k in range(len(texts))] == kept_lines(texts)
    out = lines.dedup(odd).collect()
    assert len(out) == odd.count() and {x["text"] for x in out if x["doc_id"] == 7} == {prose(1)} and {x["text"] for x in out if x["doc_id"] == 8} == {""}
    assert set(out[0].asDict()) == {*odd.columns, "__n_lines", "__n_removed"}
    assert lines.dedup(empty).count() == 0


def test_repeated_runs_of_short_lines(spark):
    """Runs of 1 to 12 lines of 1 to 3 words, among lines of their own, go wherever they have 8 words."""
    r = random.Random(21)
    texts = []
    for size in range(1, 13):
        for words in (1, 2, 3):
            run = [" ".join(f"r{size}x{words}y{k}z{i}" for i in range(words)) for k in range(size)]
            texts += ["\n".join([f"a{len(texts)}", *run, f"b{len(texts)}"]) for _ in range(2)]
    mixed = [prose(5, 50), "one", "two"]
    texts += ["\n".join(mixed), "\n".join(["x", *mixed, "y"]), "\n".join(["same"] * 12), "m\nn\n" * 9]
    texts += ["\n".join(r.choice(["p q", "s", "t u v", "w"]) for _ in range(r.randrange(3, 15))) for _ in range(30)]
    got = {x["doc_id"]: x["text"] for x in lines.dedup(table(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == kept_lines(texts)


def test_lines_of_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"line number {k} of a text that is long enough" for k in range(40_000))
    rows = [(1, long, 1, "a", 5, "k"), (2, f"first\n{long}\nlast", 2, "b", 6, "k"), (2, "other text of the same id\nand a second line", 3, "c", 7, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __key int, __id string, __h bigint, __runs string")
    out = {(x["doc_id"], x["__key"]): x for x in lines.dedup(docs).collect()}
    assert out[(2, 2)]["text"] == "first\nlast" and out[(2, 2)]["__n_removed"] == 40_000 and out[(1, 1)]["text"] == long and out[(2, 3)]["__n_removed"] == 0
    assert [out[k]["__id"] for k in sorted(out)] == ["a", "b", "c"] and out[(1, 1)]["__h"] == 5


def test_line_dedup_sql_and_brute_force(spark):
    import duckdb
    import pyarrow as pa

    r = random.Random(9)
    texts = ["\n".join(r.choice(["p q", "s", "t u v", "w", "", prose(1, 9), prose(2, 4)]) for _ in range(r.randrange(0, 15))) for _ in range(40)] + [None, ""]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    assert [x[0] for x in c.sql(f"WITH {lines.kept_sql()} SELECT text FROM kept ORDER BY doc_id").fetchall()] == kept_lines(texts)


# --- 10 languages


def test_language_id(spark, odd, empty):
    words = {"en": "the and of thing", "de": "der und die schön", "fr": "le et la éèu"}
    rows = []
    for k in range(90):
        lang = sorted(words)[k % 3]
        r = random.Random(k)
        rows.append((k, " ".join(r.choice(words[lang].split()) for _ in range(25)), lang, "s", 0))
    docs = spark.createDataFrame(rows, DDL)
    model = language_id.train(docs, F.col("doc_id") % 5 != 0)
    out = {x["doc_id"]: x for x in language_id.predict(docs, model).collect()}
    assert all(out[k]["lang_pred"] == rows[k][2] and 0 < out[k]["score"] <= 1 for k in range(90))
    same = language_id.train(docs.repartition(7), F.col("doc_id") % 5 != 0)
    assert model[0] == same[0] and (model[1] == same[1]).all()
    un = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(odd, model).collect()}
    assert [un[k] for k in (0, 1, 2, 4)] == ["und"] * 4 and un[3] != "und"
    assert language_id.predict(empty, model).count() == 0
    assert language_id.predict(table(spark, ["\U00030000", "\U000e0001"]), model).orderBy("doc_id").collect()[0]["lang_pred"] != "und"
    assert {x["lang_pred"] for x in language_id.predict(docs, language_id.train(docs.where("false"), F.lit(True))).collect()} == {"und"}
