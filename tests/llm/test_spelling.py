"""Spelling variants against all pairs of words, the registered SQL, and odd texts."""

import random

import duckdb
import pytest

from lattice.llm import spelling as S

DDL = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def close(a, b):
    """Edit distance one, from the definition."""
    cut = {a[:k] + a[k + 1 :] for k in range(len(a))}
    return a != b and (b in cut or a in {b[:k] + b[k + 1 :] for k in range(len(b))} or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1))


def brute(words):
    near = {w: [v for v in words if close(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    out = {}
    for w, n in words.items():
        end = w
        while end in form:
            end = form[end]
        out[w] = (form.get(w), end, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def family(rng, n, alphabet="abcdeé"):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 9)))
        for _ in range(rng.randrange(1, 6)):
            words[w] = rng.choice([5, 6, 30, 200, 1000])
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]]) or "x"
    return words


@pytest.mark.parametrize(("node", "queries", "leaf"), [(8192, 65536, 12), (20, 65536, 4), (7, 9, 1)])
def test_variants_equal_all_pairs(spark, monkeypatch, node, queries, leaf):
    monkeypatch.setattr(S, "NODE", node)
    monkeypatch.setattr(S, "QUERIES", queries)
    monkeypatch.setattr(S, "LEAF", leaf)
    words = family(random.Random(node), 500)
    # anagrams and letters of one group share a path down to the last level
    words |= {"".join(p): 5 + k for k, p in enumerate(random.Random(1).sample("abcdef", 6) for _ in range(40))} | {"aaaaaa": 9, "naaaaa": 50, "anaaaa": 300}
    df = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")
    assert found(S.variants(df)) == brute(words)


def test_long_and_foreign_words(spark):
    base = "x" * 70
    words = {base: 100, base[:-1]: 6, base[:40] + "y" + base[41:]: 7, "日本語語語語": 50, "日本語語語": 5, "日本語語語x": 5, "𐐀bcdef": 30, "bcdef": 6, "é" * 40_000: 60, "é" * 40_001: 9}
    df = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")
    assert found(S.variants(df)) == brute(words)


def test_chains_lead_to_their_root(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "akjihg": 15625, "lkjihg": 78125}
    got = found(S.variants(spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")))
    assert {v[1] for v in got.values()} == {"lkjihg"} and got["abcdef"][0] == "abcdeg" and got == brute(words)


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DDL)


def test_vocabulary_and_query_equal_the_sql(spark, tmp_path):
    rng = random.Random(4)
    stems = ["letter", "Letters", "spelling", "spellings", "ÉTUDIANTE", "étudiante", "grammar", "grammer", "short"]
    texts = [" ".join(rng.choice(stems) for _ in range(40)) for _ in range(400)] + [None, "", " ", "123 - 456", "a×b÷c word_word"]
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: (r[1], r[2], r[3], r[4], r[5]) for r in con.execute(S.SQL).fetchall()}
    got = found(S.op13_spelling(spark, str(tmp_path)))
    assert got == want and any(v[0] for v in got.values()) and {"étudiante", "Étudiante"} <= got.keys()  # only A to Z are lower-cased


def test_odd_documents(spark):
    none = spark.createDataFrame([], DDL)
    assert S.variants(S.vocabulary(none)).count() == 0
    docs = documents(spark, ["longish " * 3, None, "longish longish", "tiny " * 9]).unionByName(spark.createDataFrame([(None, "longish " * 2, None, None, None)] * 2, DDL)).selectExpr("*", "1 AS word", "2 AS n", "'x' AS run")
    got = {r["word"]: r["n"] for r in S.vocabulary(docs, least=1, every=10**9).collect()}
    assert got == {"longish": 9}
    assert S.vocabulary(documents(spark, ["word" * 200_000 + " " + "abcdefg " * 50_000]), least=1, every=10**9).count() == 2
    odd = spark.createDataFrame([(None, 5), ("abcdef", None), ("abcdeg", 5)], "word STRING, n BIGINT")
    assert found(S.variants(odd)) == {"abcdeg": (None, "abcdeg", 5, 0, None)}
