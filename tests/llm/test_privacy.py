"""Personal data against plain regular expressions, terms against their definition, and odd texts."""

import hashlib
import random
import re
import time
from collections import Counter
from math import log2

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattice.llm import privacy as P

DDL = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def plain(text):
    """The base patterns as they are written."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    luhn = lambda d: sum(v - 9 if v > 9 else v for k, c in enumerate(reversed(d)) for v in [int(c) * (1 + k % 2)]) % 10 == 0
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m[0]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a@.-1_ é", max_size=40), st.text("0123456789 -.", max_size=60), st.text("+1 ().-", max_size=40)))
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_base_spans_of_examples():
    text = "é A.b+c@x-y.example.org, 10.0.0.256 and 10.0.0.255.1.2.3.4; 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (555) 123-4567 +12"
    got = [(P.KINDS[k], text[a:b]) for a, k, b in P.base_spans(text)]
    assert got == [("email", "A.b+c@x-y.example.org"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert P.base_spans(text) == plain(text)


def test_searches_are_linear():
    began = time.time()
    for text in ("1" * 10**6, "a" * 10**6, "a@" * 5 * 10**5, "+1(" * 10**5, "+1" + "(" * 10**6, "1." * 5 * 10**5, "1 " * 5 * 10**5):
        P.base_spans(text)
    assert time.time() - began < 30


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [prose(80) for _ in range(200)]
    rows += [f"{prose(30)} Zorblax Quimby at z.quimby@mail.example.com {prose(30)}" for _ in range(6)]
    rows += [f"{prose(20)} zorblax {prose(5)}", None, ""]
    one = f"{prose(25)} call +1 (555) 123-4567 today {prose(25)}"
    rows += [" ".join(w if rng.random() > 0.05 else rng.choice(words) for w in one.split(" ")) for _ in range(40)]  # near copies
    return rows


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DDL)


def brute_terms(texts):
    """Terms from the definition, all counts in dictionaries."""
    beside, everywhere = Counter(), Counter()
    for t in texts:
        for e, c, w, n in P.contexts(t or ""):
            beside[e, w, c] += n
        everywhere.update(w for _, _, w in P.words_outside(t or "", plain(t or "")))
    total, share = sum(everywhere.values()), Counter()
    for (e, _, _), n in beside.items():
        share[e] += n
    out = {}
    for e, w in {(e, w) for e, w, _ in beside}:
        ns = [n for (a, b, _), n in beside.items() if (a, b) == (e, w)]
        if sum(ns) ** 2 / sum(n * n for n in ns) < P.CONTEXTS:
            continue
        told = 1 + log2(min(1.0, sum(ns) / everywhere[w])) / -log2(share[e] / total)
        if told >= P.DISCLOSED:
            out[w] = max(out.get(w, 0), told)
    return out


def test_terms_that_disclose(spark, monkeypatch):
    texts = corpus()
    docs = documents(spark, texts)
    terms = P.disclosing_terms(docs)
    got = {r["term"]: r["disclosure"] for r in terms.collect()}
    want = brute_terms(texts)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in got)
    # what stands beside one address in unlike contexts, not what near copies repeat
    assert set(got) == {"zorblax", "quimby"}
    found = {r["doc_id"]: r for r in P.find(docs, terms).collect()}
    assert {k for k, r in found.items() if r["n_term"]} == set(range(200, 207)) and found[206]["n_email"] == 0 and found[206]["spans"].startswith("term:")
    assert "[TERM] [TERM] at [EMAIL]" in found[200]["sanitised"] and "uimby" not in found[200]["sanitised"]
    # more terms than one task holds: the same by a join
    monkeypatch.setattr(P, "TERMS", 1)
    joined = {r["doc_id"]: r for r in P.find(docs, P.disclosing_terms(docs)).collect()}
    assert joined == found


def test_generalised_where_the_first_letters_tell_less(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{prose(30)} Marklin 10.1.2.3 {prose(30)}" for _ in range(6)] + [f"{prose(20)} market marked {prose(20)}" for _ in range(40)]
    docs = documents(spark, texts)
    terms = P.disclosing_terms(docs)
    assert {r["term"]: r["action"] for r in terms.collect()} == {"marklin": "generalise"}
    assert "Mar… [IP]" in P.find(docs, terms).where("doc_id = 0").first()["sanitised"]


def test_odd_documents(spark):
    texts = [None, "", " ", "a@b.c" * 3, "x " * 20_000 + "me@home.org " + "y" * 50_000, "日本 é@e.fr 🙂 1.2.3.4", "1.2.3.4 1.2.3.4"]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 6")).unionByName(spark.createDataFrame([(None, "q@r.st", None, None, None)], DDL)).withColumn("term", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("spans", F.lit("s"))
    got = P.find(docs, P.disclosing_terms(docs)).collect()
    assert len(got) == 9
    for r in got:
        text = "q@r.st" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in plain(text))
        assert r["spans"] == base and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["n_term"] == 0
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in plain(text)) for j in range(4)]
    empty = spark.createDataFrame([], DDL)
    assert P.disclosing_terms(empty).count() == 0 == P.find(empty, P.disclosing_terms(empty)).count()


def test_query_covers_the_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in P.op12_personal_data(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        base = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in plain(r["text"] or ""))
        assert rows[r["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_only_words_of_wanted_heads_are_counted(spark):
    # the counts are those of all words, whatever else the texts hold
    texts = spark.createDataFrame([("Leaked leak other words the",), ("leaking \u0130leak \u03a3\u0391\u03a3 LEAKED 1.2.3.4 more",)], "text string")
    got = {(r["general"], r["term"]): r["n"] for r in P._everywhere(texts, frozenset({"leaked"})).groupBy("general", "term").sum("n").toDF("general", "term", "n").collect()}
    assert got == {(False, "leaked"): 2, (True, "lea"): 4, (False, None): 10}


def test_words_are_lower_cased_as_each_by_itself():
    import sys

    # of all characters the dotted I alone changes the bounds of words, and sigma alone depends on what is beside it
    letter = lambda c: bool(P._WORD.fullmatch(c * 3))
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and (len(c.lower()) != 1 or letter(c) != letter(c.lower()))]
    assert odd == ["\u0130"]
    for text in ("\u0391\u03a3'\u0391\u03a3\u0391 \u0391\u0391\u03a3'\u0391", "\u0130stanbul ABC\u0130 xyz", "\u00c9cole ABC d\u00c9f"):
        words = [w.lower() for w in P._WORD.findall(text)]
        assert P._lowered(text) == words and all(P._may_hold(text, [w]) for w in words)


def test_a_text_without_a_term_is_not_split_into_words(monkeypatch):
    split = []
    monkeypatch.setattr(P, "_lowered", lambda t: split.append(t) or t.lower().split())
    assert P.all_spans("nothing of it here", {"leaked": "remove"}) == [] and not split
    assert P.all_spans("it Leaked here", {"leaked": "remove"}) == [(3, 4, 9)]
