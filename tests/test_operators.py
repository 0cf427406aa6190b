import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattice.functions import strings as S
from lattice.operators import dml as D
from lattice.operators import joins as J
from lattice.operators import text as X
from lattice.operators import vectors as V
from lattice.operators.segments import Conflict

from .conftest import got


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expr).first()[0]


def test_string_functions(spark):
    c = F.col
    dashed = {"-Users-john-projects-MyApp-ios": "MyApp/ios", "-Users-john-projects-backend": "backend", "-Users-john-projects": "projects", "-Users-john": "john"}
    for k, v in dashed.items():
        assert one(spark, S.project_of_dashed(c("x")), x=k) == v
    assert one(spark, S.html_to_text(c("x")), x="<p>a</p><SCRIPT x>if(a<b){}</script><style>p{}</style> b&amp;c") == "a b&amp;c"
    assert one(spark, S.relative_path(c("x"), F.lit("/a/b")), x="/a/b/c.py") == "c.py"
    assert one(spark, S.relative_path(c("x"), F.lit("/a/b")), x="/a/bc/c.py") == "/a/bc/c.py"
    assert one(spark, S.video_id(c("x")), x="https://youtu.be/abcdefghijk?t=1") == "abcdefghijk"
    assert one(spark, S.video_id(c("x")), x="https://x.y/none") is None
    assert [one(spark, S.clock_seconds(c("x")), x=t) for t in ("0:00", "5:30", "1:05:20", "00:00:02.010")] == [0, 330, 3920, 2.01]
    assert [one(spark, S.clock_text(c("x")), x=n) for n in (0, 330, 3920)] == ["0:00", "5:30", "1:05:20"]
    assert one(spark, S.compact_date(c("x")), x="20260102") == "2026-01-02"
    assert [one(spark, S.directory_key(c("x")), x=p) for p in ("a", "a/b", "a/b/c", "a/b/c/d")] == ["(root)", "a/", "a/b/", "a/b/"]
    assert one(spark, S.slug_of(c("x")), x="https://a.b/posts/my-slug/?x=1") == "my-slug"
    assert one(spark, S.name_parts(c("x")), x="niklas_fischer") == ["niklas", "fischer"]
    match = lambda url, title: one(spark, S.profile_matches(F.lit("niklas_fischer"), c("u"), c("t")), u=url, t=title)
    assert match("https://www.linkedin.com/in/niklas-fischer", "x") and match("https://www.linkedin.com/in/zzzz", "Niklas Fischer - CEO")
    assert not match("https://www.linkedin.com/company/niklas-fischer", "Niklas Fischer")
    assert one(spark, S.topic_tags(c("a"), c("b")), a="AI Tools, Dev", b="2026-03-01") == "ai-tools,dev,2026-03"
    assert one(spark, S.sibling_context(F.lit(None), c("a"), F.lit("n")), a="x") == "x\nn" and one(spark, S.sibling_context(F.lit(None), c("a"), F.lit("")), a="x") is None
    assert one(spark, S.looks_binary(c("a")), a="ok\n") is False and one(spark, S.looks_binary(c("a")), a="\x01" * 21) is True
    assert one(spark, S.any_timestamp(c("a")), a="nonsense") is None and one(spark, S.any_timestamp(c("a")), a="2026-01-02") is not None
    assert [one(spark, S.product_status(c("f"), c("r")), f=f, r=r) for f, r in (("x", 0), ("", 3), ("", 0))] == ["featured", "launched", "created"]
    assert one(spark, S.mermaid_id(c("a")), a="a/b.c") == "a_b_c" and one(spark, S.mermaid_label(c("a")), a='a"b') == "a'b"


def test_ranking(spark):
    lists = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "b", 1), (1, "d", 2)], "list_id int, id string, rank int")
    out = got(V.fuse(lists))
    assert [(k, round(s, 10)) for k, s in out] == [("b", 0.0325224749), ("a", 0.0163934426), ("d", 0.0161290323), ("c", 0.0158730159)]
    for pop, want in ((0, 0.68), (999, 0.80), (10_000, 0.83)):
        assert one(spark, F.lit(0.8) * V.COSINE_WEIGHT + V.boost(F.col("p")), p=pop) == pytest.approx(want, abs=1e-9)
    t = spark.createDataFrame([("v1", "x", 0.8), ("v1", "y", 0.5), ("v2", "x", 0.6), ("v2", "y", 0.7), ("v3", "y", 0.3)], "v string, t string, w double")
    rel = {r["b"]: (r["overlap"], round(r["relevance"], 6)) for r in J.related_by_tag(t, "v", "t", "w", "v1").collect()}
    assert rel == {"v2": (2, 1.3), "v3": (1, 0.4)}
    assert one(spark, V.cosine(V.vector([0.0, 0.0]), V.vector([1.0, 2.0]))) == 0.0


def test_lsh_recall(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    exact = {r["id"] for r in V.knn(df, rows[0][1], 10).collect()}
    near = {r["id"] for r in V.knn_lsh(df, rows[0][1], 10, bucket=2.0).collect()}
    assert len(exact & near) >= 9


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=string.ascii_lowercase[:5] + " .\n", max_size=3000))
def test_split_keeps_words_and_bounds(text):
    parts = X.split_text(text, 20, 100)
    assert all(0 < len(p) <= 100 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_contains_join_equals_nested_loop(spark):
    texts, frags = ["abc", "xabcx", "ab", "", "a%c", None], ["abc", "b", "", "a%", "zz", "ab", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    f = spark.createDataFrame([(x,) for x in frags], "f string")
    assert sorted(got(J.contains_join(t, "t", f, "f").select("t", "f"))) == sorted((a, b) for a in texts if a is not None for b in frags if b and b in a)


def test_contains_join_by_a_key_and_odd_letters(spark):
    rnd = random.Random(5)
    piece = lambda n: "".join(rnd.choice("abé🙂") for _ in range(rnd.randrange(n)))
    texts = [(rnd.choice("pq"), piece(12) or None, k) for k in range(80)] + [(None, "ab", 90)]
    frags = [(rnd.choice("pq"), piece(6) or None, k) for k in range(60)] + [(None, "ab", 99), ("p", "ab", 60), ("p", "ab", 61)]
    t, f = spark.createDataFrame(texts + texts[:5], "k string, t string, i int"), spark.createDataFrame(frags, "k string, f string, j int")
    want = sorted((a, x, i, y, j) for a, x, i in texts + texts[:5] for b, y, j in frags if a == b and a and x and y and y in x)
    assert sorted(got(J.contains_join(t, "t", f, "f", by=["k"]).select("k", "t", "i", "f", "j"))) == want


def test_contains_join_meets_by_the_rarest_piece(spark, monkeypatch):
    """Names with one beginning, in texts that all hold that beginning: candidates are few more than matches."""
    texts = [f"the use of the user {k % 400} and item{k}" for k in range(4000)]
    frags = [f"the user {k} and" for k in range(400)] + [f"use of the user {k} " for k in range(300, 600)]
    t, f = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in frags], "f string")
    seen = []
    real = F.contains

    def counting(a, b):
        seen.append(1)
        return F.lit(True)  # candidates as they are

    matches = J.contains_join(t, "t", f, "f", gram=6).count()
    monkeypatch.setattr(J.F, "contains", counting)
    candidates = J.contains_join(t, "t", f, "f", gram=6).count()
    monkeypatch.setattr(J.F, "contains", real)
    assert seen and matches == sum(b in a for a in texts for b in frags) and matches <= candidates <= 2 * matches


def test_interval_and_siblings(spark):
    p = spark.createDataFrame([("u", 1), ("u", 5), ("u", 9), ("v", 1)], "k string, at int")
    m = spark.createDataFrame([("u", 2, "x"), ("u", 9, "y")], "k string, at int, name string")
    assert sorted(got(J.interval_assign(p, "at", m, "at", ["k"], ["name"])), key=str) == [("u", 1, None), ("u", 5, "x"), ("u", 9, "y"), ("v", 1, None)]
    s = spark.createDataFrame([("v", 0, "a"), ("v", 1, "b"), ("v", 3, "d")], "v string, i int, t string")
    assert sorted(got(J.with_siblings(s, ["v"], "i", ["t"]).select("i", "prev_t", "next_t"))) == [(0, None, "b"), (1, "a", None), (3, None, None)]


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = D.upsert(old, new, ["k"])
    assert sorted(got(once)) == [(1, "a"), (2, "B"), (3, "c")] == sorted(got(D.upsert(once, new, ["k"])))
    assert got(D.upsert_counts(old, new, ["k"])) == [(1, 1)]
    s = D.Store(spark, str(tmp_path / "store"))
    assert s.names() == [] and s.version("t") is None
    s.write("t", old)
    assert got(s.merge("t", new, ["k"])) == [(1, 1)] and sorted(got(s.read("t"))) == [(1, "a"), (2, "B"), (3, "c")]
    s.write("t", s.read("t").where("k > 1"))  # a plan that reads what it replaces
    assert sorted(got(s.read("t"))) == [(2, "B"), (3, "c")] and s.names() == ["t"] and s.delete("t") and not s.delete("t")
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string")
    before = spark.createDataFrame([(1, "x"), (2, "q")], "k int, h string")
    assert sorted((r["k"], r["status"]) for r in D.classify(docs, before, "k", "h").collect()) == [(1, "unchanged"), (2, "updated"), (3, "new")]
    assert {r["status"] for r in D.classify(docs, before, "k", "h", force=True).collect()} == {"updated", "new"}
    a, b = spark.createDataFrame([("x", "l", None, 5)], "k string, s string, t string, n int"), spark.createDataFrame([("x", "r", "", 9), ("y", "", "T", 1)], "k string, s string, t string, n int")
    assert sorted(got(J.merge_by_key(a, b, "k", {"s": "left", "t": "right", "n": "greatest"}))) == [("x", "l", None, 9), ("y", None, "T", 1)]


def test_clear_project(spark):
    from .graphs import mini

    g = mini(spark)
    nodes, edges = D.clear_project(g.nodes, g.edges, "alpha")
    assert nodes["File"].count() == 2 and nodes["Package"].count() == 3 and nodes["Session"].count() == 3
    assert edges[("Project", "HAS_FILE", "File")].count() == 2 and edges[("Session", "EDITED", "File")].count() == 2


def test_tfidf_filters_before_the_limit(spark):
    d = spark.createDataFrame([(1, "red red", "x"), (2, "red blue", "y"), (3, "green", "y")], "id int, text string, kind string")
    assert [r["id"] for r in X.tfidf(d, "red (nope", 5).collect()] == [1, 2]
    assert [r["id"] for r in X.tfidf(d, "red", 1, where=F.col("kind") == "y").collect()] == [2]
    assert X.tfidf(d, "(only)", 5).count() == 0
    h = X.hybrid(X.embed(d, "text"), "zebra", X.hash_embedding("blue"), 2).collect()
    assert len(h) == 2 and h[0]["id"] == 2  # no word matches: the vector list alone


def test_two_merges_at_one_version_are_both_kept(spark, tmp_path):
    s = D.Store(spark, str(tmp_path / "s"))
    rows = lambda *k: spark.createDataFrame([(x, "v") for x in k], "id bigint, v string")
    s.write("t", rows(1))
    with pytest.raises(Conflict):
        s.write("t", rows(9), base=0)
    raced, real = [], D.upsert

    def upsert(old, new, key):
        if not raced:
            raced.append(1)
            D.Store(spark, str(tmp_path / "s")).merge("t", rows(2), ["id"])
        return real(old, new, key)

    D.upsert = upsert
    try:
        counts = s.merge("t", rows(1, 3), ["id"]).first()
    finally:
        D.upsert = real
    assert sorted(r["id"] for r in s.read("t").collect()) == [1, 2, 3] and (counts["created"], counts["matched"]) == (1, 1)
