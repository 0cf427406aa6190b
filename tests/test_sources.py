import json

from pyspark.sql import functions as F

from lattice.operators import reports as R
from lattice.sources import code, files, gitlog, manifests, notes, paged, products, sessions, transcripts
from lattice.tools import Engine, match_people, web_search

from .conftest import got


def tree(spark, rows, project="p"):
    return spark.createDataFrame([(project, k, v) for k, v in rows.items()], "project string, path string, text string")


def deps(df):
    return sorted((r["name"], r["version"], r["source"]) for r in df.collect())


def test_manifests(spark):
    m = lambda f, **kw: deps(f(tree(spark, kw.get("rows"))))
    assert m(manifests.package_json, rows={"package.json": '{"dependencies":{"react":"^18.2.0"},"devDependencies":{"zod":"~3.1"}}'}) == [("react", "18.2.0", "npm"), ("zod", "3.1", "npm")]
    assert m(manifests.pyproject, rows={"pyproject.toml": '[project]\ndependencies=["fastapi>=0.100","httpx"]'}) == [("fastapi", "0.100", "pip"), ("httpx", None, "pip")]
    assert m(manifests.pyproject, rows={"pyproject.toml": '[tool.poetry.dependencies]\npython="^3.12"\nclick={version="^8.1"}'}) == [("click", "8.1", "pip")]
    assert m(manifests.pyproject, rows={"pyproject.toml": "not [ toml"}) == []
    assert m(manifests.requirements, rows={"requirements.txt": "# c\n-r x\nnumpy==2.0\nfoo; python_version<\"3.9\"\n"}) == [("foo; python_version", '"3.9"', "pip"), ("numpy", "2.0", "pip")]
    assert m(manifests.package_swift, rows={"Package.swift": '.package(url: "https://github.com/apple/swift-log.git", from: "1")'}) == [("swift-log", None, "spm")]
    assert m(manifests.gradle, rows={"build.gradle.kts": 'implementation("a.b:c:1.0")'}) == [("a.b:c", "1.0", "gradle")]
    whole = {"pyproject.toml": '[project]\ndependencies=["a>=1"]', "requirements.txt": "b==2", "web/package.json": '{"dependencies":{"c":"1"}}', "node_modules/package.json": '{"dependencies":{"d":"1"}}', ".x/package.json": '{"dependencies":{"e":"1"}}', "a/b/package.json": '{"dependencies":{"f":"1"}}', "app/build.gradle.kts": 'implementation("g:h:1")', "build.gradle.kts": 'implementation("i:j:1")'}
    found = manifests.scan_dependencies(tree(spark, whole))
    assert [n for n, _, _ in deps(found)] == ["a", "c", "g:h"]
    nodes, edges = manifests.packages(found)
    assert nodes.count() == 3 == edges.count()


def test_commit_log(spark):
    text = "0123456789abcdef|Ann|2026-01-02T03:04:05+00:00\n\n10\t2\tsrc/app.ts\n-\t-\tlogo.png"
    lines = spark.createDataFrame([("p", k, x) for k, x in enumerate(text.split("\n"))], "project string, line_no bigint, line string")
    out = gitlog.parse_log(lines)
    assert sorted(got(out)) == [("logo.png", "p", "Ann", "2026-01-02", 0, 0, "01234567"), ("src/app.ts", "p", "Ann", "2026-01-02", 10, 2, "01234567")]
    f = spark.createDataFrame([("p|src/app.ts",)], "id string")
    assert [r["src"] for r in gitlog.modified_edges(out, f).collect()] == ["p|src/app.ts"] and got(gitlog.last_commit(out)) == [("p", "2026-01-02")]


def test_git_source(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x\n")
    run("add", "a.py")
    run("commit", "-qm", "one")
    out = gitlog.parse_log(gitlog.read_log(spark, {"p": str(tmp_path), "none": str(tmp_path.parent)})).collect()
    assert [(r["file"], r["author"], r["lines_added"]) for r in out] == [("a.py", "Ann", 1)]


def test_sessions(spark, tmp_path):
    d = tmp_path / "-Users-john-projects-MyApp-ios"
    d.mkdir()
    a = lambda *blocks, **kw: {"type": "assistant", "timestamp": kw.get("t"), "message": {"model": "m1", "content": list(blocks)}}
    tool = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    lines = [
        {"type": "user", "cwd": "/w", "timestamp": "2026-01-01T00:00:01Z", "gitBranch": "main", "slug": "sl", "message": {"content": "please fix the bug"}},
        {"type": "progress", "timestamp": "2026-01-01T09:00:00Z"}, {"type": "user", "message": {"content": "<system>marker text"}}, {"type": "user", "message": {"content": "ok"}},
        {"type": "user", "message": {"content": [{"type": "text", "text": "second prompt here"}, {"type": "tool_result", "text": "ignored result"}]}},
        a(tool("Read", file_path="/w/src/a.py"), {"type": "text", "text": "I looked at the file"}, t="2026-01-01T00:00:02Z"), a(tool("Edit", file_path="/w/src/a.py"), tool("Bash", command="ls"), tool("Grep", path="/other/x")),
        {"type": "system", "subtype": "turn_duration", "durationMs": 1500, "timestamp": "2026-01-01T00:00:03Z"},
    ]
    (d / "s1.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    (d / "s2.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "<x>"}}) + "\n")
    rows = sessions.parse(sessions.read_lines(spark, str(tmp_path), "myapp"))
    n = sessions.sessions(rows)
    assert [tuple(r)[1:] for r in n.collect()] == [("s1", "MyApp/ios", "/w", "2026-01-01T00:00:01Z", "2026-01-01T00:00:03Z", 1500, 2, 4, "m1", "main", "sl")]
    act = sessions.file_actions(rows, n)
    assert sorted((r["path"], r["action"], r["count"]) for r in act.collect()) == [("/other/x", "TOUCHED", 1), ("src/a.py", "EDITED", 2)]
    e = sessions.session_edges(act)
    assert got(e["EDITED"]) == [("s1", "MyApp/ios|src/a.py", 2)] and e["CREATED"].count() == 0
    s = sessions.summaries(rows, n, act).collect()[0]
    assert "Branch: main" in s["summary"] and "1. please fix the bug" in s["summary"] and "src/a.py" in s["summary"] and list(s["tags"]) == ["MyApp/ios", "main"]
    assert sessions.in_project(n, spark.createDataFrame([("MyApp/ios",)], "name string")).count() == 1


def test_notes(spark):
    t = tree(spark, {"a/n.md": "---\ntitle: T\ntype: idea\ntags: [x, y]\nopportunity_score: 7\n---\nbody text", "plain.md": "just text", "README.md": "no", "b/archive/z.md": "no", "bad.md": "---\n: [\n---\nrest", "x.txt": "no"})
    out = {r["file"]: r for r in notes.scan_notes(t, "2026-01-01").collect()}
    assert set(out) == {"a/n.md", "plain.md", "bad.md"}
    n = out["a/n.md"]
    assert (n["title"], n["doc_type"], n["status"], n["tags"], n["opportunity_score"], n["content"], n["updated"]) == ("T", "idea", "active", "x,y", 7.0, "body text", "2026-01-01")
    assert (out["plain.md"]["title"], out["plain.md"]["doc_type"], out["bad.md"]["title"]) == ("plain", "unknown", "bad")
    assert n["text"] == "T\n\nbody text"
    stats = {(r[0], r[1]): r[2] for r in got(notes.note_stats(notes.scan_notes(t, "")))}
    assert stats[("total", "documents")] == 3 and stats[("tags", "unique")] == 2


VTT = "WEBVTT\nKind: captions\nLanguage: en\n\n00:00:00.000 --> 00:00:02.000\nhello<00:00:01.000><c> world</c>\n\n00:00:02.000 --> 00:00:02.010\nhello world\n\n00:00:02.010 --> 00:00:04.000\nhello world\nsecond<c> line</c>\n\n00:00:04.000 --> 00:00:04.010\nsecond line\n"


def test_transcripts(spark):
    manual = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\none\n\n00:00:03.000 --> 00:00:05.000\none\n\n00:00:05.000 --> 00:00:06.000\ntwo\n"
    v = spark.createDataFrame([("a", VTT), ("m", manual), ("e", "")], "video_id string, vtt string")
    assert {r[0]: r[1] for r in got(transcripts.vtt_text(v))} == {"a": "hello world second line", "m": "one two", "e": ""}
    assert sorted((r["video_id"], r["start"], r["text"]) for r in transcripts.segments(v).collect()) == [("a", 2.0, "hello world"), ("a", 4.0, "second line"), ("m", 1.0, "one"), ("m", 5.0, "two")]
    d = spark.createDataFrame([("a", "About\n0:00 Intro\n5:30 Revenue Model\n1:05:20 Q&A\nbye"), ("b", "0:00 Only")], "video_id string, description string")
    assert [(r["title"], r["start_time"], r["start_seconds"]) for r in transcripts.chapters(d).orderBy("position").collect()] == [("Intro", "0:00", 0), ("Revenue Model", "5:30", 330), ("Q&A", "1:05:20", 3920)]


def test_video_chunks(spark):
    cue = lambda k, text: f"00:{k // 60:02d}:{k % 60:02d}.000 --> 00:{k // 60:02d}:{k % 60:02d}.900\n{text}\n"
    vtt = "WEBVTT\n\n" + "\n".join(cue(k * 10, f"words number {k} are spoken here at some length indeed") for k in range(60))
    rows = [("t", vtt, "0:00 First part\n5:00 Second part\n and a longer description of the video", 600), ("p", vtt, "no chapters in here, only a description of some length, really", 0), ("short", "WEBVTT\n\n" + cue(0, "hi"), "x" * 60, 10)]
    out = transcripts.video_chunks(spark.createDataFrame(rows, "video_id string, vtt string, description string, duration_seconds bigint")).orderBy("video_id", "chunk_index").collect()
    t = [r for r in out if r["video_id"] == "t"]
    assert [r["chunk_index"] for r in t] == list(range(len(t))) and t[-1]["chunk_type"] == "description" and all(len(r["text"]) <= 1500 for r in out)
    spoken = [r for r in t if r["chunk_type"] == "transcript"]
    assert {r["chapter"] for r in spoken} == {"First part", "Second part"} and spoken[0]["start_seconds"] == 0.0
    assert " ".join(r["text"] for r in spoken) == " ".join(f"words number {k} are spoken here at some length indeed" for k in range(60))
    assert min(r["start_seconds"] for r in spoken if r["chapter"] == "Second part") == 300.0
    assert {r["chapter"] for r in out if r["video_id"] == "p"} == {""} and "short" not in {r["video_id"] for r in out}
    texts = spark.createDataFrame([("q", "abcdefghij" * 10)], "video_id string, text string")
    marks = spark.createDataFrame([("q", 0, "A", "0:00", 0), ("q", 1, "B", "0:30", 30)], "video_id string, position int, title string, start_time string, start_seconds bigint")
    vids = spark.createDataFrame([("q", 100)], "video_id string, duration_seconds bigint")
    assert [(r["chapter"], len(r["text"])) for r in transcripts.proportional_chunks(texts, marks, vids).orderBy("chunk_index").collect()] == [("A", 30), ("B", 70)]
    s = transcripts.sections(spark.createDataFrame([("## 1. Title one\n" + "x" * 200 + "\n---\nshort\n---\nno heading " + "y" * 200,)], "text string"))
    assert [r["title"] for r in s.collect()] == ["Title one"]


ITEM = "slug STRING, name STRING, tagline STRING, description STRING, topics STRING, upvotes BIGINT, comments BIGINT, rating DOUBLE, daily_rank BIGINT, featured_at STRING, website STRING, url STRING, launch_date STRING, makers ARRAY<STRUCT<username: STRING, name: STRING, url: STRING, followers: BIGINT, role: STRING>>"


def item(slug, name="N", upvotes=10, makers=(), **kw):
    d = {"tagline": None, "description": None, "topics": None, "comments": None, "rating": None, "daily_rank": None, "featured_at": None, "website": None, "url": None, "launch_date": None} | kw
    return (slug, name, d["tagline"], d["description"], d["topics"], upvotes, d["comments"], d["rating"], d["daily_rank"], d["featured_at"], d["website"], d["url"], d["launch_date"], [(u, n, None, None, r) for u, n, r in makers])


def test_products(spark):
    rows = [
        item("a", "Alpha", 50, [("ann", "Ann A", "maker"), ("bob", "Bob", "commenter")], tagline="tag", topics="AI Tools, Dev", launch_date="2026-03-01", featured_at="x"),
        item("b", "Beta", 7, [("ann", "Ann", "commenter"), ("cy", "Cy", "hunter"), ("dee", "", None)], daily_rank=3), item("", "Nameless"), item("c", "", 3),
    ]
    items = spark.createDataFrame(rows, ITEM)
    d = {r["title"]: r for r in products.product_docs(items, "shop", "sp", "https://x/").collect()}
    assert set(d) == {"Alpha — 50↑", "Beta — 7↑"} and got(products.rejected(items)) == [(2,)]
    a = d["Alpha — 50↑"]
    assert a["tags"] == "shop,ai-tools,dev,2026-03" and a["content"] == "tag | 50↑ | AI Tools, Dev" and a["product_status"] == "featured" and a["popularity"] == 50
    assert a["text"] == "Alpha. tag. Topics: AI Tools, Dev. Upvotes: 50. Makers: Ann A, Bob. Launched: 2026-03-01" and d["Beta — 7↑"]["product_status"] == "launched" and d["Beta — 7↑"]["url"] == "https://x/b"
    people = {r["username"]: r for r in R.people(items).collect()}
    assert (people["ann"]["role"], people["ann"]["n_products"], people["bob"]["role"], people["dee"]["role"], people["ann"]["max_upvotes"]) == ("maker", 2, "commenter", "maker", 50)
    prof = spark.createDataFrame([("ann", "h", 20)], "username string, headline string, points bigint").select("*", *[F.lit("").alias(c) for c in ("about", "linkedin", "twitter", "github", "website", "profile_url")], F.lit(0).alias("streak"), F.lit(1).alias("followers"))
    assert [r["username"] for r in R.leads(items, prof).collect()] == ["ann"]  # others have no profile: points 0
    assert len(R.leads(items, prof, points=(0, None)).collect()) == 4
    users, edges = products.user_graph(items, "sp")
    assert {r["username"]: r["roles"] for r in users.collect()} == {"ann": "commenter,maker", "bob": "commenter", "cy": "hunter", "dee": "maker"}
    assert {k: v.count() for k, v in edges.items()} == {"MADE": 2, "COMMENTED": 2, "PARTICIPATED": 1}
    assert [r[0] for r in got(products.usernames(items))] == ["ann", "bob", "cy", "dee"]


def test_enrich_and_merge(spark):
    base = spark.createDataFrame([item("a", "A", 5, [("[REDACTED]", "[REDACTED]", "maker")]), item("b", "B", 9, [("x", "X", "maker")])], ITEM)
    found = spark.createDataFrame([item("a", "other", 8, [("ann", "Ann", "maker")], tagline="new"), item("z", "Z", 1)], ITEM)
    out = {r["slug"]: r for r in products.enrich(base, found).collect()}
    assert set(out) == {"a", "b", "z"} and (out["a"]["name"], out["a"]["upvotes"], out["a"]["tagline"], out["a"]["makers"][0]["username"]) == ("A", 8, "new", "ann") and out["b"]["makers"][0]["username"] == "x"
    assert {r["slug"]: r["name"] for r in products.merge_dumps([found, base]).collect()} == {"a": "other", "b": "B", "z": "Z"}


def test_paged_source(spark):
    def fetch(first, last, cursor):
        page = int(cursor or 0)
        return [(f"{first}-{page}", last)], str(page + 1) if page < 1 else None

    kind = paged.paged_source("paged_test", "slug string, day string", fetch)
    known = spark.createDataFrame([("2026-01-01-0",)], "slug string")
    out = paged.read_paged(spark, kind, "2026-01-01", "2026-01-10", 7, known)
    assert sorted(got(out)) == [("2026-01-01-1", "2026-01-07"), ("2026-01-08-0", "2026-01-10"), ("2026-01-08-1", "2026-01-10")]


def test_startup_pages(spark):
    html = '<meta property="og:title" content="Acme - $12k MRR"><a href="/category/saas">SaaS</a><a href="/country/de">Germany</a><a href="/tech/x">Next.js</a><a href="/tech/y">Go</a>'
    p = products.startup_pages(spark.createDataFrame([("https://s/startup/acme", html)], "url string, html string"))
    assert tuple(p.first()) == ("https://s/startup/acme", "acme", "Acme", "$12k", "SaaS", "Germany", "Next.js, Go")
    d = products.startup_docs(p.select("*", F.lit("x").alias("founder_x"), F.lit("desc").alias("description")), "biz", "bz", "https://s/").first()
    assert d["title"] == "Acme — $12k/mo" and d["tags"] == "biz,SaaS,nextjs,go" and d["content"] == "Revenue: $12k/30d | Stack: Next.js, Go | Founder: @x | Country: Germany"


PY = "import os\nfrom .util import x\nfrom a.b import c\nclass Base: pass\nclass Kid(Base, m.Other):\n    def run(self):\n        print(1)\n        helper(2)\n        self.go()\ndef helper(n):\n    return n\n"
TS = "import x from './x'\nimport {y} from '@a/b/c'\nexport class App extends Root {\n  go() { fmt(1); console.log(2) }\n}\nexport async function render(a) { fmt(3) }\n// function no() {}\n"


def test_parse_code(spark):
    t = spark.createDataFrame([("p", "pkg/a.py", "python", PY), ("p", "pkg/b.ts", "typescript", TS), ("p", "bad.py", "python", "def (:"), ("p", "none.go", "go", None)], "project string, path string, lang string, text string")
    r = code.parse(t)
    pick = lambda path, what: sorted((x["name"], x["extra"]) for x in r.where((F.col("path") == path) & (F.col("what") == what)).collect())
    assert pick("pkg/a.py", "symbol") == [("Base", "class"), ("Kid", "class"), ("helper", "function"), ("run", "function")]
    assert [n for n, _ in pick("pkg/a.py", "import")] == [".util", "a.b", "os"] and [n for n, _ in pick("pkg/a.py", "call")] == ["go", "helper"] and pick("pkg/a.py", "inherit") == [("Kid", "Base")]
    assert pick("pkg/b.ts", "symbol") == [("App", "class"), ("render", "function")] and pick("pkg/b.ts", "inherit") == [("App", "Root")] and "fmt" in [n for n, _ in pick("pkg/b.ts", "call")]


def test_other_languages():
    s = lambda lang, text: sorted((n, k) for w, n, k, _ in code.parse_file(text, lang) if w == "symbol")
    assert s("rust", "pub fn go() {}\npub struct S;\ntrait T {}\n") == [("S", "class"), ("T", "protocol"), ("go", "function")]
    assert s("go", "func (s *S) Run() {\n}\ntype S struct {}\nfunc main() {\n}") == [("Run", "function"), ("S", "class"), ("main", "function")]
    assert s("java", "public class A extends B {\n  public int f(int x) {\n  }\n}\ninterface I {\n}") == [("A", "class"), ("I", "protocol"), ("f", "function")]
    assert s("ruby", "class A < B\n  def f\n  end\nend\nmodule M\nend") == [("A", "class"), ("M", "class"), ("f", "function")]
    assert s("c", "#include <stdio.h>\nstruct P {\n};\nint main(void) {\n}") == [("P", "class"), ("main", "function")]
    assert s("cpp", "class A : public B {\n};\nvoid f(int x) {\n}") == [("A", "class"), ("f", "function")]
    assert s("swift", "protocol P {}\nclass A: P {}\nfunc f() {}") == [("A", "class"), ("P", "protocol"), ("f", "function")]
    assert s("kotlin", "class A : B() {\n fun f() {}\n}\nobject O") == [("A", "class"), ("O", "class"), ("f", "function")]
    names = lambda lang, text, what: [(n, x) for w, n, x, _ in code.parse_file(text, lang) if w == what]
    assert names("cpp", "class A : public B {\n};", "inherit") == [("A", "B")] and names("c", '#include "f.h"\n#include <stdio.h>\n', "import") == [('"f.h"', None), ("<stdio.h>", None)]
    assert names("rust", "use serde::de;\nuse crate::m;\n", "import") == [("serde::de", None), ("crate::m", None)]


def test_import_classes(spark):
    cases = [("python", ".utils", True, ".utils"), ("python", "os.path", False, "os"), ("typescript", "'./x'", True, "./x"), ("typescript", "'@a/b/c'", False, "@a/b"), ("typescript", "'a/b'", False, "a"), ("rust", "crate::m", True, "crate::m"), ("rust", "serde::de", False, "serde"), ("go", '"net/http"', False, "net/http"), ("java", "org.x.Y", False, "org"), ("ruby", "'./f'", True, "./f"), ("c", '"f.h"', True, "f.h"), ("c", "<stdio.h>", False, "stdio.h")]
    df = spark.createDataFrame(cases, "lang string, name string, inside boolean, target string")
    inside, target = code.classify_import(F.col("name"), F.col("lang"))
    for r in df.select("name", inside.alias("i"), F.col("inside"), target.alias("t"), "target").collect():
        assert (r["i"], r["t"]) == (r["inside"], r["target"]), r["name"]


def test_scan_tree_to_graph(spark, tmp_path):
    t = {"pkg/a.py": PY, "pkg/util.py": "x = 1\ndef go():\n    pass\n", "node_modules/x.ts": "class X {}", "notes.md": "# hi\n\nfirst line of the notes", "README.md": "# T\n---\nA project.", "pyproject.toml": '[project]\ndependencies=["os>=1", "fastapi"]', "package.json": '{"dependencies":{"next":"1","ai":"2"}}'}
    e = Engine(spark, str(tmp_path / "db"))
    stats = {(r["kind"], r["name"]): r["n"] for r in e.scan_tree(tree(spark, t), deep=True)}
    assert (stats[("node", "File")], stats[("node", "Package")], stats[("edge", "HAS_FILE")], stats[("edge", "INHERITS")]) == (2, 4, 2, 1)
    assert e.query("MATCH (f:File)-[:IMPORTS]->(t) RETURN f.path, labels(t)[0] AS k ORDER BY k") == [{"col_0": "pkg/a.py", "col_1": "File"}, {"col_0": "pkg/a.py", "col_1": "Package"}]
    assert e.query("MATCH (f:File)-[:CALLS]->(s:Symbol) RETURN s.name") == [{"value": "go"}]
    assert e.project_info("P")[0]["stack"] == "nextjs-ai-agents,nextjs-supabase,python-api" and e.project_info("P")[0]["description"] == "A project."
    again = {(r["kind"], r["name"]): r["n"] for r in e.scan_tree(tree(spark, t), deep=True)}
    assert again == stats and e.stats()["edges"]["DEFINES"] == stats[("edge", "DEFINES")]
    assert e.explain("p")["counts"]["files"] == 2 and "not found" in e.explain("zz") and "pkg/a.py" in e.repomap("p") and e.shared() == [] and "os" in e.diagram("p") and len(e.portfolio()) == 1


def test_search_tools(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    t = tree(spark, {"a.md": "---\ntitle: Pricing\ntype: idea\n---\nhow to set prices for software", "b.md": "---\ntitle: Cats\n---\nall about cats and dogs", "c.py": "def price():\n    return 1\n"})
    assert e.index_notes(t, "2026-01-01") == {"new": 2} and e.index_notes(t, "2026-01-01") == {"unchanged": 2}
    hit = e.notes_search("prices software", 2)
    assert hit[0]["title"] == "Pricing" and hit[0]["relevance"] == 1.0 and abs(hit[1]["relevance"] - 0.9) < 1e-9 and e.notes_search("cats", 2, doc_type="idea")[0]["title"] == "Pricing"
    ids = {r["file"]: r["doc_id"] for r in e.store.read("notes").collect()}
    more = e.notes_search("prices software", 1, adjacency=spark.createDataFrame([(ids["b.md"], ids["a.md"])], "src string, dst string"))
    assert [r["title"] for r in more] == ["Pricing", "Cats"] and more[1]["graph_source"] == ids["a.md"]
    assert e.notes_stats()["total_documents"] == 2
    assert e.code_search("price", 2) == [] and e.code_search("def price", 1, bootstrap=t)[0]["file"] == "c.py"
    assert e.code_search("def price", 3, project="p", chunk_type="code", siblings=True)[0]["sibling_chunks"] == [] and e.collections()[0]["chunks"] == 3 and e.delete_collection("p") and not e.delete_collection("p")
    e.index_sessions(spark.createDataFrame([("s1", "App", "2026", "fix login bug"), ("s2", "Web", "2026", "write docs")], "session_id string, project_name string, started_at string, summary string"))
    assert e.session_search("login bug", 1)[0]["session_id"] == "s1" and e.session_search("login", 5, project="web")[0]["session_id"] == "s2"
    docs = spark.createDataFrame([("d1", "t", "shop", "Red lamp", "lamp", "u", "", "", "red lamp for a desk", 100), ("d2", "t", "shop", "Blue chair", "chair", "u", "", "", "blue chair", 0)], "doc_id string, source_type string, source_name string, title string, content string, url string, created string, tags string, text string, popularity bigint")
    assert e.index_source(docs) == {"created": 2, "matched": 0} and e.index_source(docs) == {"created": 0, "matched": 2}
    vids = spark.createDataFrame([("abcdefghijk", "Lamps", "u1", "tube", "about lamps", "2026"), ("bbcdefghijk", "More lamps", "u2", "tube", "lamps too", "2025")], "video_id string, title string, url string, source_name string, description string, created string")
    ch = spark.createDataFrame([("abcdefghijk", 0, "intro words", "", "", 0.0, "transcript"), ("abcdefghijk", 1, "red lamp talk", "", "", 5.0, "transcript")], "video_id string, chunk_index bigint, text string, chapter string, start_time string, start_seconds double, chunk_type string")
    e.index_videos(vids, ch, topics=["lamps", "more lamps"])
    found = e.source_search("red lamp", 3)
    assert {r["source_type"] for r in found} >= {"t", "youtube-transcript"} and any(r["context"] == "intro words\nred lamp talk" for r in found)
    assert e.source_search("red lamp", 3, source="shop")[0]["title"] == "Red lamp" and [r["source"] for r in e.source_list()] == ["shop", "tube"]
    assert e.source_tags() and [r["video_id"] for r in e.source_related("https://youtu.be/abcdefghijk")] == ["bbcdefghijk"] and len(e.channel_videos("tube")) == 2 and e.videos_by_tag("lamps")
    assert e.delete_source("shop") and not e.delete_source("shop")
    assert tuple(Engine.page_text(spark.createDataFrame([("u", "<p>a b</p>")], "url string, html string"), 2).first()) == ("u", "a ", True)
    assert web_search("q", lambda q, n: [{"title": q}]) == [{"title": "q"}]
    people = spark.createDataFrame([("niklas_fischer",)], "username string")
    res = spark.createDataFrame([("niklas_fischer", "https://x.com/n", "Niklas Fischer", 0), ("niklas_fischer", "https://www.linkedin.com/in/niklas-fischer", "", 1)], "username string, url string, title string, position int")
    assert got(match_people(people, res)) == [("niklas_fischer", "https://www.linkedin.com/in/niklas-fischer")]


def test_files_and_registry(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("a\nb\n")
    (tmp_path / "n.md").write_text("x")
    t = files.read_tree(spark, {"p": str(tmp_path)})
    assert sorted((r["path"], r["lines"]) for r in files.scan_files(t, documents=True).collect()) == [("n.md", 1), ("pkg/a.py", 3)]
    assert [r["lines"] for r in files.file_status(spark, str(tmp_path / "pkg")).collect()] == [2]
    r = files.read_registry(spark, "projects: [{name: A, path: /a, stacks: [a, b], description: d}]")
    assert tuple(r.first()) == ("A", "A", "a,b", "/a", "active", False, "d")
    assert "stacks" in files.write_registry(files.registry(t))
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(got(files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int"))) == [(1,), (2,)]
    files.write_csv(spark.createDataFrame([(1, 'q"x')], "a int, b string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["b"] == 'q"x'


def test_lines_of_logs_are_numbered_in_each_file(spark, tmp_path):
    d = tmp_path / "-home-x-projects-app"
    d.mkdir()
    for name, n in (("s1", 3), ("s2", 2)):
        (d / f"{name}.jsonl").write_text("\n".join(json.dumps({"type": "user", "k": k}) for k in range(n)))
    out = sessions.read_lines(spark, str(tmp_path)).collect()
    assert sorted((r["session_id"], r["line_no"], json.loads(r["line"])["k"]) for r in out) == [("s1", 0, 0), ("s1", 1, 1), ("s1", 2, 2), ("s2", 0, 0), ("s2", 1, 1)]
