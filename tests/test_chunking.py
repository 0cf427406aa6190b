import random

from pyspark.sql import functions as F

from lattice.operators import chunking as C

MD = "intro\n# One\na\n## Two\nb\n```\n# not a heading\n```\n## Three ##\nc\n# Four\n#hashtag\n####### seven\n   # Five\n"


def test_markdown_keeps_a_stack_of_headings():
    got = [(u[0], u[1], u[2]) for u in C.markdown_units(MD)]
    assert got == [("", 1, 1), ("One", 2, 3), ("One > Two", 4, 8), ("One > Three", 9, 10), ("Four", 11, 13), ("Five", 14, 15)]
    assert "\n".join(u[3] for u in C.markdown_units(MD)) == MD


def test_code_is_cut_between_blocks():
    code = "import os\n\n# about f\ndef f(\n    x,\n):\n\n    return x\n\n}\n\n@deco\nclass A:\n    def g(self):\n        pass\n"
    got = list(C.code_units(code))
    assert [u[0] for u in got] == ["import os", "def f(", "class A:"] and "\n".join(u[3] for u in got) == code
    assert [(u[1], u[2]) for u in got] == [(1, 2), (3, 11), (12, 16)]


def test_chunks_lose_nothing_and_keep_their_bounds():
    rng = random.Random(1)
    for _ in range(200):
        lines = [rng.choice(["", "# h", "## k", "def f():", "    body text", "word " * rng.randrange(30), "```", "}"]) for _ in range(rng.randrange(1, 60))]
        text, kind = "\n".join(lines), rng.choice([C.MARKDOWN, C.CODE, C.TEXT, None])
        found = C.chunk(text, kind, 40, 120)
        assert "".join(x[4] for x in found).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
        assert all(len(x[4]) <= 120 and x[4].strip() and 1 <= x[2] <= x[3] <= len(lines) for x in found)
        assert [x[0] for x in found] == sorted({x[0] for x in found}) and all(x[0] < x[5] for x in found)
        assert [x[2] for x in found] == sorted(x[2] for x in found)


def test_ids_keep_the_raw_index():
    text = "# a\nx\n" + "\n" * 50 + "# b\ny"
    assert [x[:2] for x in C.chunk(text, C.MARKDOWN, 0, 100)] == [(0, "a"), (1, "b")]
    blank = "def a():\n    pass\n\n" + " \n" * 300 + "\ndef b():\n    pass"
    found = C.chunk(blank, C.CODE, 0, 100)
    assert found[-1][1] == "def b():" and found[-1][5] == found[-1][0] + 1


def test_table_function_in_frames_and_sql(spark):
    docs = spark.createDataFrame([("m.md", MD, "markdown"), ("c.py", "def f():\n    pass\n\n\nx = 1", "code"), ("t.txt", "plain " * 100, "text"), ("n", None, "text"), ("b", " \n ", "code"), ("k", "no kind", None)], "path STRING, text STRING, kind STRING").withColumn("total", F.lit("clash"))
    got = C.chunked(docs.drop("total"), "text", F.col("kind"), least=0, most=200).orderBy("path", "raw_index").collect()
    assert [(r["path"], r["raw_index"], r["heading"]) for r in got if r["path"] != "t.txt"] == [("c.py", 0, "def f():"), ("c.py", 1, "x = 1"), ("k", 0, "")] + [("m.md", k, h) for k, h in enumerate(["", "One", "One > Two", "One > Three", "Four", "Five"])]
    assert len([r for r in got if r["path"] == "t.txt"]) == 4
    C.register(spark)
    docs.createOrReplaceTempView("chunk_docs")
    sql = spark.sql("SELECT d.path, c.raw_index, c.text FROM chunk_docs d, LATERAL text_chunks(d.text, d.kind, 0, 200) c ORDER BY 1, 2").collect()
    assert [tuple(r) for r in sql] == [(r["path"], r["raw_index"], r["text"]) for r in got]
