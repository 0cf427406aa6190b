"""Site maps, product pages, lists of makers and folders of settings."""

import json

from pyspark.sql import functions as F

from lattice.sources import pages


def test_sitemap(spark):
    xml = "<urlset><url><loc>https://x.io/startup/a-b</loc></url><url><loc> https://x.io/startup/c/ </loc></url><url><loc>https://x.io/blog/z</loc></url><url><loc>https://x.io/startup/a-b</loc></url></urlset>"
    maps = spark.createDataFrame([(xml,), (None,), ("",)], "xml string")
    found = pages.sitemap_urls(maps, r"^https://x\.io/startup/")
    assert sorted(map(tuple, found.collect())) == [("https://x.io/startup/a-b", "a-b"), ("https://x.io/startup/c/", "c")]
    assert [r["slug"] for r in pages.sitemap_urls(maps, "/startup/", spark.createDataFrame([("a-b",)], "slug string")).collect()] == ["c"]
    assert pages.sitemap_urls(maps, "/startup/", limit=1).count() == 1


def html(ld=None, title=None, og=None, extra=""):
    parts = ["<html><head>"]
    if ld is not None:
        parts.append(f'<script type="application/ld+json">{json.dumps(ld)}</script>')
    if title:
        parts.append(f"<title>{title}</title>")
    if og:
        parts.append(f'<meta property="og:title" content="{og}"><meta property="og:description" content="shared">')
    return "".join([*parts, '<meta name="description" content="the tagline">', extra, "</head></html>"])


def test_product_pages(spark):
    ld = {"name": "Kite", "description": "d" * 1200, "datePublished": "2024-05-06T00:00:00Z", "author": [{"name": "Ann", "url": "https://x.io/@ann"}, {"name": "", "url": "https://x.io/@bob/"}, {"name": "No", "url": "https://y.io"}], "offers": {"url": "https://kite"}, "interactionStatistic": [{"interactionType": "x/UserLikes", "userInteractionCount": "12"}]}
    rows = [
        ("a", html(ld)), ("b", html({"author": {"name": "Solo", "url": "https://x.io/@solo"}}, og="Sail | X Hunt", extra='<script>{"featuredAt":"2024-01-02T03","votesCount": 7}</script>')),
        ("c", html(title="Tent - sleep well | X Hunt", extra='{"dailyRank": 3}')), ("d", html(title="Just a moment...")), ("e", "<p>nothing</p>"), ("f", None), ("g", '<script type="application/ld+json">{broken</script><title>T</title>'),
    ]
    out = {r["slug"]: r for r in pages.product_pages(spark.createDataFrame(rows, "slug string, html string"), "X Hunt").collect()}
    assert set(out) == {"a", "b", "c", "g"}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a["name"], a["upvotes"], a["launch_date"], a["website"], len(a["description"]), a["tagline"], a["product_status"]) == ("Kite", 12, "2024-05-06", "https://kite", 1000, "the tagline", "created")
    assert [(m["username"], m["name"], m["role"]) for m in a["makers"]] == [("ann", "Ann", "maker"), ("bob", "bob", "maker")]
    assert (b["name"], b["upvotes"], b["launch_date"], b["description"], b["product_status"]) == ("Sail", 7, "2024-01-02", "shared", "featured") and b["makers"][0]["username"] == "solo"
    assert (c["name"], c["product_status"], c["makers"]) == ("Tent", "launched", []) and out["g"]["name"] == "T"


def test_makers_are_confirmed_and_ordered(spark):
    kind = "ARRAY<STRUCT<username: STRING, name: STRING, url: STRING, role: STRING>>"
    people = [("c1", "C", None, "commenter"), ("h1", "H", None, "hunter"), ("m1", "M", None, "maker"), ("m2", "N", None, "maker"), ("z", "Z", None, "other"), ("n", "N", None, None)]
    df = spark.createDataFrame([(people, [("m1", "M", None, "maker"), ("c1", "C", None, "maker"), ("new", "W", None, "maker")]), (people, []), ([], [("q", "Q", None, "maker")])], f"makers {kind}, listed {kind}")
    out = [[(m["username"], m["role"]) for m in r[0]] for r in df.select(pages.confirmed_makers(F.col("makers"), F.col("listed"))).collect()]
    assert out[0] == [("c1", "maker"), ("m1", "maker"), ("new", "maker"), ("h1", "hunter"), ("m2", "commenter"), ("n", None), ("z", "other")]
    assert [u for u, _ in out[1]] == ["m1", "m2", "h1", "c1", "n", "z"] and out[2] == [("q", "maker")]


def test_folders_of_settings(spark, tmp_path):
    assert pages.channels("channels: [a, b]") == ["a", "b"] and pages.channels("") == []
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "abc.vtt").write_text("WEBVTT\n\nx")
    cache = pages.subtitle_cache(spark, str(tmp_path / "v"))
    assert cache.first()["video_id"] == "abc"
    got = pages.keep_subtitles(cache, spark.createDataFrame([("abc", "new"), ("def", "WEBVTT"), ("ghi", ""), ("jkl", None)], "video_id string, vtt string"))
    assert {r["video_id"]: r["vtt"][:6] for r in got.collect()} == {"abc": "WEBVTT", "def": "WEBVTT"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "web.yaml").write_text("name: Web\nplatform: web\nkey_packages: [a, b, c, d, e, f]\n")
    (tmp_path / "s" / "bare.yaml").write_text("# nothing\n")
    assert [tuple(r) for r in pages.stack_templates(spark, str(tmp_path / "s")).collect()] == [("bare", "bare", "?", "?", "?", ""), ("web", "Web", "web", "?", "?", "a, b, c, d, e")]
