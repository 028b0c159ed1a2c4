"""Values of the expressions, worked out from their rules."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import names, text, urls, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "scope"),
    [
        ("https://loom.example/docs/v7/warp/threads/", "/docs/v7/"),
        ("https://handbook.spool.example/4/manual/knots.html", "/4/manual/"),
        ("https://loom.example/guide/first-cloth", "/guide/"),
        ("https://loom.example/documentation/v21/start", "/documentation/v21/"),
        ("https://loom.example/", "/"),
        ("https://loom.example/docs/latest/weft", "/docs/"),
        ("https://loom.example/docs/cards/8.40/punching/", "/docs/cards/8.40/"),
    ],
)
def test_docs_scope(spark, url, scope):
    assert one(spark, urls.docs_scope(F.lit(url))) == scope


@pytest.mark.parametrize(
    ("path", "inside"),
    [("/docs/v7/looms/treadle/", True), ("/docs/v7", True), ("/shop", False), ("/", False), ("/docs/v6/looms", False), ("/docs/v7/cloth.jpg", False), ("/docs/v7/site.CSS", False)],
)
def test_crawlable(spark, path, inside):
    assert one(spark, urls.crawlable(F.lit("https://loom.example" + path), F.lit("loom.example"), F.lit("/docs/v7/"))) is inside


@pytest.mark.parametrize("path", ["/warp/start", "/warp"])
def test_normalise_drops_fragments_and_last_slashes(spark, path):
    for extra in ("", "/", "#top", "/#top"):
        assert one(spark, urls.normalise(F.lit("https://loom.example" + path + extra))) == "https://loom.example" + path
    assert one(spark, urls.normalise(F.lit("https://loom.example/"))) == "https://loom.example/"
    assert one(spark, urls.normalise(F.lit("https://loom.example" + path + "/?page=3"))) == f"https://loom.example{path}?page=3"


@pytest.mark.parametrize(
    ("path", "version"),
    [("/docs/v7/warp", "v7"), ("/docs/cards/8.40/warp", "8.40"), ("/5.6/manual/warp", "5.6"), ("/docs/latest/warp", "latest"), ("/docs/", "2031-02-03"), ("/de/417", "2031-02-03")],
)
def test_version_of(spark, path, version):
    assert one(spark, urls.version_of(F.lit("https://loom.example" + path), F.lit("2031-02-03").cast("timestamp"))) == version


@pytest.mark.parametrize(("host", "name"), [("www.treadle.website", "treadle"), ("docs.spool.org", "spool"), ("shuttle.weaver.com", "shuttle")])
def test_name_of(spark, host, name):
    assert one(spark, urls.name_of(F.lit(f"https://{host}/a/b"))) == name


def test_key_slug(spark):
    assert one(spark, urls.key_slug(F.lit("Wide  Cloth, 2nd Ed!"))) == "wide-cloth-2nd-ed"
    assert one(spark, urls.key_slug(F.lit("?!"))) == one(spark, urls.key_slug(F.lit(""))) == "untitled"
    assert one(spark, urls.key_slug(F.lit("q" * 90))) == "q" * 64


@pytest.mark.parametrize("host", ["127.9.9.9", "10.0.0.7", "172.31.4.4", "192.168.0.9", "[::1]", "localhost:8080"])
def test_private_hosts_are_not_admissible(spark, host):
    assert one(spark, urls.admissible(F.lit(f"http://{host}/warp"))) is False


def test_public_hosts_are_admissible(spark):
    assert one(spark, urls.admissible(F.lit("http://9.9.9.9/warp"))) is True
    assert one(spark, urls.admissible(F.lit("https://loom.example"))) is True
    assert one(spark, urls.admissible(F.lit("gopher://loom.example/"))) is False
    assert one(spark, urls.admissible(F.lit("no address"))) is False


@pytest.mark.parametrize("written", ["shuttle", "Shuttle.js", "SHUTTLE", "shuttle-js", " shuttle ", "@weave/shuttle"])
def test_normalise_name(spark, written):
    assert one(spark, names.normalise(F.lit(written))) == "shuttle"


def test_normalise_name_of_several_words(spark):
    assert one(spark, names.normalise(F.lit("warp_beam"))) == "warp-beam"
    assert one(spark, names.normalise(F.lit(None).cast("string"))) == ""


# oldest first: words, then dates, then releases; a release candidate comes before its release
@pytest.mark.parametrize(("older", "newer"), [("0.9", "0.10"), ("3.1", "v12"), ("12.0.1-rc2", "12.0.1"), ("latest", "2030-12-31"), ("2030-12-31", "2031-02-03")])
def test_newest(spark, older, newer):
    for order in ((older, newer), (newer, older)):
        rows = spark.createDataFrame([(x,) for x in order], "v string")
        assert rows.agg(F.max_by("v", versions.sort_key(F.col("v")))).first()[0] == newer


@pytest.mark.parametrize(("spec", "pin"), [("==4.17.2", "4.17.2"), ("^6.0.1", "6.0.1"), (">=3.3,<5", "3.3"), ("~7.8", "7.8"), ("*", ""), ("", ""), (None, "")])
def test_pinned(spark, spec, pin):
    assert one(spark, versions.pinned(F.lit(spec).cast("string"))) == pin


def test_ladder(spark):
    assert one(spark, versions.ladder(F.lit("4.17.2"))) == ["4.17.2", "v4.17.2", "4.17", "v4.17", "4", "v4"]
    assert one(spark, versions.ladder(F.lit(""))) == []


def test_text(spark):
    assert one(spark, text.visible_text(F.lit("<div>warp <i>weft</i></div><style>p{}</style>"))) == "warp weft"
    assert one(spark, text.looks_like_openapi(F.lit("openapi: 3.1.0\ninfo:\n  title: loom"))) is True
    assert one(spark, text.looks_like_openapi(F.lit("a page about openapi files"))) is False
    assert one(spark, text.strip_stamp(F.lit("<!-- source: s | type: raw | scraped: now -->\n\ncloth"))) == "cloth"
    assert one(spark, text.occurrences(F.lit("nananana"), F.lit("nana"))) == 2
