"""Specifications by hand: references of every kind, junk, older forms, the rendered text."""

import json

from corpusloom.operators import apispec

CHAIN = {f"c{i}": {"$ref": f"#/definitions/c{i + 1}"} for i in range(12)} | {"c12": {"name": "end"}}
BODY = {
    "openapi": "3",
    "info": {"title": "Shop", "version": "1.2", "description": " about \n"},
    "servers": [{"url": "https://shop.example.dev"}, {}],
    "parameters": {"L": {"name": "limit", "in": "query", "type": "integer"}},
    "definitions": {**CHAIN, "loop": {"$ref": "#/definitions/loop"}, "Row": {"type": "object"}, "Kind": {"type": "string", "enum": ["a", "b"]}},
    "components": {"requestBodies": {"B": {"required": True, "content": {"text/z": {"schema": {"$ref": "#/definitions/Row"}}, "text/a": {}}}}, "responses": {"R": {"description": "a|b\nc"}}},
    "paths": {
        "/b": {"$ref": "#/paths/~1a~0b"},
        "/a~b": {
            "parameters": [{"$ref": "#/parameters/L"}, 7, {"name": "q", "in": "query", "description": "lost"}],
            "GET": {"parameters": [{"name": "q", "in": "query", "schema": {"$ref": "#/definitions/Kind"}}, {"name": ""}], "responses": {"200": {"$ref": "#/components/responses/R"}, "100": "junk"}},
            "post": {"deprecated": True, "requestBody": {"$ref": "#/components/requestBodies/B"}, "responses": {"1": {"$ref": "#/definitions/c0"}, "2": {"$ref": "#/definitions/loop"}, "3": {"$ref": "#/servers/0"}, "4": {"$ref": "other.json#/x"}}},
        },
        "/null": None,
        "/word": {"get": "nope"},
        "/vendor": {"x-v": {}},
    },
}


def walked(pointer):
    """What a pointer leads to, through objects alone; None where there is nothing."""
    node = BODY
    for part in pointer[2:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        node = node.get(part) if isinstance(node, dict) else None
    return node


def table(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", b) for i, b in enumerate(bodies)], "spec_id string, body string")


def test_places_that_references_name(spark):
    found = {r.pointer: json.loads(r.node) for r in apispec.pointed_at(table(spark, json.dumps(BODY))).collect()}
    named = {f"#/definitions/c{i}" for i in range(13)} | {"#/definitions/loop", "#/definitions/Row", "#/definitions/Kind", "#/parameters/L", "#/components/requestBodies/B", "#/components/responses/R", "#/paths/~1a~0b"}
    assert found == {p: walked(p) for p in named}


def test_chains_end_after_ten_hops(spark):
    found = {r.pointer: json.loads(r.node) for r in apispec.targets(table(spark, json.dumps(BODY))).collect()}
    # the first hop is the one to the target itself
    assert found["#/definitions/c3"] == {"name": "end"} and found["#/definitions/c2"] == CHAIN["c11"]
    assert found["#/definitions/loop"] == BODY["definitions"]["loop"]


def test_operations_and_parameters_of_awkward_paths(spark):
    specs = table(spark, json.dumps(BODY))
    assert sorted((r.path, r.method, r.media) for r in apispec.operations(specs).collect()) == [("/a~b", "get", ""), ("/a~b", "post", "text/a,text/z"), ("/b", "get", ""), ("/b", "post", "text/a,text/z")]
    mine = [(r.pos, r.name, r.type, r.description) for r in apispec.parameters(specs).where("path = '/b' and method = 'get'").orderBy("pos").collect()]
    assert mine == [(0, "limit", "integer", ""), (2, "q", "enum: a, b", "")]
    said = [(r.code, r.description) for r in apispec.responses(specs).where("path = '/b'").orderBy("method", "pos").collect()]
    assert said == [("200", "a|b\nc"), ("100", ""), ("1", ""), ("2", ""), ("3", ""), ("4", "")]


def test_rendered_text(spark):
    texts = {r.spec: r.markdown for r in apispec.rendered(table(spark, json.dumps(BODY), '{"paths": {}}', "no [json", None, "[1]")).collect()}
    assert set(texts) == {"s0", "s1"} and texts["s1"] == "# API Reference\n\n## Endpoints\n"
    text = texts["s0"]
    assert text.startswith("# Shop\n\n**Version:** 1.2\n\n**Servers:** `https://shop.example.dev`\n\nabout\n\n## Endpoints\n\n### `GET /a~b`\n\n| Param |")
    assert text.count("`limit`") == 4 and text.count("| `200` | a\\|b c |") == 2
    assert "> **Deprecated**\n\n" in text and "**Request body (required):** `text/z`, `text/a`\n- `text/z` → `Row`\n\n" in text


def test_no_specifications(spark):
    none = spark.createDataFrame([], "spec_id string, body string")
    assert not apispec.rendered(none).collect() and not apispec.parameters(none).collect()
