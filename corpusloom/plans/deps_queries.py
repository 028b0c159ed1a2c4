"""Dependencies (D1-D5, V4-V6, J4) over manifests made of line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import versions
from corpusloom.operators import deps as o
from corpusloom.plans.fixtures import table

QUERIES, ORACLES = {}, {}
DEPS = """deps AS (SELECT l_suppkey AS project, l_orderkey * 8 + l_linenumber AS pos, replace(p_name, ' ', '-') AS name, CASE WHEN l_returnflag = 'N' THEN '' ELSE '^' || p_size || '.' || l_linenumber || '.0' END AS spec,
  CASE l_linenumber % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FILES = "files AS (SELECT p_partkey AS path, replace(p_name, ' ', '-') AS name, p_size AS size FROM part)"


def query(name: str, sql: str | None, head: str = DEPS):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = f"WITH {head}{', ' + sql[1:] if sql[0] == '+' else ' ' + sql}"
        return fn

    return register


def deps(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    spec = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("^"), F.col("p_size").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".0")))
    return rows.select(F.col("l_suppkey").alias("project"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), spec.alias("spec"), F.when(F.col("l_linenumber") % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"))


def files(spark, d, body):
    name, size = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size").cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("path"), body(name, size).alias("body"))


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("d1_package_json", "SELECT path, name, '^' || size || '.1' AS spec FROM files WHERE path % 9 <> 0 UNION ALL SELECT path, name || '-dev', '*' FROM files WHERE path % 9 <> 0", FILES)
def d1(spark, d):
    body = lambda n, s: F.when(F.col("p_partkey") % 9 == 0, "{broken").otherwise(text('{"name": "x", "dependencies": {"', n, '": "^', s, '.1", "odd": {"a": 1}}, "devDependencies": {"', n, '-dev": "*"}}'))
    return o.package_json(files(spark, d, body))


@query("d2_requirements", "SELECT path, name, '==' || size || '.2' AS spec FROM files UNION ALL SELECT path, name || '-x', '[extra]>=1' FROM files UNION ALL SELECT path, 'bare', '' FROM files", FILES)
def d2(spark, d):
    return o.requirements(files(spark, d, lambda n, s: text("# head\n-r other.txt\n", n, "==", s, ".2  # note\n\n", n, "-x[extra]>=1\nbare\n")))


@query("d3_go_mod", "SELECT path, 'example.com/' || name AS name, 'v' || size || '.0.0' AS spec FROM files UNION ALL SELECT path, 'one.example.com/z', 'v1.2.3' FROM files", FILES)
def d3(spark, d):
    return o.go_mod(files(spark, d, lambda n, s: text("module example.com/m\n\nrequire (\n\texample.com/", n, " v", s, ".0.0 // indirect\n\tnodot v1\n)\n\nrequire one.example.com/z v1.2.3\n")))


@query("d4_toml", "SELECT path, name, '>=' || size AS spec FROM files WHERE path % 9 <> 0 UNION ALL SELECT path, 'table', '1.' || size FROM files WHERE path % 9 <> 0 UNION ALL SELECT path, 'poetic', '^2' FROM files WHERE path % 9 <> 0", FILES)
def d4(spark, d):
    body = lambda n, s: F.when(F.col("p_partkey") % 9 == 0, "= broken").otherwise(text('[project]\ndependencies = ["', n, ">=", s, '"]\n[tool.poetry.dependencies]\npython = "^3"\npoetic = "^2"\n[dependencies]\ntable = {version = "1.', s, '"}\n'))
    return o.toml(files(spark, d, body))


INVENTORY = "best AS (SELECT project, name, min_by(spec, struct_pack(a := (spec = '')::INT, b := pos, c := spec, d := ecosystem)) AS spec, min_by(ecosystem, struct_pack(a := (spec = '')::INT, b := pos, c := spec, d := ecosystem)) AS ecosystem, min(pos) AS first FROM deps GROUP BY ALL), inventory AS (SELECT project, name, spec, ecosystem FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY first, name) AS rank FROM best) WHERE rank <= 300)"


@query("d5_inventory", "SELECT * FROM inventory", DEPS + ", " + INVENTORY)
def d5(spark, d):
    return o.inventory(deps(spark, d))


@query("v4_v5_pins_and_ladders", "+p AS (SELECT project, pos, regexp_extract(spec, '(\\d+(?:\\.\\d+)*)', 1) AS pin FROM deps) SELECT project, pos, pin, CASE WHEN pin = '' THEN '' ELSE pin || ',v' || pin || ',' || split_part(pin, '.', 1) || '.' || split_part(pin, '.', 2) || ',v' || split_part(pin, '.', 1) || '.' || split_part(pin, '.', 2) || ',' || split_part(pin, '.', 1) || ',v' || split_part(pin, '.', 1) END AS ladder FROM p")
def v4(spark, d):
    pin = versions.pinned(F.col("spec"))
    return deps(spark, d).select("project", "pos", pin.alias("pin"), F.array_join(versions.ladder(pin), ",").alias("ladder"))


STORED = "stored AS (SELECT DISTINCT replace(p_name, ' ', '-') AS technology, CASE p_partkey % 3 WHEN 0 THEN 'v' || p_size WHEN 1 THEN p_size || '.1' ELSE p_size || '.2.0' END AS version FROM part WHERE p_partkey % 2 = 0)"


def stored(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    version = F.when(k % 3 == 0, F.concat(F.lit("v"), s)).when(k % 3 == 1, F.concat(s, F.lit(".1"))).otherwise(F.concat(s, F.lit(".2.0")))
    return table(spark, d, "part").where(k % 2 == 0).select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("technology"), version.alias("version")).distinct()


@query("v6_best_stored_version", "+p AS (SELECT project, name, regexp_extract(spec, '(\\d+(?:\\.\\d+)*)', 1) AS pin FROM inventory), l AS (SELECT project, name, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest([pin, 'v' || pin, split_part(pin, '.', 1) || '.' || split_part(pin, '.', 2), 'v' || split_part(pin, '.', 1) || '.' || split_part(pin, '.', 2), split_part(pin, '.', 1), 'v' || split_part(pin, '.', 1)]) AS version FROM p WHERE pin <> '') SELECT project, name, min_by(l.version, pos) AS version FROM l JOIN stored s ON s.technology = name AND s.version = l.version GROUP BY ALL", DEPS + ", " + INVENTORY + ", " + STORED)
def v6(spark, d):
    return o.best_version(o.inventory(deps(spark, d)), stored(spark, d))


@query("j4_undocumented", "SELECT * FROM inventory WHERE name NOT IN (SELECT technology FROM stored)", DEPS + ", " + INVENTORY + ", " + STORED.replace("p_partkey % 2 = 0", "p_partkey % 40 = 0"))
def j4(spark, d):
    from corpusloom.operators.resolve import alias

    have = table(spark, d, "part").where("p_partkey % 40 = 0").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("technology")).distinct()
    rows = o.inventory(deps(spark, d))
    return o.documented(rows, alias(rows.select(F.col("name").alias("asked")), have), unknown_only=True)
