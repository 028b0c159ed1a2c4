"""Dependencies that manifests declare, and which of them are documented."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import versions
from corpusloom.session import ship_package

SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]
MOST = 300


def package_json(files: DataFrame) -> DataFrame:
    """(path, name, spec) of the three sections; specs that are no strings and malformed files give nothing."""
    pairs = [F.coalesce(F.map_entries(F.from_json(F.get_json_object("body", f"$.{s}"), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")) for s in SECTIONS]
    rows = files.select("path", F.explode(F.concat(*pairs)).alias("e"))
    return rows.where(~F.col("e.value").rlike(r"^\s*[\[{]")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("spec"))


def requirements(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.explode(F.split("body", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    name = F.regexp_extract("line", r"^([^<>=!~\[; ]+)", 1)
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("-"))
    return kept.select("path", name.alias("name"), F.trim(F.substring(F.col("line"), F.length(name) + 1, F.length("line"))).alias("spec")).where("name <> ''")


def go_mod(files: DataFrame) -> DataFrame:
    """Block and single-line requires; a name must have a dot. Blocks are read within the row that holds the file."""
    body = F.regexp_replace(F.concat(F.lit("\n"), "body", F.lit("\n")), r"//[^\n]*", "")
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)\n[ \t]*require \((.*?)\n[ \t]*\)"), 1)
    single = F.regexp_extract_all(F.regexp_replace(body, r"(?s)\n[ \t]*require \(.*?\n[ \t]*\)", "\n"), F.lit(r"\n[ \t]*require ([^\n]*)"), 1)
    lines = F.concat(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), single)
    parts = files.select("path", F.explode(lines).alias("line")).select("path", F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+").alias("p"))
    return parts.where((F.size("p") >= 2) & F.col("p")[0].contains(".")).select("path", F.col("p")[0].alias("name"), F.col("p")[1].alias("spec"))


def toml_dependencies(text: str) -> list[tuple[str, str]]:
    """(name, spec) of pyproject and Cargo texts; a malformed one has none."""
    try:
        data = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError):
        return []
    listed = [e.strip() for e in (data.get("project") or {}).get("dependencies") or [] if isinstance(e, str)]
    cut = [next((i for i, c in enumerate(e) if c in "<>=!~[; "), len(e)) for e in listed]
    out = [(e[:i], e[i:].strip()) for e, i in zip(listed, cut, strict=True) if i]
    poetry = ((data.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}
    tables = [{k: v for k, v in poetry.items() if k.lower() != "python"}, data.get("dependencies") or {}, data.get("dev-dependencies") or {}]
    for table in tables:
        for name, spec in table.items():
            spec = spec.get("version", "") if isinstance(spec, dict) else spec
            out.append((name, spec if isinstance(spec, str) else ""))
    return out


def toml(files: DataFrame) -> DataFrame:
    ship_package(files.sparkSession)

    @F.pandas_udf("array<struct<name:string,spec:string>>")
    def read(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"name": n, "spec": s} for n, s in toml_dependencies(b or "")])

    return files.select("path", F.explode(read("body")).alias("d")).select("path", "d.name", "d.spec")


def inventory(deps: DataFrame, most: int = MOST) -> DataFrame:
    """One row per (project, name): a pinned mention before an unpinned one, else the first; ``most`` per project by first mention."""
    pinned = (versions.pinned(F.col("spec")) != "").cast("int")
    best = deps.groupBy("project", "name").agg(F.min_by(F.struct("spec", "ecosystem"), F.struct((1 - pinned).alias("later"), "pos", "spec", "ecosystem")).alias("d"), F.min("pos").alias("first"))
    place = Window.partitionBy("project").orderBy("first", "name")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).select("project", "name", "d.spec", "d.ecosystem")


def best_version(deps: DataFrame, stored: DataFrame) -> DataFrame:
    """(project, name, version): the first label of a pin's ladder that is stored for the dependency's technology."""
    steps = deps.select("project", "name", F.posexplode(versions.ladder(versions.pinned(F.col("spec")))).alias("pos", "version"))
    found = steps.join(stored.select(F.col("technology").alias("name"), "version").distinct(), ["name", "version"])
    return found.groupBy("project", "name").agg(F.min_by("version", "pos").alias("version"))


def documented(deps: DataFrame, aliases: DataFrame, unknown_only: bool = False) -> DataFrame:
    """Dependencies with the technology that documents them (``aliases``: asked, technology); or only those with none."""
    known = aliases.where("technology is not null").select(F.col("asked").alias("name"), "technology")
    return deps.join(known, "name", "left_anti") if unknown_only else deps.join(known, "name", "left")


