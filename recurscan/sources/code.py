"""Source trees, the OLD/NEW corpus, graphs and flows as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

_FUNCTION = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("typeref", T.StringType())]))
_HEAD = re.compile(r"([A-Za-z_][\w:<>,*&\s]*?)\b([A-Za-z_~]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*)?(?:noexcept\s*)?\{")
# Words before a parenthesis and a block that are no function's name.
_CONTROL = frozenset("if for while switch catch return sizeof do else".split())


#: Every spelling of a source file's suffix, so that others are not read at all.
SOURCE_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in text.SOURCE_SUFFIXES) + "}"


def split_functions(code: str) -> list[dict]:
    """name, first and last line (from 1) and return type of each function with a body."""
    hidden = re.sub(r'/\*[\s\S]*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    hidden = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), hidden)
    out, at = [], 0
    while m := _HEAD.search(hidden, at):
        if m[2] in _CONTROL:
            at = m.end(2)
            continue
        depth, i = 1, m.end()
        while i < len(hidden) and depth:
            depth += (hidden[i] == "{") - (hidden[i] == "}")
            i += 1
        if depth:
            break
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append({"name": m[2], "line": hidden.count("\n", 0, start) + 1, "end": hidden.count("\n", 0, i) + 1, "typeref": "typename:" + " ".join(m[1].split()) if m[1].strip() else None})
        at = i
    return out


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, code of all files below a folder: UTF-8, else Windows-1252 with undefined bytes replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    utf8 = F.try_validate_utf8(F.col("content"))
    old = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace")), T.StringType())
    return files.select("path", F.coalesce(utf8, F.when(utf8.isNull(), old("content"))).alias("code"))


def read_project(spark: SparkSession, path: str, skip_loc_threshold: bool = False, splitter=split_functions) -> DataFrame:
    """Purified target functions of a source tree: func_id, func_name, path, line, code. Overloads are kept apart by their line."""
    files = read_text_files(spark, path, SOURCE_GLOB).where(text.is_source_file(F.col("path")))
    find = F.pandas_udf(lambda s: s.map(lambda c: [] if c is None else splitter(c)), _FUNCTION)
    each = files.select("path", "code", F.explode(find("code")).alias("f")).where("f.end is not null")
    body = text.line_slice(F.col("code"), F.col("f.line"), F.col("f.end"))
    first, rest = F.substring_index(body, "\n", 1), F.substr(body, F.instr(body, F.lit("\n")))
    head = text.declared(first, F.col("f.name"), F.col("f.typeref"))
    whole = F.when(F.instr(body, F.lit("\n")) > 0, F.concat(head, rest)).otherwise(head)
    out = each.select(F.concat_ws(":", "path", "f.name", F.col("f.line").cast("string")).alias("func_id"), F.col("f.name").alias("func_name"), "path", F.col("f.line").alias("line"), text.purify(whole, skip_loc_threshold).alias("code"))
    return out.where("code <> ''")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Purified functions of a corpus software/CVE/name.vul: id, software, cve_dir, name, cve, cwe, commit, file, version, func, tag, code."""
    files = read_text_files(spark, path, "*.vul")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("software"), F.element_at(parts, -2).alias("cve_dir"), F.element_at(parts, -1).alias("name"), text.purify(F.col("code")).alias("code"))
    named = named.where("code <> ''").select(F.concat_ws("/", "software", "cve_dir", "name").alias("id"), "software", "cve_dir", "name", text.parse_name(F.col("name")).alias("p"), "code")
    return named.select("id", "software", "cve_dir", "name", "p.*", "code")


def read_dot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (func_id, node_id, kind, code, line, ord) and edges (func_id, src, dst) of control-flow graphs in DOT files, the
    file's name being the function's id; self loops are dropped."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("func_id"), F.posexplode(F.split("value", "\n")).alias("ord", "line_text"))
    label = F.regexp_extract("line_text", r'^"([^"]+)" \[label = <(.+)> \]', 2)
    nodes = files.where(F.col("line_text").rlike(r'^"[^"]+" \[label = <.+> \]')).select("func_id", F.regexp_extract("line_text", r'^"([^"]+)"', 1).alias("node_id"), text.parse_label(label).alias("p"), "ord").select("func_id", "node_id", "p.kind", "p.code", "p.line", "ord")
    edges = files.select("func_id", F.regexp_extract("line_text", r'^  "([^"]+)" -> "([^"]+)"', 1).alias("src"), F.regexp_extract("line_text", r'^  "([^"]+)" -> "([^"]+)"', 2).alias("dst"))
    return nodes, edges.where("src <> '' and src <> dst")


def read_taint(spark: SparkSession, path: str) -> DataFrame:
    """func_id, lines of each flow in JSON files of flows with elements."""
    kind = "elements array<struct<lineNumber:int>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("func_id"), F.transform("elements", lambda e: e["lineNumber"]).alias("lines"))


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("old string, new string").csv(path, header=True)


def normal_sample(functions: DataFrame, size: int, seed: int) -> DataFrame:
    """`size` purified functions in a seeded order of their paths."""
    return functions.where("code <> ''").orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. One that a scan would read in fewer tasks than the cluster runs at once, as a small file of one row
    group, is dealt out first; filters and columns are still pushed into the scan."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows
