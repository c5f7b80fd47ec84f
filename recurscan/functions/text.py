"""Text of functions: purification, lines, names.

White space is Python's for ASCII: blank, 0x09-0x0D and 0x1C-0x1F.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[ \t\n\x0b\f\r\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def without_comments(code: Column) -> Column:
    """Block comments go, then line comments that end in a line break."""
    return F.regexp_replace(F.regexp_replace(code, r"/\*[\s\S]*?\*/", ""), r"//[^\n]*\n", "\n")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def purify(code: Column, skip_loc_threshold: bool = False) -> Column:
    """Comments, non-ASCII and directive lines removed, blank lines dropped, lines stripped. Empty where fewer than four
    semicolons or six lines longer than one character are left."""
    bare = F.regexp_replace(ascii_only(without_comments(code)), r"(?m)^#[^\n]*", "")
    lines = F.filter(F.transform(F.split(bare, "\n", -1), strip), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    if skip_loc_threshold:
        return joined
    long_lines = F.size(F.filter(lines, lambda x: F.length(x) > 1))
    return F.when((count_of(bare, ";") <= 3) | (long_lines <= 5), F.lit("")).otherwise(joined)


_BLOCK, _LINE, _DIRECTIVE = re.compile(r"/\*[\s\S]*?\*/"), re.compile(r"//[^\n]*\n"), re.compile(r"(?<![^\n\r])#[^\n]*")


def purified(code: str) -> str:
    """As purify(). A pattern is looked for only where its marks are, which takes a fraction of the JVM's time."""
    if "/*" in code:
        code = _BLOCK.sub("", code)
    if "//" in code:
        code = _LINE.sub("\n", code)
    code = code.encode("ascii", "ignore").decode()
    if "#" in code:
        code = _DIRECTIVE.sub("", code)
    lines = [x for x in (x.strip(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f") for x in code.split("\n")) if x]
    return "" if code.count(";") <= 3 or sum(len(x) > 1 for x in lines) <= 5 else "\n".join(lines)


def purify_batches(code: Column, replaced: tuple[str, str] = ("", "")) -> Column:
    """purify() of texts that go to Python in batches, after one replacement; null counts as empty."""
    old, new = replaced

    def run(codes: pa.Array) -> pa.Array:
        texts = ((c.as_py().decode("utf-8", "replace") if c.is_valid else "") for c in codes.cast(pa.binary()))
        return pa.array([purified(x.replace(old, new) if old else x) for x in texts], pa.string())

    return F.arrow_udf(run, T.StringType())(code)


def strip_comments_keep_urls(code: Column) -> Column:
    """Block comments, and line comments that no colon precedes."""
    return F.regexp_replace(F.regexp_replace(code, r"/\*[\s\S]*?\*/", ""), r"(?<!:)//[^\n]*", "")


def lines_of(code: Column) -> Column:
    return F.split(code, "\n", -1)


def norm_code(code: Column) -> Column:
    """The code with every line stripped."""
    return F.array_join(F.transform(lines_of(code), strip), "\n")


def line_slice(code: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first .. last (from 1, both included), joined again."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.array_join(F.slice(lines_of(code), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def line_hash(line: Column) -> Column:
    return F.sha2(strip(line).cast("binary"), 256)


SOURCE_SUFFIXES = ("c", "cc", "cxx", "cpp", "c++", "h", "hh", "hpp", "hxx", "h++")


def is_source_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SOURCE_SUFFIXES)


def declared(line: Column, name: Column, typeref: Column) -> Column:
    """The line of a function's name with what stands before the name replaced by its type (kind:name or typename:name)."""
    kind = F.split_part(typeref, F.lit(":"), F.lit(1))
    rest = F.substr(typeref, F.length(kind) + 2)
    full = F.when(F.instr(typeref, ":") == 0, typeref).when(kind == "typename", rest).otherwise(F.concat(kind, F.lit(" "), rest))
    full = F.when(full.rlike(r"[*&]$"), full).otherwise(F.concat(full, F.lit(" ")))
    at = F.instr(line, name)
    return F.when(at > 0, F.concat(F.coalesce(full, F.lit("")), F.substr(line, at))).otherwise(line)


def encode_name(name: Column, path: Column) -> Column:
    """One flat file name for a function of a path; a slash in it is escaped, then every per cent sign."""
    flat = F.concat(name, F.lit("@@@"), F.replace(path, F.lit("/"), F.lit("@#@")))
    return F.replace(F.replace(flat, F.lit("/"), F.lit("%2F")), F.lit("%"), F.lit("%25"))


def patched_name(name: Column) -> Column:
    return F.replace(name, F.lit("OLD"), F.lit("NEW"))


def cve_of(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def parse_name(name: Column) -> Column:
    """cve, cwe, commit, file, version, func and tag of a corpus file name, all stripped. The file is the run of parts with
    `.c` after the commit, the version the next part if it has a dot."""
    parts = F.split(name, "_", -1)
    rest = F.slice(parts, 4, 1_000_000)
    run = F.array_position(F.transform(rest, lambda p: F.contains(p, F.lit(".c"))), False).cast("int") - 1
    run = F.when(run < 0, F.size(rest)).otherwise(run)
    head = F.get(rest, run)
    skip = run + F.when(F.contains(head, F.lit(".")) & (run < F.size(rest) - 1), 1).otherwise(0)
    func = F.array_join(F.slice(rest, skip + 1, F.greatest(F.size(rest) - 1 - skip, F.lit(0))), "_")
    last = F.element_at(parts, -1)
    return F.struct(
        strip(F.get(parts, F.lit(0))).alias("cve"), strip(F.get(parts, F.lit(1))).alias("cwe"), strip(F.get(parts, F.lit(2))).alias("commit"),
        strip(F.array_join(F.slice(rest, 1, run), "_")).alias("file"), strip(F.when(skip > run, head).otherwise("")).alias("version"),
        strip(func).alias("func"), strip(F.substr(last, F.lit(1), F.greatest(F.length(last) - 4, F.lit(0)))).alias("tag"),
    )


def unescape_html(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_label(label: Column) -> Column:
    """kind, code and line of a control-flow node's label `(kind,code)<SUB>line</SUB>`; of a RETURN's code the first half."""
    pattern = r"^\((.+?),([^\n]+)\)<SUB>(\d+)</SUB>"
    kind, code = strip(unescape_html(F.regexp_extract(label, pattern, 1))), strip(unescape_html(F.regexp_extract(label, pattern, 2)))
    code = F.when(kind == "RETURN", F.substr(code, F.lit(1), F.floor(F.length(code) / 2).cast("int"))).otherwise(code)
    found = F.regexp_like(label, F.lit(pattern))
    line = F.when(found, F.regexp_extract(label, pattern, 3).try_cast("int"))
    return F.struct(F.when(found, kind).alias("kind"), F.when(found, flow_code(code)).alias("code"), line.alias("line"))


def flow_code(code: Column) -> Column:
    """A node's code in one line, adjacent string literals joined."""
    code = F.regexp_replace(F.replace(code, F.lit("\n"), F.lit(" ")), r"\\012\s*", " ")
    return F.regexp_replace(F.replace(code, F.lit('" "'), F.lit(" ")), rf"{WS}+", " ")
