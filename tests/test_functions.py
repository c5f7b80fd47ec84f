import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from recurscan.config import Config
from recurscan.functions import features, strings, text, tokens, trees

CODE = """int f(char *p)
{
#ifdef X
  int n = 0; // count
#endif
  /* multi
     line */
  n = g(p);
  if (n > 3)
    n--;
  h("http://é");
  return n;
}
"""
PURE = 'int f(char *p)\n{\nint n = 0;\nn = g(p);\nif (n > 3)\nn--;\nh("http:\nreturn n;\n}'


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_purify(spark):
    assert one(spark, text.purify(F.col("c")), c=CODE) == PURE
    short = "\n".join(x for x in CODE.split("\n") if x.strip() not in ("n = g(p);", "if (n > 3)", "n--;"))
    assert one(spark, text.purify(F.col("c")), c=short) == ""
    assert one(spark, text.purify(F.col("c"), True), c="a;\n\n b") == "a;\nb"


@pytest.mark.parametrize(
    "name,want",
    [
        ("CVE-2009-0385_CWE-189_72e7_4xm.c_1.1_fourxm_read_header_OLD.vul", ("CVE-2009-0385", "CWE-189", "72e7", "4xm.c", "1.1", "fourxm_read_header", "OLD")),
        ("CVE-SAMPLE_CWE-SAMPLE_abcdef_SAMPLE.cpp__SAMPLE_FUNC_NEW.vul", ("CVE-SAMPLE", "CWE-SAMPLE", "abcdef", "SAMPLE.cpp", "", "_SAMPLE_FUNC", "NEW")),
        ("CVE-1_CWE-2_ab_a_b.c_f_OLD.vul", ("CVE-1", "CWE-2", "ab", "", "", "a_b.c_f", "OLD")),
    ],
)
def test_parse_name(spark, name, want):
    assert tuple(one(spark, text.parse_name(F.col("c")), c=name)) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("if (a >= b) {", "if ( a >= b ) {"), ("x = y", "x ="), ("else", ""), ("return x", "return"), ("f()->x;", "f ( ) -> x ;"),
        ("g(a)->x;", "g ( a ) - > x ;"), ("x >>= 2;", "x >>= 2 ;"), ("a |= b;", "a | = b ;"), ("for(;;)", "for ( ; ; )"), ("a\t=\tb;", "a = \t b ;"),
        ("x; */ ", ""), ("é a;", "a ;"), ("a\r", "a"),
    ],
)
def test_tokens(spark, line, want):
    got = one(spark, tokens.code_tokens(F.col("c")), c=line)
    assert " ".join(got) == want


def scan(line):
    """The scanner by its rules, one character at a time, to hold the pattern against."""
    word, out, i = "", [], 0
    w = lambda c: c.isascii() and (c.isalnum() or c == "_")
    space = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
    while i < len(line):
        c = line[i]
        if w(c):
            word += c
            i += 1
            continue
        out, word = out + [word] * bool(word), ""
        if c in space:
            i += 1
            continue
        rest = line[i + 1 : i + 3]
        if not rest or w(rest[0]):
            out, i = out + [c], i + 1
        elif c + rest[0] in tokens.OPERATORS:
            more = rest[1:] and not w(rest[1])
            if more and c + rest in (">>=", "<<="):
                out.append(c + rest)
            else:
                out += [c + rest[0], *(rest[1] if more else "")]
            i += 3 if more else 2
        elif c == ";":
            out, i = out + [c], i + 1
        else:
            out, i = out + [c, rest[0]], i + 2
    if "\r" in out:
        out.remove("\r")
    return [t for t in out if t != " "]


def test_tokens_equal_the_scanner(spark):
    rng = np.random.default_rng(1)
    lines = ["".join(rng.choice(list("ab_1 \t\r;()<>=-+&|!*/.,"), rng.integers(0, 25))) for _ in range(3000)]
    want = [[] if re.search(r"\*/[ \t\r]*$", x) else scan(x) for x in lines]
    texts = [*lines, "\n".join(lines)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", tokens.code_tokens(F.col("c")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert all(got[i] == w for i, w in enumerate(want)) and got[len(lines)] == [t for w in want for t in w]


def test_features(spark):
    code = 'int memcpy_x(void) { /* while */ if (a->b <<= 2) printf("%5.2ld %s %%d", "x"); return free(p) && !q; } // goto'
    at = one(spark, features.positions(F.col("c")), c=code)
    names = [(features.CONVERSIONS + features.NAMES)[p] for p in at]
    assert set(names) == {"d", "s", "free", "&&", "!", "->", "<<=", "if", "int", "return", "void"}
    assert features.SIZE == 177 and len(features.kept_masks()) == 100
    assert sum(one(spark, features.one_hot(features.positions(F.col("c"))), c=code)) == len(at)


def test_each_position_is_dropped_by_a_try():
    masks = features.kept_masks()
    for p in range(features.SIZE):
        assert any(not m[p // 60] >> p % 60 & 1 for m in masks)
    assert all(sum(x.bit_count() for x in m) == 147 for m in masks)


def test_labels_and_names(spark):
    assert tuple(one(spark, text.parse_label(F.col("c")), c="(RETURN,return x;return x;)<SUB>17</SUB>")) == ("RETURN", "return x;", 17)
    assert tuple(one(spark, text.parse_label(F.col("c")), c="(&lt;operator&gt;.a,x &amp;&amp; y\\012  z)<SUB>3</SUB>")) == ("<operator>.a", "x && y z", 3)
    assert tuple(one(spark, text.parse_label(F.col("c")), c="nothing")) == (None, None, None)
    assert one(spark, text.encode_name(F.col("a"), F.col("b")), a="op/", b="x/y%.c") == "op%252F@@@x@#@y%25.c"
    assert one(spark, text.declared(F.col("a"), F.col("b"), F.col("c")), a="STATIC f(int a)", b="f", c="typename:char *") == "char *f(int a)"
    assert one(spark, text.strip_comments_keep_urls(F.col("c")), c="a(\"http://x\"); // y\nb /* z */") == 'a("http://x"); \nb '


def test_string_scores():
    assert strings.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert strings.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert strings.indel_ratio("abcd", "abed") == 0.75 and strings.jaro("", "a") == 0
    a = "".join(chr(97 + i * i % 23) for i in range(900))
    assert strings.fuzzy_score(strings.fuzzy_digest(a), strings.fuzzy_digest(a)) == 100
    assert strings.fuzzy_score(strings.fuzzy_digest(a), strings.fuzzy_digest(a[:400] + "change" + a[400:])) > 50
    assert strings.fuzzy_score(strings.fuzzy_digest(a), strings.fuzzy_digest("other words " * 80)) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab(){}[];,+-/ \n\"'", max_size=80))
def test_trees_never_fail(code):
    found = trees.nodes(code)
    assert len(found) == len(trees.edges(code)) + 1 and len(trees.subtree_hash(code)) == 64
    trees.abstract(code)


def test_trees():
    assert trees.nodes("f(a);") == ["f(a);", "f(a);", "f", "(a)", "a", ";"]
    assert trees.subtree_hash("a + b;") == trees.subtree_hash("b + a;") and trees.subtree_hash("a - b;") != trees.subtree_hash("b - a;")
    assert trees.nodes("(" * 5000)
    assert trees.abstract("int f(char *p) { int n = 0; n = g(p); return n; }") == "DTYPE1 f(DTYPE0 *FPARAM0) { DTYPE1 LVAR0 = 0; LVAR0 = g(FPARAM0); return LVAR0; }"


def test_config():
    c = Config.from_yaml("experiment:\n  token_filter:\n    jaccard_sim_threshold: 0.8  # x\n  trace:\n    ast_sim_threshold_min: 0.6\n    redis_host: '1'\n")
    assert (c.jaccard_sim_threshold, c.ast_sim_threshold_min, c.ast_sim_threshold_max) == (0.8, 0.6, 0.9)
    with pytest.raises(ValueError):
        Config.from_yaml("ast_sim_threshold_min: 0.95")
