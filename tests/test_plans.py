import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from recurscan.config import Config
from recurscan.plans.detect import build_index, code_flows, detect
from recurscan.sources import code, sinks
from recurscan.streaming.detect import detect_stream, read_targets

OLD = """int read_header(struct ctx *c, char *buf)
{
  int size = get_size(c);
  int left = size - 4;
  char *out = alloc(size);
  copy(out, buf, left);
  release(buf);
  c->data = out;
  return size;
}
"""
NEW = OLD.replace("  char *out", "  if (left < 0)\n    return -1;\n  char *out")
OTHER = """static void draw(struct view *v)
{
  for (int i = 0; i < v->n; i++) {
    paint(v, i);
    refresh(v);
  }
  v->dirty = 0;
  unlock(v->mutex);
  notify(v);
  log("done");
}
"""


def make_corpus(path):
    d = f"{path}/corpus/proj/CVE-2020-1"
    os.makedirs(d)
    for tag, body in (("OLD", OLD), ("NEW", NEW)):
        with open(f"{d}/CVE-2020-1_CWE-1_abc_file.c_1.0_read_header_{tag}.vul", "w") as f:
            f.write(body)
    d = f"{path}/project/src"
    os.makedirs(d)
    with open(f"{d}/a.c", "w") as f:
        f.write("#include <x.h>\n/* int no(void) { } */\n" + OLD + "\n" + OTHER)
    with open(f"{d}/fixed.cpp", "wb") as f:
        f.write(b"// caf\xe9 \x96\n" + NEW.encode())
    with open(f"{d}/notes.txt", "w") as f:
        f.write(OLD)


def load(spark, path):
    corpus = code.read_corpus(spark, f"{path}/corpus").withColumn("key", F.concat_ws("_", "commit", "file", "version", "func"))
    targets = code.read_project(spark, f"{path}/project")
    return targets, corpus.select("id", "cve", "key", "tag", "code")


def test_sources(spark, tmp_path):
    make_corpus(str(tmp_path))
    targets, corpus = load(spark, tmp_path)
    assert sorted(r.func_name for r in targets.collect()) == ["draw", "read_header", "read_header"]
    assert {r.tag for r in corpus.collect()} == {"OLD", "NEW"} and corpus.first()["cve"] == "CVE-2020-1"
    first = targets.where("path like '%a.c' and func_name = 'read_header'").first()
    assert first.code.startswith("int read_header(struct ctx *c, char *buf)\n{\nint size") and first.line == 3


def test_detection(spark, tmp_path):
    make_corpus(str(tmp_path))
    targets, corpus = load(spark, tmp_path)
    found = detect(spark, targets.select(F.col("func_id").alias("id"), "code"), build_index(corpus))
    records = found.records.collect()
    assert len(records) == 1 and "a.c:read_header" in records[0].dst_id and "OLD" in records[0].sim[0]
    assert tuple(found.totals.first()) == (3, 1, 1)
    counters = {r.stage: (r.input, r.passed) for r in found.counters.collect()}
    assert counters["bloom"][0] == 3 and counters["trace"] == (1, 1)
    assert found.trace.count() == 1
    sinks.write_records(found.records, found.totals, f"{tmp_path}/out")
    sinks.write_trace(found.trace, f"{tmp_path}/trace")
    sinks.write_counters(found.counters, f"{tmp_path}/info")
    assert spark.read.json(f"{tmp_path}/out/summary").first()["cnt"] == 1
    assert json.loads(spark.read.option("header", True).csv(f"{tmp_path}/trace").first()["detail"])
    whole = sinks.nested(found.records, found.totals).first()
    assert whole["all"] == 1 and whole["vul"][0]["id"] == 1
    none = detect(spark, targets.limit(0).select(F.col("func_id").alias("id"), "code"), build_index(corpus))
    assert none.records.count() == 0 and tuple(none.totals.first()) == (0, 0, 0)


def test_command_line_and_saved_index(spark, tmp_path):
    from recurscan.__main__ import arguments, run

    make_corpus(str(tmp_path))
    base = str(tmp_path)
    args = ["--index", f"{base}/index", "--out", f"{base}/result", "--restore-processed", f"{base}/functions", "--config", f"{base}/config.yml"]
    with pytest.raises(SystemExit):
        run(spark, arguments([f"{base}/project", *args]))
    run(spark, arguments([f"{base}/project", "--corpus", f"{base}/corpus", *args]))
    assert Config.from_yaml(open(f"{base}/config.yml").read()) == Config()
    first = spark.read.json(f"{base}/result/vul").collect()
    assert spark.read.json(f"{base}/result/summary").first()["cnt"] == 1 and {r.stage for r in spark.read.json(f"{base}/result/info").where("rate > 0").collect()} == {"bloom", "token", "syntax", "trace"}
    shutil.rmtree(f"{base}/corpus")
    shutil.rmtree(f"{base}/project")
    code_ = "import sys; from recurscan.__main__ import *; run(SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 4).config('spark.ui.enabled', 'false').getOrCreate(), arguments())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code_, f"{base}/project", *args], check=True, env=os.environ | {"PYTHONPATH": root}, timeout=300)  # another session
    again = spark.read.json(f"{base}/result/vul").collect()
    assert [(r.id, r.dst, r.sim) for r in again] == [(r.id, r.dst, r.sim) for r in first]


def test_flows_through_a_line_map(spark):
    rows = spark.createDataFrame([("f", "a = 1;\nb =\n a;\ng(b);")], "id string, code string")
    lines = spark.createDataFrame([("f", 1, "ONE"), ("f", 2, "TWO")], "func_id string, line int, code string")
    assert {tuple(r.flow) for r in code_flows(rows, "id", "code", line_map=lines).collect()} == {("ONE", "TWO"), ("TWO", "TWO")}
    assert {tuple(r.flow) for r in code_flows(rows, "id", "code").collect()} == {("a = 1;", " a;"), ("b =", "g(b);")}


def test_stream_equals_batch(spark, tmp_path):
    make_corpus(str(tmp_path))
    targets, corpus = load(spark, tmp_path)
    rows = targets.select(F.col("func_id").alias("id"), "code")
    rows.write.parquet(f"{tmp_path}/in")
    rows.write.mode("append").parquet(f"{tmp_path}/in")  # delivered again
    q = detect_stream(spark, read_targets(spark, f"{tmp_path}/in"), build_index(corpus), f"{tmp_path}/live", f"{tmp_path}/marks")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/live/records")
    assert [r.sim for r in got.collect()] == [r.sim for r in detect(spark, rows, build_index(corpus)).records.collect()]


def test_graph_and_flow_files(spark, tmp_path):
    with open(f"{tmp_path}/f1.dot", "w") as f:
        f.write('digraph "f" {\n"1" [label = <(METHOD,f)<SUB>1</SUB>> ]\n"2" [label = <(&lt;operator&gt;.assignment,a = 1)<SUB>2</SUB>> ]\n  "1" -> "2"\n  "2" -> "2"\n}\n')
    nodes, edges = code.read_dot(spark, f"{tmp_path}/f1.dot")
    assert [(r.func_id, r.node_id, r.kind, r.code, r.line) for r in nodes.orderBy("ord").collect()] == [("f1", "1", "METHOD", "f", 1), ("f1", "2", "<operator>.assignment", "a = 1", 2)]
    assert [tuple(r) for r in edges.collect()] == [("f1", "1", "2")]
    with open(f"{tmp_path}/f1.json", "w") as f:
        json.dump([{"elements": [{"lineNumber": 1}, {"lineNumber": 2}]}], f)
    assert [tuple(r) for r in code.read_taint(spark, f"{tmp_path}/f1.json").collect()] == [("f1", [1, 2])]
    with open(f"{tmp_path}/p.csv", "w") as f:
        f.write("old,new\na,b\n")
    assert tuple(code.read_pairs_csv(spark, f"{tmp_path}/p.csv").first()) == ("a", "b")
    functions = spark.createDataFrame([(f"p{i}", "x" if i else "") for i in range(9)], "path string, code string")
    assert code.normal_sample(functions, 5, 1).count() == 5
