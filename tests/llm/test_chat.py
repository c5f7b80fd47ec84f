import random

from recurscan.llm import chat


def brute(events):
    turns = {}
    for c, t, s, k, r, x in sorted(events, key=lambda e: (e[0], e[2], e[3] or "message", e[5] or "")):
        own = turns.setdefault(c, {})
        k, x = k or "message", x or ""
        if k == "regenerate":
            for later in [u for u in own if u > t]:
                del own[later]
        role, text = own.get(t, (None, ""))
        own[t] = (r if role is None or k != "delta" and r is not None else role, text + x if k == "delta" else x)
    return {c: [(r or "", x) for _, (r, x) in sorted(v.items())] for c, v in turns.items() if v}


TEXTS = ["", "hi", "\\### Assistant: </turn> ok", "</turn>", "\n</turn>\n### user:\nx", "\\", "\\\\", "\\l<\\h#", "a\nb\n", "é🙂<#", None, "#" * 9, "\\n"]


def test_round_trip(spark):
    rng = random.Random(2)
    events = []
    for c in range(40):
        for s in range(rng.randint(1, 25)):
            t = rng.randint(0, 5)
            events.append((c, t, s, rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None]), ["user", "assistant", "ro<#\\le\n"][t % 3], rng.choice(TEXTS)))
    df = spark.createDataFrame([(*e, 1) for e in events], "conv_id long, turn long, seq long, kind string, role string, text string, loss int").repartition(3)
    out = chat.render(chat.reconstruct(df))
    full = {r.conv_id: r for r in out.collect()}
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    want = brute(events)
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].loss_text == "".join(x for r, x in turns if r == "assistant")
        assert back[c].formatted_chars == len(full[c].formatted)
        assert full[c].formatted.count("</turn>") == full[c].formatted.count("### ") == len(turns)
        for (r, x), span in zip([t for t in turns if t[0] == "assistant"], full[c].loss):
            assert len(x) <= span.length


def test_odd_rows(spark):
    kinds = "conv_id long, turn long, seq long, kind string, role string, text string"
    df = spark.createDataFrame([(None, None, None, None, None, None), (1, 1, 1, "delta", "user", "only delta"), (1, 1, 1, "delta", "user", "only delta")], kinds)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.render(chat.reconstruct(df))).collect()}
    assert got == {None: [("", "")], 1: [("user", "only deltaonly delta")]}
    assert chat.render(chat.reconstruct(df.limit(0))).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, 1, 1, "message", "user", "x")], "conv_id long, turn long, seq long, kind string, role string, text string")
    plan = chat.read_back(chat.render(chat.reconstruct(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan


def test_query_folds_drafts_edits_and_regenerations(spark, sf_dir):
    from recurscan.llm import queries

    rows = spark.createDataFrame([(1, 1, "user", "ask"), (1, 2, "assistant", "an answer é🙂"), (1, 3, "assistant", ""), (2, 1, "assistant", "ab"), (3, 1, "", "x")], "conv_id long, turn long, role string, text string")
    log = queries.event_log(rows)
    assert {r.kind for r in log.collect()} == {"message", "edit", "delta", "regenerate"}
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.render(chat.reconstruct(log))).collect()}
    assert got == {1: [("user", "ask"), ("assistant", "an answer é🙂"), ("assistant", "")], 2: [("assistant", "ab")], 3: [("", "x")]}
    events = [(r.conv_id, r.turn, r.seq, r.kind, r.role, r.text) for r in log.collect()]
    assert got == brute(events)
    plan = queries.op10_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and "EvalPython" not in plan
