import json

from tamarack.operators import dialogue


def messages(spark, *rows):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")


def trimmed(df, budget):
    return [(r["role"], r["text"]) for r in dialogue.trim(df, budget).orderBy("turn").collect()]


def test_head_stays_and_a_note_stands_for_what_went(spark):
    df = messages(spark, ("system", "s" * 10), ("human", "a" * 100), ("ai", "b" * 100), ("human", "c" * 10))
    assert trimmed(df, 50) == [("system", "s" * 10), ("system", dialogue.NOTE), ("ai", "b" * 100), ("human", "c" * 10)]
    assert len(trimmed(df, 10_000)) == 4


def test_tool_results_at_the_start_go_and_pairs_stay(spark):
    df = messages(spark, ("system", "s"), ("human", "q" * 400), ("ai", "x" * 400), ("tool", "t" * 10), ("tool", "u" * 10), ("human", "end"))
    assert trimmed(df, 20) == [("system", "s"), ("system", dialogue.NOTE), ("human", "end")]
    df = messages(spark, ("human", "q" * 400), ("ai", "x"), ("tool", "t"), ("human", "end"))
    assert trimmed(df, 20) == [("system", dialogue.NOTE), ("ai", "x"), ("tool", "t"), ("human", "end")]


def test_an_old_note_is_not_kept_twice(spark):
    df = messages(spark, ("system", "s"), ("system", dialogue.NOTE), ("human", "a" * 400), ("human", "b"))
    assert trimmed(df, 20) == [("system", "s"), ("system", dialogue.NOTE), ("human", "b")]
    df = messages(spark, ("system", "s"), ("system", dialogue.NOTE), ("human", "b"))
    assert trimmed(df, 20) == [("system", "s"), ("human", "b")]


def test_history_skips_blanks_and_survives_a_corrupt_file(spark, tmp_path):
    turns = [{"user": f"q{i}", "assistant": "" if i == 1 else f"a{i}"} for i in range(25)]
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "project": "p", "updated_at": "", "turns": turns}))
    (tmp_path / "b.json").write_text("{broken")
    got = dialogue.history(dialogue.read_history(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r["text"] for r in got][:4] == ["q0", "a0", "q1", "q2"] and len(got) == 49


def test_last_questions(spark):
    df = messages(spark, *[("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(50)])
    rows = dialogue.last_questions(df).orderBy("pos").collect()
    assert [r["text"] for r in rows] == [f"t{i}" for i in range(10, 50, 2)]


def test_tool_calls_cost_their_characters(spark):
    df = spark.createDataFrame([(1, 0, "ai", "x" * 10, "y" * 90), (1, 1, "human", "end", None)], "conv_id long, turn long, role string, text string, tool_calls string")
    assert dialogue.estimate(df).first()["tokens"] == 41
    assert trimmed(df, 20) == [("system", dialogue.NOTE), ("human", "end")]
    assert trimmed(df.drop("tool_calls"), 20) == [("ai", "x" * 10), ("human", "end")]


def test_turns_are_appended_and_read_back(spark, tmp_path):
    turn = "struct<user:string,assistant:string>"
    old = spark.createDataFrame([("a", [("q0", "a0")]), ("b", None)], f"conv_id string, turns array<{turn}>")
    new = spark.createDataFrame([("a", 2, "q2", None), ("a", 1, "q1", "a1"), ("c", 1, "é\n", "")], "conv_id string, at int, user string, assistant string")
    done = dialogue.append(old, new)
    dialogue.write_history(done, str(tmp_path / "h"))
    (tmp_path / "h" / "bad.json").write_text("{broken\n")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in dialogue.read_saved(spark, str(tmp_path / "h")).collect()}
    assert got == {"a": [("q0", "a0"), ("q1", "a1"), ("q2", None)], "b": [], "c": [("é\n", "")]}


def test_trim_with_null_roles_ties_and_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "head"), (1, 1, None, "x" * 30), (1, 2, "user", "b" * 30), (1, 2, "user", "a" * 30), (1, 2, "assistant", None), (None, None, "user", "hi")]
    got = {tuple(r) for r in dialogue.trim(spark.createDataFrame(rows, schema), 10_000).collect()}
    assert got == {(c, None if t is None else float(t), r or "", x or "") for c, t, r, x in rows}
    cut = [tuple(r) for r in dialogue.trim(spark.createDataFrame(rows[:5], schema), 14).orderBy("turn", "role", "text").collect()]
    assert cut == [(1, 0.0, "system", "head"), (1, 1.5, "system", dialogue.NOTE), (1, 2.0, "user", "b" * 30)]


def test_append_to_a_history_without_id(spark):
    old = spark.createDataFrame([(None, [("q", "a")]), (1, [])], "conv_id long, turns array<struct<user:string,assistant:string>>")
    said = spark.createDataFrame([(None, 1, "r", "b"), (2, 1, "s", "c")], "conv_id long, at int, user string, assistant string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in dialogue.append(old, said).collect()}
    assert got == {None: [("q", "a"), ("r", "b")], 1: [], 2: [("s", "c")]}
