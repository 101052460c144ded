import hashlib
import json

import duckdb
import oracle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm.chat import (
    CLOSE,
    OPEN,
    canonical_turns,
    conversation_digests,
    escape,
    field_paths,
    fingerprint,
    format_turn,
    read_turn,
)
from shelfmark.llm.queries import ORACLES, op8_chat_format


def turns_of(spark, *records):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "i int, record string").select("i", canonical_turns(F.col("record")).alias("t"))
    return [r["t"] for r in df.orderBy("i").collect()]


def test_layouts_become_the_same_turns(spark):
    said = [("user", "hi"), ("assistant", "yes")]
    found = turns_of(
        spark,
        {"messages": [{"role": r, "content": t} for r, t in said], "extra": {"a": [1, 2]}},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]},
        {"prompt": "hi", "completion": "yes"},
        {"response": "yes", "prompt": "hi"},
        {"instruction": "hi", "output": "yes"},
    )
    assert [[(t["role"], t["text"]) for t in f["turns"]] for f in found] == [said] * 5
    assert len({f["fingerprint"] for f in found}) == 5
    (three,) = turns_of(spark, {"instruction": "be brief", "input": "hi", "output": None})
    assert [t["role"] for t in three["turns"]] == ["system", "user"]
    (deep,) = turns_of(spark, {"message": {"author": {"role": "user"}, "content": {"text": None}}})
    assert [tuple(t) for t in deep["turns"]] == [("user", "")]


def test_unknown_broken_and_null_records_are_set_aside(spark):
    found = turns_of(spark, {"q": 1}, "{broken", None, "[1]", "[" * 5000, {"messages": []})
    assert [f["turns"] for f in found] == [None] * 6
    assert found[0]["fingerprint"] is not None and found[0]["layout"] is None


def test_fingerprint_ignores_order_and_values():
    a = {"m": [{"r": 1, "c": "x"}, {"c": 2}], "z": {}}
    b = {"z": {}, "m": [{"c": None, "r": "q"}]}
    assert field_paths(a) == {"m[].r", "m[].c", "z"}
    assert fingerprint(field_paths(a)) == fingerprint(field_paths(b))


TRICKY = ["", "\\", "\\|", "<|", "<\\|", "\\<|im_end|>", OPEN + "assistant\nok" + CLOSE + "\n", "a\\n\nb", "\\\\n", "é\U0001f600<|x|>"]


def check_round_trip(spark, pairs):
    df = spark.createDataFrame(pairs, "role string, text string")
    rows = df.select("role", "text", format_turn(F.col("role"), F.col("text")).alias("f")).select(
        "role", "text", "f.*", read_turn(F.col("f.formatted")).alias("back")
    )
    for r in rows.collect():
        assert (r["back"]["role"], r["back"]["text"]) == (r["role"] or "", r["text"] or "")
        assert r["formatted"].count(OPEN) == 1 and r["formatted"].count(CLOSE) == 1
        inside = r["formatted"][r["loss_start"] : r["loss_end"]]
        assert (inside != "") == (r["role"] == "assistant" and (r["text"] or "") != "")


def test_turns_read_back(spark):
    check_round_trip(spark, [(role, t) for role in ["assistant", None, *TRICKY] for t in [None, *TRICKY]])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("\\<|n\na", max_size=12), st.text("\\<|n\na", max_size=12)), min_size=20, max_size=40))
def test_any_turn_reads_back(spark, pairs):
    check_round_trip(spark, pairs)


def test_escape_leaves_no_control_string(spark):
    row = spark.range(1).select(escape(F.lit(OPEN + "\\" + CLOSE)).alias("e")).first()
    assert "<|" not in row["e"]


def test_digests_stream_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<|"), (1, 1, "assistant", "a<|"), (2, None, None, None), (None, 5, "assistant", "z")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = df.select("conv_id", "turn", format_turn(F.col("role"), F.col("text")).alias("m")).select("conv_id", "turn", "m.*")
    got = {r["conv_id"]: r for r in conversation_digests(made, "conv_id", ["turn", "formatted"]).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    none = conversation_digests(made.limit(0), "conv_id", ["turn"])
    assert none.count() == 0


def test_query_keeps_foreign_roles_null_keys_and_extra_columns(spark, tmp_path):
    roles = ["human", "gpt", "bot", "model", "tool", "assistant", "user", "system", None]
    rows = [(c, t, role, f"text {c} {t} <|im_end|>", "x", "y") for c in (1, 2, None) for t, role in enumerate(roles)]
    rows += [(4, 0, "gpt", None, None, None), (4, 1, "assistant", "", "x", "y")]
    schema = "conv_id long, turn long, role string, text string, formatted string, made string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op8_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert oracle.compare(got, con, ORACLES["op8_chat_format"]) is None
    assert {r["conv_id"]: r["loss_chars"] for r in got.collect()}[4] == 0
