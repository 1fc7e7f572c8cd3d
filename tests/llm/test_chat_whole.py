"""Roles as given, messages that are no objects, records without mapping, an empty table."""

import hashlib

from tactigrid.llm import chat


def test_roles_stay_and_unmapped_records_have_null_digests(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "model", "c")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_records(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id")).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"human\na\ngpt\nb\n").hexdigest() and got[1]["loss_chars"] == 0 and got[2]["n_turns"] == 1
    records = [(1, '{"messages": ["plain", {"role": "user", "content": "x"}]}'), (2, "[1]"), (3, '{"messages": [{"role": "gpt", "content": null}]}')]
    x = chat.format_records(spark.createDataFrame(records, "conv_id long, record string"), "conv_id")
    out = {r["conv_id"]: r for r in x.collect()}
    assert chat.parse(out[1]["formatted"]) == [("", "plain"), ("user", "x")] and chat.parse(out[3]["formatted"]) == [("gpt", "")]
    read = {r["conv_id"]: r for r in chat.digests(x).collect()}
    assert read[2]["n_turns"] is None and read[2]["turns_sha256"] is None and read[1]["n_turns"] == 2
    empty = chat.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.digests(chat.format_records(empty, "conv_id")).count() == 0
