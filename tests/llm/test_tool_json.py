"""Every line that tool-call linking writes is JSON, with null where there is nothing."""

from __future__ import annotations

import json

from logbasin.llm import queries, tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, turn long, call_id string, result string"


def test_null_fields_are_written_as_null(spark):
    calls = [
        (1, 0, "a", "reply", '{"text":"x","final":true}', None), (1, 2, None, "reply", '{"text":"y","final":false}', []), (1, 4, "c", None, None, []),
        (1, 6, "d", "reply", "no object", []), (2, 0, "a", "reply", '{"final":true,"text":"\\u00e9\\n\\"q\\""}', []),
    ]
    results = [(1, 1, "a", None), (2, 1, "a", 'say "hi"\n\té'), (2, 3, "orphan", "late"), (2, 5, None, None)]
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tool_calls.tools(spark)).collect()
    found = {(r.conv_id, r.turn): json.loads(r.json) for r in rows}
    assert len(found) == len(rows) == 7
    by_turn = {(c[0], c[1]): c for c in calls} | {(r[0], r[1]): r for r in results if r[2] in ("orphan", None)}
    answers = {(1, "a"): None, (2, "a"): results[1][3]}
    for key, line in found.items():
        given = by_turn[key]
        assert list(line) == ["arguments", "id", "name", "result"]
        assert line["id"] == given[2] and line["name"] == (given[3] if len(given) == 6 else None)
        arguments = json.loads(given[4]) if len(given) == 6 and given[4] and given[4].startswith("{") else None
        assert line["arguments"] == arguments
        assert line["result"] == (answers.get((key[0], given[2])) if len(given) == 6 else given[3])


def test_every_line_of_the_query_is_json(spark):
    folder = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    rows = queries.op3_tool_calls(spark, folder).collect()
    assert any(r.status == "unanswered" for r in rows) and any(r.status == "orphan" for r in rows)
    for r in rows:
        line = json.loads(r.json)
        assert line["id"] == r.call_id and line["name"] == r.name
        assert line["result"] == (texts[(r.conv_id, r.turn + 1)] if r.status == "linked" else texts[(r.conv_id, r.turn)] if r.status == "orphan" else line["result"])
        assert r.status != "unanswered" or line["result"] is None
