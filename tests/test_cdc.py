"""CDC decode / validate / normalise edge cases."""

import json

from pyspark.sql import functions as F

from cdcmart.operators import cdc


def env(payload=..., **over):
    p = {
        "before": None,
        "after": {"id": "p1", "x": 1},
        "source": {"schema": "public", "table": "pulls"},
        "op": "c",
        "ts_ms": 1700000000000,
    }
    p.update(over)
    return {"payload": p} if payload is ... else payload


def run(spark, msgs):
    rows = [(m if isinstance(m, bytes) else (m if isinstance(m, str) else json.dumps(m)).encode(),) for m in msgs]
    df = spark.createDataFrame(rows, "value binary")
    return cdc.route(df, ingested_at=F.col("event_timestamp")).collect()


def reason_of(spark, m):
    return run(spark, [m])[0]["reason"]


def test_valid_and_undecodable(spark):
    r = run(spark, [env(), b"\xff\xfe", b"{bad json"])
    assert [x["route"] for x in r] == ["bronze", "undecodable", "undecodable"]


def test_reasons_in_order(spark):
    def drop(key):
        e = env()
        del e["payload"][key]
        return e

    cases = {
        "missing payload": [{}, {"payload": {}}, {"payload": None}, {"payload": 0}, {"payload": ""}, {"payload": []},
                            ["not", "an", "object"]],
        "missing payload.op": [drop("op"), {"payload": ["op"]}, {"payload": "text"}],
        "missing payload.source": [drop("source")],
        "missing payload.ts_ms": [drop("ts_ms")],
        "payload.source is not an object": [env(source="pulls")],
        "missing payload.source.table": [env(source={"schema": "public"})],
        "missing payload.source.schema": [env(source={"table": "pulls"})],
        "delete event missing payload.before": [env(op="d", before=None), env(op="d", before={})],
        "op='c' missing payload.after": [env(after={}), env(after=None)],
        "op='u' missing payload.after": [env(op="u", after=0)],
        "op=None missing payload.after": [env(op=None, after=None)],
    }
    for want, msgs in cases.items():
        for m in msgs:
            assert reason_of(spark, m) == want, (want, m)


def test_present_but_null_passes_presence(spark):
    # ts_ms present with null value passes the presence rule
    assert reason_of(spark, env(ts_ms=None)) is None
    # the string "0" is truthy
    assert reason_of(spark, env(after="0")) is None


def test_normalise(spark):
    msgs = [
        env(op="d", before={"id": "p9", "x": 2}, after=None),
        env(op="r"),
        env(op="zz"),
        env(op="u", after={"id": None, "x": 3}),
        env(after={"id": 7}),
        env(after={"player_id": "1", "banner_type": "limited"}),
    ]
    r = run(spark, msgs)
    assert [x["event"] for x in r] == ["delete", "insert", "insert", "update", "insert", "insert"]
    assert r[0]["id"] == "p9" and json.loads(r[0]["data"]) == {"id": "p9", "x": 2}
    assert r[3]["id"] == "None"
    assert r[4]["id"] == "7"
    assert r[5]["id"] == '{"banner_type":"limited","player_id":"1"}'  # sorted keys
    assert r[1]["event_timestamp"].year == 2023
    assert all(x["source_table"] == "pulls" and x["source_schema"] == "public" for x in r)


def test_dead_letter_carries_raw(spark):
    r = run(spark, [env(after={})])[0]
    assert r["route"] == "dlq" and json.loads(r["raw"])["payload"]["op"] == "c"


def test_rows_stay_in_their_message(spark):
    """Only small parts are taken out of the parsed message: not the payload, not the row."""
    fields = cdc.extract(cdc.decode(spark.createDataFrame([("{}",)], "value string"))).schema
    assert {f.name for f in fields if f.dataType.typeName() == "variant"} == {"msg", "_op", "_source", "_ts", "_id"}


def test_row_text_of_any_shape(spark):
    rows = {'{"b":1,"id":"q\\"é"}': "q\"é", '{"id":7.50,"a":[1,{"z":null}]}': "7.5", '{"id":null,"a":"{"}': "None",
            '{"player_id":"1"}': '{"player_id":"1"}', '"{x"': '"{x"', '[{"id":1}]': '[{"id":1}]', "true": "true"}
    source = '"source":{"table":"pulls","schema":"s"},"ts_ms":5'
    got = run(spark, [f'{{"payload":{{"before":null,"after":{row},"op":"c",{source}}}}}' for row in rows])
    got += run(spark, [f'{{"payload":{{"before":{row},"after":{{"id":"no"}},"op":"d",{source}}}}}' for row in rows])
    assert [(r["route"], r["id"]) for r in got] == [("bronze", v) for v in rows.values()] * 2
    sorted_text = ['{"b":1,"id":"q\\"é"}', '{"a":[1,{"z":null}],"id":7.5}', '{"a":"{","id":null}', *list(rows)[3:]]
    assert [r["data"] for r in got] == sorted_text * 2
