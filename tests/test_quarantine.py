"""Records that break any of the five rules are rejected, in Spark and in SQL."""

import duckdb

from tallyforge.plans import oracles, queries

SCHEMA = "record_no long, input struct<state:string,questions:map<string,struct<type:string,instructions:string,criteria:string>>>, reference struct<target:string,distribution:map<string,double>>"


def test_all_five_rules(spark, tmp_path):
    record = lambda n, kind, criteria, target, d=None: (n, ("s", {"decision": (kind, "i", criteria)}), (target, d))
    rows = [
        record(1, "choice", '{"a": "x", "b": "y"}', '"a"', {"a": 0.5, "b": 0.5}), record(2, "score", '["l", "h"]', "1", {"0": 0.5, "1": 0.5}), record(3, "noul", '{"false": "n", "true": "y"}', "true"),
        record(4, "other", '{"a": "x"}', '"a"'), record(5, "choice", "{}", '"a"'), record(6, "score", "[]", "0"), record(7, "choice", '{"a": "x"}', '"c"'),
        record(8, "choice", '{"a": "x"}', '"a"', {"b": 1.0}), record(9, "choice", '{"a": "x"}', '"a"', {"a": 0.5}),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/decision_records.parquet")
    got = {r["reason"]: r["n"] for r in queries.queries()["record_quarantine_reasons"](spark, str(tmp_path)).collect()}
    assert got == {"type": 1, "criteria": 2, "target": 4, "distribution keys": 1, "distribution sum": 1}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW decision_records AS SELECT * FROM '{tmp_path}/decision_records.parquet/*.parquet'")
    assert dict(c.execute(oracles.oracle_sql()["record_quarantine_reasons"]).fetchall()) == got
