"""The release audit makes all six checks, against every held-out split."""

from tallyforge.plans import queries

SCHEMA = "record_no long, id string, family string, split string, input struct<state:string>, reference struct<target:string>"


def test_all_checks_against_all_held_out_splits(spark, tmp_path):
    rows = [
        (1, "a", "f", "train", ("one",), ("x",)), (2, "b", "f", " Validation ", ("one",), ("y",)),
        (3, "c", "g", "TRAIN", ("two",), ("x",)), (4, "d", "g", "eval", ("three",), ("x",)),
        (5, "e", "h", "train", ("four",), ("x",)), (6, "i", "j", "test", ("four",), ("x",)),
        (7, "e", "k", "train", ("five",), ("x",)), (8, None, None, None, None, None),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/decision_records.parquet")
    got = {r["violation"]: r["n"] for r in queries.queries()["release_audit_counts"](spark, str(tmp_path)).collect()}
    # groups: f and g hold two records, f one state, g, h, j and k one label
    assert got == {"repeated id": 1, "repeated input": 2, "provenance": 3, "held-out family": 2, "held-out input": 2, "groups": 7}
