"""One locale's test rows against the fixed scenarios."""

import json

import pytest

from tallyforge.sources import adapters

SCHEMA = "id long, locale string, partition string, scenario string, intent string, utt string"


def test_locale_scenarios_and_blanks(spark):
    rows = [(1, "de-DE", "test", "alarm", "set", "weck"), (2, "en-US", "test", "alarm", "set", "wake"), (3, "de-DE", "test", "nowhere", "x", "x"), (4, "de-DE", "test", "news", "x", " \u3000"), (5, "de-DE", "test", "news", "x", None), (6, "de-DE", None, "news", "x", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    made = {r["id"]: r for r in adapters.massive(df, "de-DE").collect()}
    assert {k[-1]: r["status"] for k, r in made.items()} == {"1": "ok", "2": "skip", "3": "raise", "4": "skip", "5": "skip", "6": "skip"}
    assert len(json.loads(made["massive-de-DE-1"]["criteria"])) == 18 and made["massive-de-DE-1"]["target"] == '"alarm"'
    assert {r["status"] for r in adapters.massive(df).collect()} == {"raise"}
    with pytest.raises(Exception, match="massive"):
        adapters.convert("massive", df, locale="de-DE").collect()
    assert adapters.accepted(adapters.convert("massive", df.where("id <> 3"), locale="de-DE")).count() == 1
