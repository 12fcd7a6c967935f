"""The running amount may pass the budget inside a block and fall back before its end."""

from tallyforge.operators import aggregates as ag


def test_breach_that_is_refunded_within_its_block(spark):
    amounts = {5: 90.0, 7: 20.0, 9: -50.0, 10_001: 10.0, 20_001: 100.0}
    df = spark.createDataFrame(list(amounts.items()), "i long, x double")
    assert ag.budget_breach(df, "i", "x", 100).first()["first_over"] == 7
    assert ag.budget_breach(df, "i", "x", 150).first()["first_over"] == 20_001
    assert ag.budget_breach(df, "i", "x", 170).first()["first_over"] is None
