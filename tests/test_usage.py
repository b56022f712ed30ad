from quartier.operators import aggregates


def test_cost_of_a_day_may_pass_ten_thousand_dollars(spark):
    prices = spark.createDataFrame([("m", 3.0, 15.0), ("n", 0.5, 1.5)], "model string, usd_in double, usd_out double")
    rows = [("2024-01-01 01:00:00", "m", 10**9, 2 * 10**9)] * 3 + [("2024-01-01 02:00:00", "n", 1, 1), ("2024-01-02 01:00:00", "n", 10**15, 10**17)]
    spans = spark.createDataFrame(rows, "ts string, model string, tokens_in long, tokens_out long").selectExpr("timestamp(ts) AS ts", "model", "tokens_in", "tokens_out")
    got = {(r.day.day, r.model): (r.calls, float(r.cost), r.over_limit) for r in aggregates.usage_cost(spans, prices, 0.02).collect()}
    assert got == {(1, "m"): (3, 99000.0, True), (1, "n"): (1, 0.000002, True), (2, "n"): (1, 150500000000.0, True)}
