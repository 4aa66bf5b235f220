"""Lots, reconciliation, merges and snapshots."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from marlstone.operators import ledger, portfolio
from marlstone.sources import merge

FILL = "id bigint, symbol string, action string, quantity bigint, price decimal(18,2), executed_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def fills(spark, rows, symbol="X"):
    return spark.createDataFrame([(i, symbol, a, q, Decimal(p), T0 + dt.timedelta(minutes=i)) for i, (a, q, p) in enumerate(rows)], FILL)


@pytest.mark.parametrize(
    ("rows", "qty", "avg", "realized"),
    [
        ([("Buy", 10, 100)], 10, 100, 0),
        ([("Buy", 10, 100), ("Buy", 10, 110)], 20, 105, 0),
        ([("Buy", 10, 100), ("Buy", 10, 110), ("Sell", 5, 120)], 15, (5 * 100 + 10 * 110) / 15, 100),
        ([("Buy", 8, 90), ("Sell", 8, 95)], 0, 0, 40),
        ([("Sell", 10, 100), ("Buy", 10, 90)], 0, 0, 100),
        ([("Buy", 5, 10), ("Sell", 5, 12), ("Buy", 3, 15)], 3, 15, 10),
        ([("Buy", 5, 10), (None, 8, 12)], -3, 12, 10),
    ],
)
def test_positions(spark, rows, qty, avg, realized):
    r = ledger.positions(fills(spark, rows)).first()
    assert (r["qty"], r["avg_price"], r["realized"]) == (qty, pytest.approx(avg), pytest.approx(realized))


def replay(rows):
    lots, realized = [], 0
    for action, qty, price in rows:
        sign = 1 if action == "Buy" else -1
        while qty and lots and lots[0][0] * sign < 0:
            used = min(qty, abs(lots[0][0]))
            realized += (price - lots[0][1]) * used * -sign
            qty -= used
            lots[0][0] += sign * used
            if not lots[0][0]:
                lots.pop(0)
        if qty:
            lots.append([sign * qty, price])
    net = sum(q for q, _ in lots)
    return net, (sum(abs(q) * p for q, p in lots) / abs(net) if net else 0), realized


def test_lots_equal_a_replay(spark):
    rng = random.Random(11)
    cases = {f"S{k}": [(rng.choice(["Buy", "Sell"]), rng.randint(1, 9), rng.randint(1, 50)) for _ in range(rng.randint(1, 30))] for k in range(150)}
    rows = [(100 * n + i, s, a, q, Decimal(p), T0 + dt.timedelta(minutes=i // 2)) for n, (s, c) in enumerate(cases.items()) for i, (a, q, p) in enumerate(c)]
    got = {r["symbol"]: r for r in ledger.positions(spark.createDataFrame(rows, FILL)).collect()}
    for s, c in cases.items():
        net, avg, realized = replay(c)
        assert (got[s]["qty"], got[s]["avg_price"], got[s]["realized"]) == (net, pytest.approx(avg), pytest.approx(realized))


def test_reconcile(spark):
    pos = spark.createDataFrame([("A", 10, 5.0), ("B", 3, 2.0), ("C", 0, 0.0)], "symbol string, qty bigint, avg_price double")
    broker = spark.createDataFrame([("A", "Long", 10.0, 5.0), ("D", "Short", 4.0, 1.0)], "symbol string, direction string, quantity double, cost_basis double")
    theses = spark.createDataFrame([("a", "active", 5.0, 10.0), ("Z", "active", 1.0, None)], "thesis string, status string, cost_basis double, shares double")
    got = {r["symbol"]: r["status"] for r in ledger.reconcile(pos, broker, theses).collect()}
    assert got == {"A": "OK", "B": "quantity", "D": "quantity; no thesis"}
    assert {r["thesis"] for r in ledger.theses_without_position(theses, broker).collect()} == {"a", "Z"}


def test_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in merge.newer_wins(a, b, ["k"]).collect()} == {(1, "x"), (2, "new"), (3, "z")}
    assert {tuple(r) for r in merge.insert_absent(a, b, ["k"]).collect()} == {(1, "x"), (2, "y"), (3, "z")}
    c = spark.createDataFrame([(2, "y"), (4, None), (4, None)], "k int, v string")
    assert merge.append_distinct(a, c).count() == 3
    assert merge.append_distinct(merge.append_distinct(a, c), c).count() == 3


def test_snapshots(spark):
    line = '{"date": "2024-01-02", "accounts": [{"account_number": "1", "nlv": 10.0, "positions": [{"symbol": "A", "direction": "Short", "quantity": 2, "mark_price": 3, "cost_basis": 4, "multiplier": 1, "realized_day_pl": null}]}, {"account_number": "2", "nlv": 5.0}]}'
    accounts, positions = portfolio.read_snapshots(spark.createDataFrame([(line,)], "line string"))
    rows = {r["account_number"]: r for r in accounts.collect()}
    assert (rows["1"]["daily_pl"], rows["1"]["position_count"], rows["2"]["position_count"]) == (2.0, 1, 0)
    assert positions.count() == 1
