"""What the plans must and must not hold."""

import pytest

from marlstone.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["win16_regime", "win08_trades", "win12_sector_cap", "agg01_composite", "win10_positions", "jn13_lot_matches", "jn05_reconcile", "agg17_phrase_bonus", "agg05_evaluation"])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text and "Cartesian" not in text


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(spark, "flt15_trade_fills")
    assert "ReadSchema" in text and "props" in text
    text = plan(spark, "mth01_daily_rate")
    assert "n_name" not in text


def test_lots_need_no_join_of_fills(spark):
    assert "Join" not in plan(spark, "jn13_lot_matches")


def test_ranks_per_group_are_cut_early(spark):
    assert "WindowGroupLimit" in plan(spark, "top05_newest_per_account")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_window_takes_the_whole_table(spark, name):
    lines = plan(spark, name).splitlines()
    for i, line in enumerate(lines):
        if " Window [" in line:
            assert "SinglePartition" not in next((x for x in lines[i:] if "Exchange" in x), ""), line
            assert "windowspecdefinition(0," not in line, line


def test_every_query_with_sql_names_its_columns(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in catalog.ORACLE_SQL.items():
        assert con.execute("describe " + sql).fetchall(), name
