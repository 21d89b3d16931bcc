"""Every query of the library against its oracle, and rows for those that SQL can't express."""

import pytest

from tallyglass import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(str, map(tuple, df.select(*columns).collect())))
    if name not in catalogue.oracle_sql():
        assert len(got) > 0
        return
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    ref = sorted(map(str, duck.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({catalogue.oracle_sql()[name]})").fetchall()))
    assert got == ref


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_accounts_are_flattened(spark, sf, duck):
    got = catalogue.queries()["flatten_goals_actions_all"](spark, sf).count()
    assert got == duck.sql("select count(*) from lineitem join orders on l_orderkey = o_orderkey").fetchall()[0][0]


def test_numbers_of_all_orders(spark, sf):
    rows = catalogue.queries()["numeric_tokens_all"](spark, sf).collect()
    assert {r.tokens[1] for r in rows} == {-(k + 0.5) for k in {r.o_orderkey % 10 for r in rows}} and len({r.tokens[1] for r in rows}) == 10
