"""Every query with SQL equals DuckDB on the smallest tables; the others run and keep their invariants."""

import pytest
from conftest import SF
from oracle import by_sql, differences

from offerloom.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), by_sql(SF, ORACLES[name])) == ""


def test_grouping_has_one_offer_per_merchant(spark):
    rows = QUERIES["greedy_grouping"](spark, SF).toPandas()
    assert rows.seq.is_unique
    assert not rows.assign(m=rows.seq // 1_000_000).duplicated(["group_id", "m"]).any()
    assert rows.group_id.isin(rows.seq).all()


def test_scored_and_routed(spark):
    scored = QUERIES["scored_match"](spark, SF).toPandas()
    assert scored.offer_id.is_unique and scored.score.between(0, 1).all()
    assert set(scored.decision) <= {"auto_match", "review", "no_match"}
    routes = QUERIES["match_routes"](spark, SF).toPandas()
    assert routes.offer_id.is_unique and set(routes.action) <= {"reuse", "review", "new"}
    assert (routes.product_id.isna() == (routes.action == "new")).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
