"""Queries that were once registered over id ranges and prefixes read whole tables."""

import pytest

from sparkveil.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ("full_join", "union_all", "union_distinct", "intersect", "intersect_all", "except", "except_all", "unnest_cross", "unnest_left_ordinality")


@pytest.mark.parametrize("name", NAMES)
def test_whole_form_is_registered_with_its_sql(name):
    assert f"{name}_whole" in catalog.queries() and f"{name}_whole" in catalog.oracle_sql()


def test_whole_forms_read_whole_tables(spark):
    def table(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    def made(name):
        return catalog.queries()[f"{name}_whole"](spark, SF)

    sizes = table("embeddings").selectExpr("sum(size(embedding)) AS cross", "sum(CASE WHEN label > 5 THEN size(embedding) ELSE 1 END) AS outer").first()
    assert made("unnest_cross").count() == sizes["cross"] and made("unnest_left_ordinality").count() == sizes["outer"]
    assert made("union_all").count() == table("customer").count() + table("supplier").count()
    join = made("full_join")
    assert join.where("s IS NOT NULL").count() == table("supplier").count() and join.where("c IS NOT NULL").count() == table("customer").count()
