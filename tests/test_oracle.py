"""Every registered query against its SQL twin on the small test tables."""

from __future__ import annotations

import pytest

from asset_atlas.driver import registry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    result = compare(spark, SF, con, registry.QUERIES[name], registry.ORACLES.get(name))
    assert result["ok"], result


#: rounds and unions that small tables settle at once
AT_TEN_TIMES = ["color_clusters", "drift_in_changed_files", "phash_clusters", "size_clusters", "semantic_bucket", "index_run"]


@pytest.mark.parametrize("name", AT_TEN_TIMES)
def test_query_matches_sql_on_more_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    result = compare(spark, sf, connect(sf), registry.QUERIES[name], registry.ORACLES[name])
    assert result["ok"] and result["rows"] > 0, result


def test_every_query_has_a_twin():
    assert set(registry.ORACLES) == set(registry.QUERIES)
