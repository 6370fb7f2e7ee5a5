"""Every query against its DuckDB SQL."""

import pytest
from oracle import same

from tidegate.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLE:
        same(df, registry.ORACLE[name], sf)
    else:
        assert df.count() > 0
