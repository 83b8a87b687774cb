from __future__ import annotations

import pytest

from fjordline.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)
