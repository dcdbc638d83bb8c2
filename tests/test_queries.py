import os

import pytest
from oracle import assert_same

import __spark_entry__
from loomkit import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "position", "label", "href"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_subpackage():
    root = os.path.dirname(queries.__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                assert "loomkit.llm" not in open(os.path.join(folder, name)).read()
