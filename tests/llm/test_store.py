"""What operators store in between goes with the scope they run in."""

import pytest

from setwise.llm import queries
from setwise.session import Scratch, exists


@pytest.mark.parametrize("name", ["op3_interleave", "op11_group_join", "op13_merkle_manifest"])
def test_a_scope_leaves_nothing_behind(spark, name):
    with Scratch(spark) as scope:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert scope.paths and not any(exists(spark, path) for path in scope.paths)
