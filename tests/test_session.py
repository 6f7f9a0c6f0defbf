"""Stored intermediate tables and their owner."""

import os

from traceaudit.session import checkpoint_root, materialise, stored_tables


def test_stored_tables_go_with_their_owner(spark):
    root = checkpoint_root(spark).removeprefix("file:")
    with stored_tables(spark):
        held = materialise(spark.range(5))
        path = held.inputFiles()[0].removeprefix("file://")
        assert path.startswith(root) and os.path.exists(path)
        assert held.count() == 5
    assert not os.path.exists(path)
    kept = materialise(spark.range(3))
    assert kept.count() == 3
