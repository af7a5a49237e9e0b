"""Helpers: written tables and when they go."""

import os

import pytest

from tessella.llm import common as C


def test_passing_tables(spark):
    with C.passing() as outer:
        with C.passing() as inner:
            a, b = C.cut(spark.range(3), "a"), inner(C.cut(spark.range(4), "b"))
        assert not os.path.exists(a._written_to) and b.count() == 4
        c = outer(C.cut(spark.range(5), "c"))
    assert not os.path.exists(b._written_to) and c.count() == 5
    with pytest.raises(ZeroDivisionError), C.passing():
        d = C.cut(spark.range(2), "d")
        1 / 0  # noqa: B018
    assert not os.path.exists(d._written_to)
    C.discard(c)
