"""Components and shared storage."""

from __future__ import annotations

import random

import pytest

from sparkindex.llm.common import components, discard, materialize


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops", "none"])
def test_components(spark, shape):
    draw = random.Random(3)
    if shape == "chain":
        edges = [(k, k + 1) for k in range(300)]
        draw.shuffle(edges)
    elif shape == "star":
        edges = [(500, k) for k in range(300)]
    elif shape == "random":
        edges = [(draw.randrange(400) - 200, draw.randrange(400) - 200) for _ in range(250)]
    else:
        edges = [(k, k) for k in range(5)] if shape == "loops" else []
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_materialized_tables_can_be_discarded(spark):
    table = materialize(spark.range(5), "five")
    assert table.count() == 5
    discard(table)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*table.inputFiles()).count()
