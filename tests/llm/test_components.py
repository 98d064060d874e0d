"""Components against a plain search, and the work tables that they take."""

import random

from stocktake.llm.common import Workspace, fewer
from stocktake.llm.graph import components


class Counted(Workspace):
    """Keeps the number of tables written and the partitions of each."""

    def __init__(self, spark):
        super().__init__(spark, "components")
        self.parts = []

    def save(self, df, table, *args, **options):
        self.parts.append(df.rdd.getNumPartitions())
        return super().save(df, table, *args, **options)


def found_in(spark, edges):
    work = Counted(spark)
    rows = components(spark.createDataFrame(edges, "a long, b long"), work, "c").collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}, work


def plain(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {x: top(x) for x in root if top(x) != x}


def test_components_equal_a_plain_search(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(999, i) for i in range(200, 260)]
    loose = [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    edges = [*chain, *hub, *loose, (500, 500), (3, 2), (2, 3), (3, 2)]
    assert found_in(spark, edges)[0] == plain(edges)


def test_stars_around_least_nodes_take_no_round(spark):
    edges = [(i, 10 * (i // 10)) for i in range(200)]
    found, work = found_in(spark, edges)
    assert found == plain(edges) and len(work.parts) == 1
    assert found_in(spark, [(1, 1)])[0] == {}


def test_rounds_end_when_stars_are_made(spark):
    found, work = found_in(spark, [(1, 2), (2, 3)])
    assert found == {2: 1, 3: 1} and len(work.parts) == 2


def test_many_shuffle_partitions_are_written_by_fewer_tasks(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 211)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        assert max(found_in(spark, [(1, 2), (2, 3)])[1].parts) <= 48
        spark.conf.set("spark.sql.shuffle.partitions", 4000)
        assert fewer(spark.range(0, 9000, 1, 4000)).rdd.getNumPartitions() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
