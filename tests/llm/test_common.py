"""Components, prefix sums and cut tables."""

import random

from pyspark.sql import functions as F
from seriesmill.llm.common import connected_components, cut_table, n_buckets, two_level_offsets


def plain(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_components_of_paths_stars_and_random_graphs(spark):
    rnd = random.Random(1)
    path = list(range(0, 120))
    rnd.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, 1000 + k) for k in range(1, 60)] + [(rnd.randrange(2000, 2080), rnd.randrange(2000, 2080)) for _ in range(60)] + [(-5, 7), (5000, 5001), (5000, 5001)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_offsets_and_tables(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("b"))
    got = {(r.k, r.b): r.before for r in two_level_offsets(df, ["k"], "b", F.lit(1)).collect()}
    rows = [(i % 3, i % 7) for i in range(1000)]
    assert got == {(k, b): sum(x == k and y < b for x, y in rows) for k, b in set(rows)}
    assert cut_table(df).count() == 1000 and cut_table(df.limit(0)).count() == 0
    assert n_buckets(10) == 16 and n_buckets(10_000_000) == 200
