import random

from ledgerline.llm.common import components


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(140)]
    edges += [(1000 + k, 1001 + k) for k in range(120)] + [(2000, 2000 + k) for k in range(1, 60)] + [(-5, 7), (5000, 5000)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for few in (0, 100, 10**6):
        found = {r.node: r.component for r in components(df, few).collect()}
        assert found == {x: find(x) for x in linked}
    assert components(df.where("a > 10000")).collect() == []
