import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import mixing
from tests.llm.helpers import EDGES, table


def targets(sizes):
    """The rule by hand: (source, size) in order, weights 1, 2, 3, ..."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sizes)}
    left, found = sum(sizes.values()), {}
    open_ = dict(sizes)
    while True:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total >= 3 * sizes[s]]
        if not above:
            return found | {s: left * weight[s] / total for s in open_}
        for s in above:
            found[s] = 3 * sizes[s]
            del open_[s]
        left = sum(sizes.values()) - sum(found.values())
        if not open_:
            return found


def test_edges(spark):
    found = mixing.mixed(table(spark, EDGES, clash=True))
    names = found.columns[-5:]
    assert names == ["_size", "source_size", "_target", "_copies", "taken"]
    rows = found.collect()
    assert len(rows) == len(EDGES)
    sizes = {}
    for source in ("a", "b", None):
        sizes[source] = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, s in EDGES if s == source)
    wanted = targets(sizes)
    for r in rows:
        assert r["_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r["source_size"] == sizes[r.source]
        assert r["_target"] == pytest.approx(wanted[r.source])
        assert 0 <= r["taken"] <= 3 * r["_size"]
    again = mixing.mixed(table(spark, EDGES, clash=True)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty(spark):
    assert mixing.mixed(table(spark, [])).collect() == []
    assert mixing.emitted(table(spark, [])).collect() == []
    (row,) = mixing.mixed(table(spark, [(1, None)])).collect()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


def test_words_taken_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    for r in rows:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1.5 * r["max(size)"]
    mix = mixing.emitted(docs)
    assert mix.columns == docs.columns
    assert mix.count() == mixing.mixed(docs).agg({"copies": "sum"}).first()[0]


def test_one_hot_source_and_stopped_sources(spark):
    rows = [(i, "w " * 50, None, "big") for i in range(200)] + [(1000 + i, "w", None, f"s{i}") for i in range(5)]
    found = mixing.mixed(table(spark, rows)).collect()
    assert {r.target for r in found if r.source != "big"} == {3.0}
    assert all(r.taken == 3 for r in found if r.source != "big")
    assert sum(r.taken for r in found) == pytest.approx(10_005, abs=50)


def test_sources_in_order_however_alike_their_names(spark):
    names = [f"www.host{k:03}.org" for k in range(100)] + ["", "a", None]
    sizes = spark.createDataFrame([(str(n), n, 5) for n in names], "key string, source string, source_size long")
    found = {r.key: r.weight for r in mixing.ranked_weights(sizes).collect()}
    ordered = sorted((n for n in names if n is not None)) + [None]
    assert found == {str(n): k % 3 + 1 for k, n in enumerate(ordered)}


def test_rows_without_an_id_are_spread(spark):
    docs = table(spark, [(None, f"word {k}", None, "a") for k in range(2000)])
    cells = docs.select(F.substring(F.md5(F.concat_ws(":", F.lit("7"), F.md5("text"))), 1, 2)).distinct().count()
    assert cells > 200
    plan = mixing.mixed(docs).agg(F.count("*"), F.sum("taken"), F.max("target")).first()
    assert plan[0] == 2000 and abs(plan[1] - plan[2]) <= 2
