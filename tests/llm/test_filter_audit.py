import re
from itertools import permutations

import numpy as np
import pytest

from ledgerline.llm import filter_audit as fa
from tests.llm.helpers import EDGES, table

SPACES = r"[^\x20\x09-\x0D]+"


def fails(text):
    """The filters of a text alone, by their wording."""
    words = re.findall(SPACES, text)
    return {
        f
        for f, failed in {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
        }.items()
        if failed
    }


def by_hand(docs, labels, filters="ABCDE"):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = []
    for i, text, source in docs:
        failed = fails(text or "")
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs):
            failed.add("E")
        good = any(j == i and q == 1 for j, q, _ in labels) and i is not None
        toxic = any(j == i and x == 1 for j, _, x in labels) and i is not None
        rows.append((source or "", failed, good, toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        orders, total = [], dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] for r in mine) - len(gone) - sum(f in r[1] for r in left)
                unique = sum(r[1] == {f} for r in mine)
                orders.append((order, step, f, len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, "".join(o), s, k, g, r, u, gl, tl, total[f]) for o, s, f, k, g, r, u, gl, tl in orders]
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(250))
CASES = [
    (1, LONG, "a"),
    (2, LONG, "b"),
    (2, LONG, "b"),
    (3, LONG, "a"),
    (4, "short # text", "a"),
    (4, "short # text", None),
    (5, None, ""),
    (6, "", "a"),
    (7, "same word " * 300, "b"),
    (8, "LOUD " + LONG, "b"),
    (9, "É" * 300 + " " + LONG, "b"),
    (10, LONG + " |", None),
    (None, LONG, "a"),
    (None, LONG, "a"),
    (None, "x", None),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (4, None, 1), (7, 0, 0), (None, 1, 1), (99, 1, 1)]


def test_equals_the_rule_by_hand(spark, rows):
    docs = table(spark, [(i, t, None, s) for i, t, s in CASES], clash=True)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = fa.interaction_audit(fa.with_labels(fa.failures(docs), labels))
    assert rows(found) == sorted(by_hand(CASES, LABELS), key=str)
    assert found.count() == 600 * len({s or "" for _, _, s in CASES})


def test_texts_of_the_edge_table(spark):
    for i, t, *_ in EDGES:
        mask = fa.text_mask((t or "").encode())
        assert {f for k, f in enumerate("ABCD") if mask >> k & 1} == fails(t or ""), i


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.interaction_audit(fa.with_labels(fa.failures(table(spark, [])), labels)).isEmpty()


def test_hot_text_and_no_labels(spark):
    """A third of all rows is one text, some of them under one id."""
    docs = [(k if k % 3 else 7, LONG if k % 3 == 0 or k < 500 else f"{LONG} {k}", "a") for k in range(1, 1200)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    failed = fa.failures(table(spark, [(i, t, None, s) for i, t, s in docs]))
    first = min(i for i, t, _ in docs if t == LONG)
    assert failed.where("mask >= 16").groupBy().sum("n").first()[0] == sum(i > first and t == LONG for i, t, _ in docs)
    kept = fa.interaction_audit(fa.with_labels(failed, labels)).where("step = 5").select("kept").distinct().collect()
    assert [k[0] for k in kept] == [sum(not fails(t) and (i == first or t != LONG) for i, t, _ in docs)]


def test_min_plus_product():
    p = fa.products("XYZ")
    assert p.orders == ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX")
    for mask in range(8):
        for o, order in enumerate(p.orders):
            steps = [s for s, f in enumerate(order) if mask >> "XYZ".index(f) & 1]
            assert p.removed_at[mask, o] == min(steps, default=3)
    weights = np.random.default_rng(1).integers(0, 50, (4, 8))
    assert (fa.scattered(weights, p).sum(axis=2) == weights[:, 1:].sum(axis=1)[:, None]).all()
    with pytest.raises(ValueError):
        fa.products("ABCDEFGH")
    with pytest.raises(ValueError):
        fa.products("AA")


def test_general_filters(spark):
    """Any bit mask serves, not only that of the five filters."""
    failed = spark.createDataFrame(
        [("p", 0, 5, 1, 0), ("p", 1, 2, 2, 0), ("p", 3, 4, 0, 4), ("q", 2, 1, 0, 0)],
        "part string, mask int, n long, good long, toxic long",
    )
    found = {tuple(r)[:3]: tuple(r)[3:] for r in fa.interaction_audit(failed, "XY").collect()}
    assert found["p", "XY", 1] == (5, 6, 0, 2, 2, 4, 6 + 2)
    assert found["p", "XY", 2] == (5, 0, 4, 0, 0, 0, 0 + 4)
    assert found["p", "YX", 1] == (7, 4, 0, 0, 0, 4, 4)
    assert found["q", "YX", 2] == (0, 0, 0, 0, 0, 0, 0)


