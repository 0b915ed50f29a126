import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import exact_dedup
from ledgerline.llm.common import SPACE_BYTES
from tests.llm.helpers import EDGES, table


def body(text):
    return (text or "").encode().translate(None, SPACE_BYTES)


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(body(text), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text, *_ in rows:
        first = min(groups[body(text)])
        keep = None if first[1] else first[2]
        out.append((doc_id, keep, len(groups[body(text)]), doc_id == keep))
    return sorted(out, key=str)


def test_edges(spark):
    rows = [*EDGES, (30, " one\n"), (31, "one  "), (32, "on e"), (33, "two"), (33, "t wo")]
    found = exact_dedup.exact_groups(table(spark, rows, clash=True)).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute(rows)
    docs = table(spark, rows, clash=True)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    bodies = [body(r.text) for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({body(r[1]) for r in rows})


def test_repeated_rows_leave_one(spark):
    kept = exact_dedup.deduplicated(table(spark, [(5, "a b"), (5, "a b"), (5, "ab"), (6, "ab")])).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(5, "a b")]
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []
    assert exact_dedup.deduplicated(table(spark, [])).collect() == []


def test_many_copies_over_many_partitions(spark):
    rows = [(i, "same text" if i % 3 else f"text {i % 7}") for i in range(900)]
    found = exact_dedup.exact_groups(table(spark, rows).repartition(13)).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab"), max_size=12), st.integers(0, 9)), max_size=40), st.integers(1, 3000))
def test_trie_with_spilled_subtrees(pairs, limit):
    trie, wanted = exact_dedup.Trie(limit), {}
    for text, i in pairs:
        owner = (len(text), i, 1, 1)
        trie.insert(text.encode(), owner)
        key = text.encode()
        wanted[key] = exact_dedup.better(wanted[key], owner) if key in wanted else owner
    assert dict(trie.owners()) == wanted


def test_trie_of_long_texts():
    random.seed(4)
    base = bytes(random.randrange(256) for _ in range(5000))
    texts = [base[:k] + bytes([k % 256]) * 3000 for k in range(0, 5000, 97)] * 2 + [base, base[:2500]]
    trie = exact_dedup.Trie(60_000)
    for k, t in enumerate(texts):
        trie.insert(t, (len(t), k, 1, 1))
    found = dict(trie.owners())
    assert set(found) == set(texts)
    assert all(found[t][1] == texts.index(t) for t in texts)
