import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import jaccard_join as J
from tests.llm.helpers import EDGES, table


def grams(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [grams(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    out = []
    for k, r in enumerate(rows):
        ids = [x[0] for i, x in enumerate(rows) if find(i) == find(k) and x[0] is not None] if sets[k] else [r[0]]
        out.append((r[0], len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in J.near_groups(table(spark, rows, **options)).collect()), key=str)


def test_edges(spark):
    rows = [*EDGES, (40, "ONE"), (41, "one two three four five SIX"), (42, "é " * 9), (43, "É " * 9)]
    assert found(spark, rows, clash=True) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_near_copies_of_all_sizes(spark):
    random.seed(5)
    rows, ids = [], iter(range(10_000))
    passage = [f"p{k}" for k in range(60)]
    for size in [4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 20, 24, 25, 30, 45, 60, 90, 130, 200, 450]:
        for _ in range(4):
            base = [f"w{random.randrange(3000)}" for _ in range(size)]
            if size >= 90:
                base[10:70] = passage  # shared by texts that are not alike
            rows.append((next(ids), " ".join(base)))
            for _ in range(5):
                copy = list(base)
                for _ in range(random.randrange(1 + size // 25)):
                    copy[random.randrange(len(copy))] = f"x{random.randrange(100)}"
                if random.random() < 0.5:
                    copy = copy[: max(1, int(len(copy) * random.uniform(0.78, 1)))]
                if random.random() < 0.3:
                    copy += [f"y{k}" for k in range(random.randrange(1 + size // 8))]
                rows.append((next(ids), " ".join(copy)))
    random.shuffle(rows)
    wanted = brute(rows)
    assert found(spark, rows) == wanted
    assert len({r[2] for r in wanted}) < len(rows) - 100


def test_a_large_group_of_near_copies_in_a_chain(spark):
    random.seed(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(250):
        if k % 5 == 0:  # the base drifts, so first and last are far apart
            base[random.randrange(120)] = f"z{k}"
        copy = list(base)
        copy[random.randrange(120)] = f"c{k}"
        rows.append((k, " ".join(copy)))
    assert found(spark, rows) == brute(rows)


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(3, text), (3, text), (2, text + " end"), (1, "other words that stand alone here"), (None, text), (8, None)]
    docs = table(spark, rows, clash=True)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 8]


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(80)) for x in "abcde")
    rows = [(None, a), (None, a + " end"), (None, b), (None, c), (4, c)]  # c stays as 4
    rows += [(5, d), (5, e), (1, e + " end"), (6, d + " end"), (6, "six of its own"), (6, "six of another")]
    rows += [(None, None), (None, " "), (6, ""), (6, ""), (7, None)]
    kept = J.one_of_each(table(spark, rows, clash=True))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len([x for x in got if x in [(None, a), (None, a + " end")]]) == 1
    wanted = [(None, b), (4, c), (5, d), (1, e + " end"), (6, "six of its own"), (6, "six of another")]
    wanted += [(None, None), (None, " "), (6, ""), (6, ""), (7, None)]
    assert sorted((x for x in got if x[1] not in (a, a + " end")), key=str) == sorted(wanted, key=str)


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 400), st.integers(0, 2**32 - 1), st.floats(0, 1))
def test_linked_sets_share_entries_after_both_orders(size, seed, share):
    """For any costs, two linked sets share an entry that neither drops."""
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    keep = one[rng.random(len(one)) < 1 - 0.12 * share]
    two = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(0.1 * share * size)).astype(np.uint64)]))
    if not len(two) or not J.linked(one, two) or len(two) == len(one) and (one == two).all():
        return

    def left(found):
        mine = set()
        for some, spare in J.entries(found):
            mine |= set(sorted(map(int, some), key=lambda e: (-(e % 97), e))[spare:])
        return mine

    assert left(one) & left(two)


def test_hashes():
    text = b"The quick\tbrown\x0bfox  jumps over\nthe lazy dog " * 50
    assert len(J.shingles(text)) == len(grams(text.decode()))
    long = b"word%d " * 10
    many = b" ".join(b"w%d" % k for k in range(300_000))
    assert len(J.word_hashes(many)) == 300_000
    assert len(np.unique(J.word_hashes(many))) == 300_000
    assert len(J.shingles(long)) == len(grams(long.decode()))
    assert (J.word_hashes(b"a bb ccc") == J.word_hashes(b"  A\nBB ccc ")).all()
