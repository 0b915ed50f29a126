import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import runs
from ledgerline.llm.queries import repeating_part
from tests.llm.helpers import EDGES, table


def by_hand(words, shortest=6, times=4):
    """Runs by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


word = st.sampled_from([b"a", b"b", b"c"])
stretch = st.tuples(st.lists(word, min_size=1, max_size=5), st.integers(1, 30)).map(lambda x: (x[0] * x[1])[: x[1]])
document = st.lists(st.one_of(st.lists(word, max_size=8), stretch), max_size=5).map(lambda x: sum(x, []))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(document, document.map(lambda d: d * 4)), max_size=4), st.sampled_from([(6, 4), (6, 3), (4, 3), (11, 5)]))
def test_equals_brute_force(documents, limits):
    assert runs.runs_of(documents, *limits) == [by_hand(d, *limits) for d in documents]


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        runs.runs_of([[b"a"]], 6, 2)


def test_long_documents():
    assert runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    words = ([b"a", b"b", b"c"] * 100 + [b"x"]) * 60
    assert runs.runs_of([words])[0] == sorted([(0, 301 * 60, 301)] + [(301 * k, 300, 3) for k in range(60)])


def expected(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = by_hand(words)
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return (
        i,
        len(found),
        *(best[0] if best else (None,) * 3),
        1000 * best[0][1] // best[0][2] if best else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest(),
    )


def test_report_equals_brute_force(spark, rows):
    rng = random.Random(5)
    docs = [r for r in EDGES if len(r[1] or "") < 1000]
    for i in range(100, 400):
        docs.append((i, " ".join(rng.choice(["x", "y", "Zé", "w"]) for _ in range(rng.randint(0, 90)))))
    docs += [(500, "go on " * 40 + "and on " * 7), (501, "a a a a a a a b a b a b a b a b a b")]
    found = runs.run_report(table(spark, docs, clash=True), rewrite=repeating_part)
    assert rows(found) == sorted((expected(*r[:2]) for r in docs), key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in docs) > 20


def test_very_long_texts(spark):
    report = runs.run_report(table(spark, EDGES)).where("doc_id IN (7, 8)").orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in report] == [(1, 0, 60_000, 1, 60_000_000), (0, None, None, None, None)]
    assert report[0]["collapsed_sha256"] == hashlib.sha256(b"word").hexdigest()


def test_runs_and_texts(spark, rows):
    docs = table(spark, [(1, "x  la la la la la la y"), (2, " as\tis "), (3, None), (None, "o o o o o o p p p p p p p")])
    assert rows(runs.repetitions(docs)) == sorted([(1, 1, 6, 1), (None, 0, 6, 1), (None, 6, 7, 1)], key=str)
    assert rows(runs.collapsed(docs)) == sorted([(1, "x la y"), (2, " as\tis "), (3, None), (None, "o p")], key=str)


def test_empty_table(spark):
    assert runs.run_report(table(spark, [])).isEmpty()
    assert runs.repetitions(table(spark, [])).isEmpty()
