from collections import Counter

from ledgerline.llm import licenses
from tests.llm.helpers import EDGES, table


def dice(one, two):
    a, b = Counter(zip(one, one[1:], strict=False)), Counter(zip(two, two[1:], strict=False))
    return 2 * (a & b).total() / (a.total() + b.total())


def test_notices_are_found_at_their_place(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no cost").replace("merge, ", "")
    rows = [
        (1, "before it all " + mit + " and after"),
        (2, changed),
        (3, "Released under the MIT License. Some words. RELEASED under the\nMIT license!"),
        (4, "Released by the other License"),
        *[(k + 100, *r[1:]) for k, r in enumerate(EDGES)],
    ]
    found = licenses.license_matches(table(spark, rows, clash=True)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 3}
    assert [(r.license, r.dice) for r in by[1]] == [("MIT", 1.0)]
    assert by[1][0].first_word == 3
    (near,) = by[2]
    assert near.license == "MIT" and 0.9 < near.dice < 1
    assert [(r.license, r.first_word, r.end_word) for r in by[3]] == [("MIT statement", 0, 5), ("MIT statement", 7, 12)]
    assert licenses.license_matches(table(spark, [])).collect() == []


def test_every_stretch_above_the_threshold_is_found():
    """Against all stretches of a text, compared without bounds."""
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    text = (
        "the work is licensed under the gnu general public license version 3 of it and "
        "licensed under cc by nc 4 0 then licensed under the old apache license version 2 0 ends"
    )
    words = licenses.WORDS.findall(text)
    found = scanner.scan(text)
    for t in scanner.templates:
        own = licenses.WORDS.findall(licenses.TEMPLATES[t.name].lower())
        best = max(dice(words[i:j], own) for i in range(len(words)) for j in range(i + 2, len(words) + 1))
        mine = [d for name, _, _, d in found if name == t.name]
        assert bool(mine) == (best >= 0.8)
        if mine:
            assert max(mine) == best
    for name, a, b, d in found:
        assert d == dice(words[a:b], licenses.WORDS.findall(licenses.TEMPLATES[name].lower()))
