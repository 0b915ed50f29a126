"""Quoted CSV files in splits: the same rows as from one task a file."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.sources import csv_files, csv_splits
from ledgerline.sources.csv_splits import FIELD, MAYBE, PLAIN, QUOTED, STATES


def by_hand(data: bytes, delimiter: bytes, state: int):
    """The state after all bytes and the places after line feeds that end records, byte by byte."""
    ends = []
    for k in range(len(data)):
        c = data[k : k + 1]
        if state == QUOTED:
            state = MAYBE if c == b'"' else QUOTED
        elif state == MAYBE and c == b'"':
            state = QUOTED
        elif c == b'"':
            state = QUOTED if state == FIELD else PLAIN
        elif c in (delimiter, b"\n"):
            state = FIELD
            if c == b"\n":
                ends.append(k + 1)
        else:
            state = PLAIN
    return state, ends


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a,;"\n\r', max_size=40).map(str.encode), st.sampled_from(STATES), st.lists(st.integers(0, 40)), st.sampled_from(",;"))
def test_scanner_in_any_chunks(data, state, cuts, delimiter):
    cuts = sorted({min(c, len(data)) for c in cuts} | {0, len(data)})
    scanner, ends = csv_splits.Scanner(delimiter, state), []
    for a, b in zip(cuts, cuts[1:]):
        ends += [a + e for e in scanner.ends(data[a:b])]
    assert (scanner.state, ends) == by_hand(data, delimiter.encode(), state)


def text_of(rng: random.Random) -> str:
    """A CSV text with quotes, line feeds in quotes, short, long and blank records."""
    cells = ["x", "", " ", "é", '"q"', '"a,b"', '"l1\nl2"', '"he said ""no"""', '5" pipe', "12", '"', '"\n\n"', '""']
    lines = ["A,B,C"]
    for _ in range(rng.randint(0, 25)):
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "   ", ","]))
            continue
        row = [rng.choice(cells[:-3] if rng.random() < 0.98 else cells) for _ in range(rng.choice([3, 3, 3, 3, 2, 4, 1]))]
        lines.append(",".join(row))
    return "\n".join(lines) + rng.choice(["", "\n", "\n\n"])


def sound(text: str) -> bool:
    """No quotes that end in the middle of a field, which readers take as they like."""
    state, field_ended = FIELD, True
    for c in text:
        if state == MAYBE and c not in '",\n':
            return False
        state = by_hand(c.encode(), b",", state)[0]
    return state not in (QUOTED,)


def test_splits_give_the_rows_of_whole_files(spark, tmp_path):
    rng, paths = random.Random(3), []
    while len(paths) < 150:
        text = text_of(rng)
        if sound(text):
            path = tmp_path / f"f{len(paths):03}.csv"
            path.write_bytes(text.encode())
            paths.append(str(path))
    headers = ["A", "B", "C"]
    whole = csv_files.read_values(spark, paths, headers).collect()
    for split in (7, 64):
        cut = csv_files.read_values(spark, paths, headers, split_bytes=split).collect()
        for path in paths:
            mine = sorted(str(r["values"]) for r in cut if r.file == path)
            with open(path, encoding="utf-8") as f:
                assert mine == sorted(str(r["values"]) for r in whole if r.file == path), (split, f.read())


def test_a_file_is_read_by_as_many_tasks_as_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    with open(path, "w") as f:
        f.write("k,text\n")
        for k in range(20_000):
            f.write(f'{k},"line {k}\nand ""more"", of it"\n')
    files = spark.createDataFrame([(str(path), ",", path.stat().st_size)], "path string, delimiter string, bytes long")
    ranges = csv_splits.record_ranges(files, 64 << 10).collect()
    assert len(ranges) == -(-path.stat().st_size // (64 << 10))
    assert max(r.end - r.start for r in ranges) < 65 << 10
    rows = csv_files.read_text_columns(spark, str(path), ["k", "text"], split_bytes=64 << 10)
    assert sorted((int(r.k), r.text) for r in rows.collect()) == [(k, f'line {k}\nand "more", of it') for k in range(20_000)]
