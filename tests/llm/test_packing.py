import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import packing
from tests.llm.helpers import EDGES, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return packing.text_ids(f.read())


def checked(histogram, capacity, least):
    """Padding of the slots, each rest whole and each sequence gapless."""
    table, n = packing.slots(histogram, capacity, least)
    inside, parts = defaultdict(list), defaultdict(list)
    for length, low, high, each, sequence, offset, a, b in table.tolist():
        for rank in range(low, high):
            past, within = divmod(rank - low, each)
            inside[sequence + past].append((offset + within * length, b - a))
            parts[length, rank].append((a, b))
    assert set(inside) == set(range(n))
    for pieces in inside.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= capacity
    assert set(parts) == {(length, rank) for length, count in histogram.items() for rank in range(count)}
    for (length, _), cuts in parts.items():
        end = 0
        for a, b in sorted(cuts):
            assert a == end
            end = b
        assert end == length
    return n * capacity - sum(length * count for length, count in histogram.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 200), max_size=12), st.sampled_from([1, 2, 8]))
def test_slots_hold_every_rest_once(histogram, least):
    checked(histogram, 64, least)


def test_little_padding():
    rng = random.Random(1)
    spread = Counter(rng.randint(1, 1023) for _ in range(3000))
    for histogram in (spread, {600: 5000}, {513: 3000}, {600: 3000, 500: 3000, 7: 3}, {1: 50_000}):
        size = sum(length * count for length, count in histogram.items())
        assert checked(histogram, 1024, 16) < max(0.02 * size, 1024)


def test_patterns_do_not_grow_with_the_rests():
    few = packing.slots({length: 50 for length in range(1, 1024)})[0]
    many = packing.slots({length: 50_000_000 for length in range(1, 1024)})[0]
    assert len(many) < 2 * len(few)


def test_every_token_and_odd_texts_as_the_library(own, library):
    for text in own.vocab.text.values():
        word = text.decode("utf-8", "ignore")
        assert own.encode(word).tolist() == library(word)
    odd = ["a", "B", "é", "日", "😀", " ", "  ", "\n", " ", " ", "'s", "'LL", "1", "٣", "Ⅷ", "!", "<|endoftext|>", "\0", "́", "​", "\x1c"]
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        assert own.encode(text).tolist() == library(text), repr(text)
    for text in (" " * 2_500_000 + "x", "a" * 200_000, "\n" * 90_000 + "b"):
        assert own.encode(text).tolist() == library(text)


def test_every_code_point_as_the_library(own, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        text = "".join(f"a{c}1{c},{c} {c}" for c in points[k : k + 20_000])
        assert own.encode(text).tolist() == library(text)


def verified(found, docs, library, capacity=1024):
    """Pieces against the library; the share of padding."""
    ids = [(i, [*library(t), 0]) for i, t in docs]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, mine in pieces.items():
        wanted = Counter((a, zlib.crc32(np.array(x[a : a + 1], "<u4").tobytes())) for j, x in ids if j == i for a in [0])
        assert sum(r.start == 0 for r in mine) == sum(wanted.values())
        if sum(j == i for j, _ in ids) > 1:
            assert Counter(r.doc_tokens for r in mine if r.start == 0) == Counter(len(x) for j, x in ids if j == i)
            continue
        own, end = next(x for j, x in ids if j == i), 0
        for r in sorted(mine, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (end, len(own))
            end += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : end], "<u4").tobytes())
        assert end == len(own)
    for mine in sequences.values():
        end = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    total = sum(len(x) for _, x in ids)
    assert total == sum(r.length for r in found)
    return 1 - total / (capacity * len(sequences))


def test_edges(spark, library):
    docs = [r[:2] for r in EDGES]
    found = packing.packed(table(spark, EDGES, clash=True).repartition(3), PATH).collect()
    verified(found, docs, library)


def test_hot_length_and_sequences(spark, library):
    """Most rests have one length, so documents are cut to fill the gaps."""
    hot = " ".join(["word"] * 600)
    docs = [(k, hot if k % 3 else f"{k} " * (k % 50)) for k in range(900)]
    found = packing.packed(table(spark, docs).repartition(7), PATH, with_ids=True)
    pieces = found.collect()
    assert verified(pieces, docs, library) < 0.02
    assert any(r.start and r.start % 1024 for r in pieces)
    whole = {r.doc_id: bytearray(4 * r.doc_tokens) for r in pieces}
    filled = packing.sequences(found).collect()
    assert {r.sequence_id for r in filled} == {r.sequence_id for r in pieces}
    by_place = {(r.sequence_id, r.offset): r for r in pieces}
    for s in filled:
        assert len(s.ids) == 1024 or (len(s.ids) == s.used and s.used & (s.used - 1) == 0)
        assert not any(s.ids[s.used :])
        for doc, a, b in zip(s.doc_ids, s.starts, [*s.starts[1:], s.used], strict=True):
            piece = by_place[s.sequence_id, a]
            assert piece.doc_id == doc and piece.length == b - a
            whole[doc][4 * piece.start : 4 * (piece.start + piece.length)] = np.array(s.ids[a:b], "<u4").tobytes()
    for i, text in docs:
        assert np.frombuffer(whole[i], "<u4").tolist() == [*library(text), 0]


def test_empty_table(spark):
    assert packing.packed(table(spark, []), PATH).isEmpty()
