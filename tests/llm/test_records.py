import random
import zlib
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import records
from tests.llm.helpers import EDGES, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_checksum():
    assert records.crc32c(b"123456789") == 0xE3069283
    plain = lambda d: reduce(lambda c, b: records._LISTS[0][(c ^ b) & 255] ^ c >> 8, d, 0xFFFFFFFF) ^ 0xFFFFFFFF
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 128, 1000):
        data = rng.bytes(n)
        assert records.crc32c(data) == plain(data)


def test_files_and_index(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    docs = table(spark, EDGES, clash=True)
    data, index = str(tmp_path / "data"), str(tmp_path / "index")
    records.write_records(docs, data, PATH, shards=3, records_per_file=2)
    places = records.write_index(spark, data, index)
    found = records.record_digests(places).collect()
    start, wanted = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in EDGES), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == wanted
    some = places.where("doc_id IN (7, 10)")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.fetch(spark, data, some).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, *_ in EDGES if i in (7, 10)}


def test_files_follow_each_other_whatever_the_id_of_the_job(spark):
    for job in ("0a1b2c3d-0000-4000-8000-00000000000f", "0a1b2c3d-c123-4000-8000-c23400000000"):
        names = [f"part-{r:05d}-{job}-c{c:03d}.txt" for r in (0, 1) for c in (0, 1, 2)]
        rows = [(name, n) for n, name in enumerate(names, 1)]
        index = spark.createDataFrame(rows[::-1], "file string, n_ids long")
        found = {r.file: r.file_start for r in records.file_starts(index).collect()}
        assert [found[name] for name in names] == [0, 1, 3, 6, 10, 15], job


def test_a_damaged_file_is_noticed():
    good = records.framed(7, np.array([1, 70000], np.uint32)) + b"\n" + records.framed(None, np.array([], np.uint32)) + b"\n"
    read = [(a, n, i, ids.tolist()) for a, n, i, ids in records.unframed(memoryview(good))]
    assert [(r[2], r[3]) for r in read] == [(7, [1, 70000]), (None, [])]
    assert read[1][0] == read[0][1] and sum(read[-1][:2]) == len(good)
    for spot in (0, 9, 20, 30):
        bad = bytearray(good)
        bad[spot] ^= 1
        with pytest.raises((ValueError, MemoryError)):
            list(records.unframed(memoryview(bytes(bad))))


def test_empty_table(spark, tmp_path):
    data = str(tmp_path / "data")
    records.write_records(table(spark, []), data, PATH, shards=2)
    places = records.write_index(spark, data, str(tmp_path / "index"))
    assert records.record_digests(places).collect() == []


def test_words_are_encoded_as_whole_texts_are():
    library = Tokenizer.from_file(PATH)
    encoder = records.WordEncoder(open(PATH, encoding="utf-8").read())
    texts = ["A  B\n\tc", "<|ENDOFTEXT|> X", "<|endoftext|>x y", "ΣΑΣ İ ﬁ", "é É", "a b　c x\x1cy", "Don't!!, ok."]
    for text in texts:
        assert encoder.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_letters_that_compose_in_upper_case_only():
    with open(PATH, encoding="utf-8") as f:
        model = f.read()
    library = Tokenizer.from_str(model)
    for pair in ("H\u0331", "J\u030c", "T\u0308", "T\u0344", "W\u030a", "Y\u030a"):
        text = f"One {pair} and X{pair}Y"
        wanted = library.encode(text, add_special_tokens=False).ids
        assert records.WordEncoder(model).encode(text).tolist()[:-1] == wanted, pair


def test_texts_of_the_first_code_points_are_encoded_as_the_library_does():
    with open(PATH, encoding="utf-8") as f:
        model = f.read()
    library, encoder = Tokenizer.from_str(model), records.WordEncoder(model)
    rng = random.Random(4)
    points = [chr(c) for c in range(256)]
    likely = list("aabcdeinorstxyzABÀÉéèñß0123'''  \n.,-<|>") + ["'s", "'LL", "'re", " don't", "ing", "tion", "the "]
    texts = ["".join(f"a{c}b {c}{c} 1{c}'{c}" for c in points), "", " ", "'", "'s", "''s's'tis 'Twas we'll", "a" * 50_000, "<|x"]
    texts += ["".join(rng.choice(points if k % 5 == 0 else likely) for _ in range(rng.randint(0, 60))) for k in range(6000)]
    for text, found in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text).tolist() == [*found.ids, records.END_ID], repr(text)


def test_files_are_summed_in_the_order_of_their_numbers(spark):
    names = ["part-00007-x-c000.txt", "part-00007-x-c002.txt", "part-00007-x-c1000.txt", "part-99999-x-c000.txt", "part-100000-x-c000.txt"]
    index = spark.createDataFrame([(n, 0, 10 + k) for k, n in enumerate(names)], "file string, offset long, n_ids long")
    found = {r.file: r.file_start for r in records.file_starts(index).collect()}
    assert [found[n] for n in names] == [0, 10, 21, 33, 46]


def test_rows_without_an_id_lie_in_several_ranges(spark, tmp_path):
    docs = table(spark, [(None, f"text {k}") for k in range(400)])
    records.write_records(docs, str(tmp_path / "data"), PATH, shards=4)
    files = records.read_records(spark, str(tmp_path / "data")).groupBy("file").count().collect()
    assert sum(r["count"] for r in files) == 400 and max(r["count"] for r in files) < 250
