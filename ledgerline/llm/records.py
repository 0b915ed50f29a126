"""Token ids as files of length-delimited records, with an offset index.

A record is one document: the length of its data (8 bytes), a masked CRC-32C of
those 8 bytes (4), the data, a masked CRC-32C of the data (4), and one line
feed that closes it. The data is the document's id (8), a flag byte that says
whether the id is null, the width of a token id in bytes (1), the number of
token ids (8), and the token ids, 2 bytes each if all of the document are below
65536 and else 4; all numbers are little-endian. A folder has the records in ascending
``doc_id`` order, null first, in the order of the numbers in the file names, and beside it an
index with the place of each record, so that a reader can shuffle documents
and fetch any of them alone.

Spark's own writer makes the files, so a lost executor leaves no half file. A
task writes its range of ids and begins a new file after every
``records_per_file`` records. The index is taken from the finished files.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe import byte_letters
from ledgerline.llm.common import batches

# The reflected Castagnoli polynomial, and the mask of stored checksums.
CASTAGNOLI = 0x82F63B78
MASK_ADDED = 0xA282EAD8

HEAD = struct.Struct("<QI")
DATA = struct.Struct("<qBBQ")
END_ID = 1
# Bytes that a step of a checksum takes.
LANE = 64
# The character of each symbol: itself for a small letter, its capital for one that ends a
# word, and others from 0x100 on. A word is symbols up to one that ends it.
SYMBOLS = np.arange(512, dtype=np.uint16) + 0x100
SYMBOLS[97:123] = np.arange(97, 123)
SYMBOLS[256 + 97 : 256 + 123] = np.arange(65, 91)
SYMBOL_WORD = "[a-z\u0100-\u01ff]*[A-Z\u0200-\u02ff]"
# Bytes of text of a task that writes.
SHARD_BYTES = 128 << 20


def _crc_tables() -> np.ndarray:
    """Table k has the effect of a byte that is followed by k zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    tables = [table]
    for _ in range(1, LANE):
        last = tables[-1]
        tables.append((last >> 8) ^ table[last & 0xFF])
    return np.array(tables)


_TABLES = _crc_tables()
_LISTS = [row.tolist() for row in _TABLES]


def crc32c(data: bytes) -> int:
    """CRC-32C, ``LANE`` bytes a step; the table rows of a step fold in numpy."""
    crc = 0xFFFFFFFF
    whole = len(data) // LANE * LANE
    if whole:
        grid = np.frombuffer(data, np.uint8, whole).reshape(-1, LANE)
        # What each lane of bytes adds on its own; the running value enters by its first 4 bytes.
        own = np.bitwise_xor.reduce(_TABLES[np.arange(LANE - 1, -1, -1), grid], axis=1).tolist()
        t3, t2, t1, t0 = (_LISTS[LANE - 1 - k] for k in range(4))
        for x in own:
            crc = x ^ t3[crc & 255] ^ t2[crc >> 8 & 255] ^ t1[crc >> 16 & 255] ^ t0[crc >> 24]
    first = _LISTS[0]
    for b in data[whole:]:
        crc = first[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_ADDED) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The record of a document, without its closing line feed."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    data = DATA.pack(doc_id or 0, doc_id is None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    size = len(data).to_bytes(8, "little")
    return b"".join((size, masked(crc32c(size)).to_bytes(4, "little"), data, masked(crc32c(data)).to_bytes(4, "little")))


def unframed(content: memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record of a file."""
    at = 0
    while at < len(content):
        size, check = HEAD.unpack_from(content, at)
        data = content[at + HEAD.size : at + HEAD.size + size]
        end = at + HEAD.size + size
        if masked(crc32c(bytes(content[at : at + 8]))) != check or len(data) != size:
            raise ValueError(f"record at {at}: its length is damaged")
        if masked(crc32c(bytes(data))) != int.from_bytes(content[end : end + 4], "little"):
            raise ValueError(f"record at {at}: its data is damaged")
        doc_id, missing, width, n = DATA.unpack_from(data)
        yield at, end + 5 - at, None if missing else doc_id, np.frombuffer(data, f"<u{width}", n, DATA.size)
        at = end + 5


def _latin() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind of each of the first 256 code points: space, letter,
    number or other, as the tokenizer's pattern tells them apart."""
    points = [chr(c) for c in range(256)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in points], np.uint8)
    space, letter, number = (regex.compile(p) for p in (r"\p{White_Space}", r"\p{L}", r"\p{N}"))
    kind = [SPACE if space.match(c) else LETTER if letter.match(c) else NUMBER if number.match(c) else OTHER for c in points]
    return lower, np.array(kind, np.int8)


SPACE, LETTER, NUMBER, OTHER = range(4)
# The endings that the tokenizer's pattern cuts off after an apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class WordEncoder:
    """The ids of whole texts under a lower-casing vocabulary with word ends.

    The ids are those of the tokenizers library. Texts of the first 256 code
    points, which its normal form leaves as they are, are cut into words in
    numpy and merged by a compiled encoder: each byte of a word is a symbol, one
    of 256 or, at the end of a word, of 256 others, spelt as a character of its
    own. All other texts go through the library.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(model)["model"]
        end, ids = data["end_of_word_suffix"], data["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}

        def spelt(token: str) -> str:
            body = token.removesuffix(end)
            symbols = [value[c] for c in body]
            symbols[-1] += 256 * (token != body)
            return "".join(chr(SYMBOLS[x]) for x in symbols)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["merges"]]
        order = [*letters, *(c + end for c in letters), *(a + b for a, b in merges)]
        ranks = {spelt(t).encode(): k for k, t in enumerate(order)}
        if len(ranks) != len(order):
            raise ValueError("two merges make the same token")
        self.ids = np.array([ids[t] for t in order], np.uint32)
        self.merges = tiktoken.Encoding("words", pat_str=SYMBOL_WORD, mergeable_ranks=ranks, special_tokens={})
        self.lower, self.kind = _latin()

    def symbols(self, codes: np.ndarray) -> str:
        """A text of the first 256 code points as the symbols of its words."""
        kind = self.kind[codes]
        codes = self.lower[codes]
        starts = np.ones(len(codes), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        marks = np.flatnonzero((codes == ord("'")) & starts)
        if len(marks):
            tail = np.append(codes, np.zeros(3, np.uint8))
            ended = np.zeros(len(marks), bool)
            for ending in ENDINGS:
                fits = ~ended
                for k, c in enumerate(ending, 1):
                    fits &= tail[marks + k] == c
                here = marks[fits]
                starts[here + 1] = False
                after = here + 1 + len(ending)
                starts[after[after < len(codes)]] = True
                ended |= fits
        ends = np.ones(len(codes), bool)
        ends[:-1] = starts[1:]
        live = kind != SPACE
        codes, ends = codes[live].astype(np.uint16), ends[live]
        wide = codes >= 0x80
        place = np.arange(len(codes)) + np.cumsum(wide)  # of the last byte of each character
        out = np.empty(len(codes) + int(wide.sum()), np.uint16)
        out[place[wide] - 1] = 0xC0 | codes[wide] >> 6
        out[place] = np.where(wide, 0x80 | codes & 0x3F, codes) + 256 * ends
        return SYMBOLS[out].astype("<u2").tobytes().decode("utf-16-le")

    def encode(self, text: str) -> np.ndarray:
        """The ids, the end id after them."""
        if "<|" not in text:
            try:
                codes = np.frombuffer(text.encode("latin-1"), np.uint8)
            except UnicodeEncodeError:
                pass
            else:
                found = self.ids[self.merges.encode_to_numpy(self.symbols(codes), disallowed_special=())]
                return np.append(found, np.uint32(END_ID))
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)


@lru_cache(maxsize=1)
def word_encoder(model: str) -> WordEncoder:
    return WordEncoder(model)


def write_records(
    docs: DataFrame, path: str, tokenizer: str, shards: int | None = None, records_per_file: int = 20_000
) -> None:
    """Encode every text of ``docs`` and write the records to the folder ``path``.

    ``tokenizer`` names a vocabulary file with word ends, read by the driver.
    ``shards`` is the number of ranges of ``doc_id``: by default Spark's number
    of shuffle partitions, and one for each ``SHARD_BYTES`` of text if those are
    more. A null text counts as empty: its record has the end id alone. Rows
    that repeat a ``doc_id``, or have none, follow each other and may lie in
    several ranges. Other columns are not looked at; an empty table gives no
    records. A text and its record have to fit into a task.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()

    def frames(parts):
        encoder = word_encoder(model)
        schema = pa.schema([("value", pa.binary())])
        rows = (
            (framed(i, encoder.encode(t.as_py() or "")),)
            for part in parts
            for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)
        )
        yield from batches(schema, rows, lambda r: len(r[0]))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards is None:
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # Rows of one id are told apart by their text, so that a range need not hold them all.
    order = (F.col("doc_id").asc_nulls_first(), F.col("own"), F.col("text"))
    hashed = slim.withColumn("own", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    records = ordered.mapInArrow(frames, "value binary").select(F.col("value").cast("string"))
    records.write.option("maxRecordsPerFile", records_per_file).text(path)


_READ = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())]
)


def _parse(parts):
    for part in parts:
        for name, content in zip(part.column(0), part.column(1), strict=True):
            file = name.as_py().rpartition("/")[2]
            rows = ((file, *r[:3], r[3].astype("<u4").tobytes()) for r in unframed(memoryview(content.as_buffer())))
            yield from batches(_READ, rows, lambda r: len(r[4]))


_PLACE = pa.schema([*list(_READ)[:4], ("n_ids", pa.int64()), ("ids_crc32", pa.int64())])


def _places(parts):
    for part in parts:
        for name, content in zip(part.column(0), part.column(1), strict=True):
            file = name.as_py().rpartition("/")[2]
            read = unframed(memoryview(content.as_buffer()))
            yield from batches(_PLACE, ((file, *r[:3], len(r[3]), zlib.crc32(r[3].astype("<u4").tobytes())) for r in read))


def _files(spark: SparkSession, path: str) -> DataFrame:
    # One file a task batch: files can be large.
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder, checksums tested: ``file``, ``offset``,
    ``length``, ``doc_id``, ``ids`` (4 bytes each, little-endian)."""
    return _files(spark, path).mapInArrow(_parse, "file string, offset long, length long, doc_id long, ids binary")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Write and return the place of every record of the folder ``path``:
    ``file``, ``offset``, ``length``, ``doc_id``, ``n_ids`` and ``ids_crc32``
    (of the ids, 4 bytes each). Reads each file once."""
    columns = "file string, offset long, length long, doc_id long, n_ids long, ids_crc32 long"
    places = _files(spark, path).mapInArrow(_places, columns)
    places.write.parquet(index)
    return spark.read.schema(places.schema).parquet(index)


def fetch(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The records at ``places`` (rows of the index), read from their files."""
    wanted = places.select(F.col("file").alias("in_file"), F.col("offset").alias("at"))
    found = read_records(spark, path)
    return found.join(wanted, (found["file"] == wanted["in_file"]) & (found["offset"] == wanted["at"]), "left_semi")


# Ranges whose files are summed together.
BUCKET = 512


def file_starts(index: DataFrame) -> DataFrame:
    """``file`` and ``file_start``, the ids in all files before it. The numbers
    in the names give the order; sums of ``BUCKET`` ranges come first, so no
    task has all files."""
    # The number of a file in its range comes last; the id of the job before it may have such a piece too.
    number = [F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)[^-]*$")]
    files = index.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select("file", "n", number[0].alias("range"), F.coalesce(number[1], F.lit(0)).alias("part"))
    files = files.withColumn("bucket", F.call_function("div", F.col("range"), F.lit(BUCKET)))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = files.groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("bucket").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(buckets, "bucket")
    return files.select("file", (F.col("bucket_start") + F.col("before")).alias("file_start"))


def record_digests(index: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all records before), ``n_tokens``,
    ``ids_crc32`` of every record, from an index taken from its files."""
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    places = index.withColumn("in_file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(file_starts(index), "file")
    start = F.col("file_start") + F.col("in_file")
    return places.select("doc_id", start.alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
