"""Quoted CSV files read by many tasks, each from the start of a record.

A byte of a CSV file means nothing without its state: a line feed ends a record
only outside quotes. So every split of a file is first scanned from each state
that it can begin in; the scan gives the state at its end and the first record
that begins in it. Chained along the splits of a file, these small answers tell
the true state of each, and so where its records begin. Then each split is read
alone, from its first record up to that of the next, and cut into records; the
fields of a record are parsed by Spark.

A file has so many answers as splits, 32 MB each, and only they pass through one
group. A split without the start of a record belongs to the one before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.files import open_path

SPLIT = 32 << 20
CHUNK = 1 << 20
RECORDS_A_BATCH = 10_000
BYTES_A_BATCH = 4 << 20

# States between two bytes: a field begins; inside a plain field; inside quotes;
# after a quote inside quotes, which ends them unless another follows.
FIELD, PLAIN, QUOTED, MAYBE = range(4)
STATES = (FIELD, PLAIN, QUOTED, MAYBE)


class Scanner:
    """Walks the bytes of a file from a state, chunk by chunk."""

    def __init__(self, delimiter: str, state: int = FIELD):
        mark = re.escape(delimiter.encode())
        self.state = state
        self._next = re.compile(rb"\n|" + mark + rb'(?=")')
        self._quoted = re.compile(rb'[^"]*+')
        self._mark = delimiter.encode()

    def ends(self, data: bytes) -> Iterator[int]:
        """The places in ``data`` after the line feeds that end a record; the
        state goes on to the next chunk."""
        at, size, state, mark = 0, len(data), self.state, self._mark
        while at < size:
            if state == QUOTED:
                at = self._quoted.match(data, at).end()
                if at < size:
                    state, at = MAYBE, at + 1
                continue
            byte = data[at : at + 1]
            if state == MAYBE:
                state = QUOTED if byte == b'"' else PLAIN
                at += byte == b'"'
                continue
            if state == FIELD and byte == b'"':
                state, at = QUOTED, at + 1
                continue
            # Plain text up to a line feed, or to a delimiter with a quote or nothing after it.
            found = self._next.search(data, at)
            if found is None:
                state = FIELD if data.endswith(mark) else PLAIN
                break
            at = found.end()
            state = FIELD
            if data[at - 1] == 10:
                yield at
        self.state = state


def chunks(path: str, start: int, end: int) -> Iterator[bytes]:
    system, inside = open_path(path)
    with system.open_input_file(inside) as f:
        f.seek(start)
        while start < end and (data := f.read(min(CHUNK, end - start))):
            start += len(data)
            yield data


def scan(pieces: Iterable[bytes], delimiter: str, state: int) -> tuple[int, int]:
    """The state after the pieces, and how many bytes before the first record
    that begins in or right after them; -1 for none."""
    scanner, first, before = Scanner(delimiter, state), -1, 0
    for data in pieces:
        for at in scanner.ends(data):
            if first < 0:
                first = before + at
        before += len(data)
    return scanner.state, first


def records(pieces: Iterable[bytes], delimiter: str) -> Iterator[bytes]:
    """The records that the pieces hold, from the start of one, without the
    line ends; a last one may have none."""
    scanner, held = Scanner(delimiter), []
    for data in pieces:
        last = 0
        for at in scanner.ends(data):
            held.append(data[last:at])
            yield b"".join(held).removesuffix(b"\n").removesuffix(b"\r")
            held, last = [], at
        held.append(data[last:])
    if rest := b"".join(held):
        yield rest.removesuffix(b"\r")


def splits(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """``path``, ``delimiter``, ``number``, ``start``, ``end`` of the splits of
    ``files`` (``path``, ``delimiter``, ``bytes``)."""
    last = F.greatest(F.lit(0), F.ceil(F.col("bytes") / split_bytes) - 1)
    each = files.select("path", "delimiter", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"))
    start = F.col("number") * split_bytes
    end = F.least(start + split_bytes, F.col("bytes"))
    return each.select("path", "delimiter", "number", start.alias("start"), end.alias("end"))


def _scanned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for r in part.itertuples(index=False):
            # The first split of a file begins a record; in others a state is one of four.
            found = [scan(chunks(r.path, r.start, r.end), r.delimiter, s) for s in (STATES if r.number else (FIELD,))]
            ends, firsts = zip(*(found * (1 if r.number else len(STATES))))
            rows.append((r.path, r.delimiter, r.number, r.start, r.end, list(ends), list(firsts)))
        yield pd.DataFrame(rows, columns=["path", "delimiter", "number", "start", "end", "ends", "firsts"])


def _chained(table: pa.Table) -> pa.Table:
    """The ranges of whole records of one file, from the answers of its splits."""
    rows = sorted(table.to_pylist(), key=lambda r: r["number"])
    state, begins = FIELD, [0]
    for r in rows:
        if r["number"] and 0 <= r["firsts"][state] and r["start"] + r["firsts"][state] < rows[-1]["end"]:
            begins.append(r["start"] + r["firsts"][state])
        state = r["ends"][state]
    ranges = zip(begins, [*begins[1:], rows[-1]["end"]], strict=True)
    out = [{"path": rows[0]["path"], "delimiter": rows[0]["delimiter"], "start": a, "end": b} for a, b in ranges if b > a]
    return pa.Table.from_pylist(out, pa.schema([("path", pa.string()), ("delimiter", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def record_ranges(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """``path``, ``delimiter``, ``start``, ``end``: about a range for each split
    of ``files`` (``path``, ``delimiter``, ``bytes``), of whole records."""
    answers = splits(files, split_bytes).repartition(F.col("path"), F.col("number")).mapInPandas(
        _scanned, "path string, delimiter string, number long, start long, end long, ends array<long>, firsts array<long>"
    )
    return answers.groupBy("path").applyInArrow(_chained, "path string, delimiter string, start long, end long")


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("record", pa.binary())])
    for part in parts:
        for r in part.to_pylist():
            held, size, place = [], 0, r["start"]
            # The place of a record tells the first one, the header; it is no byte offset.
            for record in records(chunks(r["path"], r["start"], r["end"]), r["delimiter"]):
                if not record:
                    continue
                held.append((r["path"], place, record))
                size += len(record)
                place += 1
                if len(held) >= RECORDS_A_BATCH or size >= BYTES_A_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_records(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """``file``, ``place`` (0 for the header) and ``record`` (text without its
    line end) of every record but empty ones of ``files`` (``path``,
    ``delimiter``, ``bytes``), read by as many tasks as the files have splits."""
    ranges = record_ranges(files, split_bytes).repartition(F.col("path"), F.col("start"))
    return ranges.mapInArrow(_read, "file string, place long, record binary")
