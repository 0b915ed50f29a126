"""CSV files: delimiters, sampled cells, full reads, previews, reports."""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators import profile
from ledgerline.session import checkpointed
from ledgerline.sources import csv_splits
from ledgerline.sources.files import metadata_path, open_path, plain_path

PREVIEW_ROWS = 200
# Candidates in order of preference; the first also stands when none fits.
DELIMITERS = (",", ";", "\t", "|")
_MARKS = [d.encode() for d in DELIMITERS]
# Share of the lines that must have a candidate equally often.
AGREEING = 0.9
# Cells of one batch, and columns that the reader accepts.
CELLS_PER_BATCH = 50_000
MOST_COLUMNS = 200_000
# How the names begin that Spark's readers pass over.
HIDDEN = ("_", ".")
BAD_CHARACTER = "�"


def with_delimiter(files: DataFrame, head_bytes: int | None = None, split_bytes: int = csv_splits.SPLIT) -> DataFrame:
    """Add the ``delimiter`` of each file, from all of its lines or, with
    ``head_bytes``, from those of its start, and the error of a file that
    cannot be read as ``unread``; its delimiter is NULL.

    Large files are counted split by split, and the counts of the splits of a
    file merged in their order.
    """

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    size = _size(path)
                    rows.append((path, size if head_bytes is None else min(size, head_bytes), size, None))
                except (OSError, ValueError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "bytes", "size", "unread"]).astype({"bytes": "Int64", "size": "Int64"})

    paths = files.select("path").distinct().repartition(F.xxhash64("path"))
    listed = checkpointed(paths.mapInPandas(sized, "path string, bytes long, size long, unread string"))
    cut = csv_splits.splits(listed.where("unread IS NULL").withColumn("delimiter", F.lit(None).cast("string")), split_bytes)
    cut = cut.join(listed.select("path", (F.col("bytes") < F.col("size")).alias("headed")), "path")
    counted = cut.repartition(F.col("path"), F.col("number")).mapInPandas(
        _counted, "path string, number long, headed boolean, unread string, counts string"
    )
    merged = counted.groupBy("path").applyInPandas(_merged, "path string, delimiter string, unread string")
    unread = listed.where("unread IS NOT NULL").select("path", F.lit(None).cast("string").alias("delimiter"), "unread")
    return files.join(merged.union(unread), "path")


class LineCounts:
    """How many lines have each candidate how often, outside quotes, in a
    stretch of a file that may begin and end inside a line or quotes. Blank
    lines do not count. Stretches merge in their order; memory does not grow
    with them but by the different counts that lines have."""

    def __init__(self, quoted: bool = False):
        self.quoted = quoted  # at the end of the stretch
        self.lines: list[Counter] = [Counter() for _ in DELIMITERS]
        # Candidates of the first line up to its end, if it ends here, and of the
        # last one so far; the last number of each tells whether it is not blank.
        self.head: list[int] | None = None
        self.tail = [0] * (len(DELIMITERS) + 1)

    def feed(self, data: bytes) -> None:
        for k, piece in enumerate(data.split(b'"')):
            if k:
                self.quoted = not self.quoted
                self.tail[-1] = 1
            if self.quoted:
                continue
            for j, part in enumerate(piece.split(b"\n")):
                if j:
                    self._end()
                if part.strip(b"\r"):
                    self.tail[-1] = 1
                    for i, d in enumerate(_MARKS):
                        self.tail[i] += part.count(d)

    def _end(self) -> None:
        if self.head is None:
            self.head = self.tail
        else:
            self._count(self.tail)
        self.tail = [0] * (len(DELIMITERS) + 1)

    def _count(self, line: list[int]) -> None:
        if line[-1]:
            for counter, n in zip(self.lines, line):
                counter[n] += 1

    def follow(self, other: LineCounts) -> None:
        """Go on with the stretch after this one."""
        first = other.tail if other.head is None else other.head
        self.tail = [a + b for a, b in zip(self.tail[:-1], first[:-1])] + [self.tail[-1] | first[-1]]
        self.quoted = other.quoted
        if other.head is not None:
            self._end()
            for mine, theirs in zip(self.lines, other.lines):
                mine.update(theirs)
            self.tail = list(other.tail)

    def whole(self, headed: bool = False) -> dict[str, Counter]:
        """The counts of a whole file; the last line of a mere head is cut
        somewhere, so it does not count unless it is the only one."""
        done = LineCounts()
        done.lines = [Counter(c) for c in self.lines]
        for line in [self.head, None if headed and self.head is not None else self.tail]:
            if line is not None:
                done._count(line)
        return dict(zip(DELIMITERS, done.lines))

    def to_json(self) -> str:
        return json.dumps([self.quoted, [list(c.items()) for c in self.lines], self.head, self.tail])

    @classmethod
    def from_json(cls, text: str) -> LineCounts:
        found = cls()
        found.quoted, lines, found.head, found.tail = json.loads(text)
        found.lines = [Counter(dict(c)) for c in lines]
        return found


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of each split, in case that it begins outside and inside quotes."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            found = [LineCounts(), LineCounts(quoted=True)][: 2 if r.number else 1]
            try:
                for data in csv_splits.chunks(r.path, r.start, r.end):
                    for counts in found:
                        counts.feed(data)
                rows.append((r.path, r.number, r.headed, None, json.dumps([c.to_json() for c in found])))
            except OSError as e:
                rows.append((r.path, r.number, r.headed, f"{type(e).__name__}: {e}", None))
        yield pd.DataFrame(rows, columns=["path", "number", "headed", "unread", "counts"])


def _merged(splits: pd.DataFrame) -> pd.DataFrame:
    """The delimiter of one file from the counts of its splits."""
    splits = splits.sort_values("number")
    path, failed = splits["path"].iloc[0], splits["unread"].dropna()
    if len(failed):
        return pd.DataFrame([(path, None, failed.iloc[0])], columns=["path", "delimiter", "unread"])
    whole = LineCounts()
    for text in splits["counts"]:
        cases = json.loads(text)
        whole.follow(LineCounts.from_json(cases[whole.quoted if len(cases) > 1 else 0]))
    delimiter = choose_delimiter(whole.whole(bool(splits["headed"].iloc[0])))
    return pd.DataFrame([(path, delimiter, None)], columns=["path", "delimiter", "unread"])


def choose_delimiter(counts: dict[str, Counter]) -> str:
    """The first candidate that nine of ten lines have equally often, and at
    all; comma when there is none. A few short records change nothing."""
    for d in DELIMITERS:
        lines = counts[d].total()
        if any(n > 0 and lines and seen >= AGREEING * lines for n, seen in counts[d].items()):
            return d
    return DELIMITERS[0]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; the value is found once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def delimiter_of(text: Column) -> Column:
    """`choose_delimiter` for the lines of a text column."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', '""')
    lines = F.filter(F.split(bare, "\r?\n"), lambda s: s != "")

    def fits(d: str, lines: Column) -> Column:
        counts = F.transform(lines, lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(d), F.lit(""))))
        # What nine of ten lines have stands in the middle of the sorted counts.
        middle = lambda c: F.get(F.array_sort(c), F.floor(F.size(c) / 2).cast("int"))
        agree = lambda c, n: F.size(F.filter(c, lambda x: x == n)) >= F.size(c) * AGREEING
        return _once(counts, lambda c: _once(middle(c), lambda n: (n > 0) & agree(c, n)))

    chosen = _once(lines, lambda found: F.coalesce(*[F.when(fits(d, found), F.lit(d)) for d in DELIMITERS]))
    return F.coalesce(chosen, F.lit(DELIMITERS[0]))


def _sample(path: str, delimiter: str, limit: int | None) -> Iterator[list[tuple]]:
    """Cells of the header and of the first records of one file, or of all, in
    batches; a record count above the limit is met only by blank records. Cells
    beyond the header are left out."""
    csv.field_size_limit(sys.maxsize)
    system, inside = open_path(path)
    with system.open_input_stream(inside) as stream:
        text = io.TextIOWrapper(stream, encoding="utf-8", errors="ignore", newline="")
        records = csv.reader(text, delimiter=delimiter)
        header = next(records, [])
        if not header:
            raise ValueError("CSV has no header row")
        cells = [(path, i, name, None, None) for i, name in enumerate(header)]
        for number, record in enumerate(records, 1):
            cells += [(path, i, header[i], v, None) for i, v in enumerate(record[: len(header)])]
            if len(cells) >= CELLS_PER_BATCH:
                yield cells
                cells = []
            if limit is not None and record and number >= limit:
                break
        yield cells


def sample_cells(files: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Cells (file, ordinal, name, value) of all records of each file (path,
    delimiter), or of the first ``sample_rows``. A file that cannot be sampled
    gives one row with its ``error``; it does not stop the others."""
    columns = ["file", "ordinal", "name", "value", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, delimiter in zip(batch["path"], batch["delimiter"]):
                try:
                    for rows in _sample(path, delimiter or DELIMITERS[0], sample_rows):
                        yield pd.DataFrame(rows, columns=columns).astype({"ordinal": "Int32"})
                except (OSError, ValueError, csv.Error) as e:
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                    yield pd.DataFrame(rows, columns=columns).astype({"ordinal": "Int32"})

    schema = "file string, ordinal int, name string, value string, error string"
    return files.select("path", "delimiter").mapInPandas(read, schema)


def _literal(path: str) -> str:
    """A path in which pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_text_columns(
    spark: SparkSession,
    paths: str | list[str],
    headers: list[str],
    delimiter: str = ",",
    multi_line: bool = True,
    broken_records: bool = False,
    split_bytes: int = csv_splits.SPLIT,
) -> DataFrame:
    """CSV files of one header as trimmed text columns in snake case, and the
    ``_file`` of each row.

    The first record of each file is its header; short records give NULLs and
    surplus fields are dropped. With ``multi_line`` quoted fields may span
    lines; files of more than ``split_bytes`` are then cut into splits at
    records (`csv_splits`), others are read by one task each. Without it Spark
    splits large files at lines, and drops lines of white space alone. Files
    that Spark hides, named ``_x`` or ``.x``, are read as large ones are.
    ``broken_records`` adds ``_broken``: the text of records of another width.
    """
    columns = names.snake_headers(headers)
    schema = ", ".join(f"`{c}` string" for c in columns) + (", `_broken` string" if broken_records else "")
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    options |= {"columnNameOfCorruptRecord": "_broken", "maxColumns": str(MOST_COLUMNS)}
    paths = [paths] if isinstance(paths, str) else paths
    hidden = [p for p in paths if p.rpartition("/")[2].startswith(HIDDEN)]
    seen = [p for p in paths if p not in hidden]
    large = _larger(spark, seen, split_bytes) if multi_line and seen else {}
    small = [p for p in seen if plain_name(p) not in large]
    large |= {plain_name(p): _size(p) for p in hidden}
    found = []
    if small:
        reader = spark.read.schema(schema).options(header=True, multiLine=multi_line, encoding="UTF-8", **options)
        raw = reader.csv([_literal(p) for p in small])
        found.append(raw.select("*", metadata_path().alias("_file")))
    if large:
        files = spark.createDataFrame([(p, delimiter, n) for p, n in large.items()], "path string, delimiter string, bytes long")
        records = csv_splits.read_records(files, split_bytes).where("place > 0")
        fields = F.from_csv(F.col("record").cast("string"), schema, options)
        found.append(records.select(fields.alias("r"), F.col("file").alias("_file")).select("r.*", "_file"))
    raw = reduce(DataFrame.unionByName, found)
    # Undecodable bytes arrive as a replacement character.
    text = [names.strip(F.translate(F.col(f"`{c}`"), BAD_CHARACTER, "")).alias(c) for c in columns]
    return raw.select(*text, *(["_broken"] if broken_records else []), "_file")


def plain_name(path: str) -> str:
    """A path as Spark's file sources report it, without a local scheme."""
    return re.sub("^file:/*", "/", path)


def _size(path: str) -> int:
    system, inside = open_path(path)
    size = system.get_file_info(inside).size
    if size is None:
        raise ValueError(f"no such file: {path}")
    return size


def _larger(spark: SparkSession, paths: list[str], size: int) -> dict[str, int]:
    """The files of more than ``size`` bytes, by a listing that opens none."""
    listed = spark.read.format("binaryFile").load([_literal(p) for p in paths])
    large = listed.where(F.col("length") > size).select(plain_path(F.col("path")), "length")
    return dict(map(tuple, large.collect()))


def read_values(
    spark: SparkSession,
    paths: list[str],
    headers: list[str],
    delimiter: str = ",",
    multi_line: bool = True,
    split_bytes: int = csv_splits.SPLIT,
) -> DataFrame:
    """``file`` and ``values`` (text, by header) of every record. The reader
    does not tell an empty cell from a missing one: NULLs count as blanks, an
    empty text here, except the trailing ones of a short record, which are
    missing and stay NULL."""
    rows = read_text_columns(spark, paths, headers, delimiter, multi_line, True, split_bytes)
    values = F.array(*[F.col(f"`{c}`") for c in names.snake_headers(headers)])
    present = F.filter(F.transform(values, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(present), F.lit(-1))
    told = rows.select(F.col("_file").alias("file"), "_broken", values.alias("values"), last.alias("last"))
    missing = lambda i: F.col("_broken").isNotNull() & (i > F.col("last"))
    filled = F.transform("values", lambda v, i: F.when(~missing(i), F.coalesce(v, F.lit(""))))
    return told.select("file", filled.alias("values"))


def all_cells(
    spark: SparkSession, paths: list[str], headers: list[str], delimiter: str = ",", multi_line: bool = True
) -> DataFrame:
    """The cells (file, ordinal, name, value) of `read_values`, and one without
    a value for each column of each file."""
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(h).alias("name"), F.get("values", F.lit(i)).alias("value"))
        for i, h in enumerate(headers)
    ]
    body = read_values(spark, paths, headers, delimiter, multi_line).select("file", F.inline(F.array(*cells)))
    names_only = spark.createDataFrame(
        [(p, i, h, None) for p in paths for i, h in enumerate(headers)],
        "file string, ordinal int, name string, value string",
    )
    return body.unionByName(names_only)


def preview(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS) -> tuple[int, DataFrame]:
    """Number of records of a CSV or JSON file, and the first of them. A JSON
    file holds an array of records or one record per line."""
    if path.lower().endswith(".csv"):
        table = spark.read.options(header=True, multiLine=True, escape='"').csv(_literal(path))
    else:
        table = spark.read.option("multiLine", True).json(_literal(path))
    return table.count(), table.limit(rows)


def schema_report(files: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Per CSV file (path): delimiter, columns, profile, table definition and
    number of ``records`` that are not blank, or the error. Whole files are read, or with ``sample_rows`` their first
    records. The table is named by the lower-case file name, not in snake
    case."""
    delimited = checkpointed(with_delimiter(files))
    cells = checkpointed(sample_cells(delimited, sample_rows))
    errors = cells.where("error IS NOT NULL").groupBy(F.col("file").alias("path")).agg(F.first("error").alias("error"))
    sound = cells.join(errors.select(F.col("path").alias("file")), "file", "left_anti")
    profiled = profile.profile_columns(sound.drop("error"))
    stem = F.lower(F.regexp_replace(names.base_name("file"), r"\.[^.]*$", ""))
    ddl = profile.table_definitions(profiled, by="file", name=stem)
    columns = profiled.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "snake", "nullable"))).alias("columns")
    )
    # Blank records have no cells.
    counts = sound.where("ordinal = 0 AND value IS NOT NULL").groupBy("file").agg(F.count("*").alias("records"))
    good = columns.join(ddl, "file").join(counts, "file", "left").withColumnRenamed("file", "path")
    found = delimited.select("path", "delimiter").join(good, "path", "left").join(errors, "path", "left")
    records = F.when(F.col("error").isNull() & F.col("ddl").isNotNull(), F.coalesce("records", F.lit(0)))
    return found.select("path", "delimiter", "columns", "ddl", "error", records.alias("records"))


def record_counts(spark: SparkSession, paths: list[str], delimiter: str = ",") -> DataFrame:
    """Records per file, header excluded, of files of one delimiter."""
    rows = (
        spark.read.schema("c string")
        .options(header=True, sep=delimiter, multiLine=True, escape='"')
        .csv([_literal(p) for p in paths])
    )
    return rows.groupBy(metadata_path().alias("path")).agg(F.count("*").alias("records"))
