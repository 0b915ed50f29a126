"""Secrets in texts: fixed forms, and strings that a primed compressor finds new.

Three base kinds have fixed forms: ``assign`` (a value given to a password,
secret, token or API key), ``access`` (AWS access key ids) and ``hex`` (runs of
32 or more lower-case hex digits). The kind ``novel`` is measured: every string
of ``LEAST_VALUE`` characters or more near a sensitive word, before or after it,
is compressed by zstandard, primed with a dictionary of common identifiers and
with the code or text around the string. The bytes it still costs, per
character, tell how little of it was to be expected. From ``LONG`` characters on
that figure alone decides. A shorter string is too little for zstandard to tell
a rare word from a key, so its figure is weighed by the bits that a character of
its kinds can hold, and the limit rises as the string gets shorter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches

# The base kinds in their order, their forms and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "novel")

# Words near which a string may be a secret, and what such a string is made of.
SENSITIVE = re.compile(
    r"passphrase|password|passwd|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|auth[_-]?key",
    re.I | re.A,
)
CANDIDATE_CHARACTER = re.compile(r"[A-Za-z0-9+/_=.-]")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")

# Names that code is full of; they prime the compressor.
IDENTIFIERS = (
    "password passwd username user_name user_id account client_id client_secret access_token refresh_token "
    "passphrase credential credentials auth_key access_key authorization authentication bearer api_key apikey secret_key private_key public_key certificate signature "
    "config configuration settings environment production development staging localhost endpoint service server "
    "database connection connection_string host port schema table column index select insert update delete where "
    "import from return function const let var class def self this null none true false undefined string integer "
    "boolean float double list dict map array object value key name type data result response request header "
    "content application/json text/html http:// https:// www. .com .org .net /usr/local/bin /var/log /etc/ /home/ "
    "example sample default placeholder changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 "
    "1234567890 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "createElement getElementById addEventListener toString getInstance initialize constructor prototype callback "
    "timeout interval logger logging exception error warning message status code version release build timestamp"
)

REACH = 80  # characters between a sensitive word and a string, on either side
AROUND = 1_000  # characters before and after a string that prime the compressor
NOVEL = 0.7  # compressed bytes a character from which a string is reported
LONG = 16  # characters from which that limit holds; it rises to SHORT at LEAST_VALUE
SHORT = 0.97


def novelty(text: str, start: int, end: int) -> float:
    """Compressed bytes a character that ``text[start:end]`` adds to what is around it."""
    around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
    primed = zstandard.ZstdCompressionDict(
        (IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    packer = zstandard.ZstdCompressor(
        level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    own = text[start:end].encode()
    return (len(packer.compress(own)) - len(packer.compress(b""))) / len(own)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether what ``text[start:end]`` costs reaches the limit for its length."""
    cost, short = novelty(text, start, end), LONG - (end - start)
    if short <= 0:
        return cost >= NOVEL
    own = text[start:end]
    kinds = 26 * bool(re.search("[A-Za-z]", own)) + 10 * bool(re.search("[0-9]", own)) + 5 * bool(re.search("[+/_=.-]", own))
    kinds += 26 * bool(re.search("[a-z].*[A-Z]", own))  # a capital at the start says little
    return cost * math.log2(kinds) / 6 >= NOVEL + (SHORT - NOVEL) * short / (LONG - LEAST_VALUE)


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings near sensitive words that cannot be foretold and lie in no base
    span. The text is walked once, however many words and spans it has."""
    found, done = [], 0
    starts, ends = _covered(base)
    for word in SENSITIVE.finditer(text):
        at = max(done, word.start() - REACH)
        while at > done and CANDIDATE_CHARACTER.match(text, at - 1):
            at -= 1  # a string that reaches into the stretch counts from its own start
        # A string that begins in reach has its first characters in this stretch.
        last = word.end() + REACH
        while m := CANDIDATE.search(text, at, last + LEAST_VALUE):
            m = CANDIDATE.match(text, m.start())
            at = done = m.end()
            before = bisect_left(starts, m.end()) - 1
            if before >= 0 and ends[before] > m.start():
                continue
            if is_novel(text, m.start(), m.end()):
                found.append((m.start(), 3, m.end()))
    return found


def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)


def _scan(parts):
    def rows():
        for part in parts:
            for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base))
                counts = [sum(k == want for _, k, _ in spans) for want in range(len(KINDS))]
                yield i, *counts, hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(spans)

    yield from batches(_FOUND, rows(), lambda r: len(r[-1]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_assign``, ``n_access``,
    ``n_hex``, ``n_novel``, ``base_sha256``, ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    kind, joined by commas; ``base_sha256`` covers those of the base kinds. A
    null text counts as empty and has no spans. Whole texts are read, however
    long. Rows that repeat are rows of their own, ``doc_id`` may be null, other
    columns are not looked at, and an empty table gives an empty table.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return slim.mapInArrow(_scan, ddl)
