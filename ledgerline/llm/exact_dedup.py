"""Exact duplicates found with Patricia tries of whole normalised texts.

Two texts are equal when they are identical after every white-space character
(U+0020, U+0009 to U+000D) is deleted. Of equal texts the row with the most
code points in its original text stays, then the smallest ``doc_id``.

How it runs: each task inserts the texts of its input into a compressed radix
trie, which leaves one row per distinct text and task. Those rows are shuffled
by length and content hash, and the tries of the receiving tasks decide: equal
texts meet in one terminal node, which holds the row that stays. A group of
copies reaches its task as one row per input task, however many rows it has.
The documents then meet their owner in a join on the digest of the text, which
Spark splits where one text is very frequent.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE_BYTES, batches, checkpointed, free_name

# Bytes of labels that a trie holds before it gives rows on or spills a subtree.
TRIE_BYTES = 48 << 20
_NODE_BYTES = 200  # what a node costs beside its label


class Node:
    __slots__ = ("label", "children", "owner", "spill")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner = None  # (code points, doc_id, rows, rows that tie for first)
        self.spill = None  # a file that has what lies below this node


def better(a, b):
    """The owner of two groups of one text: most code points, smallest id, null ids last."""
    if (a[0], a[1]) == (b[0], b[1]):
        return a[0], a[1], a[2] + b[2], a[3] + b[3]
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    first = a if rank(a) < rank(b) else b
    return first[0], first[1], a[2] + b[2], first[3]


def common_length(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings with an owner per string.

    With ``spill=True`` the largest subtree moves to a file of the task's own
    whenever the labels outgrow ``limit``; ``owners`` reads it back as a trie
    of its own, so memory stays bounded for any number of texts.
    """

    def __init__(self, limit: int = TRIE_BYTES, spill: bool = True):
        self.root, self.limit, self.size, self.may_spill = Node(b""), limit, 0, spill

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], owner), node.spill, 5)
                return
            if at == len(key):
                node.owner = better(node.owner, owner) if node.owner else owner
                return
            child = node.children.get(key[at])
            if child is None:
                leaf = Node(key[at:])
                leaf.owner = owner
                node.children[key[at]] = leaf
                self.size += len(leaf.label) + _NODE_BYTES
                break
            if not key.startswith(child.label, at):
                same = common_length(child.label, key, at)
                upper = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.size += _NODE_BYTES
                child = upper
            node, at = child, at + len(child.label)
        if self.may_spill and self.size > self.limit:
            self._spill()

    def _weights(self, top: Node) -> dict[int, int]:
        """Bytes below each node, by its id."""
        below: dict[int, int] = {}
        stack = [(top, False)]
        while stack:
            node, done = stack.pop()
            if done:
                below[id(node)] = len(node.label) + _NODE_BYTES + sum(below[id(c)] for c in node.children.values())
            else:
                stack.append((node, True))
                stack.extend((c, False) for c in node.children.values())
        return below

    def _spill(self) -> None:
        below = self._weights(self.root)
        node = self.root
        while node.children:
            node = max(node.children.values(), key=lambda c: below[id(c)])
            # the smallest subtree that still holds a third of the bytes, or a leaf
            if not node.children or max(below[id(c)] for c in node.children.values()) < below[id(self.root)] // 3:
                break
        if node is self.root or node.spill is not None:
            return
        file = tempfile.TemporaryFile()
        for rest, owner in walk(node):
            pickle.dump((rest, owner), file, 5)
        self.size -= below[id(node)] - len(node.label) - _NODE_BYTES
        node.children, node.owner, node.spill = {}, None, file

    def owners(self):
        """(text, owner) of every terminal node, spilled ones included."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node.label
            if node.spill is not None:
                inner = Trie(self.limit)
                for rest, owner in spilled(node):
                    inner.insert(rest, owner)
                for rest, owner in inner.owners():
                    yield here + rest, owner
                continue
            if node.owner:
                yield here, node.owner
            stack.extend((c, here) for c in node.children.values())


def spilled(node: Node):
    """What the file of a node has, which is then closed."""
    file, node.spill = node.spill, None
    with file:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def walk(top: Node):
    """(text below the label of ``top``, owner) of the terminals of a subtree,
    with those that have been spilled."""
    stack = [(top, b"")]
    while stack:
        node, before = stack.pop()
        if node.spill is not None:
            for rest, owner in spilled(node):
                yield before + rest, owner
        if node.owner:
            yield before, node.owner
        stack.extend((c, before + c.label) for c in node.children.values())


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE_BYTES)


_LOCAL = pa.schema(
    [("body", pa.binary()), ("length", pa.int64()), ("hash", pa.int64())]
    + [(c, pa.int64()) for c in ("points", "id", "n", "ties")]
)
_LOCAL_DDL = "body binary, length long, hash long, points long, id long, n long, ties long"
_OWNER = pa.schema([("digest", pa.binary())] + [(c, pa.int64()) for c in ("points", "id", "n", "ties")])
_OWNER_DDL = "digest binary, points long, id long, n long, ties long"


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _local_owners(parts):
    """One row per distinct text of the task, in runs of bounded memory."""

    def rows():
        trie = Trie(spill=False)
        for part in parts:
            texts, points, ids = (part.column(i) for i in range(3))
            for t, p, i in zip(texts, points.to_pylist(), ids.to_pylist(), strict=True):
                trie.insert(normalised(t.as_py()), (p, i, 1, 1))
                if trie.size > TRIE_BYTES:
                    yield from trie.owners()
                    trie = Trie(spill=False)
        yield from trie.owners()

    full = ((t, len(t), _hash(t), *o) for t, o in rows())
    yield from batches(_LOCAL, full, lambda r: r[1])


def _final_owners(parts):
    def rows():
        trie = Trie()
        for part in parts:
            bodies, others = part.column(0), [part.column(i).to_pylist() for i in range(1, 5)]
            for t, *owner in zip(bodies, *others, strict=True):
                trie.insert(t.as_py(), tuple(owner))
        for text, owner in trie.owners():
            yield hashlib.sha256(text).digest(), *owner

    yield from batches(_OWNER, rows())


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(normalised(t.as_py())).digest() for t in texts], pa.binary())


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised form of a text, given as bytes."""
    return F.arrow_udf(_digests, "binary")(text)


def owners(docs: DataFrame) -> DataFrame:
    """Per distinct normalised text: ``digest`` (SHA-256), ``points`` and ``id``
    of the row that stays, ``n`` (rows) and ``ties`` (rows that share both)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        text.cast("binary").alias("t"), F.char_length(text).cast("long").alias("p"), F.col("doc_id").cast("long")
    )
    local = slim.mapInArrow(_local_owners, _LOCAL_DDL)
    return local.repartition("length", "hash").select("body", "points", "id", "n", "ties").mapInArrow(
        _final_owners, _OWNER_DDL
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.

    A null text counts as empty; empty texts are equal to each other. A null
    ``doc_id`` is the largest. Rows that repeat a ``doc_id`` with an equal text
    all carry the same flag. Other columns of ``docs`` are not looked at. An
    empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(text).alias("digest"))
    found = owners(docs)
    return members.join(found, "digest").select(
        "doc_id",
        F.col("id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct normalised text,
    with the columns of ``docs``. Rows that tie in code points and ``doc_id``
    leave one of them."""
    digest, owner = free_name(docs, "digest"), free_name(docs, "owner")
    found = checkpointed(owners(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(digest, text_digest(text.cast("binary")))
    keep = found.select(F.struct("digest", "points", "id").alias(owner))
    stays = marked.join(
        keep,
        (F.col(digest) == F.col(f"{owner}.digest"))
        & (F.char_length(text) == F.col(f"{owner}.points"))
        & F.col("doc_id").eqNullSafe(F.col(f"{owner}.id")),
        "left_semi",
    )
    if not found.where("ties > 1").isEmpty():
        stays = stays.dropDuplicates([digest])
    return stays.drop(digest)
