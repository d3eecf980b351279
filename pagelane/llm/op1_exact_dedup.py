"""Exact deduplication with Patricia tries that own the texts.

Two rounds of tries, both in Spark tasks:

* Round 1 (map side): every input partition inserts the normalised UTF-8 bytes
  of its texts into a compressed radix trie. Each row gets the *local owner*, the
  key of the row that first brought the text to this task; the terminal stores
  the smallest id and the number of rows. A group of copies therefore sends one text per task to the
  shuffle, however many rows it has, and its rows join by local owner later, so
  no key gathers the rows of a hot group.
* Round 2: round 1's terminals are dealt out by text length and content hash; each
  partition inserts the full byte strings into a trie whose terminals store the
  smallest identifier, the number of rows and the owner's key.

A trie holds at most ``max_bytes``. When it is fuller, its largest subtree is
spilled: in round 1 its terminals are sent on (later copies found a new local
owner, which round 2 merges); in round 2 the subtree's entries and all later
texts under its prefix go to a scratch file of the task, which becomes a trie of
its own afterwards. A lost executor repeats the task; the rows between the rounds
are a Parquet table in the shared folder.

Defined cases: a null text counts as empty; the smallest non-null id stays, and
among rows with equal ids exactly one; if all ids of a group are null, one of its
rows stays and keep_id is null; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelane.llm.common import BLANKS, staged, table, text_or_empty

MAX_TRIE_BYTES = 128 << 20


class Node:
    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges: dict[int, list] = {}  # first byte -> [label, node]
        self.value = None


def _shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``bytes_held`` counts its labels."""

    NODE_BYTES = 200

    def __init__(self):
        self.root = Node()
        self.bytes_held = 0

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends; new nodes have value None."""
        node, rest = self.root, text
        while rest:
            edge = node.edges.get(rest[0])
            if edge is None:
                leaf = Node()
                node.edges[rest[0]] = [rest, leaf]
                self.bytes_held += len(rest) + self.NODE_BYTES
                return leaf
            label, child = edge
            if not rest.startswith(label):
                shared = _shared_length(rest, label)
                middle = Node()
                middle.edges[label[shared]] = [label[shared:], child]
                node.edges[rest[0]] = [label[:shared], middle]
                self.bytes_held += self.NODE_BYTES
                child, label = middle, label[:shared]
            node, rest = child, rest[len(label):]
        return node

    def entries(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        stack = [(node or self.root, prefix)]
        while stack:
            at, path = stack.pop()
            if at.value is not None:
                yield path, at.value
            stack.extend((child, path + label) for label, child in at.edges.values())

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            for label, child in stack.pop().edges.values():
                total += len(label) + self.NODE_BYTES
                stack.append(child)
        return total

    def cut_largest_subtree(self) -> tuple[bytes, list[tuple[bytes, object]]]:
        """Take out the heaviest subtree under the first branching; its prefix and entries."""
        node, path = self.root, b""
        while len(node.edges) == 1 and node.value is None:
            (label, child), = node.edges.values()
            if not child.edges:
                break
            node, path = child, path + label
        first = max(node.edges, key=lambda b: len(node.edges[b][0]) + self._weight(node.edges[b][1]))
        label, child = node.edges.pop(first)
        entries = list(self.entries(child, path + label))
        self.bytes_held -= len(label) + self.NODE_BYTES + self._weight(child)
        return path + label[:1], entries


class SpillingOwners:
    """Terminals by text under a memory bound.

    ``add(text, local, best, n)`` returns the owner of the text, or None when the
    text waits in a scratch file; ``results()`` yields ("link", local, owner) for
    texts that waited and ("owner", owner, best, n) for every text.
    """

    def __init__(self, max_bytes: int = MAX_TRIE_BYTES):
        self.max_bytes = max_bytes
        self.trie = PatriciaTrie()
        self.spilled: dict[bytes, object] = {}  # prefix -> open scratch file

    def add(self, text: bytes, local: int, best: tuple, n: int) -> int | None:
        for prefix, file in self.spilled.items():
            if text.startswith(prefix):
                pickle.dump((text, [local, best, n], True), file)
                return None
        owner = self._insert(text, [local, best, n])
        if self.trie.bytes_held > self.max_bytes and self.trie.root.edges:
            prefix, entries = self.trie.cut_largest_subtree()
            file = self.spilled[prefix] = tempfile.TemporaryFile(prefix="trie-spill-")
            for path, value in entries:
                pickle.dump((path, value, False), file)
        return owner

    def _insert(self, text: bytes, value: list) -> int:
        node = self.trie.terminal(text)
        if node.value is None:
            node.value = value
        else:
            node.value[1] = min(node.value[1], value[1])
            node.value[2] += value[2]
        return node.value[0]

    def results(self) -> Iterator[tuple]:
        for _, (owner, best, n) in self.trie.entries():
            yield "owner", owner, best, n
        self.trie = PatriciaTrie()
        for file in self.spilled.values():
            inner = SpillingOwners(max(self.max_bytes, 4 * self._longest(file)))
            for text, (local, best, n), waits in self._read(file):
                owner = inner.add(text, local, best, n)
                if waits and owner is not None:
                    yield "link", local, owner
            yield from inner.results()
            file.close()

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        end = file.seek(0, os.SEEK_END)
        file.seek(0)
        while file.tell() < end:
            yield pickle.load(file)

    def _longest(self, file) -> int:
        """The longest text of the file, so that a trie always has room for some."""
        return max((len(text) for text, _, _ in self._read(file)), default=0)


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


_DDL = "kind string, doc_id long, row long, local long, owner long, n long, none boolean, sha binary, text binary"
_KINDS = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("row", pa.int64()), ("local", pa.int64()),
                    ("owner", pa.int64()), ("n", pa.int64()), ("none", pa.bool_()), ("sha", pa.binary()), ("text", pa.binary())])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """A batch of the shared output schema; columns not given are null."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _KINDS], schema=_KINDS)


def _best(doc_id, row: int) -> tuple:
    """Order of rows: smallest id first, null ids last, then the row key."""
    return doc_id is None, doc_id or 0, row


def _terminal_batches(entries, rows: int = 512):
    """Terminals of round 1 as rows: the text and what its node stores."""
    chunk = []
    for entry in entries:
        chunk.append(entry)
        if len(chunk) == rows:
            yield _terminal_batch(chunk)
            chunk = []
    if chunk:
        yield _terminal_batch(chunk)


def _terminal_batch(chunk):
    return _batch(len(chunk), kind=["text"] * len(chunk), text=[t for t, _ in chunk], local=[v[0] for _, v in chunk],
                  none=[v[1][0] for _, v in chunk], doc_id=[v[1][1] for _, v in chunk], row=[v[1][2] for _, v in chunk],
                  n=[v[2] for _, v in chunk])


def _local_owners(max_bytes: int):
    def run(batches):
        trie = PatriciaTrie()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            locals_ = []
            for doc_id, row, text in zip(ids, rows, batch.column(3)):
                node = trie.terminal(text.as_py())
                if node.value is None:
                    node.value = [row, _best(doc_id, row), 1]
                else:
                    node.value[1] = min(node.value[1], _best(doc_id, row))
                    node.value[2] += 1
                locals_.append(node.value[0])
                while trie.bytes_held > max_bytes and trie.root.edges:
                    yield from _terminal_batches(trie.cut_largest_subtree()[1])
            yield _batch(len(ids), kind=["row"] * len(ids), doc_id=ids, row=rows, local=locals_, sha=batch.column(2))
        yield from _terminal_batches(trie.entries())
    return run


def _link_batch(links):
    return _batch(len(links), kind=["link"] * len(links), local=[x[0] for x in links], owner=[x[1] for x in links])


def _owner_batch(found):
    return _batch(len(found), kind=["owner"] * len(found), owner=[x[1] for x in found], none=[x[2][0] for x in found],
                  doc_id=[x[2][1] for x in found], row=[x[2][2] for x in found], n=[x[3] for x in found])


def _global_owners(max_bytes: int):
    def run(batches):
        owners = SpillingOwners(max_bytes)
        for batch in batches:
            links = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for local, none, doc_id, row, n, text in zip(*columns, batch.column(5)):
                owner = owners.add(text.as_py(), local, (none, doc_id, row), n)
                if owner is not None:
                    links.append((local, owner))
            yield _link_batch(links)
        links, found = [], []
        for entry in owners.results():
            if entry[0] == "link":
                links.append(entry[1:])
            else:
                found.append(entry)
            if len(links) + len(found) >= 10_000:
                yield _link_batch(links)
                yield _owner_batch(found)
                links, found = [], []
        yield _link_batch(links)
        yield _owner_batch(found)
    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.unhex(F.sha2(text, 256)).alias("sha"), F.encode(text, "UTF-8").alias("text"))
    local = staged(rows.mapInArrow(_local_owners(max_trie_bytes), _DDL), "dedup-rows")

    texts = local.filter("kind = 'text'").select("local", "none", "doc_id", "row", "n", "text")
    tries = (texts.repartition(F.length("text"), F.xxhash64("text"))
             .mapInArrow(_global_owners(max_trie_bytes), _DDL).drop("text", "sha"))
    tries = staged(tries, "dedup-owners")
    owners = tries.filter("kind = 'owner'").select("owner", F.when(~F.col("none"), F.col("doc_id")).alias("keep_id"),
                                                   F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    decided = tries.filter("kind = 'link'").select("local", "owner").join(owners, "owner").drop("owner")
    return local.filter("kind = 'row'").select("doc_id", "row", "local", "sha").join(decided, "local").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
