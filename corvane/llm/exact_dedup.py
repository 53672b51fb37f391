"""Exact duplicates by owners in Patricia tries.

Each distinct normalised text ends at one terminal node of a compressed radix
trie; the node holds the smallest identifier and the number of rows. Texts are
dealt out by length and content hash, so all copies of a text meet in one trie.
A first pass of tries on the map side turns the copies that one task sees into a
single entry: a group that holds a third of all rows sends one entry per task.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, narrow

#: Bytes of text that a trie holds before it spills a subtree (or, on the map side, passes its entries on).
TRIE_BYTES = 96 << 20
NO_ID = (1 << 63) - 1  # stands for null, above every other identifier
_HEAD = struct.Struct("<qqi")


def _common(a: bytes, i: int, b: bytes, j: int, n: int) -> int:
    """Length of the common prefix of a[i:i+n] and b[j:j+n]."""
    if a[i : i + n] == b[j : j + n]:
        return n
    lo, step = 0, 16
    while a[i + lo : i + lo + step] == b[j + lo : j + lo + step]:  # ends, as they differ somewhere
        lo, step = lo + step, step * 4
    hi = min(n, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i + lo : i + mid] == b[j + lo : j + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("buf", "lo", "hi", "kids", "best", "count", "spill")

    def __init__(self, buf: bytes, lo: int, hi: int, best: int = NO_ID, count: int = 0):
        self.buf, self.lo, self.hi, self.best, self.count = buf, lo, hi, best, count
        self.kids: dict[int, _Node] | None = None
        self.spill: str | None = None


class PatriciaTrie:
    """Maps byte strings to (smallest identifier, number of rows).

    A node's label is a slice of a full string, so labels aren't copied. Over
    ``limit`` bytes of resident strings, the largest subtree below the first
    branching node goes to a file in ``folder`` and later strings that reach it
    are appended there; ``items`` then reads each such file into a trie of its own.
    Files of earlier spills within that subtree are read together with its file.
    """

    def __init__(self, limit: int = TRIE_BYTES, folder: str | None = None):
        self.limit, self.folder = limit, folder
        self.root, self.bytes, self.stuck = _Node(b"", 0, 0), 0, 0
        self.files: dict[str, list[str]] = {}  # file of a stub → files of the stubs that it replaced

    def insert(self, key: bytes, best: int, count: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while True:
            if node.spill is not None:
                self._append(node.spill, key, best, count)
                return
            if at == end:
                node.best, node.count = min(node.best, best), node.count + count
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                node.kids = {} if node.kids is None else node.kids
                node.kids[key[at]] = _Node(key, at, end, best, count)
                self._grown(end)
                return
            size = kid.hi - kid.lo
            same = _common(key, at, kid.buf, kid.lo, min(size, end - at))
            if same < size:  # split the edge
                fork = _Node(kid.buf, kid.lo, kid.lo + same)
                kid.lo += same
                fork.kids = {kid.buf[kid.lo]: kid}
                node.kids[key[at]] = fork
                kid = fork
                if at + same == end:
                    self._grown(end)
            node, at = kid, at + same

    def _grown(self, n: int) -> None:
        self.bytes += n + 200
        if self.folder and self.bytes > max(self.limit, self.stuck):
            self._spill()

    def _walk(self, node: _Node, path: bytes) -> Iterator[tuple[bytes, int, int]]:
        todo = [(node, path)]
        while todo:
            node, path = todo.pop()
            path += node.buf[node.lo : node.hi]
            if node.count:
                yield path, node.best, node.count
            todo += [(k, path) for k in (node.kids or {}).values()]

    def _stubs(self, node: _Node) -> Iterator[str]:
        todo = [node]
        while todo:
            node = todo.pop()
            if node.spill is not None:
                yield node.spill
            todo += (node.kids or {}).values()

    def _append(self, name: str, key: bytes, best: int, count: int) -> None:
        with open(name, "ab") as f:
            f.write(_HEAD.pack(best, count, len(key)) + key)

    def _spill(self) -> None:
        node, path = self.root, b""
        while node.kids and len(node.kids) == 1:
            path += node.buf[node.lo : node.hi]
            node = next(iter(node.kids.values()))
            if node.spill is not None:
                return
        here = path + node.buf[node.lo : node.hi]
        sizes = {b: sum(len(k) + 200 for k, _, _ in self._walk(n, here)) for b, n in (node.kids or {}).items() if n.spill is None}
        if len(node.kids or ()) < 2 or not sizes:
            self.stuck = 2 * self.bytes  # one chain of prefixes; nothing to part
            return
        most = max(sizes, key=sizes.get)
        gone = node.kids[most]
        fd, name = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "wb") as f:
            for key, best, count in self._walk(gone, here):
                f.write(_HEAD.pack(best, count, len(key)) + key)
        stub = _Node(gone.buf[gone.lo : gone.lo + 1], 0, 1)
        stub.spill = name
        node.kids[most] = stub
        self.files[name] = [x for old in self._stubs(gone) for x in (*self.files.pop(old), old)]
        self.bytes -= sizes[most]

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """(string, smallest identifier, rows) for each distinct string."""
        yield from self._walk(self.root, b"")
        self.root = _Node(b"", 0, 0)
        for last, earlier in self.files.items():
            part = PatriciaTrie(self.limit, self.folder)
            for name in (*earlier, last):
                with open(name, "rb") as f:
                    while head := f.read(_HEAD.size):
                        best, count, n = _HEAD.unpack(head)
                        part.insert(f.read(n), best, count)
                os.unlink(name)
            yield from part.items()


OWNERS = pa.schema([("text_sha256", pa.string()), ("body", pa.binary()), ("best", pa.int64()), ("n", pa.int64())])


def _out(rows: list[tuple[bytes, int, int]], body: bool) -> pa.RecordBatch:
    from hashlib import sha256

    keys, best, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([sha256(k).hexdigest() for k in keys]), pa.array(keys if body else [None] * len(keys), pa.binary()), pa.array(best, pa.int64()), pa.array(n, pa.int64())], schema=OWNERS)


def _batches(items: Iterable[tuple[bytes, int, int]], body: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for x in items:
        rows.append(x)
        size += len(x[0]) if body else 64
        if size > 4 << 20:
            yield _out(rows, body)
            rows, size = [], 0
    if rows:
        yield _out(rows, body)


def _map_side(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(folder=None)
    for b in it:
        for key, best in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            trie.insert(key, NO_ID if best is None else best)
            if trie.bytes > TRIE_BYTES:
                yield from _batches(trie.items(), True)
                trie = PatriciaTrie(folder=None)
    yield from _batches(trie.items(), True)


def _owners(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with tempfile.TemporaryDirectory() as folder:
        trie = PatriciaTrie(folder=folder)
        for b in it:
            for key, best, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                trie.insert(key, best, n)
        yield from _batches((x for x in trie.items() if x[2] > 1), False)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``carry``, keep_id, group_size, kept, text_sha256.

    Rows are equal if their normalised texts are. The row with the smallest
    identifier stays. Defined cases: a null text is empty; empty texts are equal
    to each other; a null identifier stands above all others, so such a row stays
    only in a group without identifiers (keep_id is then null); rows that repeat
    an identifier and a text share one fate; an empty table gives no rows; other
    columns of any name are ignored unless named in ``carry``.

    Plan: text is shuffled once, at most one copy per task and text. The join
    back carries digests, and adaptive execution splits a hot digest.
    """
    docs = narrow(df, *dict.fromkeys((id_col, text_col, *carry)))
    norm = normalised(F.col(text_col))
    texts = docs.select(F.encode(norm, "UTF-8").alias("body"), F.col(id_col).cast("long").alias("best"))
    owners = texts.mapInArrow(_map_side, "text_sha256 string, body binary, best long, n long")
    owners = owners.repartition(F.octet_length("body"), F.col("text_sha256")).select("body", "best", "n")
    owners = owners.mapInArrow(_owners, "text_sha256 string, body binary, best long, n long").select(F.col("text_sha256").alias("__sha"), F.nullif("best", F.lit(NO_ID)).alias("__best"), F.col("n").alias("__n"))
    rows = docs.select(*[c for c in docs.columns if c != text_col or c in carry], F.sha2(norm, 256).alias("__text_sha"))
    one = F.col("__n").isNull()
    keep = F.when(one, F.col(id_col).cast("long")).otherwise(F.col("__best"))
    extra = [c for c in dict.fromkeys(carry) if c != id_col]
    return rows.join(owners, F.col("__text_sha") == F.col("__sha"), "left").select(
        F.col(id_col), *extra, keep.alias("keep_id"), F.coalesce("__n", F.lit(1)).alias("group_size"), F.col(id_col).cast("long").eqNullSafe(keep).alias("kept"), F.col("__text_sha").alias("text_sha256")
    )
