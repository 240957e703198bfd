"""Exact deduplication by recursive hash partitioning into spill files and open-addressing tables."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, free_name, text_or_empty

LOCAL_SCHEMA = "row_id bigint, first boolean, gid bigint, hash bigint, least bigint, n bigint, sha string, content binary"
RESOLVED_SCHEMA = "gid bigint, keep_id bigint, keep_gid bigint, group_size bigint, text_sha256 string"


def normalise(text: str) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space."""
    raw = text.encode()
    out = b" ".join(raw.split())
    if raw and raw[:1].isspace():
        out = b" " + out
    if len(out) > 1 or not raw[:1].isspace():
        if raw and raw[-1:].isspace():
            out += b" "
    return out


class OpenTable:
    """Open addressing with linear probing over 64-bit hashes; equal means equal in complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.payloads: list[list] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, code: int, content: bytes) -> tuple[int, bool]:
        """Index of the content's entry, and whether it is new."""
        mask = len(self.slots) - 1
        at = code & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.hashes)
        self.slots[at] = entry
        self.hashes.append(code)
        self.contents.append(content)
        self.payloads.append([])
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def grace_groups(
    records: Iterator[tuple[int, bytes, object]], memory_bytes: int, fan_out: int = 16, level: int = 0
) -> Iterator[tuple[bytes, list]]:
    """(content, payloads) of every distinct content among (hash, content, payload) records.

    Records fill one table until it holds `memory_bytes`; then its entries and all later records go to `fan_out` spill
    files by the next hash digit, and each file is treated alike. Copies of one content share one entry, and a table is
    always allowed a second entry, so the recursion ends once the hash digits are used up: a last level with equal
    64-bit hashes keeps what is left in one table.
    """
    table = OpenTable()
    digits = fan_out.bit_length() - 1
    last = (level + 1) * digits > 60
    spill, files = None, []
    try:
        for code, content, payload in records:
            if not files:
                entry, _ = table.find(code, content)
                table.payloads[entry].append(payload)
                if table.bytes > memory_bytes and len(table) > 1 and not last:
                    spill = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [open(os.path.join(spill.name, str(k)), "w+b") for k in range(fan_out)]
                    for h, c, payloads in zip(table.hashes, table.contents, table.payloads):
                        for p in payloads:
                            _spill(files, level, digits, h, c, p)
                    table = OpenTable()
            else:
                _spill(files, level, digits, code, content, payload)
        yield from zip(table.contents, table.payloads)
        for file in files:
            file.seek(0)
            yield from grace_groups(_spilled(file), memory_bytes, fan_out, level + 1)
            file.close()
    finally:
        for file in files:
            file.close()
        if spill is not None:
            spill.cleanup()


def _spill(files: list, level: int, digits: int, code: int, content: bytes, payload: object) -> None:
    # The table probes by low bits, so files are dealt by high bits.
    digit = (code >> (64 - digits * (level + 1))) & ((1 << digits) - 1)
    pickle.dump((code, content, payload), files[digit], protocol=5)


def _spilled(file) -> Iterator[tuple[int, bytes, object]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def _local_groups(memory_bytes: int):
    """Combines copies within a task: one row per input row, and one row with content per distinct text of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 36
        table = OpenTable()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal table, gid
            for start in range(0, len(table), 512):
                part = slice(start, start + 512)
                contents = table.contents[part]
                ids = [[r for r in p if r is not None] for p in table.payloads[part]]
                k = len(contents)
                yield _batch(LOCAL_ARROW, [
                    [None] * k, [None] * k, [gid + start + i for i in range(k)],
                    [_signed(h) for h in table.hashes[part]], [min(i, default=None) for i in ids],
                    [len(p) for p in table.payloads[part]], [hashlib.sha256(c).hexdigest() for c in contents], contents,
                ])
            rows = []
            for entry, payloads in enumerate(table.payloads):
                best = min(range(len(payloads)), key=lambda i: (payloads[i] is None, payloads[i] or 0, i))
                rows.extend((r, i == best, gid + entry) for i, r in enumerate(payloads))
            for start in range(0, len(rows), 8192):
                ids, firsts, gids = zip(*rows[start:start + 8192])
                none = [None] * len(ids)
                yield _batch(LOCAL_ARROW, [ids, firsts, gids, none, none, none, none, none])
            gid += len(table)
            table = OpenTable()

        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = normalise(text)
                entry, _ = table.find(xxhash.xxh64_intdigest(content), content)
                table.payloads[entry].append(row_id)
                if table.bytes > memory_bytes:
                    yield from flush()
        yield from flush()

    return run


def _resolve(memory_bytes: int):
    """Joins the tasks' groups of equal content; equal contents meet in one task, one row per task that saw them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for gid, code, least, n, sha, content in zip(*(c.to_pylist() for c in batch.columns)):
                    yield code & 0xFFFFFFFFFFFFFFFF, content, (gid, least, n, sha)

        out = []
        for _, payloads in grace_groups(records(), memory_bytes):
            least, keep_gid = min(((p[1], p[0]) for p in payloads if p[1] is not None), default=(None, min(p[0] for p in payloads)))
            size = sum(p[2] for p in payloads)
            out.extend((p[0], least, keep_gid, size, p[3]) for p in payloads)
            if len(out) > 8192:
                yield _batch(RESOLVED_ARROW, list(zip(*out)))
                out = []
        if out:
            yield _batch(RESOLVED_ARROW, list(zip(*out)))

    return run


LOCAL_ARROW = pa.schema([
    ("row_id", pa.int64()), ("first", pa.bool_()), ("gid", pa.int64()), ("hash", pa.int64()), ("least", pa.int64()),
    ("n", pa.int64()), ("sha", pa.string()), ("content", pa.binary()),
])
RESOLVED_ARROW = pa.schema([
    ("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_gid", pa.int64()), ("group_size", pa.int64()),
    ("text_sha256", pa.string()),
])


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 48 << 20
) -> DataFrame:
    """Groups rows whose texts are identical after each run of ASCII white space is replaced by one space.

    Returns one row per input row: the id column, keep_id, group_size, kept, text_sha256. A null text counts as empty.
    Of the rows with the smallest id in a group, repeated ones included, exactly one is kept. A null id is never the
    smallest; a group of null ids alone has keep_id null, and one of its rows is kept. No rows give no rows; other
    columns are ignored.

    Copies are combined inside each task first, so a text that fills a third of the table reaches the shuffle once per
    task. Member rows stay narrow and meet their group's result by a join, never in one list.
    """
    space = Workspace(docs.sparkSession, "exact")
    source = docs.select(F.col(id_col).cast("bigint").alias("row_id"), text_or_empty(text_col).alias("content"))
    local = space.write(source.mapInArrow(_local_groups(memory_bytes), LOCAL_SCHEMA), "local")
    groups = (
        local.filter(F.col("hash").isNotNull()).select("gid", "hash", "least", "n", "sha", "content")
        .repartition("hash").mapInArrow(_resolve(memory_bytes), RESOLVED_SCHEMA)
    )
    members = local.filter(F.col("hash").isNull()).select("row_id", "first", "gid")
    return members.join(groups, "gid").select(
        F.col("row_id").alias(id_col), "keep_id", "group_size",
        (F.col("first") & (F.col("gid") == F.col("keep_gid"))).alias("kept"), "text_sha256",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of `exact_dedup`, all columns as they are; of repeated rows with one id and text, one."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    none = F.lit(-(1 << 63))
    key, sha, place = (free_name(docs, name) for name in ("id_key", "sha_key", "place_in_key"))
    kept = kept.select(F.coalesce(F.col(id_col), none).alias(key), F.col("text_sha256").alias(sha))
    body = F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")
    marked = docs.withColumn(key, F.coalesce(F.col(id_col).cast("bigint"), none)).withColumn(sha, F.sha2(body, 256))
    matched = marked.join(kept, [sha, key], "left_semi")
    one = Window.partitionBy(sha, key).orderBy(F.col(text_col))
    return matched.withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
