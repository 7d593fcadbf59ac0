"""Containers: many coded parts in one binary, with a table of offsets.

Layout, little-endian: magic, kind, number of entries and attributes (u32 each),
attributes (i64), offset and length of each entry (u64), and the parts one after the
other.  Offsets count from the first part.  Kinds: planes of one picture, frames,
strips (attribute: first row per strip), tiles of a pyramid.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"RFC1"
KINDS = {"plane": 1, "planes": 2, "frames": 3, "strips": 4, "tiles": 5}
HEAD = struct.Struct("<4sIII")


class BadContainer(ValueError):
    """The bytes are no container, or one cut short."""


def pack(parts: list[bytes], kind: str, attributes: tuple[int, ...] = ()) -> bytes:
    at, table = 0, []
    for p in parts:
        table.append(struct.pack("<QQ", at, len(p)))
        at += len(p)
    return b"".join([HEAD.pack(MAGIC, KINDS[kind], len(parts), len(attributes)), struct.pack(f"<{len(attributes)}q", *attributes), *table, *parts])


def header(blob: bytes, size: int | None = None) -> dict:
    """kind, attributes, entries as (offset, length), and start of the first part; checks sizes.  With a size, blob may be the head alone."""
    size = len(blob) if size is None else size
    if len(blob) < HEAD.size:
        raise BadContainer("shorter than a header")
    magic, kind, n, attributes = HEAD.unpack_from(blob)
    if magic != MAGIC or kind not in KINDS.values():
        raise BadContainer("unknown format")
    start = HEAD.size + 8 * attributes + 16 * n
    if len(blob) < start:
        raise BadContainer("cut short in the table")
    entries = [struct.unpack_from("<QQ", blob, HEAD.size + 8 * attributes + 16 * i) for i in range(n)]
    if any(start + at + length > size for at, length in entries):
        raise BadContainer("an entry lies outside")
    return {"kind": kind, "attributes": struct.unpack_from(f"<{attributes}q", blob, HEAD.size), "entries": entries, "start": start}


def entry(blob: bytes, number: int) -> bytes:
    head = header(blob)
    if not 0 <= number < len(head["entries"]):
        raise IndexError(f"there is no entry {number}")
    at, size = head["entries"][number]
    return blob[head["start"] + at : head["start"] + at + size]


def write(parts: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """key, container: data of each key's parts in order; the order is kept as attributes.  A container is one group."""
    kind_of_key = parts.schema[key].dataType.simpleString()

    def run(data):
        rows = sorted(zip(data.column("at").to_pylist(), data.column("data").to_pylist(), strict=True))
        blob = pack([d for _, d in rows], kind, tuple(a for a, _ in rows))
        return pa.table({key: data.column(key)[:1], "container": pa.array([blob], pa.binary())})

    return parts.select(key, F.col(order).cast("long").alias("at"), "data").groupBy(key).applyInArrow(run, f"{key} {kind_of_key}, container binary")


def read_index(containers: DataFrame, key: str) -> DataFrame:
    """key, entry_no, attribute, offset (in the container), length, from the headers; only these go to Python."""
    kind_of_key = containers.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                head = header(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                n = len(head["entries"])
                attributes = head["attributes"] if len(head["attributes"]) == n else [None] * n
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type), pa.array(range(n), pa.int32()), pa.array(attributes, pa.int64()), pa.array([head["start"] + a for a, _ in head["entries"]], pa.int64()), pa.array([s for _, s in head["entries"]], pa.int64())], [key, "entry_no", "attribute", "offset", "length"])

    number = lambda at: "conv(concat(" + ", ".join(f"hex(substring(container, {at + k}, 1))" for k in (3, 2, 1, 0)) + "), 16, 10)"
    head = F.expr(f"substring(container, 1, {HEAD.size} + CAST(least(16 * {number(9)} + 8 * {number(13)}, octet_length(container)) AS INT))")
    return containers.select(key, head.alias("head"), F.octet_length("container").alias("size")).mapInArrow(run, f"{key} {kind_of_key}, entry_no int, attribute long, offset long, length long")


def slices(containers: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """index with data: each entry's bytes, cut out of the container."""
    whole = containers.select(key, "container")
    inside = F.col("offset") + F.col("length") <= F.octet_length("container")
    data = F.expr("substring(container, CAST(offset + 1 AS INT), CAST(length AS INT))")
    return index.join(whole, key).withColumn("data", F.when(inside, data).otherwise(F.raise_error(F.lit("an entry lies outside")).cast("binary"))).drop("container")


def format_of(data: Column) -> Column:
    """What a binary is, by its first bytes."""
    lead = F.hex(F.substring(data, 1, 4))
    return F.when(lead == MAGIC.hex().upper(), "container").when(lead == b"RPL1".hex().upper(), "plane").when(F.substring(lead, 1, 2).isin("54", "52", "48", "50"), "stream").otherwise("unknown")
