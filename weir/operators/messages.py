"""Message-table operators: (seq, payload) rows with chunking, checksums, sequence checks and capacity policies."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.errors import BufferFullError, CorruptedMessageError, MessageTooLargeError
from weir.operators.ordering import ROWS_PER_TASK, order_piece, with_position

#: Bytes of a slot that chunk metadata takes: three fields with a 6-byte head and an 8-byte value.
CHUNK_METADATA = 3 * (6 + 8)
POLICIES = ("block", "raise", "drop_newest", "drop_oldest")


# --- slots and chunks ---


def slots(size: Column, slot_size: int) -> Column:
    """Slots that a message of so many bytes takes; NULL if it can't be chunked."""
    chunk = slot_size - CHUNK_METADATA
    many = F.ceil(size / chunk).cast("long") if chunk > 0 else F.lit(None).cast("long")
    return F.when(size <= slot_size, F.lit(1).cast("long")).otherwise(many)


def max_message(slot_size: int, capacity: int) -> int:
    return max(slot_size, capacity * max(0, slot_size - CHUNK_METADATA))


def chunk_plan(df: DataFrame, slot_size: int, capacity: int, payload: str = "payload") -> DataFrame:
    """df with n_slots, and too_large where a message can't be sent."""
    n = slots(F.octet_length(payload), slot_size)
    return df.withColumn("n_slots", n).withColumn("too_large", n.isNull() | (n > capacity))


def chunk_split(df: DataFrame, slot_size: int, payload: str = "payload") -> DataFrame:
    """A row per chunk: df's other columns, chunk_index, chunk_total, message_len, chunk, checksum."""
    size = F.octet_length(payload)
    step = F.when(size <= slot_size, F.greatest(size, F.lit(1))).otherwise(slot_size - CHUNK_METADATA)
    rows = df.withColumn("chunk_total", slots(size, slot_size).cast("int")).withColumn("message_len", size).withColumn("_step", step)
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)))
    chunk = F.substring(F.col(payload).cast("binary"), F.col("chunk_index") * F.col("_step") + 1, F.col("_step"))
    return rows.withColumn("chunk", chunk).withColumn("checksum", F.crc32("chunk")).drop("_step", payload)


def chunk_join(chunks: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, payload, valid): payloads put together; valid if all chunks are there once, agree and have their checksums."""
    parts = chunks.groupBy(seq).agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("_p"),
        F.min("chunk_total").alias("_t"),
        ((F.min("chunk_total") == F.max("chunk_total")) & (F.min("message_len") == F.max("message_len")) & F.bool_and(F.crc32("chunk") == F.col("checksum"))).alias("_same"),
        F.min("message_len").alias("_len"),
    )
    whole = F.aggregate("_p", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["chunk"]))
    there = F.transform("_p", lambda p: p["chunk_index"]) == F.sequence(F.lit(0), F.col("_t") - 1)
    out = parts.withColumn("payload", whole)
    return out.select(seq, "payload", (F.col("_same") & there & (F.octet_length("payload") == F.col("_len"))).alias("valid"))


# --- integrity and order ---


def split_corrupted(df: DataFrame, payload: str = "payload", checksum: str = "checksum") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) by CRC-32; a missing payload or checksum is rejected."""
    ok = F.coalesce(F.crc32(F.col(payload).cast("binary")) == F.col(checksum), F.lit(False))
    return df.where(ok), df.where(~ok)


def sequence_gaps(df: DataFrame, seq: str = "seq", per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(expected, seq, missing) where a sequence number isn't the one after the last. Pieces of the order are compared
    in parallel: a number's predecessor is found in its own piece, or at the end of the piece before it."""
    piece, _ = order_piece(df, seq, per_task)
    own = df.select(F.col(seq).alias("seq"), piece.alias("_b")).where("seq is not null")
    edges = own.groupBy("_b").agg(F.max("seq").alias("_last"))
    edges = edges.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_before"))  # a row per piece
    inside = F.lag("seq").over(Window.partitionBy("_b").orderBy("seq"))
    rows = own.withColumn("_prev", inside).join(edges, "_b").withColumn("_prev", F.coalesce("_prev", "_before"))
    return rows.where("seq - _prev <> 1").select((F.col("_prev") + 1).alias("expected"), "seq", (F.col("seq") - F.col("_prev") - 1).alias("missing"))


def sequence_precedes(left: Column, right: Column) -> Column:
    return left < right


def merge_producers(first: DataFrame, *others: DataFrame, order_by: str, name: str = "seq") -> DataFrame:
    """The rows of several producers under one sequence."""
    for o in others:
        first = first.unionByName(o)
    return with_position(first, order_by, name)


# --- capacity ---


def drop_newest(df: DataFrame, capacity: int, slot_size: int | None = None, seq: str = "seq", payload: str = "payload") -> DataFrame:
    """The messages that find room when none is taken out. Those of one size are accepted up to some point of the order,
    so the first capacity / size of each size decide: they meet in one task, which gives that point for each size (at most
    `capacity` rows)."""
    if slot_size is None:
        return df.orderBy(seq).limit(max(0, capacity))
    rows = df.withColumn("_slots", slots(F.octet_length(payload), slot_size)).where(F.col("_slots") <= capacity)
    first = rows.select(F.col(seq).alias("seq"), "_slots").withColumn("_n", F.row_number().over(Window.partitionBy("_slots").orderBy("seq")))
    first = first.where(f"_n <= {capacity}").where(f"_n <= {capacity} div _slots")  # the literal bound cuts before the shuffle

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        at, size, room, last = np.arange(t.num_rows), t["_slots"].to_numpy(), capacity, {}
        while len(at):  # up to the next message that finds no room; messages of its size or more find none from there on
            used = np.cumsum(size[at])
            fits = int(np.searchsorted(used, room, side="right"))
            for n, i in zip(size[at[:fits]].tolist(), at[:fits].tolist(), strict=True):
                last[n] = i
            room -= int(used[fits - 1]) if fits else 0
            at = at[fits:]
            at = at[size[at] <= room]
        return pa.table({"_size": pa.array(last.keys(), pa.int64()), "_last": t["seq"].take(pa.array(last.values(), pa.int64()))})

    kind = df.schema[seq].dataType.simpleString()
    ends = first.select("seq", "_slots").groupBy().applyInArrow(fold, f"_size long, _last {kind}")
    kept = (F.col("_slots") == F.col("_size")) & (F.col(seq) <= F.col("_last"))
    return rows.join(F.broadcast(ends), kept, "left_semi").drop("_slots")


def drop_oldest(df: DataFrame, capacity: int, slot_size: int | None = None, seq: str = "seq", payload: str = "payload") -> DataFrame:
    """The longest run of last messages that fits; each takes a slot at least, so the last `capacity` decide."""
    size = F.lit(1).cast("long") if slot_size is None else slots(F.octet_length(payload), slot_size)
    last = df.withColumn("_slots", size).where(F.col("_slots") <= capacity).orderBy(F.desc(seq)).limit(capacity)
    used = F.sum("_slots").over(Window.orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("_used", used).where(F.col("_used") <= capacity).drop("_slots", "_used")


def admit(df: DataFrame, policy: str, capacity: int, slot_size: int, seq: str = "seq", payload: str = "payload", queued: int = 0) -> DataFrame:
    """df under a backpressure policy. block and raise fail with BufferFullError when the messages don't fit (a batch has
    nobody to wait for); a message that no empty channel could hold is a MessageTooLargeError under any policy."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    n = slots(F.octet_length(payload), slot_size)
    used, worst, odd = df.agg(F.sum(n), F.max(n), F.count_if(n.isNull())).first()
    if odd or (worst or 0) > capacity:
        raise MessageTooLargeError(f"a message needs {worst or 'chunks'} of {capacity} slots")
    if policy == "drop_newest":
        return drop_newest(df, capacity - queued, slot_size, seq, payload)
    if policy == "drop_oldest":
        return drop_oldest(df, capacity, slot_size, seq, payload)
    if (used or 0) + queued > capacity:
        raise BufferFullError(f"{used} slots needed, {capacity - queued} free")
    return df


def channel_stats(df: DataFrame, capacity: int, slot_size: int, seq: str = "seq", payload: str = "payload") -> DataFrame:
    """One row of counters of a message table."""
    n = slots(F.octet_length(payload), slot_size)
    return df.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("queue_depth"),
        F.lit(capacity).alias("queue_capacity"),
        F.lit(slot_size).alias("slot_size"),
        F.lit(CHUNK_METADATA).alias("chunk_metadata_size"),
        F.lit(max(0, slot_size - CHUNK_METADATA)).alias("chunk_payload_size"),
        F.lit(max_message(slot_size, capacity)).alias("max_message_size"),
        F.coalesce(F.max(seq) + 1, F.lit(0)).cast("long").alias("next_sequence"),
        F.coalesce(F.min(seq), F.lit(0)).cast("long").alias("expected_recv_sequence"),
        (F.count(F.lit(1)) == 0).alias("empty"),
    )


# --- bytes of a payload ---


def view(payload: Column, offset: int = 0, size: int | None = None) -> Column:
    """Bytes of a payload from offset on, size of them or all."""
    if offset < 0 or size is not None and size < 0:
        raise ValueError("offset and size aren't negative")
    return F.substring(payload, F.lit(offset + 1), F.lit(size) if size is not None else F.octet_length(payload))


def byte_at(payload: Column, index: int) -> Column:
    """The byte at index as an INT; NULL beyond the end."""
    return F.conv(F.hex(F.substring(payload, index + 1, 1)), 16, 10).cast("int")


def write_at(payload: Column, data: Column, offset: int = 0) -> Column:
    """payload with data written over it at offset; the length stays."""
    end = F.octet_length(data) + offset
    return F.when(end <= F.octet_length(payload), F.overlay(payload, data, F.lit(offset + 1)))


# --- frames ---

# Fixed values of the wire format: a little-endian header, then (type, length, value) fields, then the payload.
MAGIC, VERSION, KIND_BYTES = 0x44534C4E, 2, 1
CHUNKED, CHUNK_START, CHUNK_END = 1, 2, 4
_HEADER = struct.Struct("<IHHHIQQQQI")
_FIELD = struct.Struct("<HI")
FRAME = "seq long, flags int, kind int, payload binary, fields array<struct<ty:int,value:binary>>"


def _encoded(seq: int, flags: int, kind: int, payload: bytes, fields: list) -> bytes:
    extra = b"".join(_FIELD.pack(f["ty"], len(f["value"])) + f["value"] for f in fields or ())
    head = _HEADER.pack(MAGIC, VERSION, flags, kind, _HEADER.size + len(extra), len(payload), seq, 0, 0, zlib.crc32(payload))
    return head + extra + payload


def decode_frame(frame: bytes) -> dict:
    """A frame's parts; CorruptedMessageError says what is wrong with it."""
    if len(frame) < _HEADER.size:
        raise CorruptedMessageError("short frame")
    magic, version, flags, kind, head, size, seq, _, _, checksum = _HEADER.unpack_from(frame)
    if magic != MAGIC or version != VERSION:
        raise CorruptedMessageError("wrong magic or version")
    if not 1 <= kind <= 4 or head < _HEADER.size or head > len(frame) or head + size != len(frame):
        raise CorruptedMessageError("wrong kind or length")
    fields, at = [], _HEADER.size
    while at < head:
        if at + _FIELD.size > head:
            raise CorruptedMessageError("truncated field")
        ty, n = _FIELD.unpack_from(frame, at)
        at += _FIELD.size
        if at + n > head:
            raise CorruptedMessageError("truncated field")
        fields.append({"ty": ty, "value": frame[at : at + n]})
        at += n
    payload = frame[head:]
    if zlib.crc32(payload) != checksum:
        raise CorruptedMessageError("wrong checksum")
    return {"seq": seq, "flags": flags, "kind": kind, "payload": payload, "fields": fields}


def encode_frames(df: DataFrame) -> DataFrame:
    """(seq, frame) from (seq, payload) and, where present, flags, kind and fields."""
    have = df.columns
    rows = df.select(
        F.col("seq").cast("long"),
        (F.col("flags") if "flags" in have else F.lit(0)).cast("int").alias("flags"),
        (F.col("kind") if "kind" in have else F.lit(KIND_BYTES)).cast("int").alias("kind"),
        F.coalesce(F.col("payload").cast("binary"), F.unhex(F.lit(""))).alias("payload"),
        (F.col("fields") if "fields" in have else F.array()).cast("array<struct<ty:int,value:binary>>").alias("fields"),
    )

    def f(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_encoded(**r) for r in b.to_pylist()], pa.binary())], ["seq", "frame"])

    return rows.mapInArrow(f, "seq long, frame binary")


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """FRAME columns, and error (null for good frames): rejected frames stay as rows."""
    kind = pa.schema([("seq", pa.int64()), ("flags", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), ("fields", pa.list_(pa.struct([("ty", pa.int32()), ("value", pa.binary())]))), ("error", pa.string())])

    def f(batches):
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                try:
                    out.append(decode_frame(x or b"") | {"error": None})
                except CorruptedMessageError as e:
                    out.append({"error": str(e)})
            yield pa.RecordBatch.from_pylist(out, kind)

    return df.select(F.col(frame).cast("binary")).mapInArrow(f, f"{FRAME}, error string")
