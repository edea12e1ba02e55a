"""Protocol-buffer wire format of task metadata and of the legacy envelope.

Only the two messages are known here; fields are written in order, defaults
are left out, unknown fields are skipped on reading.

Columns are written and read over Arrow batches, on the bytes of all messages at
once: a step writes or reads one field of every message.  The functions on
single messages say what both do, and tests compare them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA_TYPE = "struct<timestamp_millis:bigint,source_application_id:string,source_instance_id:string,retry_count:bigint,scheduled_time_millis:bigint>"

# Field numbers of the metadata message and of the envelope.
METADATA_NUMBERS = {1: "timestamp_millis", 2: "source_application_id", 3: "source_instance_id", 4: "retry_count", 5: "scheduled_time_millis"}
ENVELOPE_METADATA, ENVELOPE_TASK = 1, 2
TEXT_FIELDS = ("source_application_id", "source_instance_id")


def put_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def get_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("cut-off number")
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        shift += 7
        if not x & 0x80:
            return n & ((1 << 64) - 1), at


def fields(b: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of every field; raises ValueError if ``b`` isn't a message."""
    at, out = 0, []
    while at < len(b):
        tag, at = get_varint(b, at)
        number, kind = tag >> 3, tag & 7
        if number == 0:
            raise ValueError("field number 0")
        if kind == 0:
            v, at = get_varint(b, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, at = b[at : at + n], at + n
        elif kind == 2:
            n, at = get_varint(b, at)
            v, at = b[at : at + n], at + n
        else:
            raise ValueError("unknown wire type")
        if at > len(b):
            raise ValueError("cut-off field")
        out.append((number, v))
    return out


def metadata_bytes(m: dict) -> bytes:
    out = b""
    for number, name in METADATA_NUMBERS.items():
        v = m.get(name)
        if not v:
            continue
        if name in TEXT_FIELDS:
            raw = str(v).encode()
            out += put_varint(number << 3 | 2) + put_varint(len(raw)) + raw
        else:
            out += put_varint(number << 3) + put_varint(int(v))
    return out


def metadata_of(b: bytes) -> dict:
    m: dict = {name: "" if name in TEXT_FIELDS else 0 for name in METADATA_NUMBERS.values()}
    for number, v in fields(b):
        name = METADATA_NUMBERS.get(number)
        if name is None:
            continue
        if (name in TEXT_FIELDS) != isinstance(v, bytes):
            raise ValueError("wrong wire type")
        m[name] = v.decode() if isinstance(v, bytes) else v - (1 << 64) if v >> 63 else v
    return m


def envelope_bytes(metadata: dict, task: bytes) -> bytes:
    inner = metadata_bytes(metadata)
    out = put_varint(ENVELOPE_METADATA << 3 | 2) + put_varint(len(inner)) + inner
    return out + (put_varint(ENVELOPE_TASK << 3 | 2) + put_varint(len(task)) + task if task else b"")


def envelope_of(b: bytes) -> tuple[dict, bytes]:
    metadata, task = {}, b""
    for number, v in fields(b):
        if number == ENVELOPE_METADATA and isinstance(v, bytes):
            metadata = metadata_of(v)
        elif number == ENVELOPE_TASK and isinstance(v, bytes):
            task = v
    return metadata or metadata_of(b""), task


# --- writing, on Arrow buffers ----------------------------------------------------


class _Writer:
    """Messages side by side, put together from pieces: of each, its size per row and its bytes for all rows."""

    def __init__(self, n: int):
        self.n, self.pieces = n, []

    def varint(self, value: np.ndarray, some: np.ndarray, tag: int | None = None) -> None:
        """A number (with its tag before it) in the rows where ``some`` holds."""
        v = value.astype(np.int64).view(np.uint64)
        parts = (v[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))) & np.uint64(0x7F)
        size = np.maximum(1, 10 - (parts[:, ::-1] != 0).argmax(1))
        size[~parts.any(1)] = 1
        low = np.arange(10)[None, :] < size[:, None]
        out = (parts | np.where(np.arange(10)[None, :] < size[:, None] - 1, np.uint64(0x80), np.uint64(0))).astype(np.uint8)
        if tag is not None:
            out, low = np.column_stack([np.full(self.n, tag, np.uint8), out]), np.column_stack([np.ones(self.n, bool), low])
        low &= some[:, None]
        self.pieces.append((low.sum(1), out[low]))

    def raw(self, sizes: np.ndarray, data: np.ndarray) -> None:
        self.pieces.append((sizes, data))

    def text(self, number: int, column: pa.Array) -> None:
        """A field of bytes; nothing in rows where it is empty."""
        b = Batch.of(column)
        sizes = np.where(b.good, b.end - b.start, 0)
        self.varint(sizes, sizes > 0, number << 3 | 2)
        self.raw(sizes, _gather(b.data, b.start, sizes))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, bytes) of the messages."""
        total = sum(sizes for sizes, _ in self.pieces) if self.pieces else np.zeros(self.n, np.int64)
        at = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint8)
        for sizes, data in self.pieces:
            out[_places(at, sizes)] = data
            at = at + sizes
        return total, out


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The members of the ranges that begin there, one range after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)


def _gather(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[_places(begin, sizes)]


def _binary(sizes: np.ndarray, data: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    got = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())
    return got if null is None else pc.if_else(pa.array(null), pa.scalar(None, pa.binary()), got)


def _write_metadata(m: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    w = _Writer(len(m))
    for number, name in METADATA_NUMBERS.items():
        column = pc.struct_field(m, name)
        if name in TEXT_FIELDS:
            w.text(number, column.cast(pa.binary()))
        else:
            v = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            w.varint(v, v != 0, number << 3)
    return w.done()


def encode_metadata(metadata: Column) -> Column:
    """Metadata struct -> message bytes; a null struct stays null, null fields count as their defaults."""

    @F.arrow_udf("binary")
    def run(m: pa.Array) -> pa.Array:
        return _binary(*_write_metadata(m), m.is_null().to_numpy(zero_copy_only=False))

    return run(metadata.cast(METADATA_TYPE))


def encode_envelope(metadata: Column, task: Column) -> Column:
    """Legacy envelope bytes of a metadata struct and task bytes; null ones count as empty."""

    @F.arrow_udf("binary")
    def run(m: pa.Array, t: pa.Array) -> pa.Array:
        sizes, data = _write_metadata(m)
        w = _Writer(len(m))
        w.varint(sizes, np.ones(len(m), bool), ENVELOPE_METADATA << 3 | 2)
        w.raw(sizes, data)
        w.text(ENVELOPE_TASK, t)
        return _binary(*w.done())

    return run(metadata.cast(METADATA_TYPE), task)


# --- reading, on Arrow buffers ----------------------------------------------------


class Batch:
    """Messages side by side: their bytes, and where each one begins and ends (null messages are empty and not ``good``)."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, good: np.ndarray):
        # a few bytes beyond the last message may be looked at, never used
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.start, self.end, self.good = start.astype(np.int64), end.astype(np.int64), good.copy()

    @staticmethod
    def of(column: pa.Array) -> Batch:
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        return Batch(data, offsets[:-1], offsets[1:], column.is_valid().to_numpy(zero_copy_only=False))

    def varint(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, place after it, is it whole) of the numbers at these places."""
        value = np.zeros(len(at), np.uint64)
        after, open_ = at.copy(), np.ones(len(at), bool)
        for i in range(10):
            inside = open_ & (after < end)
            byte = np.where(inside, self.data[np.minimum(after, len(self.data) - 1)], 0).astype(np.uint64)
            value |= (byte & np.uint64(0x7F)) << np.uint64(7 * i)
            after += inside
            open_ = inside & (byte >= 0x80) | (open_ & ~inside)
            if not open_.any():
                break
        return value, after, ~open_

    def fields(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Field by field of all messages: (rows, numbers, wire types, numeric values, begin and end of bytes).

        A message that breaks off or has an unknown wire type stops being good.
        """
        at = self.start.copy()
        while True:
            rows = np.flatnonzero(self.good & (at < self.end))
            if not len(rows):
                return
            end = self.end[rows]
            tag, after, whole = self.varint(at[rows], end)
            number, kind = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
            value, past, whole2 = self.varint(after, end)
            numeric = (kind == 0) | (kind == 2)
            begin = np.where(kind == 2, past, after)
            length = np.where(kind == 1, 8, np.where(kind == 5, 4, np.where(kind == 2, np.minimum(value, np.uint64(2**62)).astype(np.int64), 0)))
            stop = np.where(kind == 0, past, begin + length)
            ok = whole & (number > 0) & np.isin(kind, (0, 1, 2, 5)) & (whole2 | ~numeric) & (stop <= end)
            self.good[rows[~ok]] = False
            at[rows] = np.where(ok, stop, end)
            yield rows[ok], number[ok], kind[ok], value[ok], begin[ok], stop[ok]


def _slices(batch: Batch, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between these places, one value per row."""
    return _binary(end - begin, _gather(batch.data, begin, end - begin))


def read_metadata(batch: Batch) -> dict[str, pa.Array | np.ndarray]:
    """The metadata of all messages, per field; rows that can't be read are no longer ``good``. Of a field that occurs twice the last one counts."""
    n = len(batch.start)
    numbers = {name: np.zeros(n, np.int64) for name in METADATA_NUMBERS.values() if name not in TEXT_FIELDS}
    texts = {name: (np.zeros(n, np.int64), np.zeros(n, np.int64)) for name in TEXT_FIELDS}
    for rows, number, kind, value, begin, end in batch.fields():
        for which, name in METADATA_NUMBERS.items():
            mine = number == which
            if not mine.any():
                continue
            wrong = mine & (kind != (2 if name in TEXT_FIELDS else 0))
            batch.good[rows[wrong]] = False
            mine &= ~wrong
            if name in TEXT_FIELDS:
                texts[name][0][rows[mine]], texts[name][1][rows[mine]] = begin[mine], end[mine]
            else:
                numbers[name][rows[mine]] = value[mine].view(np.int64)
    out: dict = {}
    for name in METADATA_NUMBERS.values():
        if name not in TEXT_FIELDS:
            out[name] = numbers[name]
            continue
        raw = _slices(batch, *texts[name])
        try:
            out[name] = raw.cast(pa.string())
        except pa.ArrowInvalid:  # some text isn't UTF-8: find which
            values = []
            for i, x in enumerate(raw.to_pylist()):
                try:
                    values.append(x.decode())
                except UnicodeDecodeError:
                    batch.good[i] = False
                    values.append("")
            out[name] = pa.array(values, pa.string())
    return out


def decode_metadata(raw: Column) -> Column:
    """Message bytes -> metadata struct; null for null and for bytes that aren't a message."""

    @F.arrow_udf(METADATA_TYPE)
    def run(column: pa.Array) -> pa.Array:
        batch = Batch.of(column)
        got = read_metadata(batch)
        arrays = [got[n] if n in TEXT_FIELDS else pa.array(got[n]) for n in METADATA_NUMBERS.values()]
        return pa.StructArray.from_arrays(arrays, list(METADATA_NUMBERS.values()), mask=pa.array(~batch.good))

    return run(raw)


def decode_envelope(raw: Column) -> Column:
    """Legacy envelope bytes -> struct(metadata bytes, task); null for bytes that aren't an envelope, or whose metadata isn't a message.

    Of a part that occurs twice the last one counts; one of another wire type is skipped.
    """

    @F.arrow_udf("struct<metadata:binary,task:binary>")
    def run(column: pa.Array) -> pa.Array:
        batch = Batch.of(column)
        n = len(batch.start)
        places = {ENVELOPE_METADATA: (np.zeros(n, np.int64), np.zeros(n, np.int64)), ENVELOPE_TASK: (np.zeros(n, np.int64), np.zeros(n, np.int64))}
        for rows, number, kind, _, begin, end in batch.fields():
            for which, (a, b) in places.items():
                mine = (number == which) & (kind == 2)
                a[rows[mine]], b[rows[mine]] = begin[mine], end[mine]
        inner = Batch(batch.data, *places[ENVELOPE_METADATA], batch.good)
        read_metadata(inner)  # says which ones are messages
        parts = [_slices(batch, *places[k]) for k in (ENVELOPE_METADATA, ENVELOPE_TASK)]
        return pa.StructArray.from_arrays(parts, ["metadata", "task"], mask=pa.array(~inner.good))

    return run(raw)
