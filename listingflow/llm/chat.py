"""Chat formatting by columnar byte assembly.

A turn is written as a header, its text and an end mark:

    ### Assistant: text</turn>

In texts a backslash, "### " and "</turn>" get a backslash in front, so a text can
forge no turn and reading back is exact. A role outside of ROLES is written after
an equals sign, with colons escaped too.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length
is spread over tasks. A task takes slices of a few megabytes of text. In a slice
numpy finds what to escape over the bytes of all texts at once, adds up the lengths
of headers, escaped texts and end marks to offsets, and scatters headers, contents
and marks into one preallocated Arrow buffer, which is the column of formatted
pieces; no text is handled alone. A piece is what a slice has of one conversation.

Reading back parses the formatted pieces. A conversation inside one partition is
finished there; of those that a border may cut, the pieces are chained in a second
step, each hashed as it comes (a digest of a sequence has to be taken in order).
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.text import give_back, text_slices

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
LEARNT = "assistant"
HEAD, SAYS, END = b"### ", b": ", b"</turn>\n"
#: What is escaped in a text, besides the backslash itself.
CONTROLS = (b"### ", b"</turn>")
#: Bytes of one conversation that reading back holds before it passes them on.
HELD = 16 << 20

PIECE = "conv_id long, turn long, role string, h long, part long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_NAMED = {v.encode(): k for k, v in ROLES.items()}
_TURN = re.compile(rb"### (=?)((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def header(role: str) -> bytes:
    if role in ROLES:
        return HEAD + ROLES[role].encode() + SAYS
    return HEAD + b"=" + re.sub(rb"([\\:#<])", rb"\\\1", role.encode()) + SAYS


def unescaped(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data)


def _hits(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of bytes that get a backslash in front; no control string crosses
    the end of a text (ends, sorted)."""
    found = [np.flatnonzero(data == ord("\\"))]
    for mark in CONTROLS:
        at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        found.append(at[at + len(mark) <= ends[np.searchsorted(ends, at, side="right")]])
    return np.sort(np.concatenate(found))


def _scatter(out: np.ndarray, at: np.ndarray, what: bytes) -> None:
    out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and the offsets of each text in them."""
    flat = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces_of(b: pa.RecordBatch, part: int) -> pa.RecordBatch:
    """The formatted pieces of rows in order; part is the first one's number."""
    data, offsets = _bytes(b.column("text"))
    roles = pc.fill_null(b.column("role"), "").dictionary_encode()
    names, role = [header(r) for r in roles.dictionary.to_pylist()], roles.indices.to_numpy()
    hits = _hits(data, offsets[1:])
    before = np.searchsorted(hits, offsets)
    heads = np.array([len(x) for x in names], np.int64)[role]
    bodies = np.diff(offsets) + np.diff(before)
    turns = np.concatenate([[0], np.cumsum(heads + bodies + len(END))])
    buffer = pa.allocate_buffer(int(turns[-1]))
    out = np.frombuffer(buffer, np.uint8)
    text_at = turns[:-1] + heads
    for k, name in enumerate(names):
        _scatter(out, turns[:-1][role == k], name)
    marks = np.zeros(len(data), np.int64)
    marks[hits] = 1
    to = np.arange(len(data)) + np.repeat(text_at - offsets[:-1] - before[:-1], np.diff(offsets)) + np.cumsum(marks)
    out[to] = data
    out[to[hits] - 1] = ord("\\")
    _scatter(out, text_at + bodies, END)

    conv = b.column("conv_id")
    ids, none = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1
    first = np.concatenate([[0], new]).astype(np.int64)
    last = np.append(first[1:], b.num_rows)
    places = np.append(turns[first], turns[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(places), buffer)
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    learnt = np.flatnonzero(np.array([r == LEARNT for r in roles.dictionary.to_pylist()], bool)[role])
    base = chars[places[np.searchsorted(first, learnt, side="right") - 1]]
    lists = pa.array(np.searchsorted(learnt, np.append(first, b.num_rows)), pa.int32())
    spans = [pa.ListArray.from_arrays(lists, pa.array(chars[at] - base, pa.int64())) for at in (text_at[learnt], (text_at + bodies)[learnt])]
    keys = [b.column(c).take(pa.array(first)) for c in ("conv_id", "turn", "role", "h")]
    columns = [*keys, pa.array(part + np.arange(len(first)), pa.int64()), pa.array(last - first, pa.int64()), formatted.cast(pa.string()), *spans]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "h", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = 0
    for b in text_slices(batches):
        out = pieces_of(b, part)
        part += out.num_rows
        yield out
    give_back()


def formatted(turns: DataFrame) -> DataFrame:
    """Pieces of formatted conversations: (conv_id, turn, role, h, part, n_turns,
    formatted, loss_start, loss_end).

    turns has conv_id, turn, role and text; other columns play no part. Turns are
    in order of turn (nulls first); equal ones by role, then text. Null texts and
    roles are empty; rows without conv_id are one conversation; repeated rows are
    turns each. The pieces of a conversation, sorted by (turn, role, h, part),
    joined, are its text. loss_start and loss_end are the spans of a piece, in
    code points, in which assistants' (escaped) texts lie. A turn is never cut. An
    empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    order = ("conv_id", "turn", "role", "h")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(assembled, PIECE)


class Digest:
    """What is said of one conversation, gathered piece by piece."""

    def __init__(self):
        self.n, self.chars, self.learnt = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        """One formatted piece; ValueError if it is none."""
        data, at = text.encode(), 0
        while at < len(data):
            if not (m := _TURN.match(data, at)):
                raise ValueError("not a formatted conversation")
            at = m.end()
            role = unescaped(m[2]) if m[1] else _NAMED[m[2]].encode()
            self.n += 1
            for x in (role, b"\n", unescaped(m[3]), b"\n"):
                self.turns.update(x)
        self.chars += len(text)
        for a, z in zip(starts, ends, strict=True):
            said = unescaped(text[a:z].encode())
            self.learnt += len(said.decode())
            self.loss.update(said)

    def values(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars


_KEYS = ["conv_id", "turn", "role", "h", "part"]
_OPEN = ["formatted", "loss_start", "loss_end"]
_SAID = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
READ = "conv_id long, turn long, role string, h long, part long, formatted string, loss_start array<long>, loss_end array<long>, " + DIGEST
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, of slices of bounded text."""
    for b in text_slices(batches, column="formatted"):
        yield from b.to_pylist()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    names = [*_KEYS, *_OPEN, *_SAID]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, _TYPES, strict=True)], names)


def _sized(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 256 + len(r.get("formatted") or "")
        if size > 4 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _finished(key: int | None, pieces: list[dict]) -> dict:
    d = Digest()
    for p in pieces:
        d.add(p["formatted"], p["loss_start"], p["loss_end"])
    return {"conv_id": key} | dict(zip(_SAID, d.values(), strict=True))


def _closed(rows: Iterator[dict]) -> Iterator[dict]:
    """Digests of conversations that lie inside the partition; pieces of its first
    and last one, and of those that are too long to hold."""
    key, held, size, passing, begun = None, [], 0, True, False
    for r in rows:
        if begun and r["conv_id"] != key:
            if not passing:
                yield _finished(key, held)
            held, size, passing = [], 0, False
        begun, key = True, r["conv_id"]
        if not passing:
            held.append(r)
            size += len(r["formatted"])
            passing = size > HELD
            if passing:
                yield from held
                held = []
        else:
            yield r
    yield from held


def _chained(rows: Iterator[dict]) -> Iterator[dict]:
    """Digests as they are, and those of the pieces of one conversation in order."""
    key, d = None, None
    for r in rows:
        if d and r["conv_id"] != key:
            yield {"conv_id": key} | dict(zip(_SAID, d.values(), strict=True))
            d = None
        if r["turns_sha256"] is not None:
            yield r
        else:
            key, d = r["conv_id"], d or Digest()
            d.add(r["formatted"], r["loss_start"], r["loss_end"])
    if d:
        yield {"conv_id": key} | dict(zip(_SAID, d.values(), strict=True))


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sized({c: v for c, v in r.items() if c != "n_turns"} if r.get("formatted") is not None else r for r in _closed(_rows(batches)))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sized(_chained(_rows(batches)))


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    of pieces as formatted() gives them, in its layout.

    turns_sha256 is of role, line feed, text, line feed for each turn; loss_sha256
    of the text in the loss spans; both of texts without their escapes. Only
    pieces at the borders of partitions are dealt anew, by conversation.
    """
    first = pieces.mapInArrow(closed, READ)
    dealt = first.repartition("conv_id").sortWithinPartitions(*_KEYS)
    return dealt.mapInArrow(chained, READ).select("conv_id", *_SAID)
