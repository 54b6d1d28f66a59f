r"""Chat formatting by columnar byte assembly.

Every turn becomes ``### role\n`` + text + ``</turn>\n``. Inside roles and
texts a backslash goes before each backslash, ``###`` and ``</turn>`` (in roles
also before a line end), so neither marker can be forged and removing one
backslash before any character restores the text. All segments of a batch are
copied into one preallocated buffer: lengths, cumulative offsets and scatter
indices are computed with numpy, the buffer becomes an Arrow string array.

Rows are dealt by ranges of (conversation, turn), sorted by (turn, role, text)
and streamed. A long conversation is thus formatted by several tasks and comes
in several pieces, numbered in order; memory stays bounded by a batch.

A digest reads pieces back. Conversations that lie within one partition are
digested where they are; only the pieces of those that may go on in the next
partition, or are larger than a batch, move once more, to be digested in order.

Defined results: null roles and texts count as empty; null conversation ids
form one conversation; rows equal in turn are ordered by role, then text;
repeated rows stay; an empty table gives no rows; other columns are ignored,
whatever their names; a conversation numbered -7 takes in the query's own two
rows; a turn of any length is one piece, which must fit into a task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HEAD, HEAD_END, TAIL = "### ", "\n", "</turn>\n"
LEARNED_ROLE = "assistant"
PIECE_SCHEMA = "conv_id long, piece long, n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>"
#: Bytes assembled at once; a piece's offsets stay far below 2**31.
BATCH_BYTES = 1 << 25

TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.fill_null(column.cast(pa.string()), "")
    out = pc.replace_substring(out, "\\", "\\\\")
    for mark in ("###", "</turn>", *(["\n"] if role else [])):
        out = pc.replace_substring(out, mark, "\\" + mark)
    return out


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a string array without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at[:-1], np.diff(at)


def _scatter(out: np.ndarray, to: np.ndarray, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
    total = int(lens.sum())
    if total:
        ahead = np.cumsum(lens) - lens
        step = np.arange(total)
        out[np.repeat(to - ahead, lens) + step] = raw[np.repeat(starts - ahead, lens) + step]


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """One row per run of equal conversation ids."""
    n = len(conv)
    heads = pc.binary_join_element_wise(HEAD, escape(role, role=True), HEAD_END, "")
    parts = [_bytes_of(heads), _bytes_of(escape(text)), _bytes_of(pa.array([TAIL] * n, pa.string()))]
    lens = np.stack([p[2] for p in parts], axis=1)
    ends = np.cumsum(lens.ravel()).reshape(n, 3)
    begins = ends - lens
    out = np.empty(int(ends[-1, 2]) if n else 0, np.uint8)
    for k, (raw, starts, size) in enumerate(parts):
        _scatter(out, begins[:, k], raw, starts, size)
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    void = conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (void[1:] != void[:-1])
    first = np.flatnonzero(new)
    base = begins[first, 0]
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(base, len(out)).astype(np.int32)), pa.py_buffer(out))
    learned = pc.fill_null(pc.equal(role, LEARNED_ROLE), False).to_numpy(zero_copy_only=False)
    run = np.cumsum(new) - 1
    counts = np.bincount(run[learned], minlength=len(first))
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    spans = [pa.ListArray.from_arrays(offsets, pa.array((side[learned, 1] - base[run[learned]]).astype(np.int32))) for side in (begins, ends)]
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(np.diff(np.append(first, n)), pa.int64()), formatted, *spans], ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])


def _pieces(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        conv, role, text = batch.column(0), batch.column(1), batch.column(2)
        # what a turn becomes: its role and text, twice as long at most for escapes, and the markers
        parts = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (role, text)]
        size = np.cumsum(2 * (parts[0] + parts[1]) + 16)
        start = 0
        while start < len(conv):
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + BATCH_BYTES, side="right")))
            made = assemble(conv.slice(start, stop - start), role.slice(start, stop - start), text.slice(start, stop - start))
            order = pa.array(np.arange(number, number + made.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([made.column(0), order, *made.columns[1:]], [c.rpartition(" ")[0].strip() for c in re.split(r",(?![^<]*>)", PIECE_SCHEMA)])
            number += made.num_rows
            start = stop


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted pieces with the byte spans under the loss mask, in order of piece.

    One shuffle, by ranges, so a conversation of any length is spread.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_pieces, PIECE_SCHEMA)


def read_back(formatted: str, starts: list[int], ends: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns of a piece and the texts under its loss mask, unescaped."""
    turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]
    raw = formatted.encode()
    return turns, [unescape(raw[a:b].decode()) for a, b in zip(starts, ends)]


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        turns, learned = read_back(formatted, starts, ends)
        self.n += len(turns)
        self.chars += len(formatted)
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in learned:
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


DIGEST_NAMES = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
DIGEST_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _digested(pieces) -> _Digest:
    now = None
    for piece in pieces:
        row = piece.to_pylist()[0]
        now = now or _Digest(row["conv_id"])
        now.add(row["formatted"], row["loss_starts"], row["loss_ends"])
    return now


def _settled(batches):
    """Digests of conversations that are whole, and the other pieces as they are."""
    kinds = pa.schema([(n, k) for n, k in zip(DIGEST_NAMES, DIGEST_KINDS)])
    held, size, ended, first = [], 0, [], True

    def moved(piece):
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, k.type) for k in kinds], pa.array([True]), *piece.columns], [*kinds.names, "open", *[f"p_{n}" for n in piece.schema.names]])

    def whole(rows, like):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), DIGEST_KINDS)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([False] * len(rows)), *[pa.nulls(len(rows), f.type) for f in like.schema]], [*kinds.names, "open", *[f"p_{n}" for n in like.schema.names]])

    now, loose, last = None, False, None
    for piece in _rows(batches):
        conv = (piece.column(0)[0].as_py(),)
        if conv != now:
            if held and not loose and not first:
                ended.append(_digested(held).row())
            else:
                yield from map(moved, held)
            first = now is None
            now, loose, held, size = conv, False, [], 0
            if len(ended) >= 1000:
                yield whole(ended, piece)
                ended = []
        size += piece.nbytes
        if loose or size > BATCH_BYTES:
            yield from map(moved, held)
            yield moved(piece)
            loose, held = True, []
        else:
            held.append(piece)
        last = piece
    yield from map(moved, held)  # may go on in the next partition
    if ended:
        yield whole(ended, last)


def _digests(batches):
    now, rows = None, []
    for piece in _rows(batches):
        row = piece.to_pylist()[0]
        if now is None or now.conv_id != row["conv_id"]:
            if now is not None:
                rows.append(now.row())
            now = _Digest(row["conv_id"])
        now.add(row["formatted"], row["loss_starts"], row["loss_ends"])
    if now is not None:
        rows.append(now.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), DIGEST_KINDS)], DIGEST_NAMES)


def digest(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted pieces."""
    carried = ", ".join("p_" + c.strip() for c in re.split(r",(?![^<]*>)", PIECE_SCHEMA))
    settled = stored(pieces.mapInArrow(_settled, f"{DIGEST_SCHEMA}, open boolean, {carried}"), "chats")
    whole = settled.where("NOT open").select(*DIGEST_NAMES)
    moved = settled.where("open").select(*[F.col(f"p_{c}").alias(c) for c in pieces.columns])
    rest = moved.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_digests, DIGEST_SCHEMA)
    return whole.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(format_chats(turns.unionByName(extra)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\' || chr(10))) AS r,
  length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + r + 1 + x + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
