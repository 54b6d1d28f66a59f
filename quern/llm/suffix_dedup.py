"""Removal of repeated 100-byte strings, after blockwise suffix sorting with a
difference cover.

A suffix array of the whole corpus would bring equal strings together. It is
never held: suffixes are compared to depth L = 100 only, and are sorted one
bucket at a time.

blocks    Documents that share a line are packed next to each other (range
          partitions of a least line hash) into blocks of a few MB, so that
          most repetition is settled inside a block.
cover     Positions p with p mod v in a difference cover D of v are samples.
          For any two positions i, j some shift t below v makes both i + t and
          j + t samples, so equal L-byte strings share a sample k-gram,
          k = L - v + 1, at one shift. Samples whose k-gram occurs in one place
          only can tie with nothing. They are told apart by hashed names,
          bucket by bucket; a hash that lets too many pass costs time only.
hot       A k-gram that occurs HOT_SAMPLES times, such as a licence phrase whose
          surroundings differ, would fill its bucket with one row for each
          surrounding. The strings of L bytes around it are taken themselves:
          first their names, spread over all buckets, then those that occur in
          two blocks as samples of their own, which serve the shift 0 only.
ranks     The samples left over come to their bucket with the v - 1 bytes on
          either side. The bucket sorts their k-grams, as bytes, and numbers
          them: that is their rank.
suffixes  The suffix that begins t bytes before a sample is, to depth L, its
          prefix of t bytes, then the sample's rank, then v - 1 - t bytes.
          For each t the bucket sorts by a hash of rank, prefix and end, and
          compares neighbours of equal hash as bytes; ties are equal strings,
          and the earliest of each run of ties is kept. Every pair of equal
          strings meets at some t, or at a hot k-gram as whole strings.

A block sends each distinct sample once. A sample is distinct with the bytes on
either side, so a k-gram sends a row for each surrounding it has in a block;
beyond HOT_SAMPLES of them it is hot. A string that is in all blocks is still
sent once per block, to one bucket. A bucket answers with two bits per name,
then with v bits per sample. The number of buckets follows the size of the
corpus without a cap. A block sends a row for each bucket it has names for: no
more rows than names.

Equal strings are told by hash names and compared as bytes, within a block and
within a bucket; strings whose names collide are sorted as bytes.

Defined results: null texts are empty; texts under L bytes lose nothing;
repeated rows: of rows with equal ids the one whose text sorts first counts as
earlier within a block, else the one in the block with the smaller number;
null ids come first; an empty table gives no rows; further columns are ignored,
whatever their names. A document must fit into a task's memory about forty times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, mix

LENGTH = 100
#: A perfect difference set: every residue modulo COVER_MOD is a difference.
COVER, COVER_MOD = (0, 1, 3, 13, 32, 36, 43, 52), 57
#: Bytes on either side of a sample that the suffixes it serves reach.
SIDE = COVER_MOD - 1
BLOCK_BYTES = 3 << 20
#: Text bytes per bucket.
BUCKET_BYTES = 8 << 20
BASE = 0x100000001B3
SUB = 1 << 17
#: Strings compared byte by byte at once.
ROWS = 1 << 15
#: Occurrences from which a k-gram is hot; rows of 166 bytes, so about a megabyte in a bucket before.
HOT_SAMPLES = 1 << 13
#: Smaller numbers of occurrences in a block count as one and are not sent along: a hot k-gram may so have eight
#: times HOT_SAMPLES rows before it is told.
LEAST_COUNT = 8

assert {(a - b) % COVER_MOD for a in COVER for b in COVER} == set(range(COVER_MOD))


def gram_names(data: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """64-bit names of the n-grams that start at the given ascending places, by doubling.

    The bytes are named in small pieces, which stay in the processor's cache;
    only the names asked for are kept.
    """
    out = np.empty(len(at), np.uint64)
    m = len(data) - n + 1
    for a in range(0, max(m, 0), SUB):
        b = min(m, a + SUB)
        lo, hi = np.searchsorted(at, (a, b))
        if lo == hi:
            continue
        x = data[a : b + n - 1].astype(np.uint64) + np.uint64(1)
        total, offset, width = np.zeros(b - a, np.uint64), 0, 1
        while True:
            if n & width:
                total += x[offset : offset + b - a] * np.uint64(pow(BASE, offset, 1 << 64))
                offset += width
            if width * 2 > n:
                break
            x = x[:-width] + x[width:] * np.uint64(pow(BASE, width, 1 << 64))
            width *= 2
        out[lo:hi] = mix(total[at[lo:hi] - a])
    return out


class Block:
    """Texts of a block, laid end to end, in order of (id, text)."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.void = np.frombuffer(row["void"], bool)
        self.lens = np.frombuffer(row["lens"], np.int64)
        size = int(self.lens.sum())
        raw = pa.Codec("zstd").decompress(row["data"], decompressed_size=size) if size else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens
        small = np.int32 if size < 1 << 31 else np.int64
        self.pos = np.arange(size, dtype=small) - np.repeat(self.starts.astype(small), self.lens)
        self.left = np.repeat(self.lens.astype(small), self.lens) - self.pos

    def samples(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover samples and their k-gram names."""
        k = length - COVER_MOD + 1
        of_cover = np.zeros(COVER_MOD, bool)
        of_cover[list(COVER)] = True
        at = np.flatnonzero(of_cover[self.pos % COVER_MOD] & (self.left >= k))
        return at, gram_names(self.data, k, at)

    def candidates(self, length: int, at: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Starts of L-grams with a repeated sample in reach, as a bit per byte."""
        return self._reached(length, at[repeated])

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        """Strings of so many bytes that start at the given places (which may reach beyond the text), as rows."""
        size, before = len(self.data), max(0, -int(at.min(initial=0)))
        after = max(0, int(at.max(initial=0)) + length - size)
        data = np.concatenate([np.zeros(before, np.uint8), self.data, np.zeros(after, np.uint8)]) if before or after else self.data
        return np.lib.stride_tricks.sliding_window_view(data, length)[at + before]

    def classes(self, spots: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(class of each spot, first spot of each class): spots whose strings are equal.

        Told by name; spots of one name are compared as bytes, and named anew by their bytes if they differ.
        """
        names = gram_names(self.data, length, spots)
        order = np.argsort(names, kind="stable")
        new = np.ones(len(spots), bool)
        new[1:] = names[order[1:]] != names[order[:-1]]
        order, new = _verified(order, new, lambda members: self.rows(spots[members], length))
        index = np.empty(len(spots), np.int64)
        index[order] = np.cumsum(new) - 1
        return index, spots[order[new]]

    def hot_starts(self, length: int, hot: np.ndarray) -> np.ndarray:
        """Starts of L-grams with one of the given (hot) places in reach."""
        return np.flatnonzero(self._reached(length, hot))

    def _reached(self, length: int, places: np.ndarray) -> np.ndarray:
        size = len(self.data)
        flag = np.zeros(size + COVER_MOD, np.int32)
        flag[places] = 1
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return (total[COVER_MOD : COVER_MOD + size] > total[:size]) & (self.left >= length)


def _verified(order: np.ndarray, new: np.ndarray, strings) -> tuple[np.ndarray, np.ndarray]:
    """An order with the starts of its runs of equal names, after runs whose strings differ are sorted as bytes.

    strings(members) gives rows of bytes. Equal strings have equal names, so runs are only ever cut.
    """
    pairs, wrong = np.flatnonzero(~new), []
    for i in range(0, len(pairs), ROWS):
        p = pairs[i : i + ROWS]
        differ = (strings(order[p]) != strings(order[p - 1])).any(axis=1)
        if differ.any():
            wrong.append(p[differ])
    if not wrong:
        return order, new
    runs = np.cumsum(new) - 1
    bad = np.isin(runs, runs[np.concatenate(wrong)])
    members = order[bad]
    by_bytes = np.unique(_bytes_of(strings(members)), return_inverse=True)[1].ravel()
    again = np.argsort(by_bytes, kind="stable")
    return np.concatenate([order[~bad], members[again]]), np.concatenate([new[~bad], np.diff(by_bytes[again], prepend=-1) != 0])


def _bytes_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as single values that sort in byte order."""
    return np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()


def pack(steps: Steps, docs: DataFrame) -> DataFrame:
    """Blocks (block, ids, void, lens, data, size), stored in the shared folder."""
    schema = "block long, ids binary, void binary, lens binary, data binary, size long"

    def run(batches):
        from pyspark import TaskContext

        codec, seq, held, size = pa.Codec("zstd"), 0, [], 0
        part = TaskContext.get().partitionId()

        def emit():
            held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            data = b"".join(r[1] for r in held)
            cols = {
                "block": pa.array([(part << 32) + seq], pa.int64()),
                "ids": pa.array([np.array([-(2**63) if r[0] is None else r[0] for r in held], np.int64).tobytes()], pa.binary()),
                "void": pa.array([np.array([r[0] is None for r in held], bool).tobytes()], pa.binary()),
                "lens": pa.array([np.array([len(r[1]) for r in held], np.int64).tobytes()], pa.binary()),
                "data": pa.array([codec.compress(data).to_pybytes() if data else b""], pa.binary()),
                "size": pa.array([len(data)], pa.int64()),
            }
            return pa.RecordBatch.from_arrays([*cols.values()], [*cols])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if held and size + len(raw) > BLOCK_BYTES:
                    yield emit()
                    seq, held, size = seq + 1, [], 0
                held.append((doc_id, raw))
                size += len(raw)
        if held:
            yield emit()

    text = F.coalesce("text", F.lit(""))
    least = F.array_min(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), least.alias("least"))
    near = keyed.repartitionByRange("least", "doc_id").sortWithinPartitions("least", "doc_id")
    return steps.stored(near.select("doc_id", "text").mapInArrow(run, schema), "blocks")


def bucket_bits(blocks: DataFrame) -> int:
    """Buckets are the leading bits of names; so many that a bucket stands for BUCKET_BYTES of text."""
    total, bits = blocks.agg(F.sum("size")).first()[0] or 0, 0
    while (BUCKET_BYTES << bits) < total:
        bits += 1
    return bits


def _bucket_of(names: np.ndarray, bits: int) -> np.ndarray:
    return (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)


def _coded(names: np.ndarray) -> bytes:
    """The upper 48 bits of sorted names (a filter needs no more) as first value, differences and the few large ones."""
    names = names >> np.uint64(16)
    step = np.diff(names, prepend=names[:1])
    large = np.flatnonzero(step >> np.uint64(32))
    low = step.view(np.uint8).reshape(-1, 8)[:, :4]
    head = np.array([len(step), len(large)], np.int64).tobytes() + names[:1].tobytes()
    return head + low.tobytes() + large.astype(np.int64).tobytes() + (step[large] >> np.uint64(32)).tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    n, k = np.frombuffer(raw, np.int64, 2)
    first = np.frombuffer(raw, np.uint64, 1, 16)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :4] = np.frombuffer(raw, np.uint8, n * 4, 24).reshape(n, 4)
    step = wide.view(np.uint64).ravel()
    at = 24 + n * 4
    step[np.frombuffer(raw, np.int64, k, at)] |= np.frombuffer(raw, np.uint64, k, at + 8 * k) << np.uint64(32)
    return first + np.cumsum(step, dtype=np.uint64)


SCHEMA = "bucket long, block long, n long, body binary"


def _rows_of_buckets(block: int, names: np.ndarray, bits: int, body) -> pa.RecordBatch:
    """A row for each bucket that sorted names fall into; body(a, b) codes the names from a to b."""
    used, starts = np.unique(_bucket_of(names, bits), return_index=True)
    ends = np.append(starts[1:], len(names))
    cols = [pa.array(used, pa.int64()), pa.array([block] * len(used), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([body(a, b) for a, b in zip(starts, ends)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "block", "n", "body"])


def _answered(table: pa.Table, bodies: list[bytes]) -> pa.Table:
    return pa.table({"bucket": table["bucket"], "block": table["block"], "n": table["n"], "body": pa.array(bodies, pa.binary())})


def _coded_counts(names: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted names, then places and numbers of those that occur LEAST_COUNT times or more."""
    many = np.flatnonzero(counts >= LEAST_COUNT)
    coded = _coded(names)
    return np.array([len(coded)], np.int64).tobytes() + coded + many.astype(np.int64).tobytes() + counts[many].astype(np.int64).tobytes()


def _decoded_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    names = _decoded(raw[8 : 8 + size])
    rest = np.frombuffer(raw[8 + size :], np.int64)
    counts = np.ones(len(names), np.int64)
    counts[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return names, counts


def _seen_twice(table):
    """Which names of a bucket occur in more than one block, and which of them are hot: two bits a name."""
    coded = [_decoded_counts(x) for x in table["body"].to_pylist()]
    whole, counts = np.concatenate([n for n, _ in coded]), np.concatenate([c for _, c in coded])
    order = np.argsort(whole)
    s = whole[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(starts, len(s)))
    total = np.add.reduceat(counts[order], starts)
    bits = np.zeros((2, len(s)), bool)
    bits[0, order] = np.repeat(size > 1, size)
    bits[1, order] = np.repeat((size > 1) & (total >= HOT_SAMPLES), size)
    ends = np.cumsum([len(n) for n, _ in coded])
    own = [bits[:, e - len(n) : e] for (n, _), e in zip(coded, ends)]
    out = _answered(table, [np.packbits(x).tobytes() for x in own])
    return out.append_column("hot", pa.array([bool(x[1].any()) for x in own]))


def _bits_of(answers: list[dict] | None) -> np.ndarray:
    """Two rows of bits, a column for each name of a block in order: repeated, hot."""
    got = [np.unpackbits(np.frombuffer(r["body"], np.uint8), count=2 * r["n"]).reshape(2, -1) for r in _in_order(answers)]
    return np.concatenate([np.empty((2, 0), np.uint8), *got], axis=1).astype(bool)


def _coded_samples(rows: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray) -> bytes:
    """Samples: their bytes with both sides, how much of the sides there is, and the first document."""
    raw = b"".join((before.astype(np.uint8).tobytes(), after.astype(np.uint8).tobytes(), first.tobytes(), np.ascontiguousarray(rows).tobytes()))
    return pa.Codec("zstd").compress(raw).to_pybytes()


def _decoded_samples(raw: bytes, n: int, width: int):
    raw = pa.Codec("zstd").decompress(raw, decompressed_size=n * (width + 10)).to_pybytes()
    whole = np.frombuffer(raw, np.uint8)
    return whole[10 * n :].reshape(n, width), whole[:n], whole[n : 2 * n], whole[2 * n : 10 * n].view(np.int64)


def _later(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of rows in an order in which the earliest of each run of ties comes first: those that are not first."""
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def tie_keys(start: np.ndarray, end: np.ndarray, t: int) -> np.ndarray:
    """Hashes of strings from those of rank and prefix, and of the end."""
    return start + mix(end + np.uint64(t + 1))


def sort_bucket(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """For each sample of a bucket the shifts t at which the string that begins t bytes before it
    begins earlier too: in a document with a smaller id, or in a block with a smaller number."""
    width, k = length + SIDE, length - SIDE
    counts = table["n"].to_numpy()
    parts = [_decoded_samples(x, n, width) for x, n in zip(table["body"].to_pylist(), counts.tolist())]
    rows, before, after, first = (np.concatenate(x) for x in zip(*parts))
    del parts
    block = np.repeat(table["block"].to_numpy(), counts)
    # ranks: the k-grams sorted and numbered
    rank = np.unique(_bytes_of(rows[:, SIDE : SIDE + k]), return_inverse=True)[1].ravel()
    masks = np.zeros(len(rows), np.uint64)
    served = [(before >= t) & (after >= SIDE - t) for t in range(SIDE + 1)]
    # samples alike on both sides: the earliest stands for all
    sides = np.concatenate([rows[:, :SIDE], rows[:, SIDE + k :], before[:, None], after[:, None]], axis=1)
    alike = np.unique(_bytes_of(np.concatenate([rank.astype(np.int64)[:, None].view(np.uint8).reshape(-1, 8), sides], axis=1)), return_inverse=True)[1].ravel()
    order = np.lexsort((block, first, alike))
    later = _later(order, np.diff(alike[order]) == 0)
    own = ~later & (np.bincount(rank[~later], minlength=rank.max(initial=0) + 1)[rank] > 1)
    live = np.flatnonzero(own)
    if len(live):
        # hashes of prefixes and ends grow by a byte at a time; places keep the earliest of a run in front
        live = live[np.lexsort((block[live], first[live]))]
        left, right = rows[live, :SIDE].astype(np.uint64) + np.uint64(1), rows[live, SIDE + k :].astype(np.uint64) + np.uint64(1)
        ends = np.zeros((SIDE + 1, len(live)), np.uint64)
        for t in range(1, SIDE + 1):
            ends[t] = mix(ends[t - 1] * np.uint64(BASE) + right[:, t - 1])
        start = mix(rank[live].astype(np.uint64) + np.uint64(1))
        for t in range(SIDE + 1):
            if t:
                start = mix(start * np.uint64(BASE) + left[:, SIDE - t])
            on = np.flatnonzero(served[t][live])
            key = tie_keys(start[on], ends[SIDE - t][on], t)
            order = np.argsort(key, kind="stable")
            new = np.ones(len(on), bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            order, new = _verified(order, new, lambda members: rows[live[on[members]], SIDE - t : SIDE - t + length])  # noqa: B023
            own = block[live[on[order]]]
            # the block of the earliest settles its own ties
            again = own != own[np.maximum.accumulate(np.where(new, np.arange(len(on)), 0))]
            masks[live[on[order[again]]]] |= np.uint64(1) << np.uint64(t)
    everywhere = np.zeros(len(rows), np.uint64)
    for t in range(SIDE + 1):
        everywhere[served[t]] |= np.uint64(1) << np.uint64(t)
    masks[later] = everywhere[later]
    ends = np.cumsum(counts)
    return _answered(table, [pa.Codec("zstd").compress(masks[e - n : e].tobytes()).to_pybytes() for n, e in zip(counts, ends)])


def _with_answers(blocks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """blocks with their answers; a block has no more answers than names."""
    got = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "body")).alias(name))
    return blocks.join(got.hint("merge"), "block", "left")


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _in_order(answers: list[dict] | None) -> list[dict]:
    return sorted((r for r in answers or [] if r["bucket"] >= 0), key=lambda r: r["bucket"])


TWICE_SCHEMA = SCHEMA + ", hot boolean"


def _hot_places(block: Block, row: dict, length: int) -> np.ndarray:
    at, names = block.samples(length)
    return at[_bits_of(row["answers"])[1][np.unique(names, return_inverse=True)[1].ravel()]]


def asked_names(steps: Steps, blocks: DataFrame, bits: int, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Written answers to the names of all samples, and of the whole strings around hot ones if there are any."""

    def send_names(batches):
        for row in _rows(batches):
            names, counts = np.unique(Block(row).samples(length)[1], return_counts=True)
            yield _rows_of_buckets(row["block"], names, bits, lambda a, b: _coded_counts(names[a:b], counts[a:b]))

    def send_strings(batches):
        for row in _rows(batches):
            block = Block(row)
            names = np.unique(gram_names(block.data, length, block.hot_starts(length, _hot_places(block, row, length))))
            yield _rows_of_buckets(row["block"], names, bits, lambda a, b: _coded_counts(names[a:b], np.ones(b - a, np.int64)))

    twice = steps.stored(blocks.mapInArrow(send_names, SCHEMA).groupBy("bucket").applyInArrow(_seen_twice, TWICE_SCHEMA), "names")
    if twice.where("hot").isEmpty():
        return twice, None
    strings = _with_answers(blocks, twice).mapInArrow(send_strings, SCHEMA).groupBy("bucket").applyInArrow(_seen_twice, TWICE_SCHEMA)
    return twice, steps.stored(strings, "strings")


def sent_samples(blocks: DataFrame, twice: DataFrame, strings: DataFrame | None, bits: int, length: int) -> DataFrame:
    """Rows for the buckets: samples, coded; and for bucket -1 what a block needs to read the answers."""
    k = length - SIDE

    def send(batches):
        for row in _rows(batches):
            block = Block(row)
            at, names = block.samples(length)
            distinct, index, count = np.unique(names, return_inverse=True, return_counts=True)
            index = index.ravel()
            repeated, hot = _bits_of(row["answers"])
            inside = block.candidates(length, at, (repeated | (count > 1))[index])
            cold = at[(repeated & ~hot)[index]]
            parts = [(cold, distinct[index][(repeated & ~hot)[index]], np.minimum(block.pos[cold], SIDE), np.minimum(block.left[cold] - k, SIDE))]
            if hot.any():
                starts = block.hot_starts(length, at[hot[index]])
                whole = gram_names(block.data, length, starts)
                again = _bits_of(row["again"])[0][np.unique(whole, return_inverse=True)[1].ravel()]
                parts.append((starts[again], whole[again], np.zeros(again.sum(), np.int64), np.full(again.sum(), SIDE)))
            spots, routes, which, made, sent = [], [], [], [], 0
            reach = np.arange(length + SIDE)
            for places, route, before, after in parts:
                # each distinct sample goes once, for the first place it has
                rows = block.rows(places - SIDE, length + SIDE)
                rows = np.where((reach >= SIDE - before[:, None]) & (reach < SIDE + k + after[:, None]), rows, 0).astype(np.uint8)
                _, one, own = np.unique(_bytes_of(np.concatenate([rows, before[:, None].astype(np.uint8), after[:, None].astype(np.uint8)], axis=1)), return_index=True, return_inverse=True)
                spots.append(places)
                routes.append(route[one])
                which.append(own.ravel() + sent)
                made.append((rows[one], before[one], after[one], block.ids[np.searchsorted(block.starts, places[one], side="right") - 1]))
                sent += len(one)
            spots, routes, which = (np.concatenate(x) for x in (spots, routes, which))
            order = np.argsort(routes, kind="stable")
            rows, before, after, docs_of = (np.concatenate(x)[order] for x in zip(*made))
            place = np.empty(sent, np.int32)
            place[order] = np.arange(sent, dtype=np.int32)
            yield _rows_of_buckets(row["block"], routes[order], bits, lambda a, b: _coded_samples(rows[a:b], before[a:b], after[a:b], docs_of[a:b]))
            raw = np.packbits(inside).tobytes() + spots.astype(np.int32).tobytes() + place[which].tobytes()
            note = pa.Codec("zstd").compress(raw).to_pybytes() if raw else b""
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([len(spots)], pa.int64()), pa.array([note], pa.binary())], ["bucket", "block", "n", "body"])

    asked = _with_answers(blocks, twice)
    return (asked if strings is None else _with_answers(asked, strings, "again")).mapInArrow(send, SCHEMA)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (null unless asked for), kept_sha256 of every row."""
    if length - SIDE < 16:
        raise ValueError("strings this short need a smaller cover")
    steps = Steps(docs.sparkSession)
    blocks = pack(steps, docs)
    bits = bucket_bits(blocks)
    twice, strings = asked_names(steps, blocks, bits, length)

    def settle(table: pa.Table) -> pa.Table:
        return sort_bucket(table, length) if table["bucket"][0].as_py() >= 0 else table.select(["bucket", "block", "n", "body"])

    # notes are spread by block
    made = sent_samples(blocks, twice, strings, bits, length)
    spread = F.when(F.col("bucket") < 0, F.col("block")).otherwise(-1)
    settled = steps.stored(made.withColumn("spread", spread).groupBy("bucket", "spread").applyInArrow(settle, SCHEMA), "suffixes")
    steps.drop(*[x for x in (twice, strings) if x is not None])

    def finish(batches):
        codec = pa.Codec("zstd")
        for row in _rows(batches):
            block = Block(row)
            size, answers = len(block.data), row["answers"] or []
            note = next((r for r in answers if r["bucket"] < 0), None)
            repeated, spots = np.zeros(size, bool), np.empty(0, np.int64)
            if note and note["body"]:
                n, flags = note["n"], (size + 7) // 8
                raw = codec.decompress(note["body"], decompressed_size=flags + 8 * n).to_pybytes()
                spots = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=size))
                at, place = np.frombuffer(raw, np.int32, n, flags), np.frombuffer(raw, np.int32, n, flags + 4 * n)
                masks = [np.frombuffer(codec.decompress(r["body"], decompressed_size=8 * r["n"]).to_pybytes(), np.uint64) for r in _in_order(answers)]
                masks = np.concatenate([np.empty(0, np.uint64), *masks])[place]
                for t in range(SIDE + 1):
                    repeated[at[(masks >> np.uint64(t)) & np.uint64(1) == 1] - t] = True
            index, first = block.classes(spots, length)
            repeated[spots[spots != first[index]]] = True
            flag = np.zeros(size + length, np.int32)
            flag[np.flatnonzero(repeated) + length] = 1
            total = np.cumsum(flag, dtype=np.int32)
            # total[x + length] counts repeated starts up to x
            gone = total[length : length + size] > total[:size]
            edge = gone & ~np.concatenate([[False], gone[:-1]])
            edge[block.starts[block.lens > 0]] |= gone[block.starts[block.lens > 0]]
            out = []
            for i, (a, n) in enumerate(zip(block.starts.tolist(), block.lens.tolist())):
                kept = block.data[a : a + n][~gone[a : a + n]].tobytes()
                out.append((None if block.void[i] else int(block.ids[i]), n, n - len(kept), int(edge[a : a + n].sum()), kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in RESULT_SCHEMA.split(", ")])

    return _with_answers(blocks, settled).mapInArrow(finish, RESULT_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_bytes=False).drop("kept")
