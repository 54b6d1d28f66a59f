"""SentencePiece encoding and decoding in vectorised merge rounds.

The text is cut into words that no piece of the vocabulary crosses, every
distinct word of a batch is merged once, and the ids of all documents are then
gathered with array operations. Words are cut further between two characters
that are neighbours in no piece, which leaves short segments of most long words.
A round takes the best pair of each segment (segmented minimum), merges leftmost
occurrences at once, and compacts; segments leave as soon as they hold no pair
of the vocabulary.

Defined results: null and empty texts give begin and end id only; a text of
spaces keeps them all; characters without a piece fall back to bytes; of pairs
with equal scores the leftmost merges first; repeated rows are encoded each on
their own; an empty table gives an empty table; other columns of the input are
not looked at; texts of any length are encoded whole and must fit into a task.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import received, shipped

SPACE = "▁"
#: Symbol ids of characters that have no piece of their own start here.
CHAR_BASE = 1 << 21
SHIFT = np.uint64(22)
NO_PAIR = np.int64(1 << 62)
#: Segments beyond this many symbols (runs of thousands of spaces, words of thousands of letters) are merged with
#: a heap: same result, and no quadratic number of rounds (40,000 letters took 36 s in rounds).
HEAP_FROM = 4096
#: Words a worker remembers between batches.
CACHE_WORDS = 500_000
#: Ids gathered at once when bytes are assembled.
SLICE_IDS = 1 << 19


class PieceTables:
    """Arrays made from a BPE model file: pairs, piece bytes, byte ids."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, dummy prefix and identity normalisation are supported")
        n = sp.get_piece_size()
        self.size, self.bos, self.eos = n, sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.crossed = any(SPACE in p.lstrip(SPACE) for p in ids)
        self.newline_inside = any("\n" in p for p in ids if len(p) > 1)
        # equal scores share a rank
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.searchsorted(np.unique(-scores), -scores)
        best_over: dict[int, int] = {}
        shared = np.bincount(rank[[i for p, i in ids.items() if len(p) > 1]], minlength=int(rank.max()) + 1) > 1
        known = lambda t: ids.get(t, CHAR_BASE + ord(t) if len(t) == 1 else None)
        rows = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = known(p[:cut]), known(p[cut:])
                if a is None or b is None:
                    continue
                rows.append(((a << 22) | b, rank[i], i))
                for part in (a, b):
                    best_over[part] = min(best_over.get(part, 1 << 60), int(rank[i]))
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.ranks = np.array([r[1] for r in rows], np.int64)
        self.merged = np.array([r[2] for r in rows], np.int64)
        #: Characters that are neighbours in some piece.
        self.neighbours = np.array(sorted({(ord(a) << 22) | ord(b) for p in ids for a, b in zip(p, p[1:])}), np.uint64)
        # a merge whose product cannot at once form a better pair may be done everywhere in the word
        self.alone = np.array([shared[rank[i]] or best_over.get(i, 1 << 60) <= rank[i] for i in range(n)])
        blobs = []
        self.byte_ids = np.zeros(256, np.int64)
        self.is_byte = np.zeros(n, bool)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                value = int(p[1:-1], 16)
                self.byte_ids[value], self.is_byte[i] = i, True
                blobs.append(bytes([value]))
            elif sp.is_control(i):
                blobs.append(b"")
            elif sp.is_unknown(i):
                blobs.append(" ⁇ ".encode())
            else:
                blobs.append(p.replace(SPACE, " ").encode())
        self.piece_len = np.array([len(b) for b in blobs], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.control = np.array([sp.is_control(i) for i in range(n)])

    def splitter(self) -> re.Pattern:
        if self.crossed:
            return re.compile("(?s).+")
        if self.newline_inside:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def pair_table(self) -> dict[int, tuple[int, int]]:
        """Pairs as a dict, made on first use."""
        if not hasattr(self, "_pairs"):
            self._pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.merged)}
        return self._pairs

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, or -1."""
        key = (left.astype(np.uint64) << SHIFT) | right.astype(np.uint64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)


def _symbols(tables: PieceTables, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the characters, and whether a piece has each next to the one before it."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    distinct, back = np.unique(points, return_inverse=True)
    own = np.array([tables.chars.get(chr(c), CHAR_BASE + c) for c in distinct.tolist()], np.int64)
    known, joined = tables.neighbours, np.zeros(len(points), bool)
    if len(known):
        pairs = (points[:-1].astype(np.uint64) << SHIFT) | points[1:].astype(np.uint64)
        joined[1:] = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs
    return own[back], joined


def merge_words(tables: PieceTables, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, flat, and the number of ids of each word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat, joined = _symbols(tables, "".join(words))
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    joined[1:] &= word[1:] == word[:-1]
    owner = np.cumsum(~joined) - 1  # the segment of each symbol
    word_of = word[~joined]
    sizes = np.bincount(owner)
    ends = np.cumsum(sizes)
    long = np.flatnonzero(sizes > HEAP_FROM)
    parts = {w: _heap_merge(tables, flat[ends[w] - sizes[w] : ends[w]]) for w in long.tolist()}
    if len(long):
        stay = ~np.isin(owner, long)
        flat, owner = flat[stay], owner[stay]
    done_symbols, done_owner = [], []
    while len(flat):
        at = np.full(len(flat), -1, np.int64)
        same = owner[:-1] == owner[1:]
        at[:-1][same] = tables.lookup(flat[:-1][same], flat[1:][same])
        rank = np.where(at >= 0, tables.ranks[at], NO_PAIR)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.minimum.reduceat(rank, first)
        count = np.diff(np.append(first, len(flat)))
        if (over := best == NO_PAIR).any():
            out = np.repeat(over, count)
            done_symbols.append(flat[out])
            done_owner.append(owner[out])
            keep = ~out
            flat, owner, at, rank = flat[keep], owner[keep], at[keep], rank[keep]
            if not len(flat):
                break
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best, count = best[~over], count[~over]
        hit = rank == np.repeat(best, count)
        spots = np.flatnonzero(hit)
        # leftmost occurrence of each word; further ones where that is safe
        _, lead = np.unique(owner[spots], return_index=True)
        is_lead = np.zeros(len(spots), bool)
        is_lead[lead] = True
        safe = ~tables.alone[tables.merged[at[spots]]]
        spots = spots[is_lead | safe]
        if len(spots) > 1:  # of overlapping occurrences every second, from the left
            new_run = np.diff(spots, prepend=-2) != 1
            run_start = np.maximum.accumulate(np.where(new_run, spots, 0))
            spots = spots[(spots - run_start) % 2 == 0]
        flat[spots] = tables.merged[at[spots]]
        gone = np.zeros(len(flat), bool)
        gone[spots + 1] = True
        flat, owner = flat[~gone], owner[~gone]
    symbols = np.concatenate([np.empty(0, np.int64), *done_symbols])
    owners = np.concatenate([np.empty(0, np.int64), *done_owner])
    for w in long.tolist():
        symbols = np.concatenate([symbols, parts[w]])
        owners = np.concatenate([owners, np.full(len(parts[w]), w)])
    order = np.argsort(owners, kind="stable")
    return _bytes_for_unknown(tables, symbols[order], word_of[owners[order]], len(words))


def _bytes_for_unknown(tables: PieceTables, symbols: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    strange = symbols >= CHAR_BASE
    if strange.any():
        points = symbols[strange] - CHAR_BASE
        coded = [tables.byte_ids[list(chr(c).encode("utf-8"))] for c in points.tolist()]
        width = np.ones(len(symbols), np.int64)
        width[strange] = [len(c) for c in coded]
        out = np.repeat(symbols, width)
        out[np.repeat(strange, width)] = np.concatenate(coded)
        symbols, owners = out, np.repeat(owners, width)
    return symbols, np.bincount(owners, minlength=n).astype(np.int64)


def _heap_merge(tables: PieceTables, symbols: np.ndarray) -> np.ndarray:
    n = len(symbols)
    sym = symbols.tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    table = tables.pair_table()
    heap = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (got := table.get((sym[i] << 22) | sym[j])):
            heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], nxt[i] = merged, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return np.array([s for s, ok in zip(sym, alive) if ok], np.int64)


def gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of pool[start:start+len] for all pairs, by index arithmetic."""
    total = int(lens.sum())
    if not total:
        return pool[:0]
    shift = starts - (np.cumsum(lens) - lens)
    return pool[np.repeat(shift, lens) + np.arange(total)]


class Codec:
    """Encoder and decoder with a bounded memory of words already merged."""

    def __init__(self, tables: PieceTables):
        self.t = tables
        self.split = tables.splitter().findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(set(words))
        ids, lens = merge_words(self.t, new)
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with begin and end id, as int32 arrays."""
        cut = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = [w for c in cut for w in c]
        self.learn(words)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        lens = self.lens[at]
        flat = gather(self.pool, self.starts[at], lens)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *map(len, cut)])]
        bos, eos = np.array([self.t.bos], np.int32), np.array([self.t.eos], np.int32)
        return [np.concatenate([bos, flat[a:b], eos]) for a, b in zip(ends[:-1], ends[1:])]

    def decode_slices(self, ids: np.ndarray):
        """The decoded text's bytes in slices of bounded size."""
        t, first = self.t, True
        ids = ids[~t.control[ids]]
        for a in range(0, len(ids), SLICE_IDS):
            part = ids[a : a + SLICE_IDS]
            out = gather(t.piece_bytes, t.piece_at[part], t.piece_len[part]).tobytes()
            if first and not t.is_byte[part[0]] and out[:1] == b" ":
                out = out[1:]  # the dummy prefix
            first = False
            yield out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decode_slices(ids)).decode("utf-8", errors="replace")


def chunks(texts: list, limit: int = 1 << 21):
    """Consecutive slices of about so many characters; one long text stays alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def model_tables(path: str) -> PieceTables:
    with open(path, "rb") as f:
        return PieceTables(f.read())


def encode(docs: DataFrame, model_path: str, keep_ids: bool = True, keep_decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every text.

    The model is read where the plan is made; its tables (a fixed few MB) are
    broadcast. One narrow pass, no shuffle.
    """
    spark = docs.sparkSession
    shared = shipped(spark, model_tables(model_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_decoded else "")

    def run(batches):
        codec = Codec(received(shared))
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                made = codec.encode(texts[a:b])
                digests, decoded = [], []
                for ids in made:
                    h, whole = hashlib.sha256(), []
                    for part in codec.decode_slices(ids):
                        h.update(part)
                        if keep_decoded:
                            whole.append(part)
                    digests.append(h.hexdigest())
                    decoded.append(b"".join(whole).decode("utf-8", errors="replace"))
                cols = [
                    doc_ids.slice(a, b - a).cast(pa.int64()),
                    pa.array([len(x) for x in made], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in made], pa.string()),
                    pa.array(digests, pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    lens = np.array([len(x) for x in made])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                    cols += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made), pa.int32()))]
                    names += ["ids"]
                if keep_decoded:
                    cols += [pa.array(decoded, pa.string())]
                    names += ["decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
