r"""Conversation structure repair by signatures.

Every row becomes one letter: the class of its role's initial (s, u, a or
other) and its first fault (none, truncated, blank, duplicate). The letters of
a conversation, in order, are its signature; conversations by the thousand
share one. Each distinct signature is solved once: a memoised recursion over
its suffixes gives the cheapest edits that leave a well-formed conversation
(an optional system turn, then pairs of user and assistant, or nothing), and
the answer is joined back and replayed on the rows.

Edits: Keep 0, Rerole 1 (to user or assistant), Delete 2, Insert 5 (an empty
user or assistant turn); a truncated row that stays costs 5 more; blank and
duplicate rows must go. Of equally cheap audits the least in ASCII counts.
What role a rerole or an insert gives follows from what stands before it.

At size: rows are sorted once by ranges, numbered in order and cut into pieces
of PIECE_ROWS at most, so a conversation of any length is spread over tasks.
The signature solved is that of a piece. A conversation in several pieces
takes two short folds over one row per piece, the cost of the rest from each
state backwards, then the state at each piece forwards; so its audit is the
same as if it were solved whole. First sights of texts are minima by group-by,
combined on the map side. Edits meet their rows in one shuffle by ranges, and
repaired rows come out in order. A digest reads them as a stream, like that of
the chat format: conversations that lie within a partition are digested there,
the others move on in chunks of text.

Defined results: null roles and texts count as one space; null conversation
ids form one conversation; rows are ordered by turn (nulls first), rows equal
in turn by role, the first 64 characters of the text and its digest; repeated
rows are duplicates; an empty table gives no rows; other columns are ignored,
whatever their names; equal texts are told by SHA-256; a text of any length is
read whole and must fit into a task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, table

PIECE_ROWS = 1 << 12
#: Text digested or moved at once.
CHUNK_CHARS = 1 << 24
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES, FAULTS = "sua?", ("none", "truncated", "blank", "duplicate")
#: Letter of (role class, fault): 16 letters from A on.
FIRST_LETTER = ord("A")
#: States of a conversation read from the left: nothing yet, after s, after u, after a. Two of them may end it.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FAR = 1 << 60
#: Cost of ending in each state, by inserts, and those inserts.
END_COST, END_AUDIT = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
NEXT = {"u": AFTER_U, "a": AFTER_A, "s": AFTER_S}
LEGAL = ("su", "ua", "au")


def due(state: int) -> str:
    """The role that must come next, but for a system turn at the start."""
    return "a" if state == AFTER_U else "u"


class Solver:
    """Cheapest edits of one signature, by memoised recursion over its suffixes.

    rest: for each state, what the turns after the signature cost from there.
    """

    def __init__(self, signature: str, rest: tuple[int, ...] = END_COST):
        self.rows = [divmod(ord(c) - FIRST_LETTER, 4) for c in signature]
        self.known = {(len(self.rows), s): rest[s] for s in range(4)}
        # recursion stays shallow: suffixes are solved from the end, a hundred rows at a time
        for at in range(len(self.rows), 0, -100):
            for state in range(4):
                self.cost(at - 1, state)

    def moves(self, at: int, state: int):
        """(edit, its cost, next row, next state), in ASCII order of the edits."""
        role, fault = self.rows[at]
        want = due(state)
        yield "D", DELETE, at + 1, state
        yield "I", INSERT, at, NEXT[want]
        if fault < 2:
            more = TRUNCATED if fault == 1 else 0
            mine = ROLES[role]
            if mine == want or (mine == "s" and state == START):
                yield "K", KEEP + more, at + 1, NEXT[mine]
            yield "R", REROLE + more, at + 1, NEXT[want]

    def _insert_free(self, at: int, state: int) -> int:
        return min((c + self.cost(i, s) for e, c, i, s in self.moves(at, state) if e != "I"), default=FAR)

    def cost(self, at: int, state: int) -> int:
        got = self.known.get((at, state))
        if got is None:
            # two inserts in a row lead from u to u or from a to a: never cheaper than none
            got = self._insert_free(at, state)
            if state in (AFTER_U, AFTER_A):
                other = AFTER_A if state == AFTER_U else AFTER_U
                got = min(got, INSERT + self._insert_free(at, other))
            else:
                for n, s in ((1, AFTER_U), (2, AFTER_A)):
                    got = min(got, n * INSERT + self._insert_free(at, s))
            self.known[at, state] = got
        return got

    def audit(self, state: int) -> tuple[str, int]:
        """(edits of the rows, state after them), the least of the cheapest."""
        out, at = [], 0
        while at < len(self.rows):
            left = self.cost(at, state)
            for edit, cost, i, s in self.moves(at, state):
                if cost + self.cost(i, s) == left:
                    break
            out.append(edit)
            at, state = i, s
        return "".join(out), state


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    solver = Solver(signature)
    audit, state = solver.audit(START)
    return solver.cost(0, START), audit + END_AUDIT[state]


def damage(turns: DataFrame, seed_parts: int = 20) -> DataFrame:
    """Turns as a careless collector might leave them: by a hash of conversation and turn some
    are dropped (0), emptied (1), robbed of final marks (2), repeated (3) or given to the user (4)."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")) % seed_parts
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), as_text("role").alias("role"), as_text("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


#: Separators of the plain word rule.
GAPS = " \t\n\x0b\x0c\r"


def _fault(text: Column) -> Column:
    """0, 1 or 2: none, truncated, blank; a duplicate is told later."""
    last = F.right(F.rtrim(text, F.lit(GAPS)), F.lit(1))
    return F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)


def _role_class(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def counts_of(signature: str) -> list[int]:
    """Rows blank, duplicate and truncated, and pairs of neighbours with illegal roles."""
    rows = [divmod(ord(c) - FIRST_LETTER, 4) for c in signature]
    faults = [f for _, f in rows]
    pairs = zip(rows, rows[1:])
    return [faults.count(2), faults.count(3), faults.count(1), sum(ROLES[a] + ROLES[b] not in LEGAL for (a, _), (b, _) in pairs)]


SOLVED = pa.schema([("signature", pa.string()), ("rest", pa.list_(pa.int64())), ("cost", pa.int64()), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
SOLVED_SCHEMA = "signature string, rest array<long>, cost long, audits array<string>, states array<int>, counts array<long>"


def _solve_batches(batches):
    for batch in batches:
        rows = []
        for signature, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            solver = Solver(signature, tuple(rest))
            answers = [solver.audit(s) for s in range(4)]
            rows.append({"signature": signature, "rest": rest, "cost": solver.cost(0, START), "audits": [a for a, _ in answers], "states": [s for _, s in answers], "counts": counts_of(signature)})
        yield pa.RecordBatch.from_pylist(rows, SOLVED)


def _matrix_batches(batches):
    """Cost of a signature from each state to each state."""
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            ends = [Solver(signature, tuple(0 if s == to else FAR for s in range(4))) for to in range(4)]
            rows.append([min(ends[to].cost(0, s), FAR) for s in range(4) for to in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["signature", "matrix"])


def _rest_of_pieces(got):
    """For each piece of a conversation: what the pieces after it cost from each state."""
    got = got.sort_by("start")
    rest, out = list(END_COST), []
    for m in reversed(got["matrix"].to_pylist()):
        out.append(rest)
        rest = [min(m[4 * s + to] + rest[to] for to in range(4)) for s in range(4)]
    return pa.table({"conv_id": got["conv_id"], "start": got["start"], "signature": got["signature"], "rest": pa.array(out[::-1], pa.list_(pa.int64())), "many": pa.array([True] * len(out))})


ANSWER_SCHEMA = "conv_id long, start long, begin int, audit string, tail string, cost long, counts array<long>"


def _chosen(got):
    """The state that each piece begins with and its audit; the cost of the whole stands at the first piece."""
    got = got.sort_by("start")
    state, audits, begins = START, [], []
    for texts, after in zip(got["audits"].to_pylist(), got["states"].to_pylist()):
        begins.append(state)
        audits.append(texts[state])
        state = after[state]
    tails = [""] * (len(audits) - 1) + [END_AUDIT[state]]
    cost = [got["cost"][0].as_py()] + [0] * (len(audits) - 1)
    return pa.table({"conv_id": got["conv_id"], "start": got["start"], "begin": pa.array(begins, pa.int32()), "audit": pa.array(audits, pa.string()), "tail": pa.array(tails, pa.string()), "cost": pa.array(cost, pa.int64()), "counts": got["counts"]})


REPAIRED_SCHEMA = "conv_id long, at long, step long, turn long, role string, text string"
ROLE_OF = {"u": "user", "a": "assistant"}


def _replay(batches):
    """Rows as (conv_id, kind, pos, turn, role, text, begin, audit, tail) in order, an audit (kind 0) ahead of
    the rows of its piece: the rows as repaired."""
    state, edits, tail, step = START, iter(""), "", 0
    kinds = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("step", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        out = []

        def put(conv, at, turn, role, text):
            nonlocal step
            out.append((conv, at, step, turn, role, text))
            step += 1

        def insert(conv, at):
            nonlocal state
            want = due(state)
            put(conv, at, None, ROLE_OF[want], "")
            state = NEXT[want]

        for conv, kind, pos, turn, role, text, begin, audit, ending, n in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                state, edits, tail, left, step = begin, iter(audit), ending, n, 0
                continue
            for edit in edits:
                if edit == "I":
                    insert(conv, pos)
                    continue
                if edit != "D":
                    mine = due(state) if edit == "R" else role[0]
                    put(conv, pos, turn, ROLE_OF[mine] if edit == "R" else role, text)
                    state = NEXT[mine]
                break
            left -= 1
            if not left:
                for _ in tail:
                    insert(conv, pos)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], kinds.names)


class Repair:
    """A repair of conversations, step by step: `report()` by conversation, `rows()` as repaired."""

    def __init__(self, turns: DataFrame, piece_rows: int = PIECE_ROWS):
        if piece_rows & (piece_rows - 1):
            raise ValueError("piece_rows is a power of two")
        self.shift = piece_rows.bit_length() - 1
        steps = Steps(turns.sparkSession)
        as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), as_text("role"), as_text("text"))
        keyed = rows.withColumns({"begins": F.substring("text", 1, 64), "digest": F.unhex(F.sha2("text", 256))})
        order = ["conv_id", "turn", "role", "begins", "digest"]
        dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = dealt.select("conv_id", "turn", "role", "text", "digest", _fault(F.col("text")).alias("fault"), F.monotonically_increasing_id().alias("pos"))
        self.texts = steps.stored(numbered.withColumn("piece", F.shiftright("pos", self.shift)), "texts")
        slim = self.texts.drop("text")
        # where a text is seen first; most are seen once and need no look-up
        said = slim.where("fault < 2").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1")
        again = said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
        repeated = (F.col("fault") < 2) & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
        letter = F.char(FIRST_LETTER + 4 * _role_class(F.col("role")) + F.when(repeated, 3).otherwise(F.col("fault")))
        marked = slim.join(again, same, "left").select("conv_id", "turn", "pos", "piece", letter.alias("letter"))
        self.marked = steps.stored(marked, "marked")
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda v: v["letter"])
        pieces = self.marked.groupBy("conv_id", "piece").agg(F.min("pos").alias("start"), in_order.alias("letters"))
        many = F.count("*").over(Window.partitionBy("conv_id")) > 1  # a row for each piece
        self.pieces = steps.stored(pieces.select("conv_id", "start", F.array_join("letters", "").alias("signature"), many.alias("many")), "pieces")
        end = F.array(*[F.lit(c).cast("long") for c in END_COST])
        whole = self.pieces.where("NOT many").select("conv_id", "start", "signature", end.alias("rest"), "many")
        parts = self.pieces.where("many")
        matrices = parts.select("signature").distinct().mapInArrow(_matrix_batches, "signature string, matrix array<long>")
        rest = parts.join(matrices, "signature").select("conv_id", "start", "signature", "matrix").groupBy("conv_id").applyInArrow(_rest_of_pieces, "conv_id long, start long, signature string, rest array<long>, many boolean")
        asked = steps.stored(whole.unionByName(rest), "asked")
        solved = steps.stored(asked.select("signature", "rest").distinct().mapInArrow(_solve_batches, SOLVED_SCHEMA), "solved")
        told = asked.join(solved, ["signature", "rest"])
        tail = F.get(F.array(*[F.lit(x) for x in END_AUDIT]), F.get("states", F.lit(START)))
        alone = told.where("NOT many").select("conv_id", "start", F.lit(START).alias("begin"), F.get("audits", F.lit(START)).alias("audit"), tail.alias("tail"), "cost", "counts")
        split = told.where("many").select("conv_id", "start", "cost", "audits", "states", "counts").groupBy("conv_id").applyInArrow(_chosen, ANSWER_SCHEMA)
        self.answers = steps.stored(alone.unionByName(split), "answers")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation with rows."""
        turns = self.marked.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id")
        gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
        cls = lambda c: F.floor((F.ascii(c) - FIRST_LETTER) / 4)
        legal = F.concat(*[F.substring(F.lit(ROLES), cls(c).cast("int") + 1, F.lit(1)) for c in ("before", F.left("signature", F.lit(1)))]).isin(*LEGAL)
        before = F.lag(F.right("signature", F.lit(1))).over(Window.partitionBy("conv_id").orderBy("start"))
        across = self.pieces.where("many").withColumn("before", before).where(F.col("before").isNotNull() & ~legal).groupBy("conv_id").agg(F.count("*").alias("across"))
        # a row for each piece is collected here; the audit is one string, as it must be
        parts = F.array_sort(F.collect_list(F.struct("start", F.concat("audit", "tail").alias("text"))))
        sums = self.answers.groupBy("conv_id").agg(*[F.sum(F.get("counts", F.lit(i))).alias(c) for i, c in enumerate(("blank", "duplicate", "truncated", "inside"))], F.sum("cost").alias("cost"), parts.alias("parts"))
        out = gaps
        for more, how in ((sums, "inner"), (across, "left")):
            other = more.withColumnRenamed("conv_id", "c")
            out = out.join(other, F.col("conv_id").eqNullSafe(F.col("c")), how).drop("c")
        illegal = F.col("inside") + F.coalesce("across", F.lit(0))
        return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", F.array_join(F.transform("parts", lambda v: v["text"]), "").alias("audit"))

    def rows(self) -> DataFrame:
        """conv_id, at, step, turn, role, text: the repaired turns, sorted by (at, step); inserted ones have no turn.

        at orders pieces and rows over the whole table; step orders what one piece gives.
        """
        none = lambda kind: F.lit(None).cast(kind)
        texts = self.texts.select("piece", "conv_id", F.lit(1).alias("kind"), "pos", "turn", "role", "text", none("int").alias("begin"), none("string").alias("audit"), none("string").alias("tail"), none("long").alias("n"))
        sizes = F.length(F.replace("audit", F.lit("I"), F.lit(""))).cast("long")
        audits = self.answers.select(F.shiftright("start", self.shift).alias("piece"), "conv_id", F.lit(0).alias("kind"), F.col("start").alias("pos"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "begin", "audit", "tail", sizes.alias("n"))
        dealt = texts.unionByName(audits).repartitionByRange("piece").sortWithinPartitions("pos", "kind").drop("piece")
        return dealt.mapInArrow(_replay, REPAIRED_SCHEMA)


DIGEST = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string()), ("at", pa.int64()), ("lines", pa.string())])
DIGEST_SCHEMA = "conv_id long, sha256 string, at long, lines string"


def _digested(batches):
    """Digests of conversations that lie between two others, and the text of those that may go on elsewhere.

    Text that moves is cut into chunks; (conv_id, at) orders them.
    """
    first, now, open_, held, size, out = True, None, True, [], 0, []
    at = 0

    def moved():
        nonlocal held, size
        if held:
            out.append((now, None, at, "\n".join(held)))
        held, size = [], 0

    for batch in batches:
        for conv, pos, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text")]):
            if first or conv != now:
                if open_:
                    moved()
                elif held:
                    out.append((now, hashlib.sha256("\n".join(held).encode()).hexdigest(), None, None))
                    held, size = [], 0
                now, open_, first = conv, first, False
            if not held:
                at = at + 1 if open_ and pos <= at else pos
            held.append(f"{role}:{text}")
            size += len(held[-1])
            if size > CHUNK_CHARS:
                open_ = True
                moved()
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, r)) for r in out], DIGEST)
            out = []
    moved()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, r)) for r in out], DIGEST)


def _joined(batches):
    """Digests of moved chunks, conversation by conversation, in order."""
    now, state, out = None, None, []
    for batch in batches:
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if state is None or conv != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256(lines.encode())
            else:
                state.update(b"\n" + lines.encode())
    if state is not None:
        out.append((now, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out])], ["conv_id", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text` lines joined by newlines, for conversations with repaired rows."""
    told = Steps(repaired.sparkSession).stored(repaired.mapInArrow(_digested, DIGEST_SCHEMA), "digests")
    moved = told.where("lines IS NOT NULL").select("conv_id", "at", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return told.where("lines IS NULL").select("conv_id", "sha256").unionByName(moved.mapInArrow(_joined, "conv_id long, sha256 string"))


def query(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = Repair(damage(turns))
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (repair.report(), digests(repair.rows())):
        other = more.withColumnRenamed("conv_id", "c")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
