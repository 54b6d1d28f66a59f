"""Conversation repair, source audit and sharding against brute force; edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_repair, hilbert_shards, source_audit

from compare import connect, rows_of_frame
from test_llm_operators import SF, no_documents, odd_documents

GAP = " \t\n\x0b\x0c\r"


# 11


def cheapest(rows):
    """(cost, audit, roles) of [(role, fault)] by Dijkstra over whole audits, independent of the solver."""
    heap, best = [(0, "", 0, "")], {}
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        # all that can follow depends on the row, the last role and whether there is any
        state = (at, roles[-1:])
        if state in best:
            continue
        best[state] = (cost, audit)
        steps = [(5, "I", at, r) for r in "ua"]
        if at < len(rows):
            role, fault = rows[at]
            steps.append((2, "D", at + 1, ""))
            if fault in ("none", "truncated"):
                more = 5 if fault == "truncated" else 0
                steps += [(more, "K", at + 1, role[:1] or "?"), *[(1 + more, "R", at + 1, r) for r in "ua"]]
        for more, edit, i, r in steps:
            if re.fullmatch("(s|s?(ua)*u?)", roles + r):
                heapq.heappush(heap, (cost + more, audit + edit, i, roles + r))


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def repaired_by_hand(rows):
    """The contract's row for each conversation of (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for row in damaged_by_hand(rows):
        groups[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            solid = text.rstrip(GAP)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
            seen.add((role, text))
        cost, audit, roles = cheapest([(r[2], f) for r, f in zip(mine, faults)])
        lines, at, given = [], 0, iter(roles)
        names = {"u": "user", "a": "assistant"}
        for edit in audit:
            if edit == "I":
                lines.append(names[next(given)] + ":")
                continue
            if edit == "K":
                next(given)
                lines.append(f"{mine[at][2]}:{mine[at][3]}")
            if edit == "R":
                lines.append(f"{names[next(given)]}:{mine[at][3]}")
            at += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        n = Counter(faults)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_signature(rows):
    faults = ["none", "truncated", "blank", "duplicate"]
    return "".join(chr(65 + 4 * "sua?".index(r if r in "sua" else "?") + faults.index(f)) for r, f in rows)


def test_solver_equals_dijkstra():
    rnd = random.Random(11)
    for _ in range(3000):
        rows = [(rnd.choice("suuaa?"), rnd.choice(["none", "none", "none", "truncated", "blank", "duplicate"])) for _ in range(rnd.randint(0, 9))]
        assert chat_repair.solve(as_signature(rows)) == cheapest(rows)[:2], rows


def test_solver_on_a_long_signature():
    rnd = random.Random(12)
    rows = [(rnd.choice("suuaa?"), rnd.choice(["none", "truncated", "blank"])) for _ in range(3000)]
    cost, audit = chat_repair.solve(as_signature(rows))
    assert sum(e != "I" for e in audit) == 3000 and cost > 0


TURNS = "conv_id long, turn long, role string, text string, pos long, `a.b` string, start long"


def many_turns(seed=3):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "What?", " ", "", None, "Fine!\n", "a b ", "Yes.", "long " * 3000 + ".", "x\u0085", "..", "é?"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rnd.randint(1, 12)):
            rows.append((conv, rnd.choice([turn, turn, turn * 3, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(texts)))
    # one conversation holds a third of all rows
    rows += [(99, i, ["user", "assistant"][i % 2], f"Turn {i % 50}.") for i in range(150)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows", [1, 4, 4096])
def test_repair_equals_brute_force(spark, piece_rows, monkeypatch):
    rows = many_turns()
    monkeypatch.setattr(chat_repair, "CHUNK_CHARS", 2000)
    turns = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    repair = chat_repair.Repair(chat_repair.damage(turns), piece_rows)
    want = repaired_by_hand(rows)
    told = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in repair.report().collect()}
    assert told == {c: w[:7] for c, w in want.items() if c in told}
    assert all(w[:7] == (0, 0, 0, 0, 0, 0, "") for c, w in want.items() if c not in told)
    shas = {r["conv_id"]: r["sha256"] for r in chat_repair.digests(repair.rows()).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert {c: shas.get(c, none) for c in want} == {c: w[7] for c, w in want.items()}
    roles = defaultdict(str)
    for r in repair.rows().collect():
        roles[r["conv_id"]] += r["role"][0]
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())


def test_repair_query_equals_brute_force(spark):
    rows = connect(SF).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = chat_repair.query(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got.collect()} == repaired_by_hand(rows)


def test_repair_of_no_rows(spark):
    repair = chat_repair.Repair(spark.createDataFrame([], TURNS))
    assert repair.report().count() == repair.rows().count() == chat_repair.digests(repair.rows()).count() == 0


# 12


def audit_by_hand(rows):
    """All rows of the contract for (text, lang, source), over whole vocabularies."""
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for t, _, _ in rows]
    in_docs, n = defaultdict(Counter), defaultdict(Counter)
    for w, (_, lang, source) in zip(words, rows):
        in_docs[lang or ""].update(set(w))
        n[lang or "", source or ""].update(w)
    out = set()
    for lang in in_docs:
        kept = sorted(t for t, c in in_docs[lang].items() if c >= 3)
        v = len(kept)
        sources = [s for g, s in n if g == lang]

        def shares(count):
            whole = sum(count[t] for t in kept) + v
            return {t: 1 + 10**9 * (count[t] + 1) // whole for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def audited(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def audit_rows():
    rnd = random.Random(5)
    words = ["The", "the", "cat", "été", "日本", "x" * 3000, "under_score", "1st", "a-b", "Ünder", "ünder", "dog", "sun"]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", "é", None])) for _ in range(120)]
    return rows + [(None, "en", "empty"), ("...", "only", "marks"), ("once", "only", "other"), (None, None, None)] + [rows[0]] * 60


@pytest.mark.parametrize("entries, tile", [(1 << 18, 512), (3, 2)])
def test_audit_equals_brute_force(spark, entries, tile):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n long")
    found = source_audit.Audit(docs, block_entries=entries, tile=tile)
    top = source_audit.ranked(found.terms(), "term").where("rank <= 200")
    got = source_audit.ranked(found.pairs(), "pair").unionByName(top)
    assert audited(got) == audit_by_hand(rows)


def test_audit_of_odd_and_no_documents(spark):
    docs = odd_documents(spark)
    assert audited(source_audit.audit(docs)) == audit_by_hand([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert source_audit.audit(no_documents(spark)).count() == 0


def test_colliding_hashes_are_told_apart():
    text = b"aa bb aa cc bb dd aa"
    data = source_audit.FOLD[np.frombuffer(text, np.uint8)]
    for digest in (lambda raw: 1, lambda raw: raw[0] % 2, None):
        group, terms = source_audit.group_slices(data, *source_audit.bounds(data), digest=digest)
        assert [terms[g].decode() for g in group] == text.decode().split()


def test_shares_of_large_counts():
    counts, whole = np.array([0, 10**14, 8 * 10**14 - 1]), np.array([8 * 10**14] * 3)
    assert source_audit.share(counts, whole).tolist() == [1 + 10**9 * (int(c) + 1) // int(w) for c, w in zip(counts, whole)]


# 13


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = spark.range(1 << (dims * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(f"x{i}") for i in range(dims)])
    path = cells.select("*", hilbert_shards.curve_index([F.col(f"x{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in path] == list(range(1 << (dims * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(path, path[1:]))


def shard_sizes(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {k: len(v) for k, v in slots.items()}


def test_sharding_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = hilbert_shards.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 16, zlib.crc32(docs[r["doc_id"]]), "rows", None) for r in got)
    sizes = shard_sizes(got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    # slots follow the curve, shards too
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding_of_hot_odd_and_few_rows(spark, law):
    docs = odd_documents(spark)
    sized = hilbert_shards.document_sizes(docs)
    hot = sized.crossJoin(spark.range(1)).drop("id").unionByName(spark.range(600).selectExpr("7L doc_id", "'en' lang", "'hot' source", "100L size", "5L text_crc32"))
    args = (["lang", "source", "size"], ["text_crc32", "doc_id"])
    got = hilbert_shards.assign(hot, *args, shards=7, law=law, size="size").collect()
    sizes = shard_sizes(got)
    assert sum(sizes.values()) == 611
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    if law == "rows":
        assert max(sizes.values()) - min(sizes.values()) <= 1
    else:
        assert max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in got)
    few = hilbert_shards.assign(sized, *args, law=law, size="size").collect()
    assert len(few) == 11 and (law == "bytes" or len({r["shard"] for r in few}) == 11)
    assert hilbert_shards.assign(hilbert_shards.document_sizes(no_documents(spark)), *args, law=law, size="size").count() == 0


def test_shards_pass_columns_and_kinds_of_dimensions(spark):
    rows = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, timestamp_seconds(id * 86400)) when_", "if(id % 11 = 0, double('nan'), id * -0.5) as `a.b`", "date_from_unix_date(int(id % 30)) day", "id % 3 = 0 as shard", "string(id) as cell0")
    got = hilbert_shards.assign(rows, ["when_", "a.b", "day"], ["id"], shards=9)
    assert got.columns == [*rows.columns, "curve", "shard_", "slot"]
    assert sorted(Counter(r["shard_"] for r in got.collect()).values()) == [55] * 4 + [56] * 5


def test_files_are_pruned_by_bounds(spark, tmp_path):
    rows = hilbert_shards.document_sizes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    dims = ["lang", "source", "size"]
    got = hilbert_shards.assign(rows, dims, ["text_crc32", "doc_id"])
    edges = hilbert_shards.bounds(got, dims).collect()
    touched = [r for r in edges if r["min_lang"] <= "fr" <= r["max_lang"] and r["max_size"] >= 1000 and r["min_size"] < 1500]
    assert len(edges) == 40 and len(touched) <= 10
    path = str(tmp_path / "shards")
    hilbert_shards.write_shards(got, path)
    back = spark.read.parquet(path)
    assert rows_of_frame(back.select(*got.columns)) == rows_of_frame(got)
