"""Corpus operators against brute force, libraries and exact round trips; edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import (
    chat_format,
    decontaminate,
    langid,
    line_dedup,
    llm_queries,
    ngram_join,
    quality_fm,
    quality_rules,
    sentencepiece_codec,
    suffix_dedup,
    url_filter,
)
from compare import rows_of_frame, rows_of_sql

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, d string, t string, l string, _w string, score string, _k string, _gone string, _key string, _p string, gone string, text_key string, hash string, `a.b` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "a", None), (4, "a", None), (5, long, "en"), (6, long + " end", "fr"), (None, "no id at all here", "en"), (7, "日本語 のテキスト\n\nété", "fr"), (8, "x" * 5000, "de"), (9, "x" * 5000, "de")]
    return spark.createDataFrame([(i, t, g, "s", 1, *["c"] * 13) for i, t, g in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert rows_of_frame(llm_queries.QUERIES[name](spark, SF)) == rows_of_sql(SF, llm_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(llm_queries.QUERIES) - set(llm_queries.ORACLES)))
def test_one_row_per_input_row(spark, name):
    df = llm_queries.QUERIES[name](spark, SF)
    table = {"op2": "pages", "op7": "conversations"}.get(name.split("_")[0], "documents")
    want = spark.read.parquet(f"{SF}/{table}.parquet")
    n = want.select("conv_id").distinct().count() + 1 if table == "conversations" else want.count()
    assert df.count() == n


# 1


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(model_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_tables(model_path))
    rnd = random.Random(1)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "in", "him", "▁", "\n", "ex", "é", "1", ",", "notes", "!!", "\t", "漢", "\x00", "</s>"]
    texts = [None, "", " ", "   a  b ", "a" * 6000, " " * 6000, "⁇ <unk> <0x41>", "\U0001f600", "".join(rnd.choice("etaoin") for _ in range(5000)), "".join(rnd.choice("etaoinQZ0+/") for _ in range(9000))] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 120))) for _ in range(400)]
    for text, ids in zip(texts, codec.encode(texts)):
        want = [1, *sp.encode(text or ""), 2]
        assert ids.tolist() == want
        assert codec.decode(ids) == sp.decode(want)


def test_codec_on_odd_documents(spark, model_path):
    rows = sentencepiece_codec.encode(odd_documents(spark), model_path, keep_decoded=True).collect()
    assert len(rows) == 11
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {2}
    assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in rows)
    assert sentencepiece_codec.encode(no_documents(spark), model_path).count() == 0


# 2


def test_url_rules_and_verdicts(spark):
    urls = [None, "no scheme", "http://", "https://a.example.COM/en/7x?q=1", "http://example.com/en/8", "http://x.net/de/1#f", "http://example.net/de/8", "http://badexample.net/de/8", "http://s.org/es/", "http://s.org/fr/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(11)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/7x", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("x.net", "/de/1", "net/de/"),
        ("example.net", "/de/8", "example.net/de/8"), ("badexample.net", "/de/8", "net/de/"), ("s.org", "/es/", "org/es/"), ("s.org", "/fr/", None), ("b:", "//c/d", None),
    ]
    assert got[6]["verdict"] == "block" and got[5]["verdict"] == "allow" and got[9]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id IN (0, 8, 9)")).collect()} == {"block"}


def test_rules_equal_sql(spark):
    got = url_filter.query(spark, SF).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))
    assert rows_of_frame(got) == rows_of_sql(SF, url_filter.RULE_SQL)


def test_trees_on_held_out_urls(spark):
    """URLs that neither the trees nor the suffix statistics have seen."""
    pages = spark.read.parquet(SF.replace("0.001", "0.1") + "/pages.parquet").select("page_id", "url")
    rows = url_filter.labelled(url_filter.ruled(pages))
    out = F.pmod(F.xxhash64(F.lit(99), "url"), F.lit(4)) == 2
    trees = url_filter.learn(rows.where(~out))
    got = url_filter.scored(rows.where(out), trees).collect()
    good, bad = ([r["block_score"] for r in got if r["label"] == x] for x in (0.0, 1.0))
    above = sum((b > g) + 0.5 * (b == g) for g in good for b in bad) / (len(good) * len(bad))
    right = sum((r["block_score"] >= 0.5) == (r["label"] == 1.0) for r in got)
    assert len(good) > 20 and len(bad) > 20
    # exceptions like example.com/en/7 look like the rest of their host: the majority of each top level is what
    # lexical features can reach
    tops = defaultdict(lambda: [0, 0])
    for r in got:
        tops[r["host"].rsplit(".", 1)[-1]][int(r["label"])] += 1
    assert right >= sum(max(c) for c in tops.values()) - 0.02 * len(got) and above >= 0.7
    # the first path segment, which the rules are made of, is no feature; neither is a row's own label
    assert not [k for k in url_filter.features(F.lit("a"), F.lit("b"), F.lit("c")) if "hash" in k]
    one = spark.createDataFrame([(f"http://h{i}.z/", f"h{i}.z", "/", float(i == 0)) for i in range(40)], "url string, host string, path string, label double")
    alone = url_filter.learn(one)
    made = url_filter._with_features(one, alone.suffixes, alone.total, alone.prior, True)
    fold = made.where("label = 1").first()
    others = made.where(F.col("fold") == fold["fold"]).select("f_tld_blocked").distinct().collect()
    assert len(others) == 1  # within a fold the same statistics, whatever the label


def test_odd_urls(spark):
    long = "http://a.com/en/" + "x/" * 50_000 + "?" + "&".join(f"k{i}=1" for i in range(5000))
    urls = [long, long, "http://a.com/en/1", "http://a.com/en/1", None, "", "://", "http://b.net/de/1", "http://c.org/es/1", "http://c.org/fr/1"]
    df = spark.createDataFrame([(i, u, *["c"] * 9) for i, u in enumerate(urls)], "page_id long, url string, _x string, own string, features string, label string, fold string, suffix string, probability string, ruling string, `a.b` string")
    out = url_filter.judge(df)
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict", "block_score"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == 10 and got[0]["verdict"] == "block" and got[0]["a.b"] == "c" == got[0]["_x"]
    same = lambda r: tuple(r)[2:]
    assert same(got[0]) == same(got[1]) and same(got[2]) == same(got[3])
    # of two rules of one length that both fit, the one with the longer host
    tie = url_filter.judge(df, rules=(("allow", "com", "/en/xxx"), ("block", "a.com", "/en/x"), ("allow", "com", "/en/x/x")))
    assert {r["rule"] for r in tie.where("page_id = 0").collect()} == {"a.com/en/x"}


# 3


def removed_by_hand(rows, n=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [2_000, 3 << 20])
def test_repeated_strings(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10_000)
    rnd = random.Random(3)
    parts = ["".join(rnd.choice("abcé \n") for _ in range(rnd.randint(30, 160))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(120)] + [(500, None), (501, "a" * 400), (502, "a" * 99), (503, "a" * 100)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_by_hand(rows)


def test_ties_with_colliding_names(spark, monkeypatch):
    """Names of six bits: what is equal is decided by ranks and bytes."""
    names = suffix_dedup.gram_names
    monkeypatch.setattr(suffix_dedup, "gram_names", lambda data, n, at: (names(data, n, at) >> suffix_dedup.np.uint64(58)) << suffix_dedup.np.uint64(58))
    test_repeated_strings(spark, monkeypatch, 2_000)


def test_one_passage_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1_500)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5_000)
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 90))) + passage + str(rnd.random()) + (passage[:150] + str(i) + passage[20:]) * (i % 3)) for i in range(200, 0, -1)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_by_hand(rows)


def test_ties_with_colliding_keys(spark, monkeypatch):
    """All strings of a bucket have one key: bytes alone decide."""
    monkeypatch.setattr(suffix_dedup, "tie_keys", lambda start, end, t: start * suffix_dedup.np.uint64(0))
    test_repeated_strings(spark, monkeypatch, 2_000)
    test_one_passage_in_every_block(spark, monkeypatch)


def sample_rows(spark, docs):
    """Rows that each bucket gets, and removal as a whole."""
    from quern.llm.common import Steps

    steps = Steps(spark)
    blocks = suffix_dedup.pack(steps, docs)
    bits = suffix_dedup.bucket_bits(blocks)
    twice, strings = suffix_dedup.asked_names(steps, blocks, bits, 100)
    made = suffix_dedup.sent_samples(blocks, twice, strings, bits, 100)
    return strings, [r["n"] for r in made.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()]


def test_hot_phrases(spark, monkeypatch):
    """A phrase of 60 bytes in every text, surroundings of its own in each: no bucket gets a row for each text."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4_000)
    rnd = random.Random(13)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    phrase = text(60)
    rows = [(i, text(rnd.randint(0, 120)) + phrase + text(rnd.randint(0, 120))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    strings, whole = sample_rows(spark, docs)
    assert strings is None and max(whole) > 100
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLES", 20)
    monkeypatch.setattr(suffix_dedup, "LEAST_COUNT", 2)
    strings, whole = sample_rows(spark, docs)
    assert strings is not None and max(whole, default=0) < 40  # several k-grams that are not hot, each below 20
    # passages over the phrase that do repeat, within a block and across, at different offsets
    rows += [(1000 + i, text(i % 60) + rows[i % 7][1] + text(30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sample_rows(spark, docs)[0] is not None
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed_by_hand(rows) and sum(r[1] for r in got.values()) > 0
    test_one_passage_in_every_block(spark, monkeypatch)
    test_repeated_strings(spark, monkeypatch, 2_000)


def test_repeats_in_odd_documents(spark):
    got = suffix_dedup.remove_repeats(odd_documents(spark)).collect()
    assert len(got) == 11 and sum(r["doc_id"] is None for r in got) == 1
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0


# 4


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.97 * got.count() > 0


def test_languages_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.learn(no_documents(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(no_documents(spark), nothing).count() == 0
    kept = langid.keep_known(docs, nothing, 0.5)
    assert kept.columns == docs.columns and kept.count() == 8


def test_false_positives_are_corrected():
    import numpy as np

    rng = np.random.default_rng(0)
    grams = {"a": rng.integers(0, 2**63, 400_000).astype(np.uint64), "b": rng.integers(0, 2**63, 10_000).astype(np.uint64)}
    model = langid.Languages.build(grams)
    hashes = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    wrong = np.mean((model.masks(hashes)[:, 0] & np.uint64(1)) == 1)
    assert abs(wrong - model.false_share[0]) < 0.02 and wrong > 0.1


def grams_by_hand(text):
    out = []
    for w in re.findall(r"[^\W\d_]+", text):
        s = "\0" + w.lower() + "\0"
        out += [s[i : i + n] for n in langid.SIZES for i in range(len(s) - n + 1)]
    return out


def test_masks_and_counts_by_hand(spark):
    """Seventy languages: an n-gram's mask has every language that contains it, and few others; counts add up."""
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    rows = []
    for lang in range(70):
        words = ["".join(rnd.choices(letters, k=rnd.randint(1, 7))) for _ in range(30)]
        rows += [(f"l{lang:02}", " ".join(rnd.choice(words) for _ in range(40))) for _ in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    held = {}
    for lang, text in rows:
        counts = held.setdefault(lang, defaultdict(int))
        for g in grams_by_hand(text):
            counts[g] += 1
    held = {k: {g for g, n in v.items() if n >= langid.MIN_COUNT} for k, v in held.items()}
    assert model.names == sorted(held) and model.slots.shape[1] == 2
    texts = [t for _, t in rows[::9]] + ["été l'a 9x9 _", "", None]
    hashes, owner = langid.gram_hashes(texts)
    total, _, someone, each = model.counts(hashes, owner, len(texts))
    extra = asked = 0
    for j, text in enumerate(texts):
        grams = grams_by_hand(text or "")
        assert total[j] == len(grams)
        assert someone[j] >= sum(any(g in h for h in held.values()) for g in grams)
        for i, lang in enumerate(model.names):
            own = sum(g in held[lang] for g in grams)
            assert each[i, j] >= own
            extra, asked = extra + each[i, j] - own, asked + len(grams)
    assert extra <= 1e-3 * asked
    names, _ = model.predict([t for _, t in rows])
    assert sum(a == b for a, (b, _) in zip(names, rows)) >= 0.97 * len(rows)


def test_score_falls_with_missing_evidence(spark):
    import random

    import numpy as np

    import corpus_pipeline
    from quern.llm.common import held_out

    draw = random.Random(2)
    words = lambda letters, n: " ".join("".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(n))
    foreign = [words(a, n) for a in ("абвгдежзиклмнопрст", "的一是不了人我在有他") for n in (5, 60, 400)]
    noise = [words("abcdefghijklmnopqrstuvwxyz", n) for n in (10, 60, 400)]
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").where("quality = 1")
    model = langid.learn(langid.train_set(docs))
    clean = docs.where(held_out(F.col("doc_id"))).join(labels, "doc_id", "left_semi").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*foreign, *noise])], "doc_id long, text string")
    # a clean text of several languages is known as well, though none of them leads
    some = [r["text"] for r in docs.where("lang = 'en'").limit(3).collect() + docs.where("lang = 'de'").limit(3).collect()]
    mixed = spark.createDataFrame([(10**9, "\n".join(some))], "doc_id long, text string")
    kept = [r["doc_id"] for r in langid.keep_known(clean.unionByName(odd).unionByName(mixed), model, corpus_pipeline.MIN_KNOWN_SHARE).select("doc_id").collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in clean.unionByName(mixed).collect())
    assert max(model.predict([*foreign, *noise])[1]) < 0.25

    alike, one = langid.gram_hashes(["same words"])[0], langid.gram_hashes(["only here"])[0]
    two = langid.Languages.build({"a": alike, "b": np.concatenate([alike, one])})
    assert two.predict(["same words"])[1][0] == 0 and two.predict(["only here"])[0] == ["b"] and two.predict(["only here"])[1][0] > 0.9
    assert langid.Languages.build({"a": one}).predict(["only here"])[1][0] > 0.9


# 5


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_near_lines(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(20, 90))) for _ in range(40)]

    def changed(s):
        i, o = rnd.randrange(len(s) + 1), rnd.random()
        return s[:i] + "c" + s[i:] if o < 0.33 else s[:i] + s[i + 1 :] if o < 0.66 else s[:i] + "d" + s[i + 1 :]

    docs = []
    for i in range(150):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            s = rnd.choice(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                s = changed(s)
            lines.append(s)
        docs.append((i, "\n".join(lines)))
    seen, want = [], {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            near = len(line) >= line_dedup.NEAR_CHARS
            gone = line.strip() and any(line == o or near and len(o) >= line_dedup.NEAR_CHARS and within_one(line, o) for o in seen)
            seen.append(line)
            if gone:
                continue
            kept.append(line)
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_short_and_blank_lines(spark):
    rows = [(1, "Subscribe now!"), (2, "Subscribe now!\nSubscribe now?"), (3, "}\n\n}\n \n"), (4, "}\n\n\t")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Subscribe now!", 2: "Subscribe now?", 3: "}\n\n \n", 4: "\n\t"}


def test_lines_that_share_a_half(spark):
    """Many lines with one half in common and a number that differs: none is near but the last two."""
    rows = [(i, f"This passage is repeated everywhere with {i * 1117 + 100000}") for i in range(400)] + [(500, "This passage is repeated everywhere with 100001")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    texts = dict(rows)
    for i, text in rows:
        near = any(o < i and within_one(text, texts[o]) for o, _ in rows)
        assert got[i] == ("" if near else text)
    assert got[500] == ""


def test_lines_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = line_dedup.dedup_lines(docs)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 11
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[1] is None and by_id[2] == "" and by_id[8] == "x" * 5000 and by_id[9] == ""
    assert line_dedup.dedup_lines(no_documents(spark)).count() == 0


# 6


def groups_by_hand(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    index = defaultdict(list)
    for i in sorted(sets):
        near = {o for g in sets[i] for o in index[g]}
        for o in near:
            if den * len(sets[i] & sets[o]) >= num * len(sets[i] | sets[o]):
                a, b = root(o), root(i)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            index[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num,block", [(3, 90, 2048), (5, 80, 2048), (2, 70, 8)])
def test_near_groups(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(6)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.randint(3, 160))]
        for _ in range(rnd.randint(1, 14)):
            w = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(df, ngram_join.Rule(k, num, 100)).collect()}
    assert got == groups_by_hand(rows, k, num, 100)


def test_groups_of_odd_documents(spark):
    docs = odd_documents(spark)
    assert ngram_join.near_groups(docs).count() == 11
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 8]
    assert ngram_join.near_groups(no_documents(spark)).count() == 0
    assert ngram_join.one_of_each(no_documents(spark)).count() == 0


# 7


def test_chats_read_back(spark):
    bad = ["### user\n", "</turn>\n### assistant\nhi</turn>", "\\", "\\\\###", "a\\</turn>", None, "", "é###\n", "x" * 1000]
    rows = [(c, n, ["user", "assistant", "sys\n### x", None][(c + n) % 4], bad[(c * 7 + n) % len(bad)]) for c in range(12) for n in range(9)] + [(3, 2, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    for c in range(12):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BATCH_BYTES", 500)
    df = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("é"), 50).alias("text"))
    pieces = chat_format.format_chats(df)
    assert pieces.count() > 10
    r = chat_format.digest(pieces).first()
    assert r["n_turns"] == 300 and r["loss_chars"] == 15_000
    assert chat_format.digest(chat_format.format_chats(df.limit(0))).count() == 0


def test_chats_with_other_columns(spark):
    """Clashing columns, long roles, and a conversation that has the number of the query's own."""
    rows = [(-7, 0, "user" * 500, "### hi", *["c"] * 5), (1, 0, "assistant", None, *["c"] * 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _k string, formatted string, n_turns string, piece string, `a.b` string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    for conv, _, role, text, *_ in rows:
        assert got[conv]["n_turns"] == 1
        assert got[conv]["turns_sha256"] == hashlib.sha256(f"{role}\n{text or ''}\n".encode()).hexdigest()


# 8


def test_base_counts(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e a b c d e"), (4, "l one\nl one\n \nl one"), (5, "#a |b| <c> $1 50%"), (6, "x " * 30), (7, " ".join(f"w{i}" for i in range(20_000)))]
    for r in quality_rules.judge(spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")).collect():
        text = dict(rows)[r["doc_id"]] or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_distances_by_hand(spark):
    from collections import Counter
    from math import log2, sqrt

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in docs.collect()}
    kinds = [*(re.compile(p.rstrip("+")) for p in quality_rules.CLASSES.values())]

    def classes(text):
        low = sum("a" <= c <= "z" for c in text)
        named = [sum(bool(k.match(c)) for c in text if not "a" <= c <= "z") for k in kinds]
        return [low, *named, sum(ord(c) > 127 for c in text)]

    def apart(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        h = sum((a * log2(a / x) if a else 0) + (b * log2(b / x) if b else 0) for a, b, x in zip(p, q, m))
        return sqrt(max(0.0, h / 2))

    by_lang, words, total = defaultdict(lambda: [0] * 7), defaultdict(Counter), Counter()
    for text, lang in rows.values():
        by_lang[lang] = [a + b for a, b in zip(by_lang[lang], classes(text))]
        w = re.findall("[^\x20\x09-\x0d]+", text)
        total[lang] += len(w)
        words[lang].update(x.lower() for x in w)
    refs = {g: [x / sum(v) for x in v] for g, v in by_lang.items()}
    common = {g: {w: n / total[g] for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality_rules.COMMON]} for g, c in words.items()}
    none = {g: apart([*[0] * len(c), 1], [*c.values(), 1 - sum(c.values())]) for g, c in common.items()}
    for r in quality_rules.judge(docs).collect():
        text = rows[r["doc_id"]][0]
        w = re.findall("[^\x20\x09-\x0d]+", text)
        far = near = None
        if len(text) >= quality_rules.MIN_CHARS:
            far = min(apart([x / len(text) for x in classes(text)], q) for q in refs.values())
        if len(w) >= quality_rules.MIN_WORDS:
            n = Counter(x.lower() for x in w)
            lists = [([n[x] / len(w) for x in c], [*c.values()]) for c in common.values()]
            near = min(apart([*p, 1 - sum(p)], [*q, 1 - sum(q)]) for p, q in lists)
            share = min(apart([*p, 1 - sum(p)], [*q, 1 - sum(q)]) / none[g] for g, (p, q) in zip(common, lists))
            assert abs(r["word_share"] - share) < 1e-6
        assert (r["class_distance"] is None) == (far is None) and (r["word_distance"] is None) == (near is None)
        assert far is None or abs(r["class_distance"] - far) < 1e-6
        assert near is None or abs(r["word_distance"] - near) < 1e-6
        good = (far is None or far <= quality_rules.MAX_CLASS_DISTANCE) and (near is None or share <= quality_rules.MAX_WORD_SHARE)
        assert r["kept"] == (good and not r["base_failed"])


def test_quality_rules_keep_the_good(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.query(spark, SF).join(labels, "doc_id")
    assert got.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert quality_rules.judge(odd_documents(spark)).count() == 11
    assert quality_rules.judge(no_documents(spark)).count() == 0


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_quality_rules_reject_junk(spark, scale):
    import random

    folder = SF.replace("0.001", scale)
    draw = random.Random(1)
    letters = [" ".join("".join(draw.choices("etaoinsr", k=draw.randint(3, 9))) for _ in range(n)) for n in (60, 400)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    none = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(letters)], "doc_id long, text string, lang string")
    got = quality_rules.judge(docs.unionByName(none)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").where("NOT base_failed AND word_distance IS NOT NULL").select("doc_id", "quality", "kept", "word_distance", "class_distance").collect()
    bad = [r for r in got if r["quality"] == 0]
    assert (len(bad) >= 20 or scale == "0.001") and not [r for r in bad if r["kept"]]
    assert {r["doc_id"] for r in got if not r["kept"]} >= {-1, -2}
    assert not [r for r in got if r["quality"] == 1 and not r["kept"]]
    assert quality_rules.COMMON >= 24


# 9


def test_spans_and_documents_of_the_benchmark(spark):
    words = [f"q{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words[:12])), (2, "Short item!"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + ", ".join(words[:12]).upper() + " after"), (2, " ".join(words[:9])), (3, "a short-item z"), (4, None), (4, None), (5, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, items).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in (1, 2, 3, 4, 5)] == [(14, 12, ["1"]), (9, 0, []), (4, 2, ["2"]), (0, 0, []), (1, 0, [])]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [2, 4, 4, 5]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, mode="span").collect()}
    assert spans[1] == "before after" and spans[3] == "a z" and spans[5] == "clean"
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(odd_documents(spark), items).count() == 11
    assert decontaminate.report(no_documents(spark), items).count() == 0


def test_windows_take_time_by_words_not_by_texts(spark):
    """The same words cost about as much in few long texts as in many short ones."""
    import time

    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "w1 w2")], "item_id long, text string")

    def seconds(words, rows):
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.concat(F.lit("w"), ((i * 7919 + F.col("id")) % 9973).cast("string"))), " ")
        docs = spark.range(rows, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"))
        out = []
        for _ in range(2):
            start = time.time()
            decontaminate.hits(docs, items).count()
            out.append(time.time() - start)
        return min(out)

    assert seconds(200_000, 4) < 2 * seconds(100, 8000) + 1


def test_windows_over_the_ends_of_pieces(spark, monkeypatch):
    """Pieces of few words: the same results."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 3)
    assert rows_of_frame(decontaminate.query(spark, SF)) == rows_of_sql(SF, decontaminate.ORACLE)
    test_spans_and_documents_of_the_benchmark(spark)


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", 0)
    assert rows_of_frame(decontaminate.query(spark, SF)) == rows_of_sql(SF, decontaminate.ORACLE)
    test_spans_and_documents_of_the_benchmark(spark)
    # what crosses the exchange has no words with it
    rows = decontaminate.window_rows(odd_documents(spark), [3, 10], False)
    assert not [kind for _, kind in rows.dtypes if "array" in kind or kind == "string"]


def test_windows_of_all_lengths(spark):
    """Items of several lengths, brute force."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rnd.choices(words, k=k))) for i, k in enumerate([1, 2, 2, 3, 5, 9, 10, 11, 14])]
    docs = [(i, " ".join(x for _ in range(rnd.randint(0, 4)) for x in (*rnd.choices(words, k=rnd.randint(0, 6)), rnd.choice(items)[1]))) for i in range(60)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.report(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    for i, text in docs:
        w, hit, own = text.split(), set(), set()
        for item, t in items:
            x = t.split()
            n = min(len(x), 10)
            for window in {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}:
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) == window:
                        hit |= set(range(j, j + n))
                        own.add(str(item))
        assert got[i] == (len(w), len(hit), sorted(own))


def test_odd_documents_keep_their_columns(spark):
    items = spark.createDataFrame([(1, "no id at all here"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string")
    docs = odd_documents(spark)
    for mode in ("document", "span"):
        out = decontaminate.decontaminate(docs, items, mode=mode)
        assert out.columns == docs.columns and out.count() == (8 if mode == "document" else 11)
        assert decontaminate.decontaminate(no_documents(spark), items, mode=mode).count() == 0


# 10


def test_quality_of_held_out_documents(spark):
    folder = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_fm.query(spark, folder).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above >= 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_pair_sum_identity():
    import numpy as np

    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.N_FEATURES).astype(np.float32), rng.normal(size=(quality_fm.N_FEATURES, 4)).astype(np.float32))
    rows, at, x = np.array([0, 0, 0, 1, 1]), np.array([3, 7, 9, 7, 11]), np.array([0.5, 1.0, -2.0, 1.0, 0.2], np.float32)
    for r, z in enumerate(m.logits(rows, at, x, 2)):
        i, v = at[rows == r], x[rows == r]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(z - (0.3 + (m.linear[i] * v).sum() + pairs)) < 1e-3


def test_quality_of_odd_documents(spark):
    docs = odd_documents(spark)
    one = quality_fm.fit(docs.withColumn("quality", F.lit(1)))
    assert all(r["score"] > 0.99 for r in quality_fm.score(docs, one).collect())
    none = quality_fm.fit(no_documents(spark).withColumn("quality", F.lit(1)))
    assert {round(r["score"], 3) for r in quality_fm.score(docs, none).collect()} == {0.5}
    assert quality_fm.score(no_documents(spark), none).count() == 0


def test_vocabulary_counts(spark):
    """op8: words of several scripts and lengths, none of them, and lists of nothing else."""
    from quern.llm.quality_rules import vocabulary_counts

    rng, vocabulary = random.Random(8), sorted(["a", "ab", "and", "der", "été", "é", "и", "𝒳", "zz", "ﬀ"])
    lists = [[], ["x"], ["a"] * 5, vocabulary * 3] + [[rng.choice([*vocabulary, "other", "aa"]) for _ in range(rng.randint(1, 80))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, w array<string>")
    for r in df.select("i", vocabulary_counts(F.col("w"), vocabulary).alias("k")).collect():
        assert r["k"] == [lists[r["i"]].count(v) for v in vocabulary]
