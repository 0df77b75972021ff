"""Importance resampling, chat formatting and ranked search against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probeframe.llm import chat_format, importance, queries, ranked_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `a.b` string, mark long, n_words int"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AWKWARD = [None, "", " \t\n...", "a", "Éa ÉA éa", "x\x00y", "İstanbul STRASSE straße", "naïve café ￾ 🙂🙂 x\x0by", "don't-stop_now 3.14 <|im_start|>", "word " * 30000, "z" * 5000]


def terms(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 5, 19, 20, 21, 60, 200]))) for _ in range(n)]


def table(spark, texts, first=0):
    rows = [(first + i, t, None, "s", None, 0.5, "x", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:3], (None, "no id " * 12, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [*AWKWARD, *corpus(1, 400), *(["one two three four five"] * 40)]).repartition(5).cache()


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 299)}" for _ in range(rng.choice([1, 3, 12, 40]))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "absent word", "W3 w3 W3", "é ÉA", "one two", "word z"])]
    return spark.createDataFrame([*rows, rows[2], (None, "w1 w5")], "item_id long, text string")


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def resampled(docs, target, runs=(1, 1), buckets=10_000, least=20, percent=10, seed="2024:"):
    def features(text):
        w = terms(text)
        return [" ".join(w[i : i + k]) for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = []
    for d, x in docs:
        h = int(hashlib.sha256(f"{seed}{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features(x))
        out.append([d, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(x))])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=key)


@pytest.mark.parametrize(("runs", "buckets", "least", "percent"), [((1, 1), 10_000, 20, 10), ((1, 2), 64, 5, 50), ((2, 3), 100, 0, 100)])
def test_resampling(spark, docs, items, runs, buckets, least, percent):
    got = importance.resample(docs, items, runs=runs, buckets=buckets, least_words=least, percent=percent)
    want = resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()], runs, buckets, least, percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key) == want
    drawn = importance.drawn_documents(docs, got)
    assert drawn.columns == docs.columns and drawn.count() == sum(r[4] is not None for r in want)
    assert sorted(key((r["doc_id"],)) for r in drawn.collect()) == sorted(key((r[0],)) for r in want if r[4] is not None)


def test_resampling_of_empty_tables(spark, docs, items):
    empty = docs.filter("false")
    assert importance.resample(empty, items).count() == 0
    nothing = importance.resample(docs, items.filter("false"))
    assert nothing.filter("rank is not null").count() == 10 * nothing.filter("n_words >= 20").count() // 100
    assert importance.bucket_counts(spark.createDataFrame([], SCHEMA)).sum() == 0


def test_bucket_counts_are_whole_and_merge(docs):
    whole = Counter(zlib.crc32(t.encode()) % 10_000 for r in docs.collect() for t in terms(r["text"]))
    got = importance.bucket_counts(docs.repartition(40))
    assert {i: int(n) for i, n in enumerate(got) if n} == dict(whole)


# chats


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|n|> <|", "|> <|image|>", "a\nb", "", None, "é🙂<", "<|n|>", "\\", "<<|>|", "x" * 50000]


def test_chats_come_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\nuser", "<|im_end|>", None]), rng.choice(ODD), "z") for c in [*range(30), None] for t in range(rng.randint(1, 9))]
    rows += [(99, None, "user", "first", "z"), (99, 1, "b", "tie", "z"), (99, 1, "a", "tie", "z"), (99, 1, "a", "tie", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = chat_format.write_chats(chat_format.format_chats(frame.withColumn("parts", chat_format.text_parts(F.col("text")))))
    back = chats.select("*", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    whole = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array_join(chat_format.texts_of(t["content"]), "").alias("text")))
    got = {r["conv_id"]: r for r in back.select("*", whole.alias("read")).collect()}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        want = [(r, x) for _, r, x in sorted(turns)]
        row = got[c]
        assert [(t["role"], t["text"]) for t in row["read"]] == want and row["n_turns"] == len(want)
        assert row["under"] == "".join(x for r, x in want if r == "assistant")
        assert "".join(row["formatted"][s["start"] : s["stop"]] for s in row["loss"]) == "".join(row["formatted"].encode()[s["start_byte"] : s["stop_byte"]].decode() for s in row["loss"])
        assert row["formatted"].count("<|im_start|>") == row["formatted"].count("<|im_end|>") == len(want) and row["expanded_tokens"] == 0
    assert chat_format.format_chats(frame.filter("false").withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_parts_become_placeholders_and_come_back(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    parts = [
        part("text", "see <|image|> "), part("image", ref="i1", width=57, height=28), part("audio", ref="a1", seconds=1.01), part(None, "and"), part("text", " more"),
        part("document", ref="d1", pages=3), part("hologram", ref="h1"), part("image", ref=None), part("text", None),
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "done <|audio|>")]), (2, 0, "user", None), (2, 1, "assistant", []), (3, 0, "assistant", [part("image", ref="x", width=0, height=0)])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    chats = chat_format.write_chats(chat_format.format_chats(frame))
    read = F.transform(F.arrays_zip(chat_format.turns_of(F.col("formatted")).alias("t"), F.col("attachments").alias("a")), lambda x: chat_format.parts_of(x["t"]["content"], x["a"]))
    got = {r["conv_id"]: r for r in chats.select("*", read.alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    assert [tuple(p) for p in got[1]["back"][0]] == [
        ("text", "see <|image|> ", None, 0), ("image", None, "i1", 3), ("audio", None, "a1", 26), ("text", "and more", None, 0), ("document", None, "d1", 768), ("file", None, "h1", 1), ("image", None, None, 1),
    ]
    assert [tuple(p) for p in got[1]["back"][1]] == [("text", "done <|audio|>", None, 0)] and got[1]["under"] == "done <|audio|>" and got[1]["expanded_tokens"] == 3 + 26 + 768 + 1 + 1
    assert got[1]["formatted"].startswith("<|im_start|>user\nsee <\\|image|> <|image|><|audio|>and more<|document|><|file|><|image|><|im_end|>\n")
    assert got[2]["back"] == [[], []] and got[2]["under"] == "" and [tuple(p) for p in got[3]["back"][0]] == [("image", None, "x", 1)]


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("<|\\>n a\n") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    assert all(r["u"] == r["t"] and "<|" not in r["e"] for r in got)


# search


def searched(docs, items, most):
    sizes = [(d, Counter(terms(x))) for d, x in docs]
    sizes = [(d, c, sum(c.values())) for d, c in sizes if c]
    n, total, df = len(sizes), sum(s for *_, s in sizes), Counter(t for _, c, _ in sizes for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, s in sizes:
            m = 50 + 50 * s * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:most])]
    return sorted(out, key=key)


@pytest.mark.parametrize(("most", "segment", "least", "block"), [(50, 4096, (64, 256), 512), (3, 60, (2, 6), 512), (1, 7, (1, 2), 4), (10, 1, (1, 1), 1)])
def test_search_against_all_scores(spark, docs, items, monkeypatch, most, segment, least, block):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    proven = []
    got = ranked_search.search(ranked_search.build_index(docs, segment_docs=segment, least_postings=least), items, most, proven=proven)
    want = searched([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], most)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=key) == want
    if most == 3:
        assert {0, 2} <= set(proven)  # some items need all tiers, some don't


def test_search_of_empty_tables(spark, docs, items):
    index = ranked_search.build_index(docs)
    assert ranked_search.search(index, items.filter("false")).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs.filter("false")), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs.filter("text is null")), items).columns == ["item_id", "rank", "doc_id", "score", "tier"]


def test_lower_tiers_are_not_read(spark, docs):
    index = ranked_search.build_index(docs)
    plan = index.table.select(*ranked_search._columns(0))._jdf.queryExecution().toString()
    assert "docs0" in plan and not re.search(r"ReadSchema: \S*docs1", plan)


def test_queries_are_registered():
    for name in ("op11_importance_resampling", "op12_chat_format", "op13_ranked_search"):
        assert name in queries.QUERIES and name in queries.ORACLES
