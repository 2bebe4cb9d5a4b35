"""Chat, mixing, quality rules and shards against SQL and plain Python."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsmith.llm import chat, mixing, quality_rules, sharding
from cellsmith.llm.queries import ORACLES, QUERIES
from workload.check import duck, rows_of

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = duck(SF).execute(ORACLES[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def folded(events):
    """The log played one event after the other."""
    messages = []  # [turn, role, text, kind]
    for _, kind, turn, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4])):
        if kind in ("edit", "regenerate"):
            messages = [m for m in messages if m[0] < turn]
        if kind == "message":
            messages.append([turn, role, text, kind])
            continue
        mine = [m for m in messages if m[0] == turn and m[3] != "message"]
        if mine:
            mine[0][1] = mine[0][1] or role
            mine[0][2] += text
        else:
            messages.append([turn, role, text, "grown"])
    return [(t, r, x) for t, r, x, _ in sorted(messages, key=lambda m: m[0])]


def test_fold(spark):
    rnd = random.Random(5)
    rows = []
    for conv in range(40):
        for seq in range(rnd.randint(1, 14)):
            kind = rnd.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            text = "" if kind == "regenerate" else rnd.choice(["a", "<b>", "&lt;", "</turn>\n", ""])
            rows.append((conv, seq, kind, rnd.randint(0, 3), rnd.choice(["user", "assistant"]), text))
    events = spark.createDataFrame(rows, "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string")
    made = chat.fold_events(events)
    got = {}
    for r in made.orderBy("conv_id", "turn", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for conv in range(40):
        assert got.get(conv, []) == folded([r[1:] for r in rows if r[0] == conv])
    texts = {r["conv_id"]: r for r in chat.digest_chats(chat.render(made)).collect()}
    for conv, turns in got.items():
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert texts[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert texts[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert (texts[conv]["n_turns"], texts[conv]["loss_chars"]) == (len(turns), len(learned))


def test_drafted_log(spark):
    """The log holds every kind of event, and folding it gives the rows back, as the plain fold does."""
    rnd = random.Random(9)
    rows = [(c % 30, rnd.randint(0, 5), rnd.choice(["user", "assistant", None, "tool"]), rnd.choice(["", None, "a", "a<b>🙂", "one two three"])) for c in range(300)]
    turns = spark.createDataFrame([*rows, rows[0], (None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    events = chat.drafted_log(turns)
    log = events.collect()
    assert {r["kind"] for r in log} == {"message", "delta", "edit", "regenerate"}
    got, want, plain = {}, {}, {}
    for r in chat.fold_events(events).orderBy("conv_id", "turn", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c, t, role, text in [*rows, rows[0], (None, 1, "user", "x")]:
        want.setdefault(c, []).append((t, role is not None, role or "", text is not None, text or ""))
    for r in log:
        plain.setdefault(r["conv_id"], []).append((r["seq"], r["kind"], r["turn"], r["role"], r["text"]))
    assert got == {c: [(role, text) for _, _, role, _, text in sorted(turns)] for c, turns in want.items()}
    assert got == {c: [(role, text) for _, role, text in folded(mine)] for c, mine in plain.items()}
    assert chat.drafted_log(turns.limit(0)).collect() == []


def test_chat_bounds(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (2, None, 'odd"><role', "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.render(chat.fold_events(chat.events_from_turns(turns)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 200_000
    assert got[2]["turns_sha256"] == hashlib.sha256(b'odd"><role\n\n').hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.render(chat.fold_events(chat.events_from_turns(turns.limit(0)))).collect() == []


def plain_rules(text):
    blanks = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")
    words = [w for w in (text or "").translate(blanks).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.translate(blanks).strip(" ")]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def grams_of(words, order):
    """All runs of up to ``order`` words; past the end there is nothing to add."""
    return [tuple(words[i : i + k]) + (None,) * (i + k - len(words)) for k in range(1, order + 1) for i in range(len(words))]


def check_rules(spark, docs, ids, ratio=quality_rules.Ratio()):
    rows = docs.select("doc_id", "text").collect()
    got = quality_rules.judge(docs, quality_rules.fit_ratio(docs, ids, ratio), ratio).collect()
    words = lambda t: [w for w in (t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    vocabulary = sorted({w for r in rows for w in words(r["text"])})
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    place = {(w,): h % ratio.buckets for w, h in hashed.items()}
    for k in range(2, ratio.order + 1):
        seen = sorted({g for r in rows for g in grams_of(words(r["text"]), k) if len(g) == k}, key=repr)
        columns = [f"h{i}" for i in range(k)]
        numbers = spark.createDataFrame([(i, *[hashed.get(w) for w in g]) for i, g in enumerate(seen)], "i int, " + ", ".join(f"{c} bigint" for c in columns))
        for r in numbers.select("i", F.xxhash64(*columns).alias("h")).collect():
            place[seen[r["i"]]] = r["h"] % ratio.buckets
    good_ids = {r[0] for r in ids.collect() if r[0] is not None}
    raw, good = np.zeros(ratio.buckets), np.zeros(ratio.buckets)
    for r in rows:
        for g in grams_of(words(r["text"]), ratio.order):
            raw[place[g]] += 1
            good[place[g]] += r["doc_id"] in good_ids
    p = (raw + 1) / (raw.sum() + ratio.buckets)
    mass = ratio.prior * ratio.buckets
    log = np.log((good + mass * p) / (good.sum() + mass)) - np.log(p)
    want = []
    for r in rows:
        base = plain_rules(r["text"])
        mean = sum(log[place[g]] for g in grams_of(words(r["text"]), ratio.order)) / (base[0] * ratio.order) if base[0] else 0.0
        want.append((r["doc_id"], *base, not base[-1] and mean >= ratio.least, mean))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:6])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:-1] == b[:-1] and math.isclose(a[-1], b[-1], abs_tol=1e-8)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_rules_on_edges(spark, edge_docs, few_labels, order):
    check_rules(spark, edge_docs, few_labels.filter("quality = 1").select("doc_id"), quality_rules.Ratio(order=order, buckets=1 << 12))


@needs_tables
def test_rules_on_tables(spark):
    check_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"))


def test_rules_trust_every_label(spark):
    """More good labels than the bound there once was, some without a document; each document has a word of its own."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("plain text "), 10), F.lit("own"), "id").alias("text"))
    check_rules(spark, docs, spark.range(400, 24_000).toDF("doc_id"))


def least_capacity(sizes, shards):
    """Minimax by dynamic programming over all cuts."""
    best = [0, *[math.inf] * len(sizes)]
    for _ in range(shards):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def test_minimax():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = [rnd.choice([1, 2, 5, 40]) for _ in range(rnd.randint(0, 12))]
        cuts = sharding.minimax_cuts(np.array(sizes, dtype=np.int64), 4)
        assert len(cuts) == 4 and cuts == sorted(cuts)
        loads = [sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)])]
        assert sum(loads) == sum(sizes) and max(loads) == least_capacity(sizes, 4)


def check_shards(docs):
    got = sharding.shard_documents(docs, 24).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    homes = {}
    for r in got:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["shard"] for r in got} <= set(range(24))


@pytest.mark.parametrize("hot", [1, 60, 2500])
def test_shards_are_minimal_over_groups(spark, hot):
    """With four first ranges, the largest shard is what dynamic programming over all groups finds."""
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("h"), hot)).otherwise(F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int"))).alias("text"),
    )
    sized = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 8).alias("size")).orderBy("h").collect()
    got = sharding.shard_documents(docs, 7, atoms=4).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    assert max(r["size"] for r in got) == least_capacity([r["size"] for r in sized], 7)
    assert {(r["shard"], r["size"]) for r in got} == {(r["shard"], r["size"]) for r in sharding.shard_documents(docs, 7).groupBy("shard").agg(F.sum("size").alias("size")).collect()}


def test_word_shapes_are_whole():
    from cellsmith.llm.ranking import Featurizer

    words = [b"a" * 300 + end for end in (b"99", b"zz", b"Z.")]
    assert len({Featurizer()._bucket(w) for w in words}) == 3


def test_shards(spark, edge_docs, monkeypatch):
    check_shards(edge_docs)
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    check_shards(hot)


def test_mix_keeps_every_document(spark):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 7).cast("int") + 1).alias("text"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"),
    )
    mix = mixing.Mix(repeats=2.0, budget=None)
    drawn = mixing.mix_documents(docs, mix, keep=True)
    assert drawn.columns == docs.columns
    times = Counter(r["doc_id"] for r in drawn.collect())
    assert set(times) == set(range(600)) and set(times.values()) == {1, 2}
