"""Fingerprints, personal data, BPE, ranking, n-gram join and page text against plain versions."""

import hashlib
import html
import os
import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cellsmith.llm import bpe, html_extract, ngram_join, pii, ranking, simhash
from cellsmith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")


def check_prints(docs):
    got = simhash.fingerprint_documents(docs).collect()
    tie = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = tie.orderBy(F.col("doc_id").desc_nulls_last(), "tie").collect()
    maker, want = simhash.Fingerprinter(), []
    for k, r in enumerate(rows):
        text, other = r["text"], rows[(k + 1) % len(rows)]["text"]
        tail = len(text) // 3
        changed = text[: len(text) - tail] + other[:tail]
        own, new, far = (maker.of(x.encode()) for x in (text, changed, other))
        same = lambda a, b: 1 - bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1") / 128
        want.append((r["doc_id"], len(text), own.hex(), hashlib.sha256(changed.encode()).hexdigest(), new.hex(), same(own, new), same(own, far)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_prints(spark, edge_docs):
    check_prints(edge_docs)
    check_prints(edge_docs.filter("doc_id = 4").limit(1))


@needs_tables
def test_prints_on_tables(spark):
    check_prints(spark.read.parquet(f"{SF}/documents.parquet"))


def test_search(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(128) for _ in range(30)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(0, 6))) for b in base for _ in range(4)]
    prints = [f"{x:032x}" for x in base + near + base[:5]]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    asked = df.limit(40)
    got = {r[0]: r[1] for r in simhash.count_within(df, asked).collect()}
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {q: sum(apart(q, p) <= simhash.RADIUS for p in prints) for q in {r[0] for r in asked.collect()}}


def test_search_names_near_copies(spark):
    """Planted copies at 0 to 14 bits, spread over all blocks, come back as ids; those beyond the radius do not."""
    rnd = random.Random(11)
    base = [rnd.getrandbits(128) for _ in range(20)]
    rows = [(100 * k, f"{b:032x}") for k, b in enumerate(base)]
    rows += [(100 * k + 1 + n, f"{b ^ sum(1 << x for x in rnd.sample(range(128), n)):032x}") for k, b in enumerate(base) for n in range(15)]
    prints = spark.createDataFrame(rows, "doc_id bigint, fingerprint string")
    found = simhash.find_within(prints, prints.filter("doc_id % 100 = 0"))
    got = {(r["fingerprint"], r["doc_id"]) for r in simhash.members(found, prints).collect()}
    assert got == {(rows[k][1], 100 * k + x) for k in range(20) for x in range(2 + simhash.RADIUS)}
    assert {(r["doc_id"], r["n"], r["apart"]) for r in found.filter("apart < 2").collect()} == {(100 * k + 2 * x, 2 - x, x) for k in range(20) for x in range(2)}


@needs_tables
def test_search_on_tables(spark):
    rows = QUERIES["op1_simhash"](spark, MORE).collect()
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for r in rows:
        near = [x for x in rows if apart(r["fingerprint"], x["fingerprint"]) <= simhash.RADIUS] if r["doc_id"] % 100 == 0 else None
        assert (r["n_within"], r["within"] is None) == (len(near) if near else None, near is None)
        assert not near or {x["fingerprint"] for x in near} == {c["fingerprint"] for c in r["within"]}
        assert not near or {c["doc_id"] for c in r["within"]} <= {x["doc_id"] for x in near}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_patterns():
    rnd = random.Random(8)
    for _ in range(30_000):
        text = "".join(rnd.choice("ab@@.-12 2.+%é9() ") for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text)
    for _ in range(3_000):
        text = "".join(rnd.choice("0123456789-  ") for _ in range(60)) + " 4111-1111 1111 1111 x"
        assert pii.base_spans(text) == plain_spans(text)


def test_chain_model_on_unseen_rows():
    model, table = pii.default_model(), pii.labelled_table(seed=123)
    found = pii.find_spans([t for t, _ in table], model)
    right = sum({(k, s, e) for s, e, k in spans} <= set(every) for (_, spans), (_, every) in zip(table, found))
    clean = [k for k, (_, spans) in enumerate(table) if not spans]
    assert right >= 0.98 * len(table) and sum(bool(found[k][1]) for k in clean) <= 0.03 * len(clean)


def test_viterbi_is_best_path():
    rnd = np.random.default_rng(3)
    model = pii.ChainModel(rnd.normal(size=(pii.FEATURES, 6)), rnd.normal(size=(6, 6)))
    runs = [[[int(x) for x in rnd.integers(0, pii.FEATURES, 3)] for _ in range(n)] for n in (1, 2, 4, 3)]
    from itertools import product

    for run, got in zip(runs, model.viterbi(runs)):
        score = lambda y: sum(model.emit[f, a] for fs, a in zip(run, y) for f in fs) + sum(model.move[a, b] for a, b in zip([0, *y], [*y, 0]))  # noqa: E731, B023
        assert tuple(got) == max(product(range(6), repeat=len(run)), key=score)


def test_secrets_of_letters_alone():
    """Cued words without a digit or '@' are decoded too; the same words in prose are not secrets."""
    cued = [("password={} x", "CorrectHorseBattery"), ("the passwd: {} here", "hunterhunter"), ('token = "{}" now', "abcdefghqwertzuiop"), ("bearer {} sent", "abcDEFghiJKLmnoPQRstuVWXyzABcdef")]
    texts = [line.format(word) for line, word in cued] + ["The password was changed by John Smith, see the token economy.", "CorrectHorseBattery and hunterhunter are long words"]
    found = pii.find_spans(texts, pii.default_model())
    assert [[(k, t[s:e]) for k, s, e in every] for t, (_, every) in zip(texts, found)] == [[("secret", w)] for _, w in cued] + [[], []]


def test_every_word_is_decoded():
    """Runs between certain words give the labels that decoding whole texts gives, for the trained and for random models."""
    rnd, numbers = random.Random(5), np.random.default_rng(5)
    table = [t for t, _ in pii.labelled_table(seed=9)]
    texts = ["", " \n", "="] + [" ".join(rnd.choices(table, k=rnd.randint(1, 6))) + rnd.choice(["", " =", "\n= x"]) for _ in range(80)]
    models = [pii.default_model()]
    for bias in (4, 9):
        emit = numbers.normal(size=(pii.FEATURES, 6))
        emit[pii._feature("b"), 0] += bias
        models.append(pii.ChainModel(emit, numbers.normal(size=(6, 6))))
    for model in models:
        want, got, seen = set(), set(), 0
        for n, text in enumerate(texts):
            if words := pii.WORDS.findall(text):
                labels = model.viterbi([[pii._features(words, k) for k in range(len(words))]])[0]
                want |= {(n, *m.span(), int(y)) for m, y in zip(pii.WORDS.finditer(text), labels) if y}
        for n, run in pii._runs(texts, pii.Vocabulary(model)):
            seen += len(run)
            got |= {(n, s, e, int(y)) for (s, e, _), y in zip(run, model.viterbi([[f for _, _, f in run]])[0]) if y}
        assert got == want and want and seen < sum(len(pii.WORDS.findall(t)) for t in texts)


@needs_tables
def test_redaction(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    left = pii.redact(docs).select("doc_id", "text").collect()
    assert len(left) == docs.count()
    assert not any(plain_spans(r["text"]) for r in left)
    assert not any(re.search(r"password=\w|AKIA[A-Z0-9]{16}|token = \"\w", r["text"]) for r in left)


def check_bpe(docs):
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    made = bpe.encode_documents(docs, file)
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=str)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in made.join(bpe.decode_documents(made, file).select("doc_id", "n_tokens", "decoded"), ["doc_id", "n_tokens"]).collect()), key=str)
    want = {}
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, t] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    assert {(g[0], *map(str, g[1:])) for g in got} <= {(i, *map(str, v)) for (i, _), v in want.items()}
    assert {g[0] for g in got} == {i for i, _ in texts if i is not None}


def test_bpe(spark, edge_docs):
    check_bpe(edge_docs)


@needs_tables
def test_bpe_on_tables(spark):
    check_bpe(spark.read.parquet(f"{SF}/documents.parquet"))


def test_bpe_on_odd_texts():
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    with open(file, "rb") as f:
        content = f.read()
    coder, table = bpe.BytePairCoder(content), bpe.token_bytes(content)
    assert all(coder.piece_ids(b) == [i] for i, b in table.items() if i not in coder.special.values())
    rnd = random.Random(6)
    parts = ["a", "aa", " ", "\n", "\x1c", "\x85", "\xa0", "é", "漢", "🙂", "'s", "1", "½", "_", "<|endoftext|>", "<|end", "́", "\x00", " the", "\r\n", "tion"]
    for _ in range(4_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))
        ids = np.frombuffer(coder.encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids, table) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div><p class='promo'>Ad<p>A</p><p>B</p></div>", "A\nB"),
        ("<div class=promo><p>x<p>y</div><p>Kept text.</p>", "Kept text."),
        ("<p class=ad>a<div>real <b>text</b></div>", "real text"),
        ("<p class=ad>a<br>b</p>c", "c"),
        ("<ul><li class=promo>Ad<li>one</ul>", "one"),
        ("<ul><li class=nav><ul><li>a<li>b</ul><li>kept</ul>", "kept"),
        ("<dl><dt class=ad>x<dd>kept</dl>", "kept"),
        ("<table><tr class=ad><td>x<td>y<tr><td>Kept</table>", "Kept"),
        ("<article><p>Hi.</p></article>", "Hi."),
        ("<p>Short.</p>" + "<nav>menu</nav>" * 3 + "<p>A longer line.</p>", "A longer line."),
        ("<p><a href=x>only a link</a></p>", ""),
    ],
)
def test_page_bounds(page, text):
    """End tags that may be left out, and short texts that no window lets surge: the heaviest run is taken."""
    assert html_extract.main_text(page) == text


def test_heaviest_run():
    """The run against all runs of lines that fewer than ``window`` empty lines part."""
    rnd = random.Random(8)
    for _ in range(300):
        size = [rnd.choice([0, 0, 1, 2, 5]) for _ in range(rnd.randint(1, 14))]
        runs, now = [], []
        for i, n in enumerate(size):
            if n and now and i - now[-1] > 3:
                runs.append(now)
                now = []
            if n:
                now.append(i)
        runs += [now] if now else []
        if runs:
            best = max(runs, key=lambda r: sum(size[i] for i in r))
            start, stop = html_extract._heaviest(size, 3)
            assert [i for i in range(start, stop) if size[i]] == best


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="shared test tables are not here")
def test_radius_holds_near_copies():
    """Of all pairs of different texts with a five-word Jaccard of 0.8 or more, nine in ten lie within the radius."""
    import pyarrow.parquet as pq

    texts = sorted({t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist() if t})
    sets = []
    for t in texts:
        words = t.split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    homes = {}
    for i, found in enumerate(sets):
        for shingle in found:
            homes.setdefault(shingle, []).append(i)
    # A pair of such likeness shares one of the first fifth of its rarest shingles; all their documents are looked at.
    maker, near, within = simhash.Fingerprinter(), 0, 0
    for i, found in enumerate(sets):
        if len(found) < 20:
            continue
        rare = sorted(found, key=lambda s: (len(homes[s]), s))[: len(found) // 5 + 1]
        for j in {j for s in rare for j in homes[s] if j > i and len(sets[j]) >= 20}:
            if 10 * len(found & sets[j]) >= 8 * len(found | sets[j]):
                near += 1
                a, b = (int.from_bytes(maker.of(texts[k].encode()), "big") for k in (i, j))
                within += (a ^ b).bit_count() <= simhash.RADIUS
    print(near, within)
    assert near > 30 and within >= 0.9 * near


def test_ranking_equals_a_plain_fit():
    """Weights against gradient descent over every pair of a good and a bad row, and the cut at the share of bad ones."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(80, 4)).astype(np.float32)
    good = x @ np.array([2.0, -1.0, 0.5, 0.0]) + rnd.normal(size=80) > 0.3
    model = ranking.fit_pairs(x, good, steps=3000)
    z = ((x - x.mean(0)) / (x.std(0) + 1e-3)).astype(float)
    w = np.zeros(4)
    for _ in range(3000):
        pull = np.zeros(4)
        for i in np.flatnonzero(good):
            gap = z[i] - z[~good]
            pull += (gap / (1 + np.exp(gap @ w))[:, None]).sum(0)
        w += 0.1 * (pull / (good.sum() * (~good).sum()) - 0.03 * w)
    assert model.weights @ w / np.linalg.norm(model.weights) / np.linalg.norm(w) > 0.98
    assert abs(np.linalg.norm(model.weights) / np.linalg.norm(w) - 1) < 0.2
    assert ((model.score(x) >= ranking.PASS).sum(), len(x)) == (good.sum(), 80)
    assert ranking.fit_pairs(x, np.ones(80, dtype=bool)) is None


@needs_tables
def test_ranking_holds_out(spark):
    scored = QUERIES["op7_ranking"](spark, MORE)
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out and quality is not null").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) >= 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


@pytest.mark.parametrize("block, good_share", [(8_000, 0.6), (1_000, 0.6), (1_000, 0.01)])
def test_ranking_fits_every_labelled_row(spark, monkeypatch, block, good_share):
    """More rows than a block: as many labelled rows pass as are good, and none of the labels is left out."""
    monkeypatch.setattr(ranking, "BLOCK_ROWS", block, raising=False)
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma9", "d-e", "x;y", "ZETA", "1,2", "eta."]
    rows = []
    for i in range(12_000):
        good = rnd.random() < good_share
        rows.append((i, " ".join(rnd.choices(words, [5 if good else 3, 2, 2, 2, 2, 2, 1, 3], k=rnd.randint(20, 60))), int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = ranking.fit_quality(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    scored = ranking.score_documents(docs, model).join(docs, "doc_id").filter("not held_out")
    n, wanted, passed = scored.agg(F.count("*"), F.sum("quality"), F.sum("predicted")).first()
    assert n > 8_000 and abs(passed - wanted) <= 1
    up, down = (scored.filter(f"quality = {q}").agg(F.avg("score")).first()[0] for q in (1, 0))
    assert up > down + 0.03


def test_ranking_fold(spark):
    import zlib

    ids = spark.range(200).select("id", ranking.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)


def plain_sets(rows, like):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(words[i : i + like.words]) for i in range(len(words) - like.words + 1)} if len(words) >= like.words else {tuple(words)} if words else set()))
    return out


def plain_components(rows, like):
    sets = plain_sets(rows, like)
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and like.den * len(x & y) >= like.num * len(x | y):
            up[top(a)] = top(b)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[top(k)] = min(least.get(top(k), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(k), d)) for k, (d, s) in enumerate(sets)), key=str)


def check_join(docs, like=ngram_join.Likeness()):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.near_duplicates(docs, like).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, like)


def near_copies(seed=9):
    """Groups of texts at all likenesses around the border, texts that share passages, and unlike ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 5)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([3, 4, 5, 9, 30, 120]))]
        for _ in range(rnd.randint(1, 14)):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                text[rnd.randrange(len(text))] = word()
            if rnd.random() < 0.3:
                text = text[: len(text) - rnd.randint(0, max(1, len(text) // 8))]
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(rnd.randint(0, 40))])) for k in range(30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_join_on_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    docs = spark.createDataFrame(near_copies(), "doc_id bigint, text string").repartition(4)
    check_join(docs)
    check_join(docs, corpus_pipeline.LIKE)


def test_components(spark, monkeypatch):
    from cellsmith.llm import forest

    monkeypatch.setattr(forest, "SLICE_LINKS", 5)
    rnd = random.Random(3)
    links = [(rnd.randint(0, 99), rnd.randint(0, 99)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(60)] + [(300, 300 + k) for k in range(30)]
    rnd.shuffle(links)
    up = {n: n for link in links for n in link}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = forest.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, up[n]) for n in linked)


def test_join_on_edges(spark, edge_docs):
    check_join(edge_docs)


@needs_tables
def test_join_on_tables(spark):
    check_join(spark.read.parquet(f"{MORE}/documents.parquet"))


def test_tree_is_exact():
    rnd = random.Random(1)
    like = ngram_join.Likeness(words=1, num=60, den=100)
    for _ in range(300):
        sets = [np.unique(np.array([rnd.randint(0, 14) for _ in range(rnd.randint(1, 12))], dtype=np.uint64)) for _ in range(rnd.randint(2, 14))]
        up = list(range(len(sets)))

        def top(x):
            while up[x] != x:  # noqa: B023
                x = up[x]  # noqa: B023
            return x

        def join(links):
            up[:] = range(len(sets))  # noqa: B023
            for a, b in links:
                up[top(a)] = top(b)
            return {frozenset(k for k in range(len(sets)) if top(k) == t) for t in map(top, range(len(sets)))}  # noqa: B023

        every = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 60 * len(set(sets[a]) | set(sets[b]))]
        assert join(ngram_join.tree_links(list(range(len(sets))), sets, like)) == join(every)


def test_one_of_each(spark, edge_docs):
    rows = ngram_join.one_of_each(edge_docs).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 1, 2, 3, 3, 4, 7, 8, 9, 10, 11]
    assert sum(r["doc_id"] is None for r in rows) == 1


ARTICLE = "<article><h1>A  title&amp;</h1><p>First <b>bold</b>\n words<br><p>Second.</p><div class='share'>Share it</div><p>Last &lt;p&gt; of it.</article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><nav>Only menus <a href='/x'>here</a></nav></html>", ""),
        (f"<title>T</title><script>var a='<p>no</p>';</script><nav><li>menu</li></nav><div class='ad'>Buy</div>{ARTICLE}<section id=comments><p>Nice post, thanks.</p></section><footer>&copy; us</footer>", "A title&\nFirst bold words\nSecond.\nLast <p> of it."),
        ("<body><div class='sidebar'>" + "side text " * 30 + "</div><p>" + "plain words " * 8 + "</p><p>short.</p><ul><li><a>one link only in a list</a></ul></body>", ("plain words " * 8).strip() + "\nshort."),
        ("<article><p>unclosed <i>tags <p>and &nbsp; blanks</article><p>after", "unclosed tags\nand blanks"),
        ("<article><p>a<!-- not <p> here -->b</p><style>p{}</style><p>c < d</p></article>", "ab\nc < d"),
    ],
)
def test_page_text(page, text):
    assert html_extract.main_text(page) == text


BODY = ["plain words " * 8 + "one.", "more words " * 9 + "two.", "The end."]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # One marked teaser does not replace a body in plain blocks.
        ("<body>" + "".join(f"<div>{x}</div>" for x in BODY) + "<nav><a href='/'>home</a></nav><aside>side</aside><article><a href='/n'>Next</a> story</article></body>", [*BODY, "Next story"]),
        # White space between the tags of a page without marks makes no lines.
        ("<body>\n" + "".join(f"<div>\n<div>\n<p>{x}</p>\n</div>\n</div>\n" for x in BODY) + "</body>", BODY),
        # A surge outside the article counts, short text does not.
        (f"<div>{BODY[0]}</div><article><p>{BODY[1]}</p></article><p>tail</p>", [BODY[0], BODY[1], "tail"]),
        (f"<p>Posted</p><article><p>{BODY[1]}</p></article><p>tail</p>", [BODY[1]]),
        # Inside the article, the distribution falls over what is not main text: two crumbs after it make no surge.
        (f"<article><p>{BODY[0]}</p><nav>a</nav><aside>b</aside><p>ok</p></article>", [BODY[0]]),
    ],
)
def test_distribution_decides(page, text):
    assert html_extract.main_text(page) == "\n".join(text)


@needs_tables
def test_pages_on_tables(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extract"](spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|div)[^>]*>", body)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


@needs_tables
def test_pipeline_stages(spark):
    """Each stage on what the one before it kept, against plain versions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF).cache()
    one = stages["ngram_join"](spark, kept, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = plain_components(rows, corpus_pipeline.LIKE)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in groups})
    clean = stages["pii"](spark, one, SF).cache()
    assert all(not plain_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = stages["mixing"](spark, clean, SF).cache()
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in clean.collect()}
    ids = corpus_pipeline.run(spark, SF)
    assert ids.columns == ["doc_id", "n_tokens", "ids"] and ids.count() == mixed.count()
