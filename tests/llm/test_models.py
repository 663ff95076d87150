"""Quality rules, toxicity, context tree, neighbours, pseudonyms, pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held_out_accuracy(spark, name, label):
    from shelfscope.llm.queries import QUERIES

    found = QUERIES[name](spark, LARGER)
    assert found.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    both = found.join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in both)
    return np.mean([r.predicted == r[label] for r in both])


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op2_quality_rules", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op10_toxicity_machine", "toxic") > 0.93


def test_rules_compile_to_what_they_say(spark, documents, odd_rows):
    from shelfscope.llm.quality_rules import NAMES, paths, score_column, scored, with_statistics

    forest = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 0.5)\n     If (feature 3 > 0.25)\n      Predict: 0.0\n     Else (feature 3 <= 0.25)\n      Predict: 1.0\n    Else (feature 1 > 0.5)\n     Predict: 1.0\n"
    rules = paths(forest)
    assert rules == [((1, "<=", 0.5),), ((1, "<=", 0.5), (3, ">", 0.25)), ((1, "<=", 0.5), (3, "<=", 0.25)), ((1, ">", 0.5),)]
    model = {"rules": [(r, w) for r, w in zip(rules, (0.5, -2.0, 1.5, 0.25), strict=True)], "intercept": -0.3}
    table = with_statistics(documents(odd_rows)).withColumn("s", score_column(model))
    for r in table.collect():
        total = -0.3
        for rule, w in model["rules"]:
            total += w * all((r[NAMES[f]] <= t) if sign == "<=" else (r[NAMES[f]] > t) for f, sign, t in rule)
        assert r.s == pytest.approx(1 / (1 + math.exp(-total)))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in scored(documents(odd_rows, clash=True), none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (6, 1), (6, 1), (None, 0)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in scored(documents(odd_rows), one, F.lit(True)).collect())
    assert scored(documents([]), one, F.lit(True)).collect() == []


def test_machine_learns_pairs(spark, documents, odd_rows):
    from shelfscope.llm.toxicity_fm import FactorParameters, fit_machine, machine_score, scored, term_buckets

    p = FactorParameters(buckets=1 << 10, passes=60, least_chi2=0.0)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (1200, 2))
    terms = [np.flatnonzero(np.concatenate([r, rng.integers(0, 2, 6)])) for r in x]
    labels = (x[:, 0] & x[:, 1]).astype(float)
    model = fit_machine(terms, labels, p)
    assert np.mean([(machine_score(model, t) >= 0.5) == y for t, y in zip(terms, labels, strict=True)]) > 0.97
    t = terms[0]
    v = model["vector"].astype(float)
    pairs = sum(float(v[i] @ v[j]) for a, i in enumerate(t) for j in t[a + 1 :])
    total = model["bias"] + float(model["weight"][t].sum(dtype=float)) + pairs
    assert machine_score(model, t) == pytest.approx(1 / (1 + math.exp(-total)))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = scored(documents(odd_rows, clash=True), none, F.lit(True))
    assert {r.score for r in got.collect()} == {0.5} and got.columns.count("score") == 1
    one = spark.createDataFrame([(5, 0), (6, 0), (6, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in scored(documents(odd_rows), one, F.lit(True)).collect())
    assert scored(documents([]), one, F.lit(True)).collect() == [] and len(term_buckets("", 8)) == 0


def test_machine_finds_pairs_of_neutral_terms():
    from shelfscope.llm.toxicity_fm import FactorParameters, fit_machine, informative, machine_score

    p = FactorParameters()

    def rows(seed, n=12_800):
        rng = np.random.default_rng(seed)
        alone, some = rng.random(n) < 0.11, rng.random((n, 6)) < 0.03
        meets = (some[:, 0::2] & some[:, 1::2]).any(axis=1)
        terms = [
            np.unique(np.concatenate([1000 + rng.integers(0, 400, 40), 10 + np.flatnonzero(s), [300 + rng.integers(0, 4)] * int(x)]).astype(np.int64))
            for s, x in zip(some, alone, strict=True)]
        return terms, (alone | meets).astype(float), meets & ~alone

    terms, labels, _ = rows(1)
    assert not informative(terms, labels, p)[10:16].any()
    model = fit_machine(terms, labels, p)
    terms, labels, meets = rows(2)
    called = np.array([machine_score(model, t) >= 0.5 for t in terms])
    assert meets.sum() > 20 and called[meets].mean() > 0.9 and called[labels == 0].mean() < 0.001


def brute_context_tree(train, texts, depth):
    """log10 probabilities by direct recursion over the counts."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        raw = b"\xff" * depth + text + b"\xff"
        for k in range(depth, len(raw)):
            node = 1
            for j in range(7, -1, -1):
                bit = raw[k] >> j & 1
                yield raw[k - depth : k], node, bit
                node = node << 1 | bit

    for t in train:
        for context, node, bit in decisions(t):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1

    def pe(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi) if sum(c) else 0.0

    longer = defaultdict(list)
    for context, node in list(counts):
        if context:
            longer[context[1:], node].append(context)
    memo = {}

    def pw(context, node):
        if (context, node) not in memo:
            own = pe(counts[context, node])
            if len(context) == depth:
                memo[context, node] = own
            else:
                rest = sum(pw(c, node) for c in longer[context, node])
                high = max(own, rest)
                memo[context, node] = high + math.log((math.exp(own - high) + math.exp(rest - high)) / 2)
        return memo[context, node]

    out = []
    for t in texts:
        total = 0.0
        for context, node, bit in decisions(t):
            left, one = 1.0, 0.0
            for d in range(depth + 1):
                key = context[depth - d :], node
                c = counts.get(key, [0, 0])
                stop = 1.0 if d == depth else (math.exp(pe(c) - pw(*key)) / 2 if sum(c) else 0.5)
                one += left * stop * (c[1] + 0.5) / (sum(c) + 1)
                left *= 1 - stop
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


def test_context_tree_against_recursion(spark, documents, odd_rows):
    from shelfscope.llm.common import held_out
    from shelfscope.llm.context_tree import ContextTree, scored

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sät", "on", "Mat,"]) for _ in range(rng.randrange(25))), None, None) for k in range(40)]
    rows += [r for r in odd_rows if r[0] != 4]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    learned = [(t or "").encode() for i, t, _, _ in rows if train(i)]
    words = Counter(w for t in learned for w in [*t.lower().split(), None])
    n, v = sum(words.values()), len(words)
    want = Counter()
    scores = brute_context_tree(learned, [(t or "").encode() for _, t, _, _ in rows], 2)
    for (i, t, _, _), s in zip(rows, scores, strict=True):
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, not train(i), len(w), sum(words[x] > 0 for x in w), n, round(base, 6), round(s, 6)] += 1
    for p in (ContextTree(depth=2), ContextTree(depth=2, hot=3, together=50, entries=5)):
        got = scored(documents(rows, clash=True).repartition(3), ~held_out(F.col("doc_id"), 10, 0), p).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert len(scored(documents(odd_rows), F.lit(False), ContextTree(depth=1)).collect()) == len(odd_rows)
    assert scored(documents([]), F.lit(True), ContextTree(depth=1)).collect() == []


def brute_neighbours(rows, k):
    usable = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    dims = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, dims - len(v)))) for i, v in usable]
    out = []
    for a, (i, q) in enumerate(usable):
        if i is not None and i % 20 == 0:
            best = sorted((-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(usable) if a != b)[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(best, 1)]
    return Counter(out)


def test_neighbours_against_brute_force(spark):
    from shelfscope.llm.knn import KnnParameters, voronoi_knn

    rng = np.random.default_rng(6)
    same = [0.5, 0.5, 0.1, 0.0]
    rows = [(k, rng.normal(0, 1, 4).tolist()) for k in range(300)] + [(k, same) for k in range(300, 420)]
    rows += [(k, (np.array([5.0, 0, 0, 0]) + rng.normal(0, 0.05, 4)).tolist()) for k in range(420, 520)]
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan"), 1.0]), (603, []), (20, same), (40, same), (40, same), (None, same), (620, [9.0]), (640, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute_neighbours([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 7)
    for p in (KnnParameters(k=7), KnnParameters(k=7, pivots=9, group_rows=4, block_rows=64)):
        got = voronoi_knn(table, F.col("vec_id") % 20 == 0, p=p).collect()
        assert Counter(map(tuple, got)) == want
    few = voronoi_knn(table.where("vec_id in (20, 5)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank) for r in few if r.query_id == 20]
    assert voronoi_knn(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    long = spark.createDataFrame([(20, [1e8, 0.0]), (5, [-2e7, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 63 bits"):
        voronoi_knn(long, F.col("vec_id") % 20 == 0).collect()
    fits = voronoi_knn(long.withColumn("embedding", F.transform("embedding", lambda x: x / 10)), F.col("vec_id") % 20 == 0).collect()
    assert [r["score"] for r in fits] == [int(64e7) * int(-64 * 2e6)]


def test_pseudonyms(documents, odd_rows):
    from shelfscope.llm import pii

    for size in (1, 2, 3, 10, 73, 1000):
        assert sorted(pii.permuted(i, size, b"k", "t") for i in range(size)) == list(range(size))
    clean = "Version 1.2.3.4567 of 12 items, 999.1.1.1, card 1234567890123456, 31/31/2020 and 5-6."
    assert pii.pseudonymise(clean, b"k") == (clean, [])
    values = {
        "email": "bosbt.42@mail8.example.com", "card": "4041 8949 7460 8795", "ip": "42.144.35.254", "phone": "+1 (988) 555-2485",
        "national": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00", "date": "2024-02-29", "secret": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"}
    text = "; ".join(f"{k} is {v}" for k, v in values.items())
    new, places = pii.pseudonymise(text, b"k")
    assert [p["kind"] for p in places] == list(values) and not any(v in new for v in values.values())
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    for p, old in zip(places, values.values(), strict=True):
        got = new[p["start"] : p["end"]]
        if p["kind"] not in ("email", "secret", "ip", "iban"):
            assert shape(got) == shape(old)
        if p["kind"] == "card":
            assert pii.luhn("".join(c for c in got if c.isdigit())) == 0
            assert got.replace(" ", "") in pii.pseudonymise("4041894974608795", b"k")[0]
        if p["kind"] == "iban":
            assert pii._mod97(got.replace(" ", "")) == 1
    assert pii.pseudonymise(text, b"k")[0] == new != pii.pseudonymise(text, b"other")[0]
    assert pii.pseudonymise(new.split(";")[6], b"k")[1][0]["kind"] == "date"
    mails = [f"user{k}@host.org" for k in range(300)]
    assert len({pii.mail(m, b"k") for m in mails}) == 300
    rows = odd_rows + [(50, text, None, None)]
    got = pii.pseudonyms(documents(rows, clash=True), b"k").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, new if i == 50 else t) for i, t, _, _ in rows)
    assert pii.pseudonyms(documents([]), b"k").collect() == []


def test_pseudonyms_beside_other_groups():
    from shelfscope.llm import pii

    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    new_card, new_iban = pii.card(card, b"k"), pii.iban(iban, b"k")
    around = ("{} 12/26", "{} 123", "{} 2027-01-31", "{} 12ab", "order 12 {}", "1234 5678 {}", "{} 1234 5678 9012", "is {}.", "{}-123")
    for text in around:
        got, places = pii.pseudonymise(text.format(card), b"k")
        assert new_card in got and "card" in [p["kind"] for p in places], text
    assert pii.pseudonymise(f"{card} 5500 0000 0000 0004", b"k")[0] == f"{new_card} {pii.card('5500 0000 0000 0004', b'k')}"
    assert pii.pseudonymise("3782 822463 10005 1234", b"k")[0] == pii.card("3782 822463 10005", b"k") + " 1234"
    for text in ("{}", "{} PAID", "{} PAID INVOICE 12", "{} AB", "AB12 CDEF GHIJ {} X"):
        assert pii.pseudonymise(text.format(iban), b"k")[0] == text.format(new_iban)
    two = f"{iban} DE89 3704 0044 0532 0130 00 OK"
    assert pii.pseudonymise(two, b"k")[0] == f"{new_iban} {pii.iban('DE89 3704 0044 0532 0130 00', b'k')} OK"
    for after in ("T12:00:00Z", "T12:00", "T120000.5+01:00", "t12:00:00z"):
        assert pii.pseudonymise(f"2024-03-05{after}", b"k")[0] == pii.date("2024-03-05", b"k") + after
    clean = "1234 5678 9012 3456 78, 2024-03-05Tx, BE68 5390 0754 7035 PAID"
    assert pii.pseudonymise(clean, b"k") == (clean, [])
    long = "12 " * 200_000
    assert len(pii.pseudonymise(long, b"k")[0]) == len(long)


def test_long_values_are_permuted_in_linear_time(documents):
    import time

    from shelfscope.llm import pii

    run = "0123456789abcdef" * 600_000  # 9.6 MB of hexadecimal
    started = time.monotonic()
    new, places = pii.pseudonymise(f"dump {run} end", b"k")
    assert time.monotonic() - started < 20 and [p["kind"] for p in places] == ["secret"] and len(new) == len(run) + 9
    got = new[5:-4]
    assert set(got) <= set("0123456789abcdef") and sum(x == y for x, y in zip(got, run)) < len(run) / 8
    # one character changes all of the pseudonym; equal values get equal ones; the classes of a mail name stay
    other = pii.permuted_text("1" + run[1:2000], b"k", "hex", ("0123456789abcdef",))
    assert sum(x == y for x, y in zip(other, pii.permuted_text(run[:2000], b"k", "hex", ("0123456789abcdef",)))) < 300
    name = "ab1.C-" * 60
    changed = pii.permuted_text(name, b"k", "t")
    assert changed != name and all(x == y if not x.isalnum() else (x.isdigit(), x.isupper()) == (y.isdigit(), y.isupper()) for x, y in zip(name, changed))
    # one-to-one: all values of a small domain of long values, most of whose places are fixed by their class
    values = {pii._long_text(f"{k:04d}", b"k", "t", {c: "0123456789" for c in "0123456789"}, "9999") for k in range(10_000)}
    assert len(values) == 10_000 == sum(len(v) == 4 and v.isdigit() for v in values)
    rows = documents([(1, "mail a@b.org", "en", "a")]).selectExpr("*", "'x' AS replaced", "1 AS _found")
    found = pii.pseudonyms(rows, b"k").first()
    assert found["_found"] == 1 and found.replaced[0].kind == "email"


def test_phones_are_linked_by_their_digits():
    from shelfscope.llm import pii

    forms = ("+44 2079460958", "+442079460958", "+44 20 7946 0958", "+44 (20) 7946-0958")
    assert len({pii._digits(pii.phone(f, b"k")) for f in forms}) == 1 and pii.phone(forms[1], b"k").startswith("+44")
    assert [pii.phone(f, b"k")[: len(c) + 1] for f, c in (("+1 988 555 2485", "1"), ("+352 26 12 34 56", "352"))] == ["+1", "+352"]


def test_pseudonyms_of_named_secrets():
    from shelfscope.llm import pii

    for text, value in (("Password: hunter-2_ab.cd!", "hunter-2_ab.cd!"), ("API_KEY=ABCD-1234.x", "ABCD-1234.x"), ("see ghp_" + "a1B2" * 9, "a1B2" * 9),
                        ('"apiKey": "q1w2e3r4t5."', "q1w2e3r4t5")):
        got, places = pii.pseudonymise(text, b"k")
        assert [p["kind"] for p in places] == ["secret"] and got == text.replace(value, pii.secret(value, b"k")), text
    new = pii.secret("hunter2abcd", b"k")
    for name in ("password", "passwd", "token", "secret", "api_key", "PASSWORD", "Token"):
        for sign in ("=", " = ", ":", ": ", ': "'):
            for rest in ("", " and 1=1"):
                got, places = pii.pseudonymise(f"{name}{sign}hunter2abcd{rest}", b"k")
                assert got == f"{name}{sign}{new}{rest}" and [p["kind"] for p in places] == ["secret"]
    assert pii.pseudonymise("a secret garden: nothing", b"k") == ("a secret garden: nothing", [])


def test_queries_equal_their_sql(spark):
    import duckdb

    from shelfscope.llm.queries import ORACLES, QUERIES

    assert [n for n in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) and len(QUERIES) == 13
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.select(cols).collect())) == Counter(want) and want, name


def test_pipeline_keeps_texts_that_share_an_id(spark, documents):
    import corpus_pipeline as cp

    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, words(1), "en", "a"), (1, words(2), "en", "a"), (2, words(3), "en", "a"), (2, words(3), "de", "b"), (2, words(3), "de", "b"),
            (3, words(1) + " more", "en", "a"), (None, words(4), "en", "a"), (None, words(4), "en", "a"), (None, words(5), "en", "a"),
            (None, words(3), "en", "a"), (4, None, "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), ((1 << 63) - 1, words(6), "en", "a")]
    seen = set()
    for big in (False, True):
        some = rows if big else rows[:-1]
        for parts in (1, 5):
            got = cp.near_dedup(spark, documents(some).repartition(parts), SF)
            seen.add((big, tuple(sorted(map(repr, got.collect())))))
            texts = Counter(r.text for r in got.collect())
            assert set(texts.values()) == {1}
            assert {words(2), words(4), words(5), None, ""} <= set(texts) and words(3) in texts and (words(1) in texts) + (words(1) + " more" in texts) == 1
    assert len(seen) == 2  # repeated runs agree
    assert cp.near_dedup(spark, documents([]), SF).count() == 0


def test_pipeline_stages(spark, documents, odd_rows):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").union(documents(odd_rows))
    columns, before = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, before, SF), "test")
        assert docs.columns == columns, name
        if name == "language":
            gone = {r.doc_id for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            assert {1, 2, 3, 8} - gone <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        if name == "near_dedup":
            # rows that share an id have different texts and are no near copies
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts)) and sum(r.doc_id in (4, 9) for r in docs.collect()) == 4
        before = docs
    index = cp.STAGES[-1][1](spark, before, SF)
    assert index.count() == before.count() and [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "token_files"]
    assert cp.run(spark, SF).count() > 100


def test_pipeline_stages_bound_their_memory(spark, documents, odd_rows, monkeypatch, tmp_path):
    """Whole texts come in small batches while the language stage runs; workers of the token files remember few pieces."""
    import corpus_pipeline as cp
    from shelfscope.llm.queries import vocabulary
    from shelfscope.llm.token_planes import PieceEncoder, read_token_files, write_token_files

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for step in ("fit_and_identify", "stored"):
        monkeypatch.setattr(cp, step, lambda *a, run=getattr(cp, step), **b: seen.append(int(spark.conf.get(name))) or run(*a, **b))
    docs = documents(odd_rows)
    cp.language(spark, docs, SF)
    assert len(seen) == 2 and max(seen) <= 1000 and spark.conf.get(name) == before
    asked = []
    monkeypatch.setattr(cp, "token_table", lambda *a, **b: asked.append(b["remembered"]))
    cp.token_files(spark, docs, SF)
    assert asked[0] <= 30_000

    e = PieceEncoder(vocabulary(), 10)
    for k in range(300):
        text = f"w{k} x{k % 7} y{k * k}"
        assert b"".join(e.parts(text)) == e.whole(text)
        assert len(e.code.__self__) <= 10 and len(e.code.__self__.older) <= 10
    few, many = (sorted(map(tuple, read_token_files(write_token_files(docs, vocabulary(), 2, str(tmp_path / str(n)), remembered=n)).collect()), key=repr)
                 for n in (10, 360_000))
    assert few == many and few


def test_all_meeting_pairs_get_a_start():
    """Many pairs of either label: none is left without vectors, and products lean to their label."""
    import numpy as np

    from shelfscope.llm.toxicity_fm import FactorParameters, _start

    p = FactorParameters(buckets=1 << 14, factors=32)
    pairs = [(k, 5000 + k, -3.0) for k in range(500)] + [(1000 + k, 6000 + k, 3.0) for k in range(500)]
    terms = [np.array([a, b]) for a, b, _ in pairs]
    model = {"bias": 0.0, "weight": np.zeros(p.buckets), "vector": np.zeros((p.buckets, p.factors))}
    _start(model, pairs, terms, p)
    v = model["vector"]
    products = np.array([v[a] @ v[b] for a, b, _ in pairs])
    assert np.all(np.abs(v[[a for a, _, _ in pairs]]).sum(axis=1) > 0)
    assert np.mean(products[:500] < -0.5) > 0.9 and np.mean(products[500:] > 0.5) > 0.9
