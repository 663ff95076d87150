"""Near duplicates, decontamination, mixture, token files, language, against brute force and on odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def near_copies(seed, groups=12, copies=12, words=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_against_brute_force(spark, documents):
    from shelfscope.llm.near_dedup import NearDedup, near_duplicates

    rows = near_copies(3)
    df = documents([(i, t, "en", "a") for i, t in rows], clash=True).repartition(4)
    want = brute_components(rows)
    for p in (NearDedup(), NearDedup(block=3, filter_bits=64)):
        got = {r.doc_id: r for r in near_duplicates(df, p).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) and r.n_shingles == len(shingles(dict(rows)[i])) for i, r in got.items())


def test_near_duplicates_odd_rows(documents, odd_rows):
    from shelfscope.llm.near_dedup import near_duplicates

    got = near_duplicates(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[7].n_shingles == 1
    assert by[None].component_id is None and by[None].kept is None and by[None].n_shingles == 8
    # one id, two texts: the id ties both groups together
    tied = near_duplicates(documents([(1, "a b c d e f", None, None), (2, "g h i j k l", None, None), (3, "a b c d e f", None, None), (3, "g h i j k l", None, None)]))
    assert {r.component_id for r in tied.collect()} == {1}
    assert near_duplicates(documents([])).collect() == []


def test_near_duplicates_meet_in_small_batches(spark, documents, monkeypatch):
    """Texts, and pairs with both their sets, come to a task in batches of a bounded number of rows."""
    from shelfscope.llm import near_dedup as nd

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(name)
    for step in ("signatures", "_verified"):
        monkeypatch.setattr(nd, step, lambda *a, run=getattr(nd, step), step=step: seen.update({step: int(spark.conf.get(name))}) or run(*a))
    same = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    got = nd.near_duplicates(documents([(k, f"{same} {k}", None, None) for k in range(1, 8)])).collect()
    assert {r.component_id for r in got} == {1}
    assert seen["signatures"] <= 1000 and seen["_verified"] <= 128 and spark.conf.get(name) == before


def test_shingle_hashes_tell_sets_apart():
    from shelfscope.llm import hashing

    texts = [b"A b  c\td e f", b"a B c d e f", b"", b"x " * 400_000, b"one", b"y" * 700_000 + b" z"]
    words = list(hashing.word_hashes(texts))
    assert [len(w) for w in words] == [6, 6, 0, 400_000, 1, 2]
    assert (words[0] == words[1]).all() and len(set(words[3].tolist())) == 1
    assert len(hashing.shingle_hashes(words[3])) == 1 and len(hashing.shingle_hashes(words[0])) == 2
    assert (hashing.shingle_hashes(words[0][:4]) != hashing.shingle_hashes(words[0][1:5])).all()


def test_estimate_counts_equal_low_bits(spark):
    from pyspark.sql import functions as F

    from shelfscope.llm.near_dedup import _planes, similar_bits

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (2, 128)).astype(np.uint64)
    df = spark.createDataFrame([(_planes(a, 2).tolist(), _planes(b, 2).tolist())], "x array<long>, y array<long>")
    share = (np.mean(a == b) - 0.25) / 0.75
    assert df.select(similar_bits(F.col("x"), F.col("y"), 128, 2)).first()[0] == pytest.approx(share)


def test_components_of_a_path_and_a_hub(spark):
    from shelfscope.llm.common import Scratch
    from shelfscope.llm.components import connected_components

    edges = [(k, k + 1) for k in range(100, 140)] + [(900, k) for k in range(500, 700)] + [(7, 7), (None, 3)]
    with Scratch(spark, "test") as keep:
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 500 for k in [*range(500, 700), 900]}


def test_contained_items(spark, documents, odd_rows):
    from shelfscope.llm.decontaminate import contained_items, decontaminated

    rng = random.Random(5)
    items = [(k, " ".join(f"i{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 6, 14, 40])))) for k in range(30)]
    items += [(40, items[4][1]), (41, None), (42, ""), (None, items[5][1])]
    docs = []
    for d in range(80):
        words = [f"d{rng.randrange(1000)}" for _ in range(rng.randrange(3, 400))]
        if d % 3 == 0:
            item = rng.choice(items[:30])[1].upper().split()
            at = rng.randrange(len(words))
            item = item[: len(item) - rng.randrange(3)]
            words[at:at] = item
        docs.append((d, " ".join(words)))
    docs += [(i, t) for i, t, _, _ in odd_rows] + [(90, items[1][1]), (90, items[2][1])]
    want = Counter()
    for i, t in docs:
        for k, x in items:
            s, n = len(shingles(t) & shingles(x)), len(shingles(x))
            if n and 100 * s >= 75 * n:
                want[(i, k, s, n)] += 1
    table = spark.createDataFrame(items, "item_id long, text string")
    df = documents([(i, t, "en", "a") for i, t in docs], clash=True)
    for rows in (1_000_000, 0):
        got = contained_items(df, table, broadcast_rows=rows).collect()
        assert Counter((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got) == want and want
    bad = {(i, t) for i, t in docs for _, x in items if shingles(x) and 100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(x))}
    left = decontaminated(df, table)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(d for d in docs if d not in bad)
    assert decontaminated(df, table.limit(0)).count() == len(docs) and contained_items(documents([]), table).collect() == []


def test_mixture(documents, odd_rows):
    from shelfscope.llm.mixing import mixed, mixture

    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(200), None, rng.choice("aaaabc")) for k in range(600)] + odd_rows
    df = documents(rows, clash=True)
    got = mixture(df).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
        size, taken, target, most = per.get(r.source, (0, 0, r.target, 0))
        per[r.source] = size + r.size, taken + r.taken, r.target, max(most, r.size)
    total = sum(p[0] for p in per.values())
    assert sum(p[2] for p in per.values()) == pytest.approx(1.5 * total)
    for size, taken, target, most in per.values():
        assert target <= 2 * size and abs(taken - target) <= 2 * most
    again = mixture(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixture(documents([])).collect() == [] and mixed(documents([])).collect() == []


def test_token_files_round_trip(spark, documents, odd_rows, tmp_path):
    from shelfscope.llm.queries import vocabulary
    from shelfscope.llm.token_planes import PieceEncoder, read_shard, read_token_files, write_token_files

    encoder = PieceEncoder(vocabulary())
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))
    want, start = [], 0
    for i, t, _, _ in rows:
        ids = np.append(np.frombuffer(encoder.whole(t or ""), "<u4"), 2).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for kind, block in (("byte", 1 << 16), ("bit", 1000)):
        manifest = write_token_files(documents(odd_rows, clash=True), vocabulary(), 2, str(tmp_path / kind), kind=kind, block=block)
        got = [tuple(r) for r in read_token_files(manifest).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
        files = [r.file for r in manifest.orderBy("shard").collect()]
        ids = [(i, b"".join(p)) for f in files for i, p in read_shard(f)]
        assert [i for i, _ in ids] == [w[0] for w in want] and all(zlib.crc32(b) == w[3] for (_, b), w in zip(ids, want, strict=True))
    assert read_token_files(write_token_files(documents([]), vocabulary(), 2, str(tmp_path / "none"))).collect() == []


def test_pieces_are_those_of_the_tokenizer():
    from shelfscope.llm.queries import vocabulary
    from shelfscope.llm.token_planes import PieceEncoder

    e, rng = PieceEncoder(vocabulary()), random.Random(1)
    some = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC, 0x4E00, 0x1F600]] + list("  \n\t  's'll aZ09.,!") * 20
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        assert b"".join(e.parts(text)) == e.whole(text), repr(text)


def test_added_tokens_are_those_of_the_plain_call(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    from shelfscope.llm.queries import vocabulary
    from shelfscope.llm.token_planes import PieceEncoder, read_shard, write_token_files

    fresh, e, rng = Tokenizer.from_file(vocabulary()), PieceEncoder(vocabulary()), random.Random(4)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x", f" {end}\n\n{end}  漢字 <|endof{end}text|>", f"it's{end}'s", "<|endoftext|", f"x {end} " * 90_000]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "漢", "'s", "12", end, "<|"]) for _ in range(20)) for _ in range(500)]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for t, ids in zip(texts, want, strict=True):
        assert np.frombuffer(b"".join(e.parts(t)), "<u4").tolist() == ids == np.frombuffer(e.whole(t), "<u4").tolist(), t[:80]
    manifest = write_token_files(documents([(k, t, None, None) for k, t in enumerate(texts[:7])]), vocabulary(), 2, str(tmp_path / "added"))
    got = {i: np.frombuffer(b"".join(p), "<u4").tolist() for r in manifest.collect() for i, p in read_shard(r.file)}
    assert got == {k: [*ids, 2] for k, ids in enumerate(want[:7])}


def brute_viterbi(scores, penalty):
    best = list(scores[0])
    for row in scores[1:]:
        top = max(best) - penalty
        best = [max(b, top) + x for b, x in zip(best, row, strict=True)]
    return max(best)


def test_viterbi_is_the_best_path():
    from shelfscope.llm.language import viterbi

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40, 300):
        for scale in (0.3, 3, 30):
            scores = rng.normal(0, scale, (n, 3))
            path = viterbi(scores, 4.0)
            value = scores[np.arange(n), path].sum() - 4.0 * np.count_nonzero(np.diff(path))
            assert value == pytest.approx(brute_viterbi(scores.tolist(), 4.0))


def test_language(spark, documents, odd_rows):
    from pyspark.sql import functions as F

    from shelfscope.llm.common import held_out
    from shelfscope.llm.language import fit_and_identify

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    found = fit_and_identify(docs, ~out).where(out).select("lang", "language.lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    text = {r.lang: r.text for r in docs.where("length(text) > 1500").collect()}
    greek = "αυτη ειναι μια προταση στα ελληνικα " * 40
    rows = [(1000 + k, text[x], x, "a") for k, x in enumerate(sorted(text))]
    mix = text["en"][:600] + "\n" + text["de"][:600] + "\n" + greek[:400]
    rows += [(2000, greek, "el", "a"), (2001, mix, None, "a"), (2002, "İστανμπουλ ειναι", None, "a")]
    got = {r.doc_id: r.language for r in fit_and_identify(documents(rows + odd_rows, clash=True).drop("language"), F.lit(True)).collect()}
    assert [s.lang for s in got[2001].spans][-2:] == ["de", "el"] and 0 < got[2001].score < 1
    assert got[2002].lang_pred == "el" and mix[got[2001].spans[-1].start :][:4] == "αυτη"
    for i in (1, 2, 3, 8):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == []
    none = fit_and_identify(documents(odd_rows), F.lit(False)).select("language.lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"] and fit_and_identify(documents([]), F.lit(True)).collect() == []
