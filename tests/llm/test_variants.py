"""Spelling variants, token alignment and piecewise fingerprints against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
LOWER = {ord("A") + k: ord("a") + k for k in range(26)}


def brute_words(rows, damage=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def test_spelling_against_brute_force(spark, documents):
    from shelfscope.llm.spelling import Spelling, spelling_variants

    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    long = "".join(rng.choice("abc") for _ in range(66))
    base += ["aaaaaaaa", "aaaaaaaaa", long[:63], long[:64], long[:65], long, long[:40] + "x" + long[41:], long[:40] + "y" + long[41:]]
    rows = []
    for i in range(60):
        words = []
        for w in base:
            for _ in range(rng.choice((0, 1, 1, 2, 12))):
                at = rng.randrange(len(w))
                edits = (w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÀ") + w[at:], w[:at] + rng.choice("abc") + w[at + 1 :])
                words.append(rng.choice((w, w, w.upper(), *edits)))
        words += ["kettenwort"] * 16 + ["ketenwort"] * (i % 2 * 2) + ["ketnwort"] * (i % 20 == 0)  # a form of a form
        rows.append((i, " ".join(words), "en", "a"))
    rows += [(None, "ziffern 12 und buchstaben", "de", None), (None, "ziffern und buchstaben", "de", None), (61, None, "en", "a")]
    want = brute_variants(brute_words([(i, t) for i, t, *_ in rows]))
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] for v in want.values() if v[0])
    for p in (Spelling(), Spelling(long=8)):
        got = spelling_variants(documents(rows, clash=True).repartition(3), p).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)


def test_spelling_of_odd_rows(spark, documents, odd_rows):
    from shelfscope.llm.spelling import Spelling, hashed_rotations, spelling_variants

    assert spelling_variants(documents([])).count() == 0
    run = "ab" * 100_000  # twice the same word; its rotations as text would take 40 GB
    rows = [(i, t) for i, t, *_ in odd_rows] + [(100, run), (101, run), (102, run[1:]), (103, run[1:])]
    got = {r.word: r for r in spelling_variants(documents([(i, t, "en", "a") for i, t in rows]), Spelling(damage=0)).collect()}
    assert got[run].n_near == got[run[1:]].n_near == 1 and got[run].n == 2 and got[run].form is None
    assert set(brute_words([(i, t) for i, t, *_ in odd_rows], 0)) <= set(got)
    assert len({k for k, _ in hashed_rotations("aab", 0)}) == 7


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from public_tokenizers import path
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), a, sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def brute_alignment(rows, a, b):
    """By the plain calls and sets of ends; bytes of A by the tokenizer's own decoder table."""
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    letter = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for text in rows:
        links, groups, n = [], "", (0, 0)
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelt = [[bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]], [b_bytes(i) for i in ids[1]]]
            if all(b"".join(s) == (" " + text).encode() for s in spelt):
                n = len(ids[0]), len(ids[1])
                ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
                both = sorted(set(ends[0]) & set(ends[1]))
                at = [{e: k for k, e in enumerate(es)} for es in ends]
                links = [(ids[0][at[0][e]], ids[1][at[1][e]]) for e in both]
                cuts = [[at[s][e] + 1 for e in both] for s in (0, 1)]
                groups = ";".join(
                    ",".join(map(str, ids[0][i0:i1])) + "|" + ",".join(map(str, ids[1][j0:j1]))
                    for i0, i1, j0, j1 in zip([0, *cuts[0]], cuts[0], [0, *cuts[1]], cuts[1]))
        counts.update(links)
        docs.append((*n, links, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, j), c in counts.items():
        most[j] = max(most[j], c)
    return [(na, nb, len(ls), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h) for na, nb, ls, h in docs]


def test_alignment_against_brute_force(spark, documents, odd_rows, tokenizers):
    from shelfscope.llm.token_alignment import alignment_groups, alignment_table

    va, vb, a, b = tokenizers
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    texts = [t for _, t, *_ in odd_rows] + [d.text for d in given] + [
        "  two  blanks \n", " ", "foo ", "foo  bar  ", "foo \n", "foo\n ", "a▁ ", "  ", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "日本語 \U0001f600 ﬁ é", "\x00", "x" * 300, "a b" * 40_000,
        "▁ " * 5_000, " " * 7_000 + "x"]
    for work, short in ((1 << 16, 1 << 30), (500, 200_000), (7, 3000)):
        rows = [(k, t, "en", "a") for k, t in enumerate(texts) if len(t or "") < short]
        want = brute_alignment([t for _, t, *_ in rows], a, b)
        assert sum(w[0] == 0 for w in want) < 8 < sum(w[4] < w[3] for w in want)
        got = {r.doc_id: r for r in alignment_table(documents(rows, clash=True).repartition(3), va, vb, work).collect()}
        assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for _, r in sorted(got.items())] == want
        assert all(r.n_overlaps == r.n_a + r.n_b - r.n_links for r in got.values())
    rows = [(k, t, "en", "a") for k, t in enumerate(texts[:30])]
    want = brute_alignment(texts[:30], a, b)
    cut = alignment_groups(documents(rows), va, vb, 50).orderBy("doc_id", "piece").collect()
    for i, own in groupby(cut, key=lambda r: r.doc_id):
        own = list(own)
        assert sum(len(r.a_ends) for r in own) == want[i][2] and [r.piece for r in own] == list(range(len(own)))
        assert sum((r.b_ids for r in own), []) == b.encode(texts[i]) and all(r.a_ends[-1] == len(r.a_ids) for r in own)
    assert {r.doc_id for r in cut} == {k for k in range(30) if want[k][0]}
    assert alignment_table(documents([]), va, vb).count() == 0


def test_merge_path_pieces():
    from shelfscope.llm.token_alignment import crossing, pieces

    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        a, b = (np.sort(np.append(rng.choice(99, rng.integers(1, n + 1), replace=False), 100)) for _ in "ab")
        merged = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
        for d in range(len(merged) + 1):
            assert crossing(a, b, d) == sum(side == 0 for _, side in merged[:d])
        for work in (1, 2, 3, 7, 1000):
            found = [np.concatenate(x) for x in zip(*pieces(a, b, work))]
            ends = np.unique(np.concatenate((a, b)))
            assert np.array_equal(found[0], np.searchsorted(a, ends)) and np.array_equal(found[1], np.searchsorted(b, ends))
            assert np.array_equal(found[2], np.isin(ends, a) & np.isin(ends, b))
            assert max(len(x[0]) for x in pieces(a, b, work)) <= work


def plain_fingerprint(raw, window=7, least=32, most=128):
    """Byte by byte, without arrays."""
    levels = []
    for k in range(len(raw)):
        h = 0
        for j, c in enumerate(raw[max(0, k - window + 1) : k + 1][::-1]):
            h += (c + 1) * pow(0x01000193, j, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 16
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        levels.append(len(re.search("1*$", f"{h:b}").group()))
    level = max([k for k in range(33) if sum(x >= k for x in levels) >= least], default=0)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    parts = [str(level)]
    for k in range(3):
        stops = [i + 1 for i, x in enumerate(levels) if x >= level + k][: most]
        stops = stops[: most - 1] if len(stops) >= most else stops
        if raw and stops[-1:] != [len(raw)]:
            stops.append(len(raw))
        codes = [zlib.crc32(raw[max(0, i - window + 1) : j]) & 0xFFF for i, j in zip([0, *stops], stops)]
        parts.append("".join(letters[c >> 6] + letters[c & 63] for c in codes))
    return ":".join(parts)


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (m, *a), (n, *b) = x.split(":"), y.split(":")
    level = max(int(m), int(n))
    if level >= int(m) + 3 or level >= int(n) + 3:
        return 0.0
    s, t = (re.findall("..", z) for z in (a[level - int(m)], b[level - int(n)]))
    cost = [list(range(len(t) + 1))]
    for i, c in enumerate(s, 1):
        cost.append([i])
        for j, d in enumerate(t, 1):
            cost[i].append(cost[i - 1][j - 1] if c == d else 1 + min(cost[i - 1][j], cost[i][j - 1]))
    return 1 - cost[-1][-1] / (len(s) + len(t)) if s or t else 1.0


def test_fingerprints_against_brute_force(spark, documents, odd_rows):
    from shelfscope.llm.piecewise_hash import neighbour_fingerprints

    rng = random.Random(9)
    rows = [(i, t, la, s) for i, t, la, s in odd_rows if not t or len(t) < 9000]
    rows += [(100 + k, " ".join(rng.choice(("ab", "ü", "wort", "lang", "漢字")) for _ in range(rng.randrange(400))), "en", "a") for k in range(30)]
    rows += [(200, "line again\n" * 700, "en", "a"), (201, "line again\n" * 700 + "end", "en", "a"), (202, "\x00" * 900, "en", "a")]
    ordered = sorted(((i is None, i or 0, t or "", i) for i, t, *_ in rows), key=lambda r: (r[:2], r[2]))
    texts = [t for _, _, t, _ in ordered]
    want = Counter()
    for k, (_, _, t, i) in enumerate(ordered):
        after = texts[(k + 1) % len(texts)]
        n = len(t) // 4
        new = t[: len(t) - n] + after[:n]
        x, y, z = (plain_fingerprint(s.encode()) for s in (t, new, after))
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), x, y, round(plain_likeness(x, y), 9), round(plain_likeness(x, z), 9)] += 1
    for df in (documents(rows, clash=True).repartition(5), documents(rows).coalesce(1)):
        got = Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in neighbour_fingerprints(df).collect())
        assert got == want


def test_fingerprints_tell_texts_apart(spark, documents):
    from shelfscope.llm.piecewise_hash import Piecewise, boundary_levels, fingerprint, neighbour_fingerprints

    found = neighbour_fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    long = [r for r in found if r.n_chars >= 200]
    assert sum(0.55 <= r.near_edited <= 1 for r in long) > 0.97 * len(long) and sum(r.near_next < 0.3 for r in long) > 0.8 * len(long)
    text = ("some words and " * 300_000).encode()
    assert np.array_equal(boundary_levels(text, 7)[2_000_000:2_000_050], boundary_levels(text[1_999_000:2_001_000], 7)[1000:1050])
    assert fingerprint(text) == fingerprint(bytes(text)) and len(fingerprint(text)) < 1000
    one = neighbour_fingerprints(documents([(1, "only one", "en", "a")]), Piecewise()).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].near_edited <= 1.0
    assert neighbour_fingerprints(documents([])).count() == 0
