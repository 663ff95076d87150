"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct letter runs in lower case, and the first four and five
letters of the longer ones, hashed into `buckets`. The score is the logistic of a bias, one weight
per term, and the inner products of the vectors of all pairs of terms, so that two terms
together can mean more than each alone.

Terms take part if their presence depends on the label, or if a pair of them does: where the machine
of the first kind leaves rows on the wrong side, all pairs of the terms of these rows are tested
against its probabilities over all fitted rows, and it is fitted on with the pairs that account for them.

The fit uses at most about `fit_rows` labelled rows (by hash of the id), of which one task
makes several passes in mini-batches with AdaGrad; the model has a fixed size and is sent to
all tasks, which score every row. Null or empty text: no terms, the score of the bias.
Labels: the largest of repeated ones. No labelled training row, or one class only: the
bias alone, the log-odds of the (smoothed) share of label 1. Repeated rows: each is scored.
Null doc_id: held out, scored. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import Scratch, slices

RUN = re.compile(r"[^\W\d_]+")
#: Names whose products with all others are held at a time.
START_ROWS = 512


@dataclass(frozen=True)
class FactorParameters:
    buckets: int = 1 << 18
    factors: int = 4
    passes: int = 8
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-4
    fit_rows: int = 16_000
    #: A term that fewer fitted rows have, or that depends less on the label and stands in no pair that does,
    #: keeps weight zero: in long texts the noise of thousands of such terms would drown the others.
    least_rows: int = 5
    least_chi2: float = 30.0
    #: The chance that any of the tested pairs passes where none depends on the label.
    pair_chance: float = 0.01
    seed: int = 7


def term_buckets(text: str, buckets: int) -> np.ndarray:
    runs = set(RUN.findall(text.lower()))
    runs |= {"^" + r[:n] for r in runs for n in (4, 5) if len(r) > n}
    found = np.fromiter((crc32(r.encode()) % buckets for r in runs), np.int64, len(runs))
    return np.unique(found)


def _sums(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=rows)


def informative(terms: list[np.ndarray], labels: np.ndarray, p: FactorParameters) -> np.ndarray:
    """Buckets that enough rows have and whose presence depends on the label (chi-square of the 2 x 2 table)."""
    count = lambda some: np.bincount(np.concatenate([np.empty(0, np.int64), *some]), minlength=p.buckets).astype(float)
    n, ones = len(labels), labels.sum()
    both, any_ = count([t for t, y in zip(terms, labels, strict=True) if y]), count(terms)
    spread = np.maximum(any_ * (n - any_) * ones * (n - ones), 1e-9)
    return (any_ >= p.least_rows) & (n * (n * both - any_ * ones) ** 2 / spread >= p.least_chi2)


def _excess(hits: np.ndarray, rows: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Binomial deviance of the hits among some rows, zero where they are not more than expected."""
    rest = rows - hits
    found = hits * np.log(np.maximum(hits, 1e-9) / expected) + rest * np.log(np.maximum(rest, 1e-9) / (rows - expected))
    return np.where(hits > expected, 2 * found, 0.0)


def meeting_pairs(terms: list[np.ndarray], labels: np.ndarray, chance: np.ndarray, p: FactorParameters) -> list[tuple[int, int, float]]:
    """Pairs of buckets whose rows have a label more often than `chance` says, with their log-odds beyond it.

    Sought in the rows that `chance` puts on the wrong side, tested over all rows. The strongest come first;
    a later pair counts only the rows that no earlier one holds, so that echoes of a pair are not taken with it.
    """
    out = []
    for label in (0, 1):
        mine = labels == label
        share = np.clip(chance if label else 1 - chance, 0.01, 0.99)
        wrong = mine & (share < 0.5)
        often = np.bincount(np.concatenate([np.empty(0, np.int64), *(terms[i] for i in np.flatnonzero(wrong))]), minlength=p.buckets) >= p.least_rows
        names = np.flatnonzero(often)
        if len(names) < 2:
            continue
        least = 2 * math.log(len(names) * (len(names) - 1) / 2 / p.pair_chance)
        place = np.cumsum(often) - 1
        rows = [place[t[often[t]]] for t in terms]
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        holders = np.split(owner[np.argsort(flat, kind="stable")], np.cumsum(np.bincount(flat, minlength=len(names)))[:-1])
        found = []
        for a, held in enumerate(holders):
            some = held[wrong[held]]
            # No pair passes with fewer wrong rows than would do if these were all its rows.
            need = max(p.least_rows, least / (-2 * math.log(share[some].min())))
            if len(some) < need:
                continue
            met = np.bincount(np.concatenate([rows[i] for i in some]), minlength=len(names))
            met[: a + 1] = 0
            others = np.flatnonzero(met >= need)
            if not len(others):
                continue
            with_a, of = np.concatenate([rows[i] for i in held]), np.repeat(held, [len(rows[i]) for i in held])
            n, hits, expected = (np.bincount(with_a, w, minlength=len(names))[others] for w in (None, mine[of], share[of]))
            g = _excess(hits, n, expected)
            found += [(-x, a, b) for x, b in zip(g, others.tolist(), strict=True) if x >= least]
        left = np.ones(len(rows), bool)
        for _, a, b in sorted(found):
            both = np.intersect1d(holders[a], holders[b], assume_unique=True)
            both = both[left[both]]
            hits, expected = mine[both].sum(), share[both].sum()
            if (wrong[both].sum() >= p.least_rows) and _excess(hits, len(both), expected) >= least:
                odds = math.log((hits + 0.5) / (len(both) - hits + 0.5)) - math.log(expected / (len(both) - expected))
                out.append((int(names[a]), int(names[b]), odds if label else -odds))
                left[both[mine[both]]] = False
    return out


def _start(model: dict, pairs: list[tuple[int, int, float]], terms: list[np.ndarray], p: FactorParameters) -> None:
    """Vectors whose products reach the log-odds of the pairs, and weights that take back what these
    products give the terms on the average."""
    names, at = np.unique([x[:2] for x in pairs], return_inverse=True)
    a, b = at.reshape(-1, 2).T
    goal = np.array([x[2] for x in pairs])
    # Both directions of each pair, in the order of the first name.
    rows, cols, goals = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((goal, goal))
    order = np.argsort(rows, kind="stable")
    rows, cols, goals = rows[order], cols[order], goals[order]
    n, own = len(names), np.sign(goals)
    # Products of terms that are no pair only have to stay below zero: more pairs than factors have room so.
    weigh = min(30.0, max(1.0, (n * n - len(rows)) / len(rows)))
    vector = np.random.default_rng(p.seed).normal(0, 1, (n, p.factors))
    speed, steps = np.full_like(vector, 1e-6), max(100, min(1000, 1000 * 800 * 800 // (n * n)))
    for k in range(steps):
        g = np.empty_like(vector)
        for i in range(0, n, START_ROWS):  # some names against all at a time
            part = vector[i : i + START_ROWS] @ vector.T
            x, y = np.searchsorted(rows, (i, i + START_ROWS))
            product = part[rows[x:y] - i, cols[x:y]]
            np.maximum(part, 0, out=part)
            part[np.arange(len(part)), np.arange(i, i + len(part))] = 0
            part[rows[x:y] - i, cols[x:y]] = weigh * own[x:y] * np.minimum(own[x:y] * (product - goals[x:y]), 0)
            g[i : i + START_ROWS] = 2 * part @ vector
        speed = 0.99 * speed + 0.01 * g * g
        vector -= 0.05 * (1 - k / steps) * g / np.sqrt(speed + 1e-9)
    place = np.full(p.buckets, -1)
    place[names] = np.arange(n)
    given, rows_of = np.zeros(n), np.zeros(n)
    for t in terms:
        here = place[t]
        here = here[here >= 0]
        mine = vector[here]
        given[here] += mine @ mine.sum(axis=0) - (mine * mine).sum(axis=1)
        rows_of[here] += 1
    model["vector"][names] = vector
    model["weight"][names] -= 0.5 * given / np.maximum(rows_of, 1)


def _descend(model: dict, terms: list[np.ndarray], labels: np.ndarray, random: np.random.Generator, p: FactorParameters) -> None:
    """The passes over the rows, from where the model is."""
    bias, weight, vector = model["bias"], model["weight"], model["vector"]
    seen_b, seen_w, seen_v = 1e-6, np.full(p.buckets, 1e-6), np.full((p.buckets, p.factors), 1e-6)
    for _ in range(p.passes):
        order = random.permutation(len(terms))
        for k in range(0, len(order), p.batch):
            some = order[k : k + p.batch]
            flat = np.concatenate([terms[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(terms[i]) for i in some])
            v = vector[flat]
            total = np.stack([_sums(v[:, f], owner, len(some)) for f in range(p.factors)], axis=1)
            pairs = 0.5 * ((total**2).sum(axis=1) - _sums((v**2).sum(axis=1), owner, len(some)))
            score = bias + _sums(weight[flat], owner, len(some)) + pairs
            slope = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]
            used, at = np.unique(flat, return_inverse=True)
            g = _sums(slope[owner], at, len(used)) + p.decay * weight[used]
            seen_w[used] += g * g
            weight[used] -= p.rate * g / np.sqrt(seen_w[used])
            for f in range(p.factors):
                g = _sums(slope[owner] * (total[owner, f] - v[:, f]), at, len(used)) + p.decay * vector[used, f]
                g = np.clip(g, -5, 5)
                seen_v[used, f] += g * g
                vector[used, f] -= 0.1 * p.rate * g / np.sqrt(seen_v[used, f] + 1.0)
            g = slope.sum()
            seen_b += g * g
            bias -= p.rate * g / math.sqrt(seen_b)
    model["bias"] = bias


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, p: FactorParameters) -> dict:
    """Bias, weights and vectors, from the term buckets of some rows."""
    random = np.random.default_rng(p.seed)
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    model = {"bias": math.log(share / (1 - share)), "weight": np.zeros(p.buckets), "vector": random.normal(0, 0.01, (p.buckets, p.factors))}
    known = informative(terms, labels, p)
    small = model["vector"].copy()
    model["vector"][~known] = 0
    if 0 < labels.sum() < len(labels):
        alone = [t[known[t]] for t in terms]
        _descend(model, alone, labels, random, p)
        pairs = meeting_pairs(terms, labels, np.array([machine_score(model, t) for t in alone]), p)
        if pairs:
            more = np.zeros(p.buckets, bool)
            more[[x for a, b, _ in pairs for x in (a, b)]] = True
            model["vector"][more & ~known] = small[more & ~known]
            known |= more
            terms = [t[known[t]] for t in terms]
            _start(model, pairs, terms, p)
            _descend(model, terms, labels, random, p)
    return {"bias": model["bias"], "weight": model["weight"].astype(np.float32), "vector": model["vector"].astype(np.float32)}


def machine_score(model: dict, terms: np.ndarray) -> float:
    v = model["vector"][terms].astype(np.float64)
    pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
    score = model["bias"] + float(model["weight"][terms].sum(dtype=np.float64)) + pairs
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, score))))


def fit(rows: DataFrame, p: FactorParameters) -> dict:
    """The model, from a bounded number of rows of doc_id, text and label."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            found = [term_buckets(t, p.buckets) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.int64())), batch["label"]], ["doc_id", "terms", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(i, t.values.to_numpy(), y) for b in batches for i, t, y in zip(b["doc_id"].to_pylist(), b["terms"], b["label"].to_pylist(), strict=True)]
        found.sort(key=lambda r: (r[0], len(r[1]), r[2]))
        model = fit_machine([t for _, t, _ in found], np.array([y for _, _, y in found], float), p)
        yield pa.RecordBatch.from_pydict({
            "bias": [model["bias"]], "weight": [model["weight"].tobytes()], "vector": [model["vector"].tobytes()]})

    bounded = rows.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int")).mapInArrow(
        terms, "doc_id long, terms array<long>, label int")
    row = bounded.repartition(1).mapInArrow(learn, "bias double, weight binary, vector binary").first()
    if row is None:
        return {"bias": 0.0, "weight": np.zeros(p.buckets, np.float32), "vector": np.zeros((p.buckets, p.factors), np.float32)}
    return {"bias": row["bias"], "weight": np.frombuffer(row["weight"], np.float32),
            "vector": np.frombuffer(row["vector"], np.float32).reshape(p.buckets, p.factors)}


def scored(docs: DataFrame, labels: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text",
           label_column: str = "toxic", p: FactorParameters = FactorParameters()) -> DataFrame:
    """The columns but the text, with score and predicted in place of any of that name; labels of rows where `train` holds are learned from."""
    known = labels.groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label_column).alias("label")).where("label is not null")
    with Scratch(docs.sparkSession, "toxicity") as keep:
        known = keep.stored(known)
        # The bound is kept among the labels, so the few that are left go to every task and no text is shuffled.
        share = min(1_000_000, math.ceil(1e6 * p.fit_rows / max(known.count(), 1)))
        chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1_000_000)) < share)
        rows = docs.where(train).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        model = fit(rows.join(F.broadcast(chosen), "doc_id"), p)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            out = []
            for k in range(0, len(whole), 256):
                out += [machine_score(sent.value, term_buckets(t or "", p.buckets)) for t in whole.slice(k, 256).to_pylist()]
            yield pa.array(out, pa.float64())

    others = [c for c in docs.columns if c not in (text_column, "score", "predicted")]
    found = docs.select(*others, F.arrow_udf(predict, "double")(F.col(text_column)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
