"""Toxicity by weak supervision.

Voters: lexicons and patterns. The lexicons' entries are words and beginnings
of words (so that inflected forms are caught), learned from labelled documents:
those whose log odds between toxic and other documents are beyond chance, in
several slices by odds and by frequency, and those that speak against toxicity.
The patterns are fixed forms of address and emphasis. A voter says toxic (1),
not toxic (-1), or abstains (0).

A generative label model (two classes, accuracies per voter and class) is
fitted by EM on the votes of documents with and without a label. The given
label is one more voter, of unknown accuracy, which abstains where there is none.
Accuracies are estimated on the documents that didn't make the lexicons.
Correlations: the residual agreement of each pair of voters beyond what the
classes explain, estimated anew in each round; a voter's evidence is divided by
one plus its residual correlations, so that copies of one voter count about
once. A linear classifier on the chosen words and beginnings is trained on the
posterior labels.

Predictions read whole texts: words and beginnings are hashed and looked up
among the chosen ones' hashes, which come from a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Log odds of a feature's toxic use, at their lower end, from which the classifier reads it.
LEAST_ODDS = 0.7
#: Lower ends of the lexicons' slices of odds.
ODDS = (0.7, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
#: Beginnings of words, in bytes, that are features besides whole words.
PREFIXES = (3, 4, 5, 6, 7)

#: Patterns that vote, as (regular expression, vote).
PATTERNS = (
    (r"(?i)\byou(?:'re| are)?\s+(?:an?\s+|such\s+)?\w*(?:idiot|moron|stupid|dumb|loser|trash|scum|clown|fool)", 1),
    (r"(?i)\b(?:idiot|moron|scum|loser|stupid|disgusting|worthless|pathetic|hate)\b", 1),
    (r"(?i)\b(?:shut up|go away|get lost|drop dead)\b", 1),
    (r"!{2,}", 1),
    (r"\b[A-Z]{4,}(?:\s+[A-Z]{4,})+\b", 1),
    (r"(?i)\b(?:thank(?:s| you)|please|license[d]?|copyright)\b", -1),
)


@dataclass
class Model:
    """What predictions need: sorted feature hashes with their weights; and what the label model found."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def lexicon_voters(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Lexicons as (feature numbers, vote): slices by the nearer end of the features' odds (log), so that a voter's entries are about equally telling."""
    edges = [*ODDS, np.inf]
    slices = [(np.flatnonzero((side >= a) & (side < b)), vote) for side, vote in ((low, 1), (-high, -1)) for a, b in zip(edges, edges[1:])]
    return [(s, vote) for s, vote in slices if len(s)]


def lexicon_votes(row: np.ndarray, number: np.ndarray, n: int, features: int, voters: list[tuple[np.ndarray, int]]) -> np.ndarray:
    out = np.zeros((n, len(voters)), np.int8)
    for k, (entries, vote) in enumerate(voters):
        inside = np.zeros(features, bool)
        inside[entries] = True
        out[row[inside[number]], k] = vote
    return out


def posteriors(votes: np.ndarray, prior: float, table: np.ndarray, correlations: np.ndarray) -> np.ndarray:
    """Chance of toxic for each row: the evidence of the voters that don't abstain, each divided by one plus its residual correlations with others."""
    discount = 1 / (1 + np.maximum(correlations - np.eye(len(correlations)), 0).sum(1))
    weigh = (np.log(table[:, 1]) - np.log(table[:, 0])) * discount[:, None] * np.array([1, 0, 1])
    logit = np.full(len(votes), np.log(prior / (1 - prior)))
    for k, own in enumerate(weigh):
        logit += own[votes[:, k] + 1]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, start: np.ndarray | None = None, balance: float | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of toxic for each row, accuracies (voter x class x vote), residual correlations of the voters, and the prior.

    ``labels``: 1, 0, or -1 for unknown. Labelled rows hold their class in
    each step of EM; the others take their posterior, from ``start`` on (the prior where it isn't given).
    ``balance``: the share of toxic documents, where it is known: without labels that hold, votes alone don't tell it.
    ``before``: counts by voter, class and vote that are added to the rows' own (0.5 each where they aren't given).
    """
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # n x m x 3
    known = labels >= 0
    p = (labels[known].sum() + 1) / (known.sum() + 2) if known.any() else 0.1
    q = np.where(known, labels, p if start is None else start).astype(float)
    table, corr = np.zeros((m, 2, 3)), np.eye(m)
    before = np.full((m, 2, 3), 0.5) if before is None else before
    for step in range(rounds):
        for c, w in enumerate((1 - q, q)):
            counts = np.einsum("n,nmv->mv", w, onehot) + before[:, c]
            table[:, c] = counts / counts.sum(1, keepdims=True)
        p = float(min(max(q.mean() if balance is None else balance, 1e-4), 1 - 1e-4))
        if step >= 2 and m:
            # residual agreement: votes less what the classes expect of them
            expect = q[:, None] * (table[:, 1, 2] - table[:, 1, 0]) + (1 - q)[:, None] * (table[:, 0, 2] - table[:, 0, 0])
            rest = votes - expect
            scale = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = np.clip((rest / scale).T @ (rest / scale) / max(1, n), -1, 1)
        posterior = posteriors(votes, p, table, corr)
        q = np.where(known, labels, posterior)
    return posterior, table, corr, p


def train_linear(row: np.ndarray, number: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray, features: int, epochs: int = 600, rate: float = 0.4, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of features, by full-batch steps with momentum.

    A feature's step is scaled by the root of its frequency: what many
    documents share (a beginning) takes more of the weight than what few have (its inflected forms).
    """
    w, b = np.zeros(features), float(np.log((target @ weight + 1) / ((1 - target) @ weight + 1)))
    seen = np.bincount(number, weights=weight[row], minlength=features)
    pull = rate / np.sqrt((seen + 1) * (seen.max(initial=0) + 1))
    hold, hold_b, total = np.zeros(features), 0.0, max(1.0, float(weight.sum()))
    for _ in range(epochs):
        z = b + np.bincount(row, weights=w[number], minlength=n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.bincount(number, weights=err[row], minlength=features) + decay * seen * w
        hold = 0.8 * hold - pull * grad
        hold_b = 0.8 * hold_b - rate * err.sum() / total
        w, b = w + hold, b + hold_b
    return w, b


def train(documents: DataFrame, text: str = "text", toxic: str = "toxic", max_rows: int = 8_000, max_unlabelled: int = 8_000, digest: str | None = None) -> Model:
    """Fit voters, label model and classifier on a bounded sample of texts, with and without a label (null).

    The sample: about ``max_rows`` distinct labelled texts and
    ``max_unlabelled`` others, by hash, read whole; copies of a text with one
    label, or without, are one row of it. Rows without text are left out. Without labels of both
    kinds the model is a constant (0 without any label). ``digest``: a column with the xxhash64 of the
    text (null for no text). Where ``documents`` is a join, one made before it
    lets the texts be counted and sampled without all of them being shuffled.
    """
    h = F.shiftrightunsigned(F.col(digest) if digest else F.xxhash64(text), 1)  # 63 bits
    usable = documents.where(F.col(digest or text).isNotNull())
    given = F.col(toxic).isNotNull()
    n_texts, n_others, n_bad, n_good = usable.agg(*[F.approx_count_distinct(F.when(x, h)) for x in (given, ~given)], *[F.sum((F.col(toxic) == 1).cast("int") if y else (F.col(toxic) != 1).cast("int")) for y in (1, 0)]).first()
    if not n_bad or not n_good:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 4.0 if n_bad else -4.0)
    labelled_to, others_to = (min((1 << 63) - 1, (1 << 63) * most // max(1, n)) for most, n in ((max_rows, n_texts), (max_unlabelled, n_others)))
    hits = F.array(*[F.coalesce(F.col("t").rlike(p), F.lit(False)) for p, _ in PATTERNS])
    taken = usable.where(h <= max(labelled_to, others_to)).where(h <= F.when(given, labelled_to).otherwise(others_to))
    distinct = taken.groupBy(h.alias("h"), F.when(given, (F.col(toxic) == 1).cast("int")).otherwise(-1).alias("y")).agg(F.min(text).alias("t"))
    whole = tx.stored(distinct.select("t", "y", (F.col("h") % 2 == 0).cast("int").alias("half"), "h"))
    sample = whole.where("y >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffers(batch.column(0))
            kind = batch.column(2).to_numpy() * 2 + batch.column(1).to_numpy()
            for a, b in tx.slices(at):
                row, value = distinct_pairs(*tx.word_features(data, at[a : b + 1], tx.ALNUM, PREFIXES))
                for k in range(4):
                    found, n = np.unique(value[kind[a:b][row] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(n), k)), pa.array(n)], names=["f", "k", "n"])

    totals = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    split = all(totals.get((s, y)) for s in (0, 1) for y in (0, 1))
    # the lexicons are from half 0, where both halves have both labels; else from all
    mine = (lambda y: F.col(f"n{y}")) if split else (lambda y: F.col(f"n{y}") + F.col(f"n{y + 2}"))
    of = lambda y: sum(n for (s, k), n in totals.items() if k == y and (s == 0 or not split))
    table = sample.select("t", "y", "half").mapInArrow(count, "f bigint, k bigint, n bigint").groupBy("f").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])

    def ends(bad, good, all_bad: int, all_good: int):
        odds = F.log((bad + 1) / (all_bad + 2)) - F.log((good + 1) / (all_good + 2))
        spread = 3 * F.sqrt(1 / (bad + 1) + 1 / (good + 1))  # there are many features: few may pass by chance
        return odds - spread, odds + spread

    every = lambda y: sum(n for (_, k), n in totals.items() if k == y)
    low, high = ends(F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2"), every(1), every(0))
    own_low, own_high = ends(mine(1), mine(0), of(1), of(0))
    chosen = table.select("f", low.alias("low"), high.alias("high"), own_low.alias("own_low"), own_high.alias("own_high")).where(f"low > {LEAST_ODDS} or high < -0.7").toPandas()  # of the sample's words
    hashes = chosen["f"].to_numpy(np.int64).view(np.uint64)
    chosen, hashes = chosen.iloc[np.argsort(hashes)], np.sort(hashes)
    known = tx.KnownHashes(hashes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffers(batch.column(0))
            for a, b in tx.slices(at):
                row, value = tx.word_features(data, at[a : b + 1], tx.ALNUM, PREFIXES)
                place, number = known.number(value)
                row, number = distinct_pairs(row[place], number)
                lists = tx.list_array(pa.array(number.astype(np.int32)), np.bincount(row, minlength=b - a))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), lists], names=["y", "half", "h", "hits", "found"])

    got = whole.select("t", "y", "half", "h", hits.alias("hits")).mapInArrow(look, "y int, half int, h bigint, hits array<boolean>, found array<int>").toPandas().sort_values(["h", "y"], kind="stable")
    y, half = got["y"].to_numpy(), got["half"].to_numpy()
    row = np.repeat(np.arange(len(got)), [len(s) for s in got["found"]])
    number = np.concatenate([np.zeros(0, np.int64), *got["found"]]).astype(np.int64)
    voters = lexicon_voters(chosen["own_low"].to_numpy(), chosen["own_high"].to_numpy())
    fixed = np.array([[v if hit else 0 for hit, (_, v) in zip(hits_, PATTERNS)] for hits_ in got["hits"]], np.int8)
    votes = np.concatenate([lexicon_votes(row, number, len(got), len(hashes), voters), fixed], 1)
    # accuracies are estimated on documents that didn't make the lexicons: on their own half, votes look better than they are
    judge = (half == 1) | (y < 0) if split else np.ones(len(y), bool)
    target, accuracies, correlations = weak_labels(votes, y, judge)
    # the rows without a label shape the label model; learning from their posteriors too found fewer of the toxic documents
    weight = np.abs(2 * target - 1) * (y >= 0)
    # words against toxicity only vote: in a long text there are always many of them
    speaks = (chosen["low"] > LEAST_ODDS).to_numpy()[number]
    w, b = train_linear(row[speaks], number[speaks], len(got), target, weight, len(hashes))
    return Model(hashes, w, b, accuracies, correlations)


def weak_labels(votes: np.ndarray, given: np.ndarray, judge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, accuracies and correlations of the voters, of which the last is the given label (-1: it abstains).

    EM starts from the labels and from what the voters' agreement with them says of the
    rows without one; from there on every row's posterior is free to move, so that a label
    that the others speak against is outvoted. The share of toxic documents stays that of the labels. ``judge``: the rows that are estimated on.
    """
    known = judge & (given >= 0)
    _, table, correlations, prior = label_model(votes[known], given[known], rounds=3)
    start = np.where(given >= 0, given, posteriors(votes, prior, table, correlations))
    every = np.concatenate([votes, np.where(given < 0, 0, 2 * given - 1)[:, None].astype(votes.dtype)], 1)
    nobody = np.full(int(judge.sum()), -1)
    # what the labels said of the other voters stays as counts beside those of all rows
    share = np.array([1 - prior, prior])[None, :, None]
    before = np.concatenate([0.5 + known.sum() * share * table, np.full((1, 2, 3), 0.5)])
    _, table, correlations, prior = label_model(every[judge], nobody, start=start[judge], balance=prior, before=before)
    return posteriors(every, prior, table, correlations), table, correlations


def score(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.7) -> DataFrame:
    """``docs`` without its text, with score (0 to 1, higher: toxic likelier) and predicted (1 if score >= ``limit``).

    Null and empty texts have the score of a text without words. Texts of any
    length are read whole. An empty table gives an empty one. Rows are
    independent: repeated rows get equal scores. Columns of ``docs`` named like
    a result column are replaced.
    """
    made = ["score", "predicted"]
    kept = [c for c in tx.others(docs, made) if c != text]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double"])
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))  # features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, bias = shared.value
        known = tx.KnownHashes(hashes)
        for batch in batches:
            data, at = tx.text_buffers(batch.column(len(kept)))
            out = np.zeros(len(at) - 1)
            for a, b in tx.slices(at):
                row, value = tx.word_features(data, at[a : b + 1], tx.ALNUM, PREFIXES)
                place, number = known.number(value)
                row, number = distinct_pairs(row[place], number)
                out[a:b] = np.bincount(row, weights=weights[number], minlength=b - a)
            p = 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(p)], names=[*kept, "score"])

    scored = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text")).mapInArrow(run, fields)
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))
