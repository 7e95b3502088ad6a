"""Toxic passages: maximal-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import bare_words, discard, hash_words, learnable, mix, slices, split_words, written
from gapwright.llm.decontam import karp_rabin

#: Hashed vocabulary of each feature kind: the model's size whatever the corpus.
BUCKETS = 1 << 17
#: Feature kinds of a token: the word, then its first so many letters; the first telling one counts.
PREFIXES = (0, 6, 5, 4)
#: Labelled texts that fit the classifier: at most so many of each label, by hash of the id.
FIT_ROWS = 10_000


@dataclass
class Model:
    """score[kind, bucket]; the Gumbel's scale and log K; the logistic's weights; the drift."""

    score: np.ndarray
    rate: float
    log_k: float
    bias: float
    slope: float
    drift: float = 0.1

    def words(self, vocab: pa.Array) -> np.ndarray:
        """The score of each word: its first telling feature's odds, less the drift."""
        out = np.zeros(len(vocab))
        for kind, which in enumerate(_buckets(vocab)):
            out = np.where(out == 0, self.score[kind][which], out)
        return out - self.drift


def _buckets(vocab: pa.Array) -> np.ndarray:
    """(kinds, words): the hashed features of each word; each distinct one is hashed once."""
    bare = bare_words(vocab).dictionary_encode()
    out = []
    for n in PREFIXES:
        part = (pc.utf8_slice_codeunits(bare.dictionary, 0, n) if n else bare.dictionary).dictionary_encode()
        hashed = (hash_words(part.dictionary, n) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)
        out.append(hashed[np.asarray(part.indices)][np.asarray(bare.indices)])
    return np.stack(out)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, total) of a sequence, in order.

    The linear scan of Ruzzo and Tompa over the positive tokens: a list of
    candidates, each with the running total before and after it; a new token is
    merged leftwards while some earlier candidate starts lower and ends lower.
    """
    hot = np.flatnonzero(score > 0)
    if not len(hot):
        return []
    total = np.cumsum(score, dtype=np.float64)
    found: list[tuple[int, int, float, float]] = []
    links: list[int] = []  # nearest earlier candidate whose left total is smaller
    for at, right in zip(hot.tolist(), total[hot].tolist(), strict=True):
        start, left = at, right - float(score[at])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = links[j]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:], links[j:]
        found.append((start, at + 1, left, right))
        links.append(j)
    return [(a, b, right - left) for a, b, left, right in found]


def _evidence(found: list[tuple[int, int, float]], n: int, model: Model, level: float) -> tuple[float, list]:
    """Nats beyond chance, summed over the segments whose E-value in a text of n tokens is under ``level``."""
    base = model.log_k + math.log(max(n, 1)) - math.log(level)
    good = [(a, b, model.rate * s - base) for a, b, s in found if model.rate * s > base]
    return sum(x[2] for x in good), good


def _counts(rows: DataFrame, exact: bool) -> np.ndarray:
    """Texts that hold each feature, over whole texts; (2, kinds, BUCKETS) by the column ``toxic``.

    A text counts once for a word, so that one that repeats it a thousand
    times says no more than one that says it once; if ``exact`` also once for
    a prefix that several of its words have.
    """
    size = len(PREFIXES) * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * size, dtype=np.int64)
        for part in slices(batches, "text"):
            words = split_words(part.column("text"))
            if not len(words.codes):
                continue
            toxic = np.asarray(part.column("toxic"), dtype=np.int64)
            row = np.repeat(np.arange(part.num_rows), words.lengths)
            once = np.unique(row * len(words.vocab) + words.codes)
            row, code = once // len(words.vocab), once % len(words.vocab)
            for kind, which in enumerate(_buckets(words.vocab)):
                at = row * BUCKETS + which[code]
                at = np.unique(at) if exact else at
                sums += np.bincount(toxic[at // BUCKETS] * size + kind * BUCKETS + at % BUCKETS, minlength=2 * size)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["cell", "n"])

    table = rows.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size)
    out[np.asarray(table["cell"])] = np.asarray(table["n"])
    return out.reshape(2, len(PREFIXES), BUCKETS)


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, texts: tuple[int, int], prior: float = 2000.0, level: float = 1e-5) -> np.ndarray:
    """Odds of a feature in toxic against clean texts under an informative Dirichlet prior.

    The prior spreads ``prior`` pseudo-counts as the whole corpus does.  A
    feature counts only if so many of its texts are toxic by chance with a
    probability under ``level`` (Chernoff's bound on the binomial tail).
    """
    alpha = prior * (corpus + 0.5) / (corpus + 0.5).sum()
    a, b = toxic + alpha, clean + alpha
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    base = min(max(texts[1] / max(1, sum(texts)), 1e-6), 1 - 1e-6)
    n = toxic + clean
    share = np.divide(toxic, n, out=np.zeros_like(n), where=n > 0)
    gain = np.where(share > 0, share * np.log(np.maximum(share, 1e-12) / base), 0) + np.where(share < 1, (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - base)), 0)
    odds[(share <= base) | (n * gain < -math.log(level)) | (odds < 0)] = 0
    return odds


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One text of each label and least shingle hash: near copies would pass for
    independent evidence.  ``sample`` is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = split_words(part.column("text"))
            hashed = hash_words(words.vocab)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
            shingles = karp_rabin(hashed, 5)
            least = [
                int(shingles[a : b - 4].min()) if b - a >= 5 else int(mix(hashed[a:b].sum(keepdims=True))[0]) if b > a else 0
                for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("text"), pa.array(np.array(least, dtype=np.uint64).view(np.int64))], ["toxic", "text", "least"])

    marked = sample.mapInArrow(run, "toxic int, text string, least bigint")
    return marked.groupBy("toxic", "least").agg(F.min("text").alias("text")).select("toxic", "text")


def _rate(model: Model, clean: np.ndarray) -> float:
    """The positive root of sum p exp(rate * score) = 1 for clean text (the Gumbel's scale)."""
    p = (clean + 1e-3) / (clean + 1e-3).sum()
    score = model.score[0] - model.drift
    value = lambda r: float(p @ np.exp(np.minimum(r * score, 600)))
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps on a lightly penalised likelihood."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (y - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _squash(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


def scan(rows: DataFrame, model: Model, level: float = 1.0) -> DataFrame:
    """(…, tokens, best, evidence, passages) for rows (id columns, text): whole-text scan.

    passages lists (first token, tokens, nats) of every significant segment.
    """
    keys = [f for f in rows.schema.fields if f.name != "text"]
    passage = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("nats", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = split_words(part.column("text"))
            score = model.words(words.vocab)[words.codes] if len(words.codes) else np.zeros(0)
            tokens = words.lengths
            best, evidence, lists = np.zeros(part.num_rows), np.zeros(part.num_rows), [[] for _ in tokens]
            row = np.repeat(np.arange(len(tokens)), tokens)
            for i in np.unique(row[score > 0]).tolist():
                found = segments(score[words.offsets[i] : words.offsets[i + 1]])
                best[i] = max(s for _, _, s in found)
                evidence[i], good = _evidence(found, int(tokens[i]), model, level)
                lists[i] = [{"first": a, "words": b - a, "nats": s} for a, b, s in good]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in keys), pa.array(tokens, pa.int64()), pa.array(best), pa.array(evidence), pa.array(lists, pa.list_(passage))],
                [*(f.name for f in keys), "tokens", "best", "evidence", "passages"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(run, f"{schema}, tokens bigint, best double, evidence double, passages array<struct<first int, words int, nats double>>")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits token odds, the extreme-value law and the final logistic.

    Labelled, learnable rows (id and label not null; a document labelled twice
    is toxic if any label says so) give a sample of at most ``fit_rows`` texts
    of each label, chosen by hash of the id (of several texts with one id the
    least); near copies among them count once.
    The prior counts every document.
    With one label only or none, every score is the share of toxic labels
    (a half without labels).
    """
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for y in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # at most 2 * fit_rows ids
    sample = docs.where(learnable(F.col("doc_id"))).select("doc_id", "text").join(chosen, "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    labelled = written(sample, "toxicity_labelled")
    sample = written(_one_of_copies(labelled), "toxicity_sample")
    discard(labelled)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = _counts(sample, exact=True)
    corpus = _counts(docs.select(F.lit(0).alias("toxic"), "text"), exact=False)[0]
    odds = np.stack([log_odds(toxic[k], clean[k], corpus[k], (sizes.get(0, 0), sizes.get(1, 0))) for k in range(len(PREFIXES))])
    model = Model(odds, 1.0, 0.0, 0.0, 0.0)
    model.rate = _rate(model, clean[0])
    table = scan(sample, model).select("toxic", "tokens", "best").toArrow()
    y, n, best = (np.asarray(table[c], dtype=np.float64) for c in ("toxic", "tokens", "best"))
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        model.bias = 30.0 * (2 * share - 1)
        discard(sample)
        return model
    chance = model.rate * best[y == 0] - np.log(np.maximum(n[y == 0], 1))
    model.log_k = float(chance.mean() - 0.5772156649)  # the Gumbel's mean is log K n + gamma, over the rate
    table = scan(sample, model).select("toxic", "evidence").toArrow()
    discard(sample)
    x = _squash(np.asarray(table["evidence"], dtype=np.float64))
    model.bias, model.slope = _logistic(x, np.asarray(table["toxic"], dtype=np.float64))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) per input row; an empty or null text has no
    passage and gets the score of a text without any.  Ids may be null or
    repeated; other columns are not looked at."""
    z = F.lit(model.bias) + F.lit(model.slope) * F.log1p(F.greatest("evidence", F.lit(0.0)))
    found = scan(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "passages")
