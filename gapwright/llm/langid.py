"""Language of texts and of their spans: script ranges, then Viterbi over word scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import Words, learnable, slices, split_words

#: First and last code point of script blocks; letters elsewhere count as Latin.
SCRIPTS = [
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
]
#: Bytes of text labelled at once: the steps of Viterbi are as many as the longest text's words, so few slices are better.
TEXT_BYTES = 4 << 20
#: Hashed character trigrams (a word's ends count as characters).
BUCKETS = 1 << 15
UNKNOWN = "und"


@dataclass
class Model:
    """langs in order; logp[lang, bucket]; allowed[script, lang]."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray


@cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: is it a letter; the script (0: none, 1: Latin and all else)."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = letter.astype(np.int8)
    for i, (_, low, high) in enumerate(SCRIPTS):
        script[low : high + 1] = np.where(letter[low : high + 1], i + 2, 0)
    return letter, script


def _features(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its trigram buckets (flat, with starts) and its script."""
    letter, script = _code_points()
    words = pc.utf8_lower(vocab)
    joined = " " + " ".join(words.to_pylist()) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    # only a separator is a space: words hold none
    gaps = np.flatnonzero(points == 32)
    starts = gaps[:-1]  # each word's window begins at the space before it
    hashed = points[:-2] * 0x9E3779B1 + points[1:-1] * 0x85EBCA6B + points[2:] * 0xC2B2AE35
    buckets = (hashed ^ (hashed >> 15)) & (BUCKETS - 1)
    inner = points[1:-1] != 32  # trigram i is centred on point i + 1
    number = np.cumsum(inner) - inner
    kind = np.where(points < 0x110000, script[np.minimum(points, 0x10FFFF)], 0)
    return buckets[inner], number[starts], np.maximum.reduceat(kind, starts) if len(starts) else kind[:0]


def word_scores(vocab: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score[word, lang], has letters[word]).  Scores are log-likelihoods less
    the best one; a language that the word's script rules out gets -50."""
    flat, starts, script = _features(vocab)
    score = np.empty((len(vocab), len(model.langs)), dtype=np.float32)
    for i in range(len(model.langs)):
        score[:, i] = np.add.reduceat(model.logp[i][flat], starts)
    score -= score.max(axis=1, keepdims=True)
    can = model.allowed[script]
    score[~can & can.any(axis=1, keepdims=True)] = -50
    score -= score.max(axis=1, keepdims=True)
    score[script == 0] = 0
    return np.maximum(score, -50), script > 0


def viterbi(score: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, all texts side by side, one word at a time.

    A change of label costs ``penalty``.  Ties stay with the label, then go to
    the first.  Texts are ordered by length, so step t touches only those that
    are longer.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    base, sizes = offsets[:-1][order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    path = np.zeros(len(score), dtype=np.int32)
    if not longest:
        return path
    stays = np.ones(score.shape, dtype=bool)
    came = np.zeros(len(score), dtype=np.int32)
    state = score[base[: active[0]]].astype(np.float64)
    ends = np.zeros(len(sizes), dtype=np.int32)
    for t in range(1, longest):
        n = active[t]
        if n < len(state):
            ends[n : len(state)] = state[n:].argmax(axis=1)
            state = state[:n]
        at = base[:n] + t
        best = state.argmax(axis=1)
        top = state[np.arange(n), best]
        switch = top - penalty
        stay = state >= switch[:, None]
        stays[at] = stay
        came[at] = best
        state = np.where(stay, state, switch[:, None]) - top[:, None] + score[at]
    ends[: len(state)] = state.argmax(axis=1)
    label = ends[: active[0]].copy()
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = base[:n] + t
        now = label[:n]
        path[at] = now
        if t:
            label[:n] = np.where(stays[at, now], now, came[at])
    return path


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram and script counts over all learnable rows (no sampling).

    Rows with a null id, text or language teach nothing.  Each task sums its
    own counts; what reaches the driver is bounded by languages x buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", TEXT_BYTES):
            words = split_words(part.column("text"))
            if not len(words.codes):
                continue
            flat, starts, script = _features(words.vocab)
            langs = part.column("lang").dictionary_encode()
            owner = np.repeat(np.asarray(langs.indices), words.lengths)
            spans = np.diff(np.append(starts, len(flat)))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                seen = np.bincount(words.codes[owner == i], minlength=len(words.vocab)).astype(np.float64)
                counts = np.bincount(flat, weights=np.repeat(seen, spans), minlength=BUCKETS)
                scripts = np.bincount(script, weights=seen, minlength=len(SCRIPTS) + 2)
                totals[lang] = totals.get(lang, 0) + np.concatenate([counts, scripts])
        for lang, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some].astype(np.int64))],
                ["lang", "cell", "n"],
            )

    rows = docs.where(learnable(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = rows.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    where = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 2))
    if langs:
        row = np.array([where[x] for x in table["lang"].to_pylist()])
        counts[row, np.asarray(table["cell"])] = np.asarray(table["n"])
    grams, scripts = counts[:, :BUCKETS] + 0.1, counts[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)) if langs else grams
    lettered = scripts[:, 1:].sum(axis=1, keepdims=True) if langs else scripts[:, :1]
    return Model(langs, logp.astype(np.float32), (scripts >= 0.01 * np.maximum(lettered, 1)).T.copy())


def _labelled(texts: pa.Array, model: Model, penalty: float) -> tuple[Words, np.ndarray, np.ndarray]:
    words = split_words(texts)
    if not len(words.codes) or not model.langs:
        return words, np.zeros(len(words.codes), np.int32), np.zeros(len(words.codes), bool)
    score, lettered = word_scores(words.vocab, model)
    return words, viterbi(score[words.codes], words.offsets, penalty), lettered[words.codes]


def _voted(words: Words, path: np.ndarray, lettered: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: has it a language; the one of most of its lettered words; its share of them."""
    n, k = len(words.lengths), max(1, len(model.langs))
    row = np.repeat(np.arange(n), words.lengths)
    votes = np.bincount(row[lettered] * k + path[lettered], minlength=n * k).reshape(n, k)
    total = votes.sum(axis=1)
    return total > 0, votes.argmax(axis=1), np.where(total > 0, votes.max(axis=1) / np.maximum(total, 1), 0.0)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """(doc_id, lang_pred, score, spans) per input row.

    spans lists (first word, words, lang) of the Viterbi path; lang_pred is the
    language of most words that hold letters (ties: the first by name) and
    score its share of them.  A null or empty text, one without letters, and
    every text under a model that learned no language give ``und``, score 0 and
    no spans.  Ids may be null or repeated; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", TEXT_BYTES):
            words, path, lettered = _labelled(part.column("text"), model, penalty)
            n = part.num_rows
            row = np.repeat(np.arange(n), words.lengths)
            some, best, score = _voted(words, path, lettered, model)
            names = np.array([*model.langs, UNKNOWN], dtype=object)
            pred = names[np.where(some, best, len(model.langs))]
            new = np.ones(len(path), dtype=bool)
            new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new & some[row]) if len(row) else np.zeros(0, int)
            ends = np.append(np.flatnonzero(new), len(path))
            stop = ends[np.searchsorted(ends, at, side="right")] if len(at) else at
            spans = pa.StructArray.from_arrays(
                [pa.array((at - words.offsets[row[at]]).astype(np.int32)), pa.array((stop - at).astype(np.int32)), pa.array(names[path[at]], pa.string())],
                fields=list(span),
            )
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=n)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), spans)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), lists], ["doc_id", "lang_pred", "score", "spans"]
            )

    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<first int, words int, lang string>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def filter_known(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 12.0, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language: ``label`` gives them
    one, with a score of ``least`` or more.

    Texts without letters go, and so do those whose spans are of several
    languages none of which has that share of the lettered words.  The label
    is taken beside the row in one pass, so nothing is joined or shuffled.
    Under a model that learned no language every row goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, TEXT_BYTES):
            some, _, score = _voted(*_labelled(part.column(text_col), model, penalty), model)
            yield part.filter(pa.array(some & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
