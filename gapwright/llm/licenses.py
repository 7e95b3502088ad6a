"""License texts inside documents: winnowed template index, then banded alignment."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapwright.llm.common import bare_words, hash_words, slices, split_words
from gapwright.llm.decontam import karp_rabin
from gapwright.llm.license_texts import TEMPLATES

#: Words of a fingerprint, and fingerprints of a winnowing window.
GRAM, WINNOW = 3, 2
#: Share of a template's words that must match.
COVERAGE = 0.8
#: Share of a longer template's fingerprints that must hit within its band.
SHARE = 1 / 8
#: The index is sent to every worker: templates beyond this size are refused.
MAX_TEMPLATE_BYTES = 16 << 20

#: Templates of fewer words are looked up by single words, so that none within the coverage is missed.
SHORT = 16


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each ``window`` of them (the rightmost on ties)."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (np.arange(len(views)) + views.argmin(axis=1)))


@dataclass
class Match:
    matched: int
    first: int
    end: int
    agreed: set[int]


def align(template: list[int], text: list[int], diagonal: int, band: int) -> Match:
    """Aligns the whole template within ``band`` of a diagonal (text place less template place).

    Agreement +2, any other pair -1, a gap -1; text before and after is free.
    Ties prefer pairs, then gaps in the text.  Returns agreeing words and the
    text span from the first to the last of them, and which of the template's words they are.
    """
    n, m, width = len(template), len(text), 2 * band + 1
    low = -(10**9)
    before = [0 if 0 <= diagonal - band + k <= m else low for k in range(width)]
    moves = []
    for i in range(1, n + 1):
        row, move = [low] * width, [0] * width
        for k in range(width):
            j = i + diagonal - band + k
            if not 0 <= j <= m:
                continue
            best, how = low, 0
            if j and before[k] > low:
                best, how = before[k] + (2 if template[i - 1] == text[j - 1] else -1), 1
            if k + 1 < width and before[k + 1] - 1 > best:
                best, how = before[k + 1] - 1, 2
            if k and row[k - 1] - 1 > best:
                best, how = row[k - 1] - 1, 3
            row[k], move[k] = best, how
        moves.append(move)
        before = row
    k = max(range(width), key=lambda x: before[x])
    i, first, end = n, 0, 0
    agreed: set[int] = set()
    while i and moves[i - 1][k]:
        how, j = moves[i - 1][k], i + diagonal - band + k
        if how == 1:
            if template[i - 1] == text[j - 1]:
                first, end = j - 1, max(end, j)
                agreed.add(i - 1)
            i -= 1
        elif how == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return Match(len(agreed), first, end, agreed)


class Index:
    """Templates, and where each of their fingerprints stands in them.

    Of a template of n words up to n - ceil(coverage n) may be missing, so one
    of any larger number of its words is there: a short template's fingerprints
    are that many of its words, those that the fewest templates hold.  Longer
    ones have winnowed ones of ``GRAM`` words.  Words of a short template that
    name its license (those with a digit, or of capitals only) must match.
    """

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.ids, self.tokens, self.prints, self.musts, self.short = [], [], [], [], []
        found: dict[int, list[tuple[int, int]]] = {}
        single: dict[int, list[tuple[int, int]]] = {}
        split = []
        for name, text in sorted(templates):
            words = split_words(pa.array([text]))
            vocab = words.vocab.to_pylist()
            split.append((name, [vocab[c] for c in words.codes.tolist()], hash_words(bare_words(words.vocab))[words.codes] if len(words.codes) else np.zeros(0, np.uint64)))
        common: dict[int, int] = {}
        for _, _, tokens in split:
            for t in set(tokens.tolist()):
                common[t] = common.get(t, 0) + 1
        for k, (name, plain, tokens) in enumerate(split):
            n = len(tokens)
            self.ids.append(name)
            self.tokens.append(tokens.tolist())
            self.short.append(n < SHORT)
            if n < SHORT:
                spare = n - math.ceil(coverage * n)
                order = sorted(range(n), key=lambda p: (common[int(tokens[p])], -len(plain[p]), p))
                for p in order[: spare + 1]:
                    single.setdefault(int(tokens[p]), []).append((k, p))
                self.prints.append(1)
                self.musts.append([p for p, w in enumerate(plain) if any(c.isdigit() for c in w) or sum(c.isupper() for c in w) >= max(2, sum(c.isalpha() for c in w))])
                continue
            gram = karp_rabin(tokens, GRAM)
            chosen = winnow(gram, WINNOW)
            self.prints.append(max(1, math.ceil(len(chosen) * SHARE)))
            self.musts.append([])
            for p in chosen.tolist():
                found.setdefault(int(gram[p]), []).append((k, p))
        self.places, self.single = found, single
        self.hashes, self.words = np.array(sorted(found), dtype=np.uint64), np.array(sorted(single), dtype=np.uint64)


def _candidates(hits: list[tuple[int, int, int]], index: Index) -> Iterator[tuple[int, int, int]]:
    """(template, diagonal, band) for hits (template, text place, template place) that lie
    close together and are enough of the template's fingerprints."""
    by_template: dict[int, list[tuple[int, int]]] = {}
    for k, t, p in hits:
        by_template.setdefault(k, []).append((t - p, p))
    for k, places in by_template.items():
        band = max(4, len(index.tokens[k]) // 10)
        places.sort()
        start, end = 0, 0
        while start < len(places):
            while end < len(places) and places[end][0] <= places[start][0] + band:
                end += 1
            group = places[start:end]
            if index.short[k]:
                yield from ((k, d, band) for d in sorted({d for d, _ in group}))
            elif len({p for _, p in group}) >= index.prints[k]:
                yield k, group[len(group) // 2][0], band
            # groups overlap by half, so that none is cut in two; those of a short template are taken whole
            half = places[start][0] + (band if index.short[k] else band // 2)
            while start < len(places) and (places[start][0] <= half or end == len(places)):
                start += 1


def find(text: np.ndarray, hits: list[tuple[int, int, int]], index: Index, coverage: float) -> list[tuple[int, float, int, int, int]]:
    """Matches (template, coverage, matched words, first, end), the best of those that overlap.

    Better is: more of the template's words matched, then the higher coverage,
    then the first template by name.
    """
    found = set()
    for k, diagonal, band in _candidates(hits, index):
        template = index.tokens[k]
        begin = max(0, diagonal - band)
        part = text[begin : max(0, diagonal + len(template) + band)].tolist()
        if len(set(template).intersection(part)) < len(set(template)) - (1 - coverage) * len(template) - 1e-9:
            continue  # too few of its words are there at all
        m = align(template, part, diagonal - begin, band)
        if m.matched >= coverage * len(template) and m.agreed.issuperset(index.musts[k]):
            found.add((k, m.matched / len(template), m.matched, m.first + begin, m.end + begin))
    taken: list[tuple[int, float, int, int, int]] = []
    starts: list[int] = []
    for x in sorted(found, key=lambda x: (-x[2], -x[1], x[0], x[3])):
        # matches taken so far do not overlap, so only the neighbours can
        at = bisect.bisect_right(starts, x[3])
        if (at and taken[at - 1][4] > x[3]) or (at < len(taken) and taken[at][3] < x[4]):
            continue
        starts.insert(at, x[3])
        taken.insert(at, x)
    return taken


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, template, coverage, matched, first_word, end_word): license notices in whole texts.

    Words are compared in lower case without punctuation at their ends.  A row
    stands for one notice in one input row; overlapping matches give only the
    best.  Null and empty texts match nothing, null ids are returned as they
    are, repeated rows give repeated results, and other columns are not looked
    at.  A template without words matches nothing.

    Templates of fewer than ``SHORT`` words miss no match whose words lie
    within ``band`` of one diagonal; a longer one is found if an eighth of its
    winnowed fingerprints are there, which at the least coverage holds for
    nearly all (the tests measure it).
    """
    if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("too many templates to send to every worker; scan in several calls")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, coverage)
        for part in slices(batches, "text"):
            words = split_words(part.column("text"))
            if not len(words.codes):
                continue
            hashed = hash_words(bare_words(words.vocab))
            tokens = hashed[words.codes]
            alone = np.flatnonzero(np.isin(hashed, index.words)[words.codes])
            grams = karp_rabin(tokens, GRAM)
            hit = np.flatnonzero(np.isin(grams, index.hashes))
            row = np.searchsorted(words.offsets, hit, side="right") - 1
            hit = hit[hit + GRAM <= words.offsets[row + 1]]
            found = np.concatenate([hit, alone])
            row = np.searchsorted(words.offsets, found, side="right") - 1
            by_gram = np.arange(len(found)) < len(hit)
            order = np.argsort(row, kind="stable")
            out = []
            for group in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
                r = int(row[group[0]])
                begin = int(words.offsets[r])
                text = tokens[begin : int(words.offsets[r + 1])]
                hits = []
                for g, gram in zip(found[group].tolist(), by_gram[group].tolist(), strict=True):
                    hits.extend((k, g - begin, p) for k, p in (index.places[int(grams[g])] if gram else index.single[int(tokens[g])]))
                out.extend((r, index.ids[k], share, n, a, b) for k, share, n, a, b in find(text, hits, index, coverage))
            if out:
                rows, names, share, n, first, end = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), pa.array(names), pa.array(share), pa.array(n, pa.int32()), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                    ["doc_id", "template", "coverage", "matched", "first_word", "end_word"],
                )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"doc_id {kind}, template string, coverage double, matched int, first_word int, end_word int")
