"""Licence scan: Dice coefficient over word bigrams against templates.

A text is lower-cased and split at everything but letters, digits and
non-ASCII characters.  Its segments are its lines, its paragraphs (between
blank lines) and itself; a segment matches the template with the highest Dice
coefficient of distinct bigrams (ties: the first licence by name), if that is
at least ``threshold``.

A licence may also be several paragraphs of a longer text, a notice wrapped
over two lines, or one within a line of prose.  So every run of words is
compared as well, from any bigram of a template to any other; of runs that
overlap the one of the highest coefficient counts (ties: licence by name, then
the first), and it is a match as a segment is.  A run of fewer bigrams than its
template takes in the words up to the next line or sentence bounds, as far as
the template's size, each as a bigram that the template lacks: ``SPDX
licence identifier`` before some other name isn't most of ``... MIT``.

Dice(a, b) >= t needs t/(2-t) <= |a|/|b| <= (2-t)/t, so a template is compared
only with segments in those size bounds, and a segment only if t/(2-t) of its
bigrams occur in any template; both bounds are exact.

Defined cases: null or empty texts have no match; a segment of fewer than two
words has no bigram; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .license_templates import TEMPLATES
from .shared import ensure_columns

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bigrams(h: np.ndarray) -> np.ndarray:
    return tk.mix(h[:-1] * tk.P + h[1:])


@lru_cache(maxsize=2)
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, np.ndarray]], np.ndarray]:
    out = []
    for name, text in sorted(templates):
        data, off = tk.raw(tk.lower(tk.as_array(pa.array([text]))))
        s, e, _ = tk.words(data, off, SEPARATOR)
        out.append((name, np.unique(_bigrams(tk.word_hashes(data, s, e)))))
    return out, np.unique(np.concatenate([b for _, b in out])) if out else np.zeros(0, np.uint64)


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(table >> np.uint64(48)).astype(np.int64)] = True
    out = np.zeros(len(h), dtype=bool)
    maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, h[maybe]), max(len(table) - 1, 0))
    out[maybe] = table[at] == h[maybe] if len(table) else False
    return out


def _breaks(data: np.ndarray, off: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of line and of paragraph for each word; rows break both."""
    newline = np.flatnonzero(data == 10)
    line = np.searchsorted(newline, s)
    first = np.zeros(len(data) + 1, dtype=np.int64)
    first[off[:-1]] = 1
    row = np.cumsum(first)[s]
    blank = np.zeros(0, dtype=np.int64)
    if len(newline) > 1:  # between two line ends only white space
        ink = np.concatenate([[0], np.cumsum(~tk.SPACE[data])])
        blank = newline[1:][ink[newline[1:]] == ink[newline[:-1]]]
    return line + row * (len(newline) + 1), np.searchsorted(blank, s) + row * (len(blank) + 1)


@lru_cache(maxsize=2)
def _holders(templates: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each bigram of the vocabulary the templates that have it, and where its list of them begins."""
    prepared, vocabulary = _prepared(templates)
    at = np.concatenate([np.searchsorted(vocabulary, b) for _, b in prepared])
    own = np.repeat(np.arange(len(prepared)), [len(b) for _, b in prepared])
    order = np.argsort(at, kind="stable")
    return own[order], np.searchsorted(at[order], np.arange(len(vocabulary) + 1))


def _bounds(data: np.ndarray, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each word in its sentence, which ends with its line or with ``.``, ``!`` or ``?`` and white space."""
    stop = data == 10
    stop[:-1] |= np.isin(data[:-1], (33, 46, 63)) & tk.SPACE[data[1:]]
    seen = np.cumsum(stop)[s]
    new = np.concatenate([[True], seen[1:] > seen[:-1]])
    new[first[:-1][first[:-1] < len(s)]] = True
    begin = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    at = np.arange(len(s))
    return at - begin[own], np.append(begin[1:], len(s))[own] - 1 - at


def _runs(pairs: np.ndarray, before: np.ndarray, after: np.ndarray, bags: list[tuple[str, np.ndarray, np.ndarray]], threshold: float) -> Iterator[tuple[str, float]]:
    """Licence and coefficient of the best runs of one text that don't overlap; bags: templates with the places of their bigrams in the text."""
    share, total = threshold / (2 - threshold), len(pairs)
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    last, following = np.full(total, -1), np.full(total, -1)
    last[order[1:][same]], following[order[:-1][same]] = order[:-1][same], order[1:][same]
    heap: list[tuple[float, str, int, int, int]] = []
    flags = []
    starts: dict[int, list[tuple[int, int]]] = {}
    for t, (_, _, places) in enumerate(bags):
        flags.append(np.zeros(total, dtype=bool))
        flags[t][places] = True
        for k, a in enumerate(places.tolist()):
            starts.setdefault(a, []).append((t, k))

    def best(t: int, a: int, fresh: np.ndarray) -> None:
        """The best run from a on; fresh: places of the bigrams not seen since a."""
        name, bag, _ = bags[t]
        hit = flags[t][fresh]
        n, shared, ends = (np.flatnonzero(hit) + 1), np.arange(1, int(hit.sum()) + 1), fresh[hit]
        if len(ends):
            size = np.maximum(n, np.minimum(n + before[a] + after[ends + 1], len(bag)))
            dice = 2 * shared / (size + len(bag))
            i = int(np.argmax(dice))
            if dice[i] >= threshold:
                heapq.heappush(heap, (-float(dice[i]), name, a, int(ends[i]), t))

    first = np.flatnonzero(last < 0).tolist()  # the first places of all bigrams from ``a`` on, in order
    for a in range(max(starts) + 1):
        for t, k in starts.get(a, ()):
            _, bag, places = bags[t]
            least, most = int(np.ceil(share * len(bag) - 1e-9)), int(len(bag) / share + 1e-9)
            if k + least <= len(places) and (a + most >= total or len(first) <= a + most or places[k + least - 1] <= first[a + most]):
                best(t, a, np.array(first[a : a + most]))
        if following[a] >= 0:
            insort(first, int(following[a]), a + 1)
    begins, ends = [], []  # words of the runs that count, in order
    while heap:
        dice, name, a, b, t = heapq.heappop(heap)
        k = bisect_right(begins, a)
        if k and ends[k - 1] >= a:
            continue
        if k < len(begins) and begins[k] <= b + 1:
            inside = np.arange(a, begins[k] - 1)
            best(t, a, inside[last[inside] < a])
            continue
        begins.insert(k, a)
        ends.insert(k, b + 1)
        yield name, -dice


def matches(texts: pa.Array, templates: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[int, str, float]]:
    """(row, licence, best Dice) for lower-cased texts."""
    prepared, vocabulary = _prepared(templates)
    data, off = tk.raw(texts)
    s, e, first = tk.words(data, off, SEPARATOR)
    if len(s) < 2 or not prepared:
        return []
    h = tk.word_hashes(data, s, e)
    pairs = _bigrams(h)
    row = np.searchsorted(first, np.arange(len(h)), side="right") - 1
    line, paragraph = _breaks(data, off, s)
    hit = _member(pairs, vocabulary)
    share = threshold / (2 - threshold)
    sizes = [len(b) for _, b in prepared]
    low, high = share * min(sizes), max(sizes) / share
    best: dict[tuple[int, str], float] = {}
    done = None
    for segment in (line, paragraph, row):
        inside = segment[:-1] == segment[1:]
        if done is not None and np.array_equal(inside, done):
            continue
        done = inside
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        ids = np.cumsum(np.concatenate([[0], (np.diff(segment[at]) != 0)]))
        count = np.bincount(ids)
        live = (np.bincount(ids, weights=hit[at]) > 0) & (count >= low)
        at, ids = at[live[ids]], ids[live[ids]]
        if not len(at):
            continue
        _, one = np.unique(tk.mix(pairs[at] + ids.astype(np.uint64) * tk.P), return_index=True)
        one = np.sort(one)
        at, ids = at[one], ids[one]
        n = np.bincount(ids)
        ok = (np.bincount(ids, weights=hit[at]) >= share * n - 1e-9) & (n >= low - 1e-9) & (n <= high + 1e-9) & (n > 0)
        at, ids = at[ok[ids]], ids[ok[ids]]
        for part in np.split(at, np.flatnonzero(np.diff(ids)) + 1) if len(at) else []:
            bag = pairs[part]
            found, name = 0.0, ""
            for candidate, b in prepared:
                if share * len(b) - 1e-9 <= len(bag) <= len(b) / share + 1e-9:
                    dice = 2 * len(np.intersect1d(bag, b, assume_unique=True)) / (len(bag) + len(b))
                    if dice > found:
                        found, name = dice, candidate
            if found >= threshold:
                key = (int(row[part[0]]), name)
                best[key] = max(best.get(key, 0.0), found)
    at = np.flatnonzero(hit & (row[:-1] == row[1:]))
    if len(at):
        holders, begin = _holders(templates)
        term = np.searchsorted(vocabulary, pairs[at])
        one = np.unique(row[at] * len(vocabulary) + term)
        many = np.diff(begin)[one % len(vocabulary)]
        which = holders[np.repeat(begin[one % len(vocabulary)] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        key, n = np.unique(np.repeat(one // len(vocabulary), many) * len(prepared) + which, return_counts=True)
        key = key[n >= share * np.array(sizes)[key % len(prepared)] - 1e-9]
        before, after = _bounds(data, s, first) if len(key) else (first, first)
        for r in np.unique(key // len(prepared)).tolist():
            i, j = int(first[r]), int(first[r + 1])
            x, y = np.searchsorted(at, (i, j))
            bags = [(*prepared[t], at[x:y][_member(pairs[at[x:y]], prepared[t][1])] - i) for t in (key[key // len(prepared) == r] % len(prepared)).tolist()]
            for name, dice in _runs(pairs[i : j - 1], before[i:j], after[i:j], bags, threshold):
                best[r, name] = max(best.get((r, name), 0.0), dice)
    return [(r, name, dice) for (r, name), dice in sorted(best.items())]


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice: each licence that a segment of the document matches, with the best coefficient."""
    ensure_columns(docs, id_col, text_col)
    chosen = tuple(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(1)))
            for i, j in tk.slices(texts):
                found = matches(texts.slice(i, j - i), chosen, threshold)
                if found:
                    r, name, dice = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(r) + i)), pa.array(name), pa.array(dice)], names=["doc_id", "license", "dice"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return base.mapInArrow(run, "doc_id long, license string, dice double")
