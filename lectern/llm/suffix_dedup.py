"""Repeated passages by two-stage suffix sorting.

A passage is repeated where a run of ``length`` words (50) occurs earlier in
the corpus, in the order of (id, text hash, word).  No suffix array of a whole
corpus fits one machine, so the windows of ``length`` words are first routed by
content: a window belongs to the smallest hash among its ``gram``-word runs
(its minimiser).  Equal windows have equal minimisers, so every class of equal
windows meets in one place, and neighbouring windows of a document with the
same minimiser travel as one snippet.  Snippets whose minimiser occurs once
can't hold a repeat and never travel.

Counts of minimisers are added up where they arise, so one that occurs everywhere
costs its task no more than others.  A minimiser with more than ``hot_words`` words
of different snippets is split: its windows are routed again, by the smallest
hash under another order, and so on, until each part fits.

Where they meet, snippets with equal words are one, and a suffix array is built
over the rest: words are ranked; only suffixes smaller than their successors
are sorted directly (to the depth that counts); the others are induced by one
scan over the buckets; common prefixes of neighbours then give the classes.

Words are the runs between white space, compared with their case, by 32 bits of
hash each, so a false match needs ``length`` equal words but for a collision.

Defined cases: rows with a null id or a null text are left out; texts of fewer
than ``length`` words have no window; rows equal in id and text are the same
occurrence, and rows that share only the id are told apart by the text's hash;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut, ensure_columns

CHUNK_WORDS = 400_000
HOT_WORDS = 2_000_000
LEVELS = 12  # orders that are tried; windows that share their minimiser in all of them stay together


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every full window."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if len(x) >= w else x[:0]


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple:
    """Word hashes, first word of each row, and the segments: row, first window, one past the last window, minimiser, how often it occurs there."""
    s, e, first = tk.words(data, off)
    h = tk.word_hashes(data, s, e)
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return h, first, none, none, none, np.zeros(0, np.uint64), none
    span = length - gram + 1
    grams = tk.window_hashes(h, gram)
    low = sliding_min(grams, span)  # one for each of len(h) - length + 1 windows
    row = np.searchsorted(first, np.arange(len(low)), side="right") - 1
    ok = np.arange(len(low)) + length <= first[row + 1]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(new & ok)
    bounds = np.flatnonzero(np.concatenate([new | ~ok, [True]]))
    ends = bounds[np.searchsorted(bounds, starts, side="right")]
    low = low[starts]
    times = np.where(ends - starts > span, 2, 0)  # a segment of more windows has its minimiser twice
    for d in range(2 * span - 1):
        times += (grams[np.minimum(starts + d, len(grams) - 1)] == low) & (d < ends - starts + span - 1)
    return h, first, row[starts], starts, ends, low, times


def resplit(words: list[np.ndarray], length: int, gram: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of snippets by their minimisers under another order: snippet, first window, one past the last window, minimiser."""
    size = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(size)])
    h = tk.mix(np.concatenate(words).astype(np.uint64) + np.uint64(level) * tk.P)
    low = sliding_min(tk.mix(tk.window_hashes(h, gram) + np.uint64(level)), length - gram + 1)
    row = np.searchsorted(first, np.arange(len(low)), side="right") - 1
    ok = np.arange(len(low)) + length <= first[row + 1]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(new & ok)
    bounds = np.flatnonzero(np.concatenate([new | ~ok, [True]]))
    ends = bounds[np.searchsorted(bounds, starts, side="right")]
    return row[starts], starts - first[row[starts]], ends - first[row[starts]], low[starts]


def _parts(length: int, gram: int, level: int):
    """Rows of ``one`` -> the same columns for each part of a snippet, with the snippet (oh, osh) and the part's place in it (off)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            lists = [np.frombuffer(x, dtype=np.uint32) for x in col("words").to_pylist()]
            row, lo, hi, key = resplit(lists, length, gram, level)
            take = pa.array(row)
            words = [lists[r][a : b + length - 1].tobytes() for r, a, b in zip(row, lo, hi)]
            same = pa.array([int.from_bytes(xxhash.xxh64_digest(w), "big", signed=True) for w in words], pa.int64())
            old = np.asarray(col("h"))[row].view(np.uint64)
            pos = np.asarray(col("pos"))[row] + lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(tk.mix(old ^ tk.mix(key)).view(np.int64)), same, col("id").take(take), col("r").take(take), pa.array(pos.astype(np.int32)), col("copies").take(take), pa.array(words, pa.binary()), col("h").take(take), col("sh").take(take), pa.array(lo.astype(np.int32))],
                names=["h", "sh", "id", "r", "pos", "copies", "words", "oh", "osh", "off"],
            )

    return run


def _minimisers(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.as_array(batch.column(1))
            ids = np.asarray(batch.column(0))
            for i, j in tk.slices(texts):
                data, off = tk.raw(texts.slice(i, j - i))
                _, _, row, _, _, low, times = segments(data, off, length, gram)
                if len(row):  # twice in one segment is twice, as a window can repeat there
                    row, low = np.repeat(row, np.minimum(times, 2)), np.repeat(low, np.minimum(times, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(ids[i:j][row])], names=["h", "id"])

    return run


def _snippets(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = tk.as_array(batch.column(names.index("text")))
            ids, keys = np.asarray(batch.column(names.index("id"))), np.asarray(batch.column(names.index("r")))
            wanted = batch.column(names.index("hs"))
            flat = np.asarray(wanted.flatten())
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(wanted)))])
            for i, j in tk.slices(texts):
                data, off = tk.raw(texts.slice(i, j - i))
                h, first, row, lo, hi, low, _ = segments(data, off, length, gram)
                if not len(row):
                    continue
                want = flat[at[i] : at[j]]
                owner = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                low = low.view(np.int64)
                key = tk.mix(low.view(np.uint64) + row.astype(np.uint64) * tk.P)
                keep = np.isin(key, tk.mix(want.view(np.uint64) + owner.astype(np.uint64) * tk.P))
                row, lo, hi, low = row[keep], lo[keep], hi[keep], low[keep]
                if not len(row):
                    continue
                end = hi + length - 1
                prefix = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(h * tk.powers(len(h)), out=prefix[1:])
                sh = tk.mix((prefix[end] - prefix[lo]) * tk.powers(len(h), True)[lo] + (end - lo).astype(np.uint64))
                fresh = np.zeros(len(sh), dtype=bool)
                fresh[np.unique(sh, return_index=True)[1]] = True
                short = (h >> np.uint64(32)).astype(np.uint32)
                words = [short[a:b].tobytes() if f else None for a, b, f in zip(lo, end, fresh)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), pa.array(sh.view(np.int64)), pa.array(ids[i:j][row]), pa.array(keys[i:j][row]), pa.array((lo - first[row]).astype(np.int32)), pa.array((end - lo).astype(np.int32)), pa.array(words, pa.binary())],
                    names=["h", "sh", "id", "r", "pos", "size", "words"],
                )

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (small non-negative ints) in order, exact to ``depth`` symbols.

    Two stages: suffixes smaller than their successors are sorted directly; a
    suffix that is larger than its successor is put at the head of its bucket
    when the scan meets that successor.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    size = int(text.max()) + 2
    padded = np.concatenate([text + 1, np.zeros(depth + 2, dtype=np.int64)])
    step = np.sign(padded[1 : n + 1] - padded[:n])  # 1: smaller than the successor, -1: larger
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]  # equal symbols take the kind of what follows
    small = step[np.minimum(known, n - 1)] > 0
    at = np.flatnonzero(small)
    key = padded[at] * (size + 1) + padded[at + 1]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(at) else np.zeros(0, np.int64)
    done = 2
    while done < depth and len(at):
        count = np.bincount(group)
        open_ = np.flatnonzero(count[group] > 1)
        if not len(open_):
            break
        part, g = at[open_], group[open_]
        key = padded[part + done] * (size + 1) + padded[part + done + 1]
        order = np.lexsort((key, g))
        at[open_] = part[order]
        key, g = key[order], g[order]
        cuts = np.zeros(len(at), dtype=np.int64)
        cuts[1:] = group[1:] != group[:-1]
        cuts[open_[1:]] |= (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        group = np.cumsum(cuts)
        done += 2
    counts = np.bincount(padded[:n], minlength=size)
    ends = np.cumsum(counts)
    sa = np.full(n, -1, dtype=np.int64)
    if len(at):
        symbol = padded[at]
        per = np.bincount(symbol, minlength=size)
        sa[ends[symbol] - per[symbol] + np.arange(len(at)) - (np.cumsum(per) - per)[symbol]] = at
    head = (ends - counts).tolist()
    out, symbols, large = sa.tolist(), padded[:n].tolist(), (~small).tolist()
    if large[n - 1]:  # the empty suffix comes before all
        c = symbols[n - 1]
        out[head[c]] = n - 1
        head[c] += 1
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and large[j]:
            c = symbols[j]
            out[head[c]] = j
            head[c] += 1
    return np.array(out, dtype=np.int64)


def same_prefix(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each i > 0, whether suffixes sa[i - 1] and sa[i] share their first ``depth`` symbols."""
    padded = np.concatenate([text, -np.ones(depth, dtype=np.int64)])
    live = np.arange(1, len(sa))
    for k in range(depth):
        a, b = sa[live - 1] + k, sa[live] + k
        live = live[(padded[a] == padded[b]) & (np.maximum(a, b) < len(text))]
    out = np.zeros(len(sa), dtype=bool)
    out[live] = True
    return out


def _classes(length: int):
    """Rows (h, sh, id, r, pos, copies, words) ordered by h -> runs (h, sh, at, n, fid, fr, fpos)."""

    def decide(t: pa.Table) -> pa.RecordBatch | None:
        lists = [np.frombuffer(x, dtype=np.uint32) for x in t.column("words").to_pylist()]
        size = np.array([len(x) for x in lists])
        ids, keys, pos, copies = (np.asarray(t.column(c).combine_chunks()) for c in ("id", "r", "pos", "copies"))
        vocabulary, rank = np.unique(np.concatenate(lists), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size + 1)])
        n = int(starts[-1])
        owner = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(n) - starts[owner]
        text = np.empty(n, dtype=np.int64)
        inside = place < size[owner]
        text[inside] = rank + len(size)
        text[~inside] = np.arange(len(size))  # a separator occurs once
        sa = suffix_array(text, length)
        window = place + length <= size[owner]
        sa = sa[window[sa]]
        joined = same_prefix(text, sa, length)
        doc = np.unique(np.rec.fromarrays([ids, keys]), return_inverse=True)[1]
        here = (doc[owner[sa]].astype(np.int64) << 32) | (pos[owner[sa]].astype(np.int64) + place[sa])
        head = np.flatnonzero(~joined)
        first = np.repeat(np.minimum.reduceat(here, head), np.diff(np.append(head, len(sa))))
        emit = (copies[owner[sa]] > 1) | (first != here)
        sa, first = sa[emit], first[emit]
        if not len(sa):
            return None
        order = np.argsort(sa)
        sa, first = sa[order], first[order]
        new = np.ones(len(sa), dtype=bool)
        new[1:] = (sa[1:] != sa[:-1] + 1) | (first[1:] != first[:-1] + 1) | (owner[sa[1:]] != owner[sa[:-1]])
        lead = np.flatnonzero(new)
        count = np.diff(np.append(lead, len(sa)))
        row, f = owner[sa[lead]], first[lead]
        back = np.zeros(int(doc.max()) + 1, dtype=np.int64)
        back[doc] = np.arange(len(doc))
        source = back[f >> 32]
        return pa.RecordBatch.from_arrays(
            [
                t.column("h").combine_chunks().take(pa.array(row)),
                t.column("sh").combine_chunks().take(pa.array(row)),
                pa.array(place[sa[lead]].astype(np.int32)),
                pa.array(count.astype(np.int32)),
                pa.array(ids[source]),
                pa.array(keys[source]),
                pa.array((f & 0xFFFFFFFF).astype(np.int32)),
            ],
            names=["h", "sh", "at", "n", "fid", "fr", "fpos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            while batch.num_rows:
                cum = np.cumsum(np.asarray(pc.binary_length(batch.column("words"))) // 4)
                room = int(np.searchsorted(cum, max(1, CHUNK_WORDS - total)))
                if room >= batch.num_rows:
                    held.append(batch)
                    total += int(cum[-1])
                    break
                hs = np.asarray(batch.column("h"))
                edge = room + 1  # to the end of this minimiser
                while edge < batch.num_rows and hs[edge] == hs[edge - 1]:
                    edge += 1
                if edge == batch.num_rows:  # it may go on in the next batch
                    held.append(batch)
                    total += int(cum[-1])
                    break
                if held and held[-1].column("h")[-1].as_py() != hs[0] and total and room == 0:
                    edge = 0
                if edge:
                    held.append(batch.slice(0, edge))
                batch = batch.slice(edge)
                if (out := decide(pa.Table.from_batches(held))) is not None:
                    yield out
                held, total = [], 0
        if held and (out := decide(pa.Table.from_batches(held))) is not None:
            yield out

    return run


RUNS = "h long, sh long, at int, n int, fid long, fr long, fpos int"


def _runs(one: DataFrame, sizes: DataFrame, length: int, gram: int, hot_words: int, level: int = 1) -> DataFrame:
    """The runs of ``_classes`` for distinct snippets (h, sh, id, r, pos, copies, words), of ``sizes`` (h, sh, size) words; what is too much for one task is split first."""
    total = sizes.repartition("h").groupBy("h", "sh").agg(F.max("size").alias("size")).groupBy("h").agg(F.sum("size").alias("n"))
    hot = cut(total.where(F.col("n") > hot_words).select("h"), "hot-minimisers")
    whole = level >= LEVELS or hot.isEmpty()
    cold = one if whole else one.join(hot, "h", "left_anti").select(one.columns)
    runs = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_classes(length), RUNS)
    if whole:
        return runs
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema.fields) + ", oh long, osh long, off int"
    parts = cut(one.join(hot, "h", "left_semi").select(one.columns).mapInArrow(_parts(length, gram, level), schema), "parts")
    sizes = parts.select("h", "sh", (F.octet_length("words") / 4).alias("size"))
    fewer = parts.groupBy("h", "sh").agg(F.min(F.struct("id", "r", "pos")).alias("m"), F.sum("copies").alias("copies"), F.max("words").alias("words"))
    below = _runs(fewer.select("h", "sh", "m.*", "copies", "words"), sizes, length, gram, hot_words, level + 1)
    back = parts.select("h", "sh", "oh", "osh", "off").join(below, ["h", "sh"])
    return runs.unionByName(back.select(F.col("oh").alias("h"), F.col("osh").alias("sh"), (F.col("off") + F.col("at")).alias("at"), "n", "fid", "fr", "fpos"))


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """id, r (text hash), start, stop (words, half open) of passages that occur earlier, with the first occurrence: first_id, first_start."""
    ensure_columns(docs, id_col, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    seen = base.mapInArrow(_minimisers(length, gram), "h long, id long")
    seen = cut(seen, "seen-minimisers")
    more = seen.groupBy("h").count().where("count > 1").select("h")
    again = cut(seen.join(more, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("hs")), "minimisers")
    found = cut(base.withColumn("r", F.xxhash64("text")).join(again, "id").mapInArrow(_snippets(length, gram), "h long, sh long, id long, r long, pos int, size int, words binary"), "snippets")
    one = found.groupBy("h", "sh").agg(F.min(F.struct("id", "r", "pos")).alias("m"), F.count("*").alias("copies"), F.max("words").alias("words"))
    runs = _runs(one.select("h", "sh", "m.*", "copies", "words"), found.select("h", "sh", "size"), length, gram, hot_words)
    marks = (
        found.select("h", "sh", "id", "r", "pos")
        .join(runs, ["h", "sh"])
        .select("id", "r", (F.col("pos") + F.col("at")).alias("start"), "n", "fid", "fr", "fpos")
        .where("not (id = fid and r = fr and start = fpos)")
        .distinct()
    )
    order = Window.partitionBy("id", "r").orderBy("start")
    before = lambda c: F.lag(c).over(order)
    follows = (F.col("start") == before("start") + before("n")) & (F.col("fid") == before("fid")) & (F.col("fr") == before("fr")) & (F.col("fpos") == before("fpos") + before("n"))
    return (
        marks.withColumn("new", F.when(follows, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(order))
        .groupBy("id", "r", "span")
        .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + length - 1).alias("stop"), F.min("fid").alias("first_id"), F.min("fpos").alias("first_start"))
        .drop("span")
    )


def repeated_passages(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """One row for each passage of at least ``length`` words that occurs earlier in the corpus, as long as it follows one first occurrence."""
    spans = repeated_spans(docs, length, gram, id_col, text_col, hot_words)
    return spans.select(
        F.col("id").alias("doc_id"),
        F.col("start").cast("long").alias("start_word"),
        F.col("stop").cast("long").alias("end_word"),
        F.col("first_id").alias("first_doc_id"),
        F.col("first_start").cast("long").alias("first_start_word"),
    )


def cut_repeats(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents without the words of their repeated passages; the first occurrence stays.

    A document of which nothing is left goes.  ``chars_col``, where there is such a
    column, is counted again for the texts that were cut.
    """
    spans = repeated_spans(docs, length, gram, id_col, text_col)
    per = cut(spans.groupBy(F.col("id").alias("__lectern_id"), F.col("r").alias("__lectern_r")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__lectern_spans")), "spans")
    joined = docs.withColumn("__lectern_r", F.xxhash64(F.col(text_col).cast("string"))).join(per.withColumnRenamed("__lectern_r", "__lectern_r2"), (F.col(id_col) == F.col("__lectern_id")) & (F.col("__lectern_r") == F.col("__lectern_r2")), "left")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("__lectern_spans")
            hit = np.flatnonzero(np.asarray(spans.is_valid()))
            columns = [batch.column(c) for c in names]
            gone = np.zeros(batch.num_rows, dtype=bool)
            if len(hit):
                texts = tk.as_array(columns[at].take(pa.array(hit)))
                new = []
                for k, (text, cuts) in enumerate(zip(texts, spans.take(pa.array(hit)).to_pylist())):
                    data, off = tk.raw(texts.slice(k, 1))
                    s, e, _ = tk.words(data, off)
                    drop = np.zeros(len(s) + 1, dtype=np.int64)
                    for c in cuts:
                        drop[c["start"]] += 1
                        drop[c["stop"]] -= 1
                    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                    gone[hit[k]] = not len(stay)
                    whole = data.tobytes()
                    lead = np.flatnonzero(np.diff(np.concatenate([[-2], stay])) > 1)
                    ends = np.append(lead[1:], len(stay)) - 1 if len(stay) else lead
                    new.append("\n".join(whole[s[stay[a]] : e[stay[b]]].decode() for a, b in zip(lead, ends)))
                where = pa.array(np.isin(np.arange(batch.num_rows), hit))
                columns[at] = pc.replace_with_mask(columns[at].cast(pa.string()), where, pa.array(new, pa.string()))
                if chars_col in names:
                    c = names.index(chars_col)
                    columns[c] = pc.replace_with_mask(columns[c], where, pa.array([len(x) for x in new]).cast(columns[c].type))
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out.filter(pa.array(~gone)) if gone.any() else out

    return joined.select(*names, "__lectern_spans").mapInArrow(run, docs.schema)
