"""Toxicity by weak supervision.

Voters are lexicons, patterns mined as word beginnings from a bounded sample of
labelled rows (so that languages without a lexicon have voters too), and
patterns of use (several different hits, hits close together, a hit beside the
second person, no hit at all).  Each fires or not.  A generative label model is
fitted to how often each combination of voters fires over *all* documents (at
most 2**17 rows whatever the corpus): expectation maximisation estimates the
class balance and each voter's firing rate in both classes, the correlations
of voters within a class shrink the weights of voters that repeat each other,
and the posterior of every combination follows.  A linear classifier (logistic
loss on posteriors as soft labels) over the voters and hashed words is trained
on a bounded sample and scores every document.

Defined cases: a null or wordless text has posterior and score 0 and is not
toxic; a combination of votes that no row had in fitting has the posterior that
the model's rates give it; repeated rows get equal rows; without labels nothing is mined; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut, ensure_columns

LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile imbeciles dumb dumbass dimwit halfwit brainless fool fools foolish retard retarded cretin dunce dolt",
    "worth": "worthless pathetic loser losers scum trash garbage vermin filth filthy lowlife useless failure degenerate degenerates parasite parasites subhuman",
    "ridicule": "clown clowns jerk jerks creep creeps coward cowards freak freaks weirdo psycho lunatic pig pigs",
    "disgust": "disgusting disgust vile repulsive revolting sickening nasty hideous ugly despicable contemptible",
    "profanity": "damn damned crap shit shitty bullshit fuck fucking fucker fucked bitch bitches bastard bastards asshole assholes prick cunt whore slut piss",
    "hostility": "hate hateful despise kill kys murder destroy shutup crush exterminate",
    "german": "idioten dumm dummkopf blödmann arschloch scheiße scheiss scheisse abschaum wertlos erbärmlich widerlich versager trottel drecksack hurensohn",
    "french": "idiote imbécile imbéciles connard connards connasse merde salaud salope ordure pourriture débile minable dégoûtant dégueulasse crétin abruti pute",
    "spanish": "idiotas imbécil imbéciles estúpido estúpida basura asqueroso asquerosa inútil patético mierda puta cabrón pendejo gilipollas escoria tonto",
}
SECOND_PERSON = "you your yours yourself du dich dir dein deine tu toi vous votre ton ta usted ustedes te ti"
USE = ["two_different", "three_hits", "dense", "second_person", "no_hit_short", "no_hit_long"]
NAMES = [*LEXICONS, "beginnings", "words", *USE]  # 17: all combinations are collected, 2**17 at most
CLEAN = {"no_hit_short", "no_hit_long"}
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
BUCKETS = 1024
SAMPLE_ROWS = 20_000

LETTERS = np.ones(256, dtype=bool)  # what separates words
LETTERS[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False


def _hashes(words: str) -> np.ndarray:
    data, off = tk.raw(tk.as_array(pa.array([words.lower()])))
    s, e, _ = tk.words(data, off)
    return np.sort(tk.word_hashes(data, s, e))


def _lexicon_hashes() -> list[int]:
    return [int(x) for x in np.concatenate([_hashes(w) for w in LEXICONS.values()]).view(np.int64)]


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each hash is in a sorted table; a bitmap of 16 bits leaves few for the search."""
    out = np.zeros(len(h), dtype=bool)
    if len(table):
        bits = np.zeros(1 << 16, dtype=bool)
        bits[(table >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
        out[maybe] = table[at] == h[maybe]
    return out


@dataclass
class Tokens:
    h: np.ndarray
    first: np.ndarray
    begin: dict[int, tuple[np.ndarray, np.ndarray]]  # by length in bytes: indices of words, hashes


def tokens(texts: pa.Array, sizes: tuple[int, ...] = BEGINNINGS) -> Tokens:
    data, off = tk.raw(texts)
    s, e, first = tk.words(data, off, LETTERS)
    prefix = tk.byte_prefix(data)
    begin = {}
    for size in sizes:
        at = np.flatnonzero(e - s >= size)
        begin[size] = (at, tk.slice_hashes(prefix, s[at], s[at] + size) ^ np.uint64(size))
    return Tokens(tk.slice_hashes(prefix, s, e), first, begin)


def _features(t: Tokens, mined: dict[int, np.ndarray], lexicons: list[np.ndarray], second: np.ndarray, dense: float, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of voters (bits in the order of NAMES) and hit counts, for each row."""
    rows = len(t.first) - 1
    count = np.diff(t.first)
    hit = np.zeros(len(t.h), dtype=bool)
    votes = np.zeros((rows, len(NAMES)), dtype=bool)

    def fire(j: int, where: np.ndarray) -> None:
        hit[where] = True
        if len(where):
            votes[np.searchsorted(t.first, where, side="right") - 1, j] = True

    for j, table in enumerate(lexicons):
        fire(j, np.flatnonzero(_member(t.h, table)))
    for size, table in mined.items():
        if size and len(table):
            at, h = t.begin[size]
            fire(NAMES.index("beginnings"), at[_member(h, table)])
        elif not size:
            fire(NAMES.index("words"), np.flatnonzero(_member(t.h, table)))
    where = np.flatnonzero(hit)
    owner = np.searchsorted(t.first, where, side="right") - 1
    hits = np.bincount(owner, minlength=rows)
    pairs = np.unique(np.rec.fromarrays([owner, t.h[where]])) if len(where) else np.rec.fromarrays([owner, owner])
    different = np.bincount(np.asarray(pairs.f0), minlength=rows)
    votes[:, NAMES.index("two_different")] = different >= 2
    votes[:, NAMES.index("three_hits")] = hits >= 3
    votes[:, NAMES.index("dense")] = hits >= np.maximum(1, dense * count)
    near = np.concatenate([[0], np.cumsum(_member(t.h, second))])
    beside = near[np.minimum(where + 4, t.first[owner + 1])] > near[np.maximum(where - 3, t.first[owner])]
    votes[owner[beside], NAMES.index("second_person")] = True
    votes[:, NAMES.index("no_hit_short")] = (hits == 0) & (count > 0) & (count < long)
    votes[:, NAMES.index("no_hit_long")] = (hits == 0) & (count >= long)
    return votes, hits


def label_model(masks: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict:
    """Class balance, firing rates by class, correlations within classes, weights and accuracies of the voters."""
    m = len(NAMES)
    fired = ((masks[:, None] >> np.arange(m)) & 1).astype(float)
    total = counts.sum()
    polarity = np.array([n not in CLEAN for n in NAMES])
    rate = np.stack([np.where(polarity, 0.02, 0.6), np.where(polarity, 0.3, 0.02)])
    share = np.ones(m)
    balance = 0.1
    post = np.zeros(len(masks))
    rho = np.zeros((m, m))
    for i in range(rounds):
        gain = np.log(rate[1] / rate[0]) * fired + np.log((1 - rate[1]) / (1 - rate[0])) * (1 - fired)
        logit = np.log(balance / (1 - balance)) + (gain * share).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        moved = float(np.abs(new - post).max()) if len(post) else 0.0
        post = new
        w = np.stack([(1 - post) * counts, post * counts])
        size = w.sum(axis=1)
        rate = np.clip((w @ fired + 0.5) / (size[:, None] + 1), 1e-4, 1 - 1e-4)
        balance = float(np.clip(size[1] / max(total, 1), 1e-4, 0.5))
        rho = np.zeros((m, m))
        for k in (0, 1):
            d = (fired - rate[k]) * w[k][:, None]
            cov = d.T @ (fired - rate[k]) / max(size[k], 1.0)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            rho += np.abs(cov / sd[:, None] / sd[None, :]) * size[k] / max(total, 1)
        np.fill_diagonal(rho, 0)
        share = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(axis=1))
        if i > 5 and moved < 1e-6:
            break
    accuracy = np.where(polarity, rate[1] * balance + (1 - rate[0]) * (1 - balance), rate[0] * (1 - balance) + (1 - rate[1]) * balance)
    return {"balance": balance, "rate": rate, "correlation": rho, "share": share, "accuracy": accuracy}


def posterior(label: dict, masks: np.ndarray) -> np.ndarray:
    """The label model's probability that a row with these votes is toxic, also for combinations that it wasn't fitted to; 0 of a model fitted to nothing."""
    if "rate" not in label:
        return np.zeros(len(masks))
    fired = ((masks[:, None] >> np.arange(len(NAMES))) & 1).astype(float)
    rate, balance = label["rate"], label["balance"]
    gain = np.log(rate[1] / rate[0]) * fired + np.log((1 - rate[1]) / (1 - rate[0])) * (1 - fired)
    logit = np.log(balance / (1 - balance)) + (gain * label["share"]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels, classes weighted evenly; Nesterov's method, last weight the bias."""
    n, d = x.shape
    y = y.astype(np.float32)
    w, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    pos = max(float(y.sum()), 1e-3)
    weight = np.where(y > 0.5, 0.5 / pos, 0.5 / max(n - pos, 1e-3)).astype(np.float32)
    scale = np.sqrt((x * x).sum(axis=1).max() + 1)
    rate = np.float32(8 / scale**2)
    for i in range(steps):
        look = w + np.float32(i / (i + 3)) * (w - v)
        v = w
        p = 1 / (1 + np.exp(-np.clip(x @ look[:-1] + look[-1], -30, 30)))
        r = weight * (p - y)
        g = np.append(r @ x, r.sum()) + np.float32(l2) * look
        w = (look - rate * g).astype(np.float32)
    return w


@dataclass
class ToxicityModel:
    mined: dict[int, np.ndarray]
    dense: float
    long: int
    label: dict
    weights: np.ndarray
    threshold: float

    def voters(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Tokens]:
        t = tokens(texts, tuple(size for size, table in self.mined.items() if size > 0 and len(table)))
        veto = self.mined.get(-1, np.zeros(0, np.uint64))
        lexicons = [np.setdiff1d(_hashes(x), veto) for x in LEXICONS.values()]
        mined = {k: v for k, v in self.mined.items() if k >= 0}
        votes, hits = _features(t, mined, lexicons, _hashes(SECOND_PERSON), self.dense, self.long)
        return votes, hits, t

    def inputs(self, votes: np.ndarray, hits: np.ndarray, t: Tokens) -> np.ndarray:
        """Voters, log hits and density, and hashed words scaled to length 1."""
        rows, count = len(hits), np.diff(t.first)
        owner = np.repeat(np.arange(rows), count)
        bag = np.bincount(owner * BUCKETS + (t.h >> np.uint64(54)).astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32)
        bag = np.sqrt(bag)
        bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1)
        own = np.column_stack([votes, np.log1p(hits), np.minimum(1, 50 * hits / np.maximum(count, 1))]).astype(np.float32)
        return np.hstack([own, bag])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the label model and the classifier's probability."""
        votes, hits, t = self.voters(texts)
        masks = votes @ (1 << np.arange(len(NAMES)))
        post = posterior(self.label, masks)
        x = self.inputs(votes, hits, t)
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))
        empty = np.diff(t.first) == 0
        post[empty] = p[empty] = 0
        return post, p.astype(float)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _counts(known: dict[int, np.ndarray] | None = None):
    """Distinct words and beginnings of each row, of those known where given: size, hash and the number of rows, added up over a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(0)))
            for i, j in tk.slices(texts):
                t = tokens(texts.slice(i, j - i))
                row = np.repeat(np.arange(j - i), np.diff(t.first))
                for size, (at, h) in {**t.begin, 0: (np.arange(len(t.h)), t.h)}.items():
                    if known is not None:
                        ok = _member(h, known[size])
                        at, h = at[ok], h[ok]
                    if len(h):
                        _, one = np.unique(tk.mix(h + row[at].astype(np.uint64) * tk.P), return_index=True)
                        keys, n = np.unique(h[one], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["size", "h", "n"])

    return run


def mine(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, share: float = 0.015, ratio: float = 30.0) -> dict[int, np.ndarray]:
    """Words and beginnings of words that occur in at least ``share`` of the sample's toxic rows and ``ratio`` times as often as in its clean rows.

    Under -1: lexicon words that the sample's clean rows hold about as often, which some language has as an ordinary word; they don't vote.
    What is collected has at most (distinct words a row) / share entries.
    """
    picked = labels.where("toxic is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = cut(picked.orderBy(F.xxhash64("id"), "id").limit(rows), "labelled")  # at most ``rows`` rows, so it may be broadcast
    sample = cut(_base(docs, id_col, text_col).where("text is not null").join(F.broadcast(picked), "id").select("text", "toxic").distinct(), "labelled-texts")
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if bad < 3 or not good:
        return {}
    schema, sizes = "size int, h long, n long", (0, *BEGINNINGS)

    def count(toxic: int, known: dict[int, np.ndarray] | None = None, least: int = 1):
        return sample.where(F.col("toxic") == toxic).select("text").mapInArrow(_counts(known), schema).groupBy("size", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas().set_index(["size", "h"])["n"]

    least = max(4, int(np.ceil(share * bad)))
    table = lambda keys: {k: np.sort(np.array([h for s, h in keys if s == k], dtype=np.int64).view(np.uint64)) for k in sizes}
    in_bad = count(1, least=least)
    lexicon = [(0, h) for h in _lexicon_hashes()]
    in_good = count(0, table([*in_bad.index, *lexicon]))
    found = [k for k, n in in_bad.items() if n / bad >= ratio * (in_good.get(k, 0) + 0.5) / good]
    common = [k for k in set(lexicon) if in_good.get(k, 0) > 0.005 * good and in_bad.get(k, 0) / bad < 5 * in_good.get(k, 0) / good]
    return {-1: table(common)[0]} | table(found)


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, dense: float = 0.005, long: int = 50, threshold: float = 0.5) -> ToxicityModel:
    ensure_columns(docs, id_col, text_col)
    mined = mine(docs, labels, sample_rows, id_col, text_col) if labels is not None else {}
    model = ToxicityModel(mined, dense, long, {}, np.zeros(len(NAMES) + BUCKETS + 3, np.float32), threshold)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(0)))
            for i, j in tk.slices(texts):
                v, _, t = model.voters(texts.slice(i, j - i))
                keys, n = np.unique((v @ (1 << np.arange(len(NAMES))))[np.diff(t.first) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["mask", "n"])

    base = _base(docs, id_col, text_col)
    counts = base.select("text").where("text is not null").mapInArrow(votes, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).toPandas()
    total = int(counts["n"].sum())
    if not total:
        return model
    model.label = label_model(counts["mask"].to_numpy(np.int64), counts["n"].to_numpy(float))
    part = min(1.0, sample_rows / total)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(0)))
            for i, j in tk.slices(texts, 500_000, 1024):
                v, hits, t = model.voters(texts.slice(i, j - i))
                x = model.inputs(v, hits, t)[np.diff(t.first) > 0].astype(np.float16)
                y = posterior(model.label, (v @ (1 << np.arange(len(NAMES))))[np.diff(t.first) > 0])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y, pa.float64())], names=["x", "y"])

    rows = base.where("text is not null").where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < int(part * 1_000_000)).select("text").mapInArrow(examples, "x binary, y double").limit(2 * sample_rows).toPandas()
    if len(rows):
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)
        model.weights = _fit_linear(x, rows["y"].to_numpy())
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior, score, is_toxic for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(1)))
            for i, j in tk.slices(texts, 500_000, 1024):
                post, p = model.score(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(post), pa.array(p), pa.array(p >= model.threshold)], names=["doc_id", "posterior", "score", "is_toxic"])

    return _base(docs, id_col, text_col).mapInArrow(run, "doc_id long, posterior double, score double, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that the classifier doesn't call toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(at)))
            for i, j in tk.slices(texts, 500_000, 1024):
                _, p = model.score(texts.slice(i, j - i))
                yield batch.slice(i, j - i).filter(pa.array(p < model.threshold))

    return docs.mapInArrow(run, docs.schema)
