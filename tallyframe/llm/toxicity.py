"""Abusive, hateful or sexual passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Scores. A token's score is the log-odds that it is part of such a passage, by the longest word n-gram ending at it that was
seen often enough, against the overall odds or those of ``reference``, whichever are higher, less a constant drift. The odds
of an n-gram carry a Dirichlet prior centred on those of its shorter suffix (for single words, on the overall odds), so rare
n-grams say little.

Tokens. Every text is read once into 64-bit hashes of its words (``tokenised``, a written table); all rounds and the scan
work on the hashes of whole Arrow batches, an n-gram's hash being mixed from its words'. Two n-grams of 10^8 share a hash
with a chance of about 10^-3, and would then share a count.

Fitting. Votes on a document make a posterior (raters err at ``rater_error``). The first round counts n-grams by that
posterior; later rounds count as toxic only the maximal segments that score at least ``seed_score`` within documents
judged toxic, so the ordinary words around an insult become evidence against (a document judged toxic in which nothing is
found counts by the chance that a passage of ``passage`` tokens covers a token). Then documents without votes join in: a spread
round counts whole documents again, those with a segment of at least ``sure_score`` as toxic, so that wordings no vote covers
are learnt from the company they keep, and a last round returns to segments. Documents fall into ``folds`` folds and each
fold's segments are found with a model of the others, so a wrong vote doesn't confirm itself. Votes of at most ``max_fitted``
documents are used, by hash of their identifier; all other documents join in without votes, whatever their number. Counting
and scoring of n-grams are distributed. A model holds the n-grams whose odds differ from their suffix's by at least
``least_news`` (else the suffix says the same) and that were seen at least twice and in ``least_share`` of all tokens, so there
are at most 3 / ``least_share`` of them whatever the size of the data: that bounds what is collected and sent to every task.

Search. Every document, whole, is scanned once in linear time for all maximal scoring segments. The best segment of m tokens
of ordinary text follows an extreme-value law, P(S > s) = 1 - exp(-K m exp(-lambda s)). lambda is the maximum-likelihood rate
of segment scores below ``seed_score`` in documents voted clean (higher ones may be real passages with wrong votes, so the
likelihood is that of the truncated law), K the number of such segments per token. A segment is significant if the number
expected in the document's length is at most ``max_expected`` and its score at least the floor above which no more documents
voted clean lie (scored by the other folds' model) than wrong votes explain; with few votes that floor is high.

Defined results: null or empty texts score 0 and aren't flagged; votes that are null or not 0 or 1 are ignored, as are
votes on unknown documents; without any toxic votes nothing is flagged; repeated documents are scored each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.disguise import tokens
from tallyframe.session import discard, spread, written

ORDERS = 3
PRIOR_WEIGHT = (4.0, 3.0, 3.0)
LOW, HIGH = -4.0, 6.0
HASHES, WORDS = "__hashes", "__words"
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Settings:
    drift: float = 0.5
    rounds: int = 3
    seed_score: float = 4.0
    sure_score: float = 6.0
    passage: float = 12.0
    prior_segments: float = 5.0
    reference: float = 0.1
    rater_error: float = 0.1
    max_fitted: int = 20_000
    least_news: float = 0.1
    least_share: float = 1e-7
    max_expected: float = 1e-4
    folds: int = 5


@dataclass
class Lookup:
    """Scores by n-gram hash: sorted hashes, and where each value of their leading bits starts."""

    keys: np.ndarray
    scores: np.ndarray
    bits: int = 1
    starts: np.ndarray = field(default_factory=lambda: np.zeros(3, np.int64))
    longest: int = 0

    @staticmethod
    def of(keys: np.ndarray, scores: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        keys, scores = keys[order], scores[order].astype(np.float32)
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        starts = np.append(np.searchsorted(keys, edges), len(keys))
        return Lookup(keys, scores, bits, starts, int(np.diff(starts).max(initial=0)))

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The score of each hash, NaN where there is none."""
        out = np.full(len(h), np.nan)
        if not len(self.keys):
            return out
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[cell], self.starts[cell + 1]
        live = np.flatnonzero(at < end)
        at, end, h = at[live], end[live], h[live]
        while len(live):
            hit = self.keys[at] == h
            out[live[hit]] = self.scores[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end, h = live[more], at[more], end[more], h[more]
        return out


@dataclass
class Model:
    """n-gram scores and the calibration."""

    scores: Lookup
    drift: float
    rate: float = 1.0
    log_k: float = 0.0
    floor: float = 0.0

    def log10_expected(self, score: float, length: int) -> float:
        """log10 of the expected number of segments as good in ``length`` ordinary tokens."""
        return (self.log_k + math.log(max(1, length)) - self.rate * score) / math.log(10)


# --- tokens and n-grams ----------------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASH = _Hashes()


def word_hash(w: str) -> int:
    return _HASH[w]


def tokenised(docs: DataFrame, ident: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """ident, ``keep``, the tokens of ``text`` joined by blanks, and their hashes: a written table, read from then on."""
    names = [ident, *(keep or [])]
    source = spread(docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text")))
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ends, hashes = [], [0], []
            for t in b.column(b.num_columns - 1).to_pylist():
                toks = tokens(t)
                words.append(" ".join(toks))
                hashes += [_HASH[w] for w in toks]
                ends.append(len(hashes))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.string()), lists], [*names, WORDS, HASHES])

    return written(source.mapInArrow(run, f"{head}, {WORDS} string, {HASHES} array<bigint>"), "tokens")


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each document starts, and all tokens' hashes."""
    at = lists.offsets.to_numpy()
    return (at - at[0]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def grams(at: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: the positions where an n-gram ends within its document, and its hash there."""
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    out, full = [(np.arange(len(h)), h)], h
    for n in range(1, ORDERS):
        # The gram of n+1 words: its suffix of n words, led by the word n places earlier.
        longer = np.zeros(len(h), np.uint64)
        if len(h) > n:
            x = (full[n:] ^ (h[:-n] * MIX + np.uint64(n))) * MIX
            longer[n:] = x ^ (x >> np.uint64(29))
        where = np.flatnonzero(place >= n)
        out.append((where, longer[where]))
        full = longer
    return out


def gram_hash(text: str) -> int:
    """The hash of an n-gram given as words and blanks."""
    h = np.array([word_hash(w) for w in text.split()], np.uint64)
    return int(grams(np.array([0, len(h)]), h)[len(h) - 1][1][-1])


def token_scores(at: np.ndarray, h: np.ndarray, scores: Lookup, drift: float) -> np.ndarray:
    """Per token the score of the longest known n-gram ending there, less the drift."""
    out = np.zeros(len(h))
    for where, g in grams(at, h):
        s = scores.find(g)
        known = ~np.isnan(s)
        out[where[known]] = s[known]
    return np.clip(out, LOW, HIGH) - drift


def segments(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal scoring segments of every document: document, score, start and end (among all tokens), in one pass.

    A segment is maximal if no piece of it scores higher and no longer one around it is free of that. Neighbouring positive
    tokens are one candidate, kept with the running totals before and after it; a new one joins earlier ones while that
    raises its total.
    """
    total = np.append(0.0, np.cumsum(values))
    plus = np.flatnonzero(values > 0)
    doc = np.searchsorted(at, plus, "right") - 1
    new = np.append(True, (np.diff(plus) > 1) | (np.diff(doc) > 0)) if len(plus) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    start, end = plus[heads], plus[np.append(heads[1:], len(plus)) - 1] + 1 if len(plus) else plus
    of, before, after = doc[heads].tolist(), total[start].tolist(), total[end].tolist()
    out: list[tuple[int, float, float, int, int]] = []
    found: list[tuple[float, float, int, int]] = []
    current = -1
    for d, a, b, x, y in zip(of, before, after, start.tolist(), end.tolist()):
        if d != current:
            out += [(current, *f) for f in found]
            found, current = [], d
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= a:
                j -= 1
            if j < 0 or found[j][1] >= b:
                found.append((a, b, x, y))
                break
            a, x = found[j][0], found[j][2]
            del found[j:]
    out += [(current, *f) for f in found]
    cols = list(zip(*out)) if out else [()] * 5
    return np.array(cols[0], np.int64), np.array(cols[2], float) - np.array(cols[1], float), np.array(cols[3], np.int64), np.array(cols[4], np.int64)


def maximal_segments(values: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of one document as (score, start, end)."""
    _, score, start, end = segments(np.array([0, len(values)]), np.array(values, float))
    return list(zip(score.tolist(), start.tolist(), end.tolist()))


# --- fitting ---------------------------------------------------------------------------------------------------------


def vote_posterior(prior: float, error: float):
    """P(toxic) of a document from ``ones`` of ``votes``."""
    yes = F.lit(math.log((1 - error) / error))
    logit = F.lit(math.log(prior / (1 - prior))) + yes * (2 * F.col("ones") - F.col("votes"))
    return 1 / (1 + F.exp(-logit))


def fitting_documents(docs: DataFrame, labels: DataFrame, ident: str, s: Settings) -> DataFrame:
    """(fold, hashes, y) of tokenised documents, y being null where there is no vote or, beyond about ``max_fitted``, none is used."""
    votes = labels.where(F.col("label").isin(0, 1) & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("__id")).agg(
        F.sum("label").alias("ones"), F.count(F.lit(1)).alias("votes"),
    )
    got = votes.agg(F.count(F.lit(1)).alias("docs"), F.sum("ones").alias("ones"), F.sum("votes").alias("votes")).first()
    share = (got.ones or 0) / max(1, got.votes or 0)
    prior = min(0.5, max(0.005, (share - s.rater_error) / (1 - 2 * s.rater_error)))
    known = min(1.0, s.max_fitted / max(1, got.docs))
    million = F.lit(1_000_000)
    picked = votes.where(F.pmod(F.xxhash64("__id", F.lit(1)), million) < int(known * 1_000_000))
    picked = written(picked.select("__id", vote_posterior(prior, s.rater_error).alias("y")), "votes")
    fold = F.pmod(F.xxhash64(F.col(f"`{ident}`"), F.lit(2)), F.lit(s.folds)).cast("int")
    # Sampled before the join: about max_fitted rows of 16 bytes at any size of the data.
    return docs.join(F.broadcast(picked), F.col(f"`{ident}`") == F.col("__id"), "left").select(fold.alias("fold"), HASHES, "y")


VOTES, SEGMENTS, SPREAD, ALL_SEGMENTS = range(4)
BEST = 1_000_000


def by_fold(fold: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Documents of each fold that occurs."""
    for f in np.unique(fold):
        yield int(f), np.flatnonzero(fold == f)


def pick(at: np.ndarray, h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some documents."""
    size = at[docs + 1] - at[docs]
    new = np.append(0, np.cumsum(size))
    return new, h[np.repeat(at[docs] - new[:-1], size) + np.arange(new[-1])]


def token_weights(at: np.ndarray, h: np.ndarray, y: np.ndarray, step: int, scores: Lookup | None, s: Settings) -> np.ndarray:
    """How toxic each token counts in a round; ``y`` is NaN for documents without a vote."""
    size, unknown = np.diff(at), np.isnan(y)
    if step == VOTES:
        return np.repeat(y, size)
    doc, score, start, end = segments(at, token_scores(at, h, scores, s.drift))
    if step == SPREAD:
        sure = np.zeros(len(y), bool)
        sure[doc[score >= s.sure_score]] = True
        return np.repeat(np.where(unknown, np.where(sure, 0.9, 0.02), y), size)
    judged = np.where(unknown, 0.7, np.maximum(y, 0.5))
    hit = (score >= s.seed_score) & (unknown | (y > 0.15))[doc]
    change = np.zeros(len(h) + 1)
    np.add.at(change, start[hit], judged[doc[hit]])
    np.add.at(change, end[hit], -judged[doc[hit]])
    out = np.round(np.cumsum(change[:-1]), 9)
    # Judged toxic, but nothing in it is known to be: any passage of the usual length may be the one.
    unmet = ~unknown & (y > 0.5)
    unmet[doc[hit]] = False
    share = np.where(unmet, y * np.minimum(1.0, s.passage / np.maximum(1, size)), 0.0)
    return out + np.repeat(share, size)


def count_grams(fitted: DataFrame, step: int, models: dict[int, Lookup] | None, s: Settings) -> DataFrame:
    """(fold, size, gram, suffix, toxic, seen): weighted counts per fold and batch; a size of 0 carries the totals."""
    shared = fitted.sparkSession.sparkContext.broadcast(models)
    names = ["fold", "size", "gram", "suffix", "toxic", "seen"]

    def one(fold: int, at: np.ndarray, h: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        weight = token_weights(at, h, y, step, shared.value[fold] if shared.value else None, s)
        out = [tuple(np.array([x]) for x in (fold, 0, np.uint64(0), np.uint64(0), weight.sum(), float(len(weight))))]
        shorter = np.zeros(len(h), np.uint64)
        for n, (where, g) in enumerate(grams(at, h)):
            key, first, inv = np.unique(g, return_index=True, return_inverse=True)
            seen = np.bincount(inv, minlength=len(key)).astype(float)
            toxic = np.bincount(inv, weight[where], len(key))
            same = np.full(len(key), fold), np.full(len(key), n + 1)
            out.append((*same, key, shorter[where[first]], toxic, seen))
            shorter[where] = g
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fold, y = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            at, h = flat(b.column(1))
            rows: list[tuple[np.ndarray, ...]] = []
            for f, docs in by_fold(fold, at):
                rows += one(f, *pick(at, h, docs), y[docs])
            c = [np.concatenate(x) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2].view(np.int64)), pa.array(c[3].view(np.int64)), pa.array(c[4]), pa.array(c[5])], names,
            )

    if step in (VOTES, SEGMENTS):
        fitted = fitted.where("y is not null")
    return fitted.mapInArrow(run, "fold int, size int, gram bigint, suffix bigint, toxic double, seen double")


def models_of(counted: DataFrame, s: Settings) -> tuple[dict[int, Lookup], Lookup]:
    """For each fold the model of the others, and that of all: log-odds of n-grams against the overall or the reference odds."""
    of = lambda f, c: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0.0))
    every = range(s.folds + 1)
    wide = counted.groupBy("size", "gram").agg(
        F.first("suffix").alias("suffix"), F.sum("toxic").alias(f"t{s.folds}"), F.sum("seen").alias(f"n{s.folds}"),
        *[of(f, "toxic").alias(f"t{f}") for f in range(s.folds)], *[of(f, "seen").alias(f"n{f}") for f in range(s.folds)],
    ).where(F.col(f"n{s.folds}") >= 2)
    wide = written(wide.withColumns({
        **{f"t{f}": F.greatest(F.col(f"t{s.folds}") - F.col(f"t{f}"), F.lit(0.0)) for f in range(s.folds)},
        **{f"n{f}": F.col(f"n{s.folds}") - F.col(f"n{f}") for f in range(s.folds)},
    }), "grams")
    total = wide.where("size = 0").first()
    models = {k: Lookup.of(np.zeros(0, np.uint64), np.zeros(0)) for k in every}
    base = {k: total[f"t{k}"] / total[f"n{k}"] for k in every if total and 0 < total[f"t{k}"] < total[f"n{k}"]}
    if base:
        support = max(2.0, s.least_share * total[f"n{s.folds}"])
        # Single words, then pairs centred on words, then triples centred on pairs.
        known, parts = None, []
        for n in range(ORDERS):
            rows = wide.where((F.col("size") == n + 1) & (F.col(f"n{s.folds}") >= support))
            if known is not None:
                rows = rows.join(known.select(F.col("gram").alias("suffix"), *[F.col(f"p{k}").alias(f"c{k}") for k in base]), "suffix", "left")
            centre = {k: F.lit(base[k]) if known is None else F.coalesce(F.col(f"c{k}"), F.lit(base[k])) for k in base}
            p = {k: (F.col(f"t{k}") + PRIOR_WEIGHT[n] * centre[k]) / (F.col(f"n{k}") + PRIOR_WEIGHT[n]) for k in base}
            p = [F.when(F.col(f"n{k}") >= 2, p[k]).alias(f"p{k}") for k in base]
            known = rows.select("gram", *p, *[centre[k].alias(f"c{k}") for k in base])
            parts.append(known)
        odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
        hit = {k: F.when(F.abs(odds(f"p{k}") - odds(f"c{k}")) >= s.least_news, odds(f"p{k}")).cast("float") for k in base}
        rows = [x.select("gram", *[hit[k].alias(f"s{k}") for k in base]).where(F.coalesce(*[F.col(f"s{k}") for k in base]).isNotNull()) for x in parts]
        got = rows[0].unionByName(rows[1]).unionByName(rows[2]).toArrow()
        keys = got.column("gram").to_numpy().view(np.uint64)
        for k in base:
            high = max(base[k], s.reference)
            column = got.column(f"s{k}").to_numpy()
            some = ~np.isnan(column)
            models[k] = Lookup.of(keys[some], column[some] - math.log(high / (1 - high)))
    discard(wide)
    return models, models.pop(s.folds)


def truncated_rate(scores: np.ndarray, counts: np.ndarray, top: float) -> float:
    """Maximum-likelihood rate of an exponential law cut off at ``top``."""
    mean = float((scores * counts).sum() / counts.sum())
    lo, hi = 1e-3, 100.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if 1 / mid - top / math.expm1(min(mid * top, 700)) > mean:
            lo = mid
        else:
            hi = mid
    return lo


def calibrate(labelled: DataFrame, models: dict[int, Lookup], model: Model, s: Settings) -> Model:
    """lambda and K from documents voted clean, scored by the other folds' model; only a histogram reaches the driver."""
    shared = labelled.sparkSession.sparkContext.broadcast(models)
    top = s.seed_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            if not b.num_rows:
                continue
            at, h = flat(b.column(1))
            seen[-1] += len(h)
            for f, docs in by_fold(b.column(0).to_numpy(), at):
                own, x = pick(at, h, docs)
                doc, score, _, _ = segments(own, token_scores(own, x, shared.value[f], s.drift))
                best = np.zeros(len(docs))
                np.maximum.at(best, doc, score)
                for bins in ((score[score < top] * 20).astype(np.int64), BEST + (best * 20).astype(np.int64)):
                    for k, n in zip(*np.unique(bins, return_counts=True)):
                        seen[int(k)] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["bin", "n"])

    clean = labelled.where("y < 0.15").select("fold", HASHES, "y")
    got = {r.bin: r.n for r in clean.mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    length = max(1, got.pop(-1, 0))
    best = sorted(((b - BEST, n) for b, n in got.items() if b >= BEST), reverse=True)
    got = {b: n for b, n in got.items() if b < BEST}
    wrong = clean.agg(F.sum("y")).first()[0] or 0.0
    above = 0
    for b, n in best:
        above += n
        if above > 1.5 * wrong + 1:
            model.floor = (b + 1) / 20
            break
    n = sum(got.values())
    # Few segments in ordinary text leave the rate near its prior, that of ``prior_segments`` segments of mean 1.
    bins = np.append((np.array(list(got), float) + 0.5) / 20, min(1.0, top / 2))
    model.rate = truncated_rate(bins, np.append(np.array(list(got.values()), float), s.prior_segments), top)
    model.log_k = math.log((n + 1) / length / -math.expm1(-model.rate * top))
    return model


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Model:
    """``docs``: documents, or the table ``tokenised`` made of them."""
    s = settings or Settings()
    if HASHES not in docs.columns:
        docs = tokenised(docs, ident, text)
    fitted = fitting_documents(docs, labels, ident, s)
    models: dict[int, Lookup] | None = None
    total = Lookup.of(np.zeros(0, np.uint64), np.zeros(0))
    for step in (VOTES, *[SEGMENTS] * (s.rounds - 1), SPREAD, ALL_SEGMENTS):
        models, total = models_of(count_grams(fitted, step, models, s), s)
    return calibrate(fitted.where("y is not null"), models, Model(total, s.drift), s)


# --- the scan --------------------------------------------------------------------------------------------------------


def score_documents(
    docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """ident, ``keep`` columns, score (-log10 of the chance of the best segment), segment_score, passages, worst, flagged.

    ``passages`` counts significant segments and ``worst`` shows the tokens of the best one. ``docs``: documents, or the table
    ``tokenised`` made of them.
    """
    s = settings or Settings()
    names = [ident, *(keep or [])]
    clash = {"score", "segment_score", "passages", "worst", "flagged"} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"rename columns {sorted(clash)} first")
    if HASHES not in docs.columns:
        docs = tokenised(docs, ident, text, keep)
    source = docs.select(*[F.col(f"`{c}`") for c in names], WORDS, HASHES)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = math.log10(s.max_expected)
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            at, h = flat(b.column(b.num_columns - 1))
            doc, score, start, end = segments(at, token_scores(at, h, m.scores, m.drift)) if len(m.scores) else [np.zeros(0, np.int64)] * 4
            size = np.diff(at)
            expected = (m.log_k + np.log(np.maximum(1, size))[doc] - m.rate * score) / math.log(10)
            best = np.full(b.num_rows, -1, np.int64)
            order = np.lexsort((end, start, score))  # of a document's equal scores the last one stays
            best[doc[order]] = order
            some = best >= 0
            e = np.where(some, expected[best] if len(expected) else 0.0, 300.0)
            near = -np.expm1(-(10.0 ** np.clip(e, -12.0, 2.0)))
            chance = np.where(e < -12, e, np.log10(np.maximum(1e-300, near)))
            passages = np.bincount(doc[(score >= m.floor) & (expected <= limit)], minlength=b.num_rows)
            worst = [" ".join(w.split(" ")[start[k] - a : end[k] - a]) if k >= 0 else "" for w, k, a in zip(b.column(b.num_columns - 2).to_pylist(), best.tolist(), at.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:-2], pa.array(np.maximum(0.0, -chance)), pa.array(np.where(some, score[best] if len(score) else 0.0, 0.0)),
                    pa.array(passages, pa.int32()), pa.array(worst, pa.string()), pa.array(passages > 0),
                ],
                [*names, "score", "segment_score", "passages", "worst", "flagged"],
            )

    return source.mapInArrow(run, f"{head}, score double, segment_score double, passages int, worst string, flagged boolean")


def source_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, flagged ones, their rate and the mean score per source (a null source is one)."""
    hit = F.when(F.col("flagged"), 1).otherwise(0)
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(hit).alias("flagged_docs"), F.avg(hit.cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
