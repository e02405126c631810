"""Toxicity by non-negative positive-unlabelled learning.

A numpy classifier is trained from confirmed toxic documents and unlabelled text.
Its risk is corrected by the class prior: the unlabelled loss minus the prior's
share of the positives' loss stands for the negatives, and where that estimate
falls below zero the step is taken back. The text of a document is all a score
sees: hashed words and word beginnings, each counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import text_of

BITS = 18  # the hashed feature space
BEGINNINGS = (4, 5, 6)  # letters of a word's beginning that are features of their own
#: At most so many labelled positives and so many other documents are learnt from.
POSITIVES, UNLABELLED = 4000, 8000
#: Features of a training document that are learnt from at most (by hash, so of the whole text).
SEEN = 6000
#: Features the classifier may weigh: those that most tell positives from the rest.
WEIGHED = 1024
PRIOR = 0.1  # share of toxic documents where no labels say otherwise
THRESHOLD = 0.7
CACHED = 300_000
#: Of two training texts this similar one is learnt from; told by so many min-hashes, to about 0.025.
NEAR, MINIMA = 0.8, 256
STRIP = b".,;:!?*%&#$|()[]\"'"


def _words(text: bytes | str | None) -> set[bytes]:
    if not isinstance(text, bytes):
        text = b"" if text is None else str(text).encode()
    return set(text.lower().split())


class Features:
    """The distinct hashed features of a whole text, sorted."""

    def __init__(self):
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        plain = word.strip(STRIP)
        if not plain:
            return ()
        letters = plain.decode("utf-8", "replace")
        parts = [b"w" + plain] + [b"p" + letters[:n].encode() for n in BEGINNINGS if len(letters) > n]
        return tuple(xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts)

    def of(self, text: bytes | None) -> np.ndarray:
        words = _words(text)
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache, found = self.cache, set()
        for w in words:
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.of_word(w)
            found.update(got)
        return np.fromiter(found, np.int32, len(found))


#: One random number for each feature, and the factors and offsets that make many hashes of it.
_RANDOM = np.random.default_rng(11)
_MIXED = _RANDOM.integers(1 << 32, size=1 << BITS, dtype=np.uint32)
_FACTORS = _RANDOM.integers(1 << 32, size=(MINIMA, 1), dtype=np.uint32) | np.uint32(1)
_OFFSETS = _RANDOM.integers(1 << 32, size=(MINIMA, 1), dtype=np.uint32)


def _minima(features: np.ndarray) -> np.ndarray:
    """The min-hashes of a set of features; two sets share about as many of them as their similarity."""
    least = np.full(MINIMA, (1 << 32) - 1, np.uint32)
    for at in range(0, len(features), 1024):
        mixed = _MIXED[features[at : at + 1024]][None, :] * _FACTORS + _OFFSETS
        np.minimum(least, mixed.min(1), out=least)
    return least


def _sampled(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """A bounded sample of rows (toxic, text) as features and their min-hashes; the text never reaches the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            sets = [np.sort(make.of(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            minima = pa.array([_minima(s).astype("<u4").tobytes() for s in sets], pa.binary())
            # By a fixed hash, so that what is kept depends on the text alone.
            sets = [s if len(s) <= SEEN else np.sort(s[np.argsort(_MIXED[s], kind="stable")[:SEEN]]) for s in sets]
            cells = pa.array([s.astype("<i4").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, minima], names=["toxic", "f", "m"])

    got = rows.mapInArrow(features, "toxic int, f binary, m binary").collect()
    # In an order of their own, so that the same rows stand for their copies on each run.
    got.sort(key=lambda r: (len(r.f), r.m, r.f))
    return [(r.toxic, np.frombuffer(r.f, "<i4"), np.frombuffer(r.m, "<u4")) for r in got]


class Bag:
    """Rows of binary features in compressed form."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width = width
        self.at = np.cumsum([0] + [len(r) for r in rows])
        self.f = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.at))
        self.n = len(rows)

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.f], minlength=self.n) + b

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.f, weights=per_row[self.row], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    width: int,
    prior: float,
    sparse: float,
    steps: int = 200,
    rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam.

    Risk: prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]), and ``sparse``
    times the absolute weights.
    """
    p, u = Bag(positive, width), Bag(unlabelled, width)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = p.margins(w, b), u.margins(w, b)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = su / max(1, u.n), prior * sp / max(1, p.n)  # of the two parts of the negatives' risk
        if negative >= 0:
            dp, du = -prior * (1 - sp) / max(1, p.n) - gp, gu
        else:  # take the negatives' step back
            dp, du = gp, -gu
        g = p.gradient(dp) + u.gradient(du) + sparse * np.sign(w)
        gb = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def _telling(positive: list[np.ndarray], rest: list[np.ndarray]) -> np.ndarray:
    """The features that lean most to the positives, by the z-score of their two shares."""
    p = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    u = np.bincount(np.concatenate(rest), minlength=1 << BITS) if rest else np.zeros(1 << BITS)
    a, b = p / max(1, len(positive)), u / max(1, len(rest))
    share = (p + u + 1) / (len(positive) + len(rest) + 2)
    z = (a - b) / np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / max(1, len(rest))))
    order = np.argsort(-z, kind="stable")[:WEIGHED]
    return order[(p[order] >= 3) & (z[order] > 2)]


def _unlike(minima: list[np.ndarray]) -> list[int]:
    """Positions of one of each group of near copies and of every other row: copies would make chance words telling.

    A row goes only if it is as similar as ``NEAR`` to one that stays.
    """
    stay = np.empty((len(minima), MINIMA), np.uint32)
    kept: list[int] = []
    for i, row in enumerate(minima):
        before = stay[: len(kept)]
        # A few of the hashes rule out nearly all pairs.
        close = before[np.count_nonzero(before[:, :32] == row[:32], axis=1) >= 16 * NEAR]
        if not (np.count_nonzero(close == row, axis=1) >= NEAR * MINIMA).any():
            stay[len(kept)] = row
            kept.append(i)
    return kept


def _shift(z: np.ndarray, prior: float) -> float:
    """What to add to the margins so that the unlabelled texts' mean score is the prior."""
    low, high = -10.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _sigmoid(z + mid).mean() < prior else (low, mid)
    return low


def _part(df: DataFrame, column: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``column``; all if there are fewer."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(column, F.lit(3)), F.lit(n)) < most)


def held_out(column: str) -> Column:
    """Rows whose labels are never learnt: crc32 of the identifier as text leaves 1 modulo 3."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, float], float]:
    """Weight by feature, and the bias. Without positives nothing is toxic."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("i")).agg(F.max("toxic").alias("toxic")).filter("i IS NOT NULL")
    rates = known.agg(F.avg("toxic")).first()[0]
    prior = min(0.5, max(0.001, rates or PRIOR))
    confirmed = _part(known.filter("toxic = 1"), "i", POSITIVES).select("i", "toxic")
    text = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("text")).filter(~held_out("i"))
    # Both tables are bounded by the sample sizes above.
    positives = text.join(F.broadcast(confirmed), "i").select("i", "toxic", "text")
    # Unlabelled means any text, the toxic share of all documents among it.
    rest = _part(docs.select(F.col(id_col).alias("i")).filter(~held_out("i")), "i", UNLABELLED)
    unlabelled = text.join(F.broadcast(rest.distinct()), "i").select("i", F.lit(0).alias("toxic"), "text")
    # One row of each identifier, so that the bound holds where identifiers repeat.
    both = positives.unionByName(unlabelled).groupBy("i", "toxic").agg(F.min("text").alias("text"))
    got = _sampled(both.select("toxic", "text"))
    confirmed, others = [r for r in got if r[0] == 1], [r for r in got if r[0] != 1]
    p, u = ([rows[i][1] for i in _unlike([r[2] for r in rows])] for rows in (confirmed, others))
    if not p:
        return {}, float(np.log(prior / (1 - prior)))
    chosen = np.sort(_telling(p, u))
    cut = lambda rows: [np.searchsorted(chosen, r[np.isin(r, chosen)]) for r in rows]
    # A sparse fit picks the features; a second fit of those alone sets their weights.
    first, _ = fit_nnpu(cut(p), cut(u), len(chosen), prior, sparse=0.012 / len(p) ** 0.5)
    chosen = chosen[np.abs(first) > 0.05]
    w, b = fit_nnpu(cut(p), cut(u), len(chosen), prior, sparse=2e-6)
    # The prior is a share of all texts, copies among them.
    every = Bag(cut([r[1] for r in others]), len(chosen)).margins(w, b)
    return {int(f): float(x) for f, x in zip(chosen, w)}, b + _shift(every, prior)


def _scorer(weights: dict[int, float], bias: float, field: int | None):
    """Rows with their scores; the text is the second column, or a field of the first one."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Features(), {}
        for batch in batches:
            out = np.empty(batch.num_rows)
            texts = batch.column(1) if field is None else batch.column(0).field(field)
            for i, text in enumerate(texts):
                text = text.as_py()
                if len(known) > CACHED:
                    known.clear()
                found: set[int] = set()
                for word in _words(text):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = tuple(f for f in make.of_word(word) if f in weights)
                    if got:
                        found.update(got)
                out[i] = bias + sum(weights[f] for f in sorted(found))
            scores = pa.array(_sigmoid(out), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["row", "score"])

    return score


def _scored(docs: DataFrame, model, row: Column, *text: Column, field: int | None = None) -> DataFrame:
    one = docs.select(row.alias("row"), *text)
    schema = T.StructType([one.schema["row"], T.StructField("score", T.DoubleType())])
    return one.mapInArrow(_scorer(*model, field), schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= threshold).

    Only the text enters a score. Null and empty texts have no features and score
    what the bias alone says. Labels of held-out identifiers, null labels and
    labels of unknown documents are not learnt; a document labelled twice counts
    as toxic if one says so. An empty table gives no rows.
    """
    done = _scored(docs, train(docs, labels, id_col, text_col), F.col(id_col), text_of(text_col).cast("binary"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return done.select(F.col("row").alias("doc_id"), held_out("row").alias("held_out"), "score", predicted)


def keep_civil(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The input rows that score below the threshold, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    # The text travels once, inside its row.
    field = [c.lower() for c in docs.columns].index(text_col.lower())
    done = _scored(docs, model, F.struct("*"), field=field)
    return done.filter(F.col("score") < threshold).select("row.*")
