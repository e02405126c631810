"""Quality classifier by co-training.

Two views of a document are learnt apart: what its text is made of, and what its
metadata say (source, language, recorded length). Over rounds each classifier
labels the unlabelled documents it is surest of for the other one. Each view is
then calibrated on labelled documents neither has learnt from, and their log odds
are added. All documents are scored by one projection of built-in functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.binding import bind
from marketloom.llm.common import text_of, words_of
from marketloom.llm.rules import STOP_WORDS
from marketloom.llm.toxicity import _part, held_out

#: At most about so many labelled and so many other documents are learnt from.
LABELLED, UNLABELLED = 6000, 6000
ROUNDS = 5
SURE = 0.02  # share of the unlabelled documents that a view labels for the other in a round
BINS = 12  # of a measure, by quantiles of the sample
NAMES = 200  # sources or languages with a weight of their own
THRESHOLD = 0.5


def _text_view(text: Column) -> Column:
    """Shares of the whole text, each between 0 and 1 or a small number."""

    def shares(t: Column, w: Column) -> Column:
        chars, n = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(w), F.lit(1))
        left = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", ""))
        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS)))))
        lines = F.split(t, "\n")
        return F.struct(
            F.log1p(F.size(w)).alias("words"),
            (F.length(F.array_join(w, "")) / n).alias("word_chars"),
            (F.size(F.array_distinct(w)) / n).alias("distinct_words"),
            (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_lines"),
            (stops / n).alias("stop_words"),
            (left("#*$%&|<>") / n).alias("symbols"),
            (left("!?") / n).alias("shouts"),
            (left("A-ZÀ-ÖØ-Þ") / chars).alias("capitals"),
            (left("0-9") / chars).alias("digits"),
        )

    return bind(shares, t=text, w=words_of(text))


TEXT = ("words", "word_chars", "distinct_words", "distinct_lines", "stop_words", "symbols", "shouts", "capitals", "digits")


class View:
    """A logistic model over one-hot cells: bins of numbers, values of names, and "missing"."""

    def __init__(self, numbers: dict[str, np.ndarray], names: dict[str, list[str]]):
        self.edges = {
            k: np.unique(np.quantile(v[~np.isnan(v)], np.linspace(0, 1, BINS + 1)[1:-1])) if (~np.isnan(v)).any() else np.empty(0)
            for k, v in numbers.items()
        }
        self.names = names
        self.offset, width = {}, 0
        for k in [*self.edges, *names]:
            self.offset[k] = width
            width += (len(self.edges[k]) if k in self.edges else len(names[k])) + 2
        self.w, self.b = np.zeros(width), 0.0
        self.scale, self.shift = 1.0, 0.0

    def cells(self, numbers: dict[str, np.ndarray], names: dict[str, np.ndarray]) -> np.ndarray:
        cols = []
        for k, e in self.edges.items():
            bins = np.searchsorted(e, numbers[k], side="right")
            cols.append(self.offset[k] + np.where(np.isnan(numbers[k]), len(e) + 1, bins))
        for k, known in self.names.items():
            place = {v: i for i, v in enumerate(known)}
            cols.append(self.offset[k] + np.array([place.get(v, len(known)) for v in names[k]], int))
        return np.stack(cols, 1) if cols else np.empty((0, 0), int)

    def fit(self, cells: np.ndarray, y: np.ndarray, steps: int = 120) -> None:
        w, b = np.zeros_like(self.w), 0.0
        g2, gb2 = np.full_like(w, 1e-8), 1e-8
        for _ in range(steps):  # AdaGrad with a little shrinkage
            p = 1 / (1 + np.exp(-(w[cells].sum(1) + b)))
            d = (p - y) / max(1, len(y))
            g = np.bincount(cells.ravel(), weights=np.repeat(d, cells.shape[1]), minlength=len(w)) + 1e-4 * w
            g2 += g * g
            gb2 += d.sum() ** 2
            w -= 0.3 * g / np.sqrt(g2)
            b -= 0.3 * d.sum() / np.sqrt(gb2)
        self.w, self.b = w, b

    def margin(self, cells: np.ndarray) -> np.ndarray:
        return self.w[cells].sum(1) + self.b

    def calibrate(self, cells: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling: score = sigmoid(scale * margin + shift)."""
        z, a, c = self.margin(cells), 1.0, 0.0
        for _ in range(300):
            d = 1 / (1 + np.exp(-(a * z + c))) - y
            a -= 0.1 * (d * z).mean() / max(1.0, (z * z).mean())
            c -= 0.1 * d.mean()
        self.scale, self.shift = max(0.0, float(a)), float(c)

    def column(self, numbers: dict[str, Column], names: dict[str, Column]) -> Column:
        """The calibrated margin as an expression."""
        total = F.lit(float(self.b))
        for k, e in self.edges.items():
            w = self.w[self.offset[k] : self.offset[k] + len(e) + 2]
            value = F.when(numbers[k].isNull() | F.isnan(numbers[k]), F.lit(float(w[len(e) + 1])))
            for i, edge in enumerate(e):
                value = value.when(numbers[k] < float(edge), F.lit(float(w[i])))
            total = total + value.otherwise(F.lit(float(w[len(e)])))
        for k, known in self.names.items():
            w = self.w[self.offset[k] :]
            value = F.lit(float(w[len(known)]))
            if known:
                table = F.create_map(*[x for i, v in enumerate(known) for x in (F.lit(v), F.lit(float(w[i])))])
                value = F.coalesce(F.try_element_at(table, F.coalesce(names[k], F.lit(""))), value)
            total = total + value
        return total * self.scale + self.shift


def co_train(text: View, meta: View, x: tuple, y: np.ndarray, pool: tuple, rounds: int = ROUNDS) -> None:
    """Each round, each view labels the pool's documents it is surest of for the other."""
    views, given = (text, meta), ([], [])  # per view: (pool rows, label) from the other
    free = np.ones(len(pool[0]), bool)
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = [x[v]] + [pool[v][i] for i, _ in given[v]]
            labels = [y] + [np.full(len(i), label) for i, label in given[v]]
            views[v].fit(np.concatenate(rows), np.concatenate(labels))
        if turn == rounds or not free.any():
            return
        rate = y.mean()
        for v in (0, 1):
            z = np.where(free, views[v].margin(pool[v]), np.nan)
            left = np.flatnonzero(free)
            order = left[np.argsort(z[left], kind="stable")]
            for label, share, some in ((0.0, 1 - rate, order), (1.0, rate, order[::-1])):
                # As many of each label as the labelled rows have, and only clear ones.
                some = some[: int(len(pool[0]) * SURE * share)]
                clear = some[(z[some] > 0) == (label == 1)]
                clear = clear[free[clear]]
                given[1 - v].append((clear, label))
                free[clear] = False


def _views(docs: DataFrame, id_col: str, text_col: str, columns: tuple[str, str, str]) -> DataFrame:
    source, lang, chars = columns
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("i"),
        _text_view(text_of(text_col)).alias("t"),
        F.struct(F.log1p(F.greatest(F.col(chars), F.lit(0)).cast("double")).alias("n_chars")).alias("m"),
        F.struct(name(source).alias("source"), name(lang).alias("lang")).alias("n"),
    )


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, str, str] = ("source", "lang", "n_chars"),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, held_out, text_score, metadata_score, score, kept.

    Labels of held-out identifiers (crc32 modulo 3 is 1) are not learnt. Null
    metadata are values of their own, null text counts as empty. With labels of
    fewer than two kinds every score is the share of good labels (1 without any),
    so nothing is lost. Repeated rows score alike; an empty table gives no rows.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("i")).agg(F.min("quality").cast("double").alias("y"))
    chosen = _part(known, "i", LABELLED)
    pool = _part(docs.select(F.col(id_col).alias("i")).filter(~held_out("i")), "i", UNLABELLED)
    pool = pool.distinct().join(known, "i", "left_anti").withColumn("y", F.lit(None).cast("double"))
    # Both bounded by the sample sizes above; only numbers and names reach the driver, no text.
    rows = _sampled_views(docs, chosen.unionByName(pool), id_col, text_col, columns)
    y = np.array([np.nan if r.y is None else r.y for r in rows])
    numbers = {k: np.array([getattr(r.t, k) for r in rows], float) for k in TEXT}
    chars = {"n_chars": np.array([np.nan if r.m.n_chars is None else r.m.n_chars for r in rows], float)}
    names = {k: np.array([getattr(r.n, k) for r in rows], object) for k in ("source", "lang")}
    scored = _views(docs, id_col, text_col, columns)
    have = ~np.isnan(y)
    if len(np.unique(y[have])) < 2:
        flat = F.lit(float(y[have].mean()) if have.any() else 1.0)
        cols = {"text_score": flat, "metadata_score": flat, "score": flat}
    else:
        common = {k: [v for v, _ in _most(names[k])] for k in names}
        text, meta = View(numbers, {}), View(chars, common)
        cells = (text.cells(numbers, {}), meta.cells(chars, names))
        turn = np.cumsum(have) % 5 == 0  # a fifth of the labelled rows calibrates
        learn, check, free = have & ~turn, have & turn, ~have
        if len(np.unique(y[learn])) < 2:
            learn = check = have
        co_train(text, meta, tuple(c[learn] for c in cells), y[learn], tuple(c[free] for c in cells))
        for view, c in zip((text, meta), cells):
            view.calibrate(c[check], y[check])
        rate = float(np.clip(y[learn].mean(), 0.001, 0.999))
        base = float(np.log(rate / (1 - rate)))
        a = text.column({k: F.col("t")[k] for k in TEXT}, {})
        b = meta.column({"n_chars": F.col("m.n_chars")}, {k: F.col("n")[k] for k in names})
        odds = lambda z: 1 / (1 + F.exp(-z))
        # Log odds of both views, the common base rate counted once.
        cols = {"text_score": odds(a), "metadata_score": odds(b), "score": odds(a + b - base)}
    out = scored.select(F.col("i").alias("doc_id"), held_out("i").alias("held_out"), *[c.alias(k) for k, c in cols.items()])
    return out.withColumn("kept", F.col("score") >= threshold)


def _most(values: np.ndarray) -> list[tuple[str, int]]:
    found, counts = np.unique(values.astype(str), return_counts=True)
    order = np.argsort(-counts, kind="stable")[:NAMES]
    return [(str(found[i]), int(counts[i])) for i in order]


def _sampled_views(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, columns: tuple[str, str, str]) -> list:
    """The views of the sampled documents, by identifier, with their labels; no text."""
    wanted = ids.withColumnRenamed("i", "wanted")
    views = _views(docs, id_col, text_col, columns)
    found = views.join(F.broadcast(wanted), F.col("i") == F.col("wanted"))
    # One row of each identifier, so that the bound holds where identifiers repeat.
    one = found.groupBy("wanted", "y").agg(F.min(F.struct("t", "m", "n")).alias("v"))
    return one.orderBy(F.xxhash64("wanted"), "wanted").select("v.*", "y").collect()
