"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words of smallest period q (words q apart are
equal), at least ``least`` words and four periods long, that no neighbour
extends. Periods below ``SMALL`` are found by comparing the words with
themselves moved by the period. For every scale t = 8, 16, 32, ... a
synchronising set of the text is chosen: of the hashes of the t words from each
position on, those that are the least among the t positions after or before
them. Whether a position is chosen depends on the 2t words from it on only, so
inside a run of period q the choice repeats every q words; and among any t
neighbouring positions one is chosen, unless their words have a period of t/4 or
less. Positions whose words have such a short period take no part: they lie in
runs found before, and would be chosen too often.

A run of period q in [t, 2t) therefore holds two chosen positions q apart with
equal 2t words, and none between with the same, so neighbours among the chosen
positions of equal context propose every period. A proposal is compared word by
word in both directions, so no run is reported wrongly; one could be missed only
where two of a text's n contexts share a 64-bit hash by chance (n^2 / 2^65).

Texts are taken together: the arrays of all scales cover many texts at once, and
drop the texts too short for a scale, so a text of n words costs n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.binding import bind
from marketloom.llm.common import text_of, words_of
from marketloom.llm.shingles import U64, mix

EXPONENT = 4
LEAST = 6
SMALL = 8  # smallest scale; shorter periods are compared directly
TOGETHER = 1 << 17  # words taken together (a longer text is taken alone)
NEVER = np.iinfo(U64).max
STEP = U64(0x9E3779B97F4A7C15)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
NO_RUNS = np.empty((0, 3), np.int64)


def _direct(ids: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) of periods below ``SMALL``."""
    found: list[np.ndarray] = []
    for p in range(1, SMALL):
        if len(ids) <= p:
            break
        same = np.zeros(len(ids) - p + 2, np.int8)
        same[1:-1] = (ids[p:] == ids[:-p]) & (text[p:] == text[:-p])
        turns = np.flatnonzero(np.diff(same))
        start, end = turns[::2], turns[1::2] + p
        long = end - start >= max(least, EXPONENT * p)
        found.append(np.stack([start[long], end[long], np.full(long.sum(), p)], 1))
    if not found:
        return NO_RUNS
    runs = np.concatenate(found)
    # a stretch of period 2 is one of 4 and 6 as well: the smallest stays
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def _least_ahead(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row, from two passes over blocks of that size."""
    n = len(values)
    blocks = -(-n // size)
    padded = np.full(blocks * size, NEVER, U64)
    padded[:n] = values
    table = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(table, 1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1 : n])


def synchronising(hashes: np.ndarray, short: np.ndarray, scale: int) -> np.ndarray:
    """Positions of the synchronising set; ``short`` marks those of short period."""
    if len(hashes) <= scale:
        return np.empty(0, np.int64)
    marks = np.where(short, NEVER, hashes)
    least = _least_ahead(marks, scale + 1)
    here, there = marks[: len(least)], marks[scale : scale + len(least)]
    return np.flatnonzero((least != NEVER) & ((least == here) | (least == there)))


def _same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of ``a`` and ``b`` (of one length) agree; reads twice as many at most."""
    at, step = 0, 32
    while at < len(a):
        differs = a[at : at + step] != b[at : at + step]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = at + step, 2 * step
    return len(a)


@dataclass
class _Texts:
    """Texts laid one after the other: word numbers, and where each text begins and ends."""

    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _proposed(t: _Texts, where: np.ndarray, gaps: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs among proposals: position and distance of equal contexts."""
    known: dict[tuple[int, int], int] = {}  # (text, period) -> end of the last stretch looked at
    found = []
    texts = np.searchsorted(t.first, where, "right") - 1
    for i, q, k in zip(where.tolist(), gaps.tolist(), texts.tolist()):
        if known.get((k, q), -1) >= i + q:
            continue
        a, b = int(t.first[k]), int(t.last[k])
        ahead = _same_ahead(t.ids[i : b - q], t.ids[i + q : b])
        back = _same_ahead(t.ids[a:i][::-1], t.ids[a + q : i + q][::-1])
        start, end = i - back, i + q + ahead
        known[k, q] = end
        if end - start >= max(least, EXPONENT * q):
            found.append((start, end, q))
    return found


def _mark(size: int, runs: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose ``scale`` words lie in a run of period ``scale / EXPONENT`` or less."""
    some = runs[(runs[:, 2] * EXPONENT <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    if not len(some):
        return np.zeros(size, bool)
    turns = np.zeros(size + 1, np.int64)
    np.add.at(turns, some[:, 0], 1)
    np.add.at(turns, some[:, 1] - scale + 1, -1)
    return np.cumsum(turns[:-1]) > 0


def runs_of(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs (start, end, period) of texts laid one after the other, by start and period.

    ``ids`` are word numbers, equal for equal words; positions count over all texts.
    """
    n = len(ids)
    if not n:
        return NO_RUNS
    last = np.cumsum(lengths)
    first = last - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    runs = _direct(ids, text, least)
    hashes = mix(ids.astype(U64) + STEP)
    scale, place = 1, np.arange(n)  # where each word still looked at stands in all texts
    t = _Texts(ids, first, last)
    while True:
        # from the hashes of ``scale`` words to those of twice as many
        moved = np.empty_like(hashes)
        moved[: max(0, len(hashes) - scale)] = hashes[scale:]
        moved[max(0, len(hashes) - scale) :] = 0
        wider = mix(hashes * STEP + mix(moved + U64(scale)))
        if scale >= SMALL:
            end = np.repeat(last[lengths > 0], lengths[lengths > 0])
            blocked = _mark(n, runs, scale)[place] if len(runs) else np.zeros(len(place), bool)
            chosen = synchronising(hashes, blocked, scale)
            chosen = chosen[place[chosen] + 2 * scale <= end[chosen]]
            context = wider[chosen]
            order = np.argsort(context, kind="stable")
            here = place[chosen[order]]
            gaps, same = np.diff(here), np.diff(context[order].view(np.int64)) == 0
            good = same & (gaps >= scale) & (gaps < 2 * scale)
            where, gaps = here[:-1][good], gaps[good]
            by = np.argsort(where, kind="stable")
            found = _proposed(t, where[by], gaps[by], least)
            if found:
                runs = np.concatenate([runs, np.array(found, np.int64)])
        scale *= 2
        # texts too short for four periods of the next scale go
        stay = lengths >= EXPONENT * scale
        if not stay.any():
            break
        if scale >= SMALL and not stay.all():
            keep = np.repeat(stay, lengths)
            place, wider = place[keep], wider[keep]
            lengths, last = lengths[stay], last[stay]
        hashes = wider
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = [number(w, len(known)) for words in texts for w in words]
    return np.array(ids, np.int64), np.array([len(w) for w in texts], np.int64)


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without all but the first period of each run."""
    if not len(runs):
        return b" ".join(words)
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 1], -1)
    keep = np.cumsum(turns[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _some(cells: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of each text, in groups of a bounded number of words."""
    at, group, size = 0, [], 0
    for i, cell in enumerate(cells):
        group.append((cell.as_py() or b"").split())
        size += len(group[-1])
        if size >= TOGETHER:
            yield at, group
            at, group, size = i + 1, [], 0
    if group:
        yield at, group


def _find(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _some(batch.column("text").cast(pa.large_binary())):
                ids, lengths = _numbered(texts)
                runs = runs_of(ids, lengths, least)
                first = np.cumsum(lengths) - lengths
                of = np.searchsorted(first, runs[:, 0], "right") - 1 if len(runs) else np.empty(0, np.int64)
                cuts = np.searchsorted(of, np.arange(len(texts) + 1))
                start, length, period = runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2]
                items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], names=RUN.names)
                kept = []
                for i, words in enumerate(texts):
                    own = runs[cuts[i] : cuts[i + 1]].copy()
                    own[:, :2] -= first[i]
                    kept.append(_kept(words, own))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(at, len(texts)) for c in batch.schema.names if c != "text"],
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=[*[c for c in batch.schema.names if c != "text"], "n_words", "runs", "collapsed"],
                )

    return find


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period) and the collapsed text.

    Runs stand by start, then period. ``collapsed`` holds the words that remain
    after dropping from every run all words after its first period, joined by one
    space. A null or empty text has no words, no runs and an empty collapsed text.
    Rows, identifiers (null or repeated) and their number stay as they come; an
    empty table gives no rows; other columns are ignored. Each text is one task's
    work, with memory in proportion to its words; nothing is shuffled.
    """
    one = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType(
        [
            one.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return one.mapInArrow(_find(least), schema)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the texts end in a repetition laid down by the identifier.

    With h = crc32(doc_id as text) and g = h div 10, a text of n > 0 words and
    h % 10 = 0 has each word i >= a = g % n replaced by word a + (i - a) % p, for
    p = 1 + (n - a) div (3 + g % 8). A null identifier leaves its text as it is.
    """
    h = F.crc32(F.col(id_col).cast("string"))

    def repeated(words: Column, h: Column) -> Column:
        n = F.size(words).cast("bigint")
        g = F.floor(h / 10).cast("bigint")

        def laid(n: Column, a: Column, g: Column) -> Column:
            p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
            return bind(lambda w, p: F.array_join(F.concat(F.slice(w, 1, a.cast("int")), F.transform(F.sequence(F.lit(0).cast("bigint"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))), " "), w=words, p=p)

        return F.when(n > 0, bind(laid, n=n, a=g % n, g=g)).otherwise(F.lit(""))

    text = text_of(text_col)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(chosen, bind(repeated, words=words_of(text), h=h)).otherwise(text).alias("text"),
    )


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent and digests of all runs and of the collapsed text."""

    def greater(best: Column, x: Column) -> Column:
        # exact: length / period compared crosswise; the earlier of equals stays
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    runs = F.col("runs")
    none = F.lit(None).cast(RUN)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        F.aggregate(runs, none, greater).alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
