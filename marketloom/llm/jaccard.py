"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two texts link when the Jaccard similarity of their shingle sets reaches a
bound. For each text, the texts that share at least T of its shingles are found
in inverted lists: the short lists are merged, and what occurs often enough
there is probed for in the long lists by binary search.

Lists are built per block of texts, and every pair that can link meets in a
block: the hash range is cut into more segments than a linking pair may have
differing shingles, so such a pair agrees on a whole segment. Texts that agree
on a segment meet in the block of the smallest of them. Segments hold several
shingles spread over the whole text, so texts that only share passages seldom
meet; those with too many shingles of their own are set aside before blocks form,
and blocks that lie within another one go. Blocks above a bounded number of
shingles are cut into chunks, and each pair of chunks is a task; there is no cap,
and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import text_of
from marketloom.llm.components import components
from marketloom.llm.shingles import U64, Shingler, digest, mix
from marketloom.session import stored

CHUNK = 2_000_000  # shingles of one chunk of a block
DIGESTS_SEEN = 200_000
KEYS_A_ROW = 256  # about so many


class Bound:
    """Similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Shingles that sets of sizes a and b must share to link."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def differing(self, size: int) -> int:
        """Shingles in which linking sets of up to ``size`` may differ."""
        return 2 * size * (self.den - self.num) // (self.num + self.den)

    def size_class(self, n: int) -> int:
        """Classes grow by den / num, so linking sets are in one class or in neighbours."""
        step = math.log(self.den / self.num)
        c = int(math.log(n) / step)
        while self.class_start(c) > n:
            c -= 1
        while self.class_start(c + 1) <= n:
            c += 1
        return c

    def class_start(self, c: int) -> float:
        return (self.den / self.num) ** c


def signatures(shingles: np.ndarray, bound: Bound) -> np.ndarray:
    """One key per segment, for the set's size class and the next.

    Sets of one class use the same segments. Linking sets differ in at most
    ``differing`` shingles, and a differing shingle spoils one segment, so with
    ``empty + 1`` more segments they agree on more than ``empty`` of them: on one
    that is not empty, or on empty ones of sets that have more than ``empty``
    such, and those give keys for their empty segments too.
    """
    n, own = len(shingles), bound.size_class(len(shingles))
    high, inner = shingles >> U64(32), mix(shingles ^ U64(0x5555))
    keys = []
    for c in (own, own + 1):
        most = bound.differing(math.ceil(bound.class_start(c + 1)))
        few = (most + 1) * math.exp(-bound.class_start(c - 1) / (most + 1))  # empty ones to expect
        empty = int(few + 3 * math.sqrt(few))
        segments = most + 1 + empty
        at = (high * U64(segments)) >> U64(32)  # rises with the hash: segments are runs
        starts = np.searchsorted(at, np.arange(segments, dtype=U64))
        full = np.diff(np.append(starts, n)) > 0
        content = np.zeros(segments, U64)
        content[full] = np.add.reduceat(inner, starts[full])
        wanted = full if segments - full.sum() <= empty else np.ones(segments, bool)
        name = np.arange(segments, dtype=U64) + U64(c * 1_000_003 + 1)
        keys.append(mix(content + mix(name))[wanted])
    return np.concatenate(keys)


def _short_id(found: bytes) -> int:
    return int.from_bytes(found[:8], "little", signed=True)


def _digests(words: int):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in batches:
            sizes, names = [], []
            for s in make.sets(batch.column(1)):
                sizes.append(len(s))
                names.append(digest(s))
            cols = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "n", "digest"])

    return digests


def _key_bits(rows: int) -> int:
    """Bits of a key: few enough to travel well, enough that chance meetings are rare at any size."""
    return min(64, 16 + max(1, rows * KEYS_A_ROW).bit_length())


def _signed(words: int, bound: Bound, bits: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()
        for batch in batches:
            keys, names, held = [], [], 0
            for s in make.sets(batch.column(0)):
                if not len(s):
                    continue
                found = digest(s)
                if found in seen:  # a copy has the same keys; later steps are over distinct sets
                    continue
                if len(seen) >= DIGESTS_SEEN:
                    seen.clear()
                seen.add(found)
                keys.append((signatures(s, bound) >> U64(64 - bits)).view(np.int64))
                names.append(np.full(len(keys[-1]), _short_id(found)))
                held += len(keys[-1])
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names)], names=["key", "sid"])
                    keys, names, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names)], names=["key", "sid"])

    return signed


def _matching(make: Shingler, batch: pa.RecordBatch, seen: set[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, digest, ...): the rows whose text has the digest, with their shingles; repeated rows are left out."""
    wanted = batch.column(1).to_pylist()
    if len(seen) >= DIGESTS_SEEN:
        seen.clear()
    for i, s in enumerate(make.sets(batch.column(0))):
        found = digest(s)
        if found == wanted[i] and found not in seen:
            seen.add(found)
            yield i, s


def _with_sets(words: int):
    """(text, digest, to) -> the shingles of the rows whose text has the digest."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()

        def taken(batch: pa.RecordBatch, rows: list[int], cells: list[bytes]) -> pa.RecordBatch:
            some = batch.take(pa.array(rows, pa.int64()))
            cols = [some.column(1), some.column(2), pa.array(cells, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["digest", "to", "cells"])

        for batch in batches:
            rows, cells, held = [], [], 0
            for i, s in _matching(make, batch, seen):
                rows.append(i)
                cells.append(s.tobytes())
                held += len(cells[-1])
                if held > 16 << 20:
                    yield taken(batch, rows, cells)
                    rows, cells, held = [], [], 0
            if rows:
                yield taken(batch, rows, cells)

    return with_sets


def _half_of_sets(words: int, bits: int):
    """(text, digest, sid) -> the shingles of one half of the hash range, a row each.

    Shortened to ``bits``: two that meet by chance count as shared, which only
    leaves a set in.
    """

    def half_of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()
        for batch in batches:
            sids = batch.column(2).to_pylist()
            for i, s in _matching(make, batch, seen):
                s = (s[s & U64(1) == 0] >> U64(64 - bits)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), sids[i]))], names=["hash", "sid"])

    return half_of_sets


def _not_nested(routes: DataFrame) -> DataFrame:
    """Routes (sid, block, ...) without the blocks whose sets all lie in one earlier block.

    A block is named by a set. Where that set lies in an earlier block too, and
    all others of its block with it, every pair of the block meets there. Near
    copies lie in many such blocks.
    """
    outer = routes.groupBy(F.col("sid").alias("block")).agg(F.min("block").alias("outer")).filter("outer < block")
    within = routes.select("sid", "block").join(outer, "block")
    also = routes.select("sid", F.col("block").alias("outer"), F.lit(1).alias("both"))
    nested = within.join(also, ["sid", "outer"], "left").groupBy("block").agg(F.count("both").alias("both"), F.count(F.lit(1)).alias("sets"))
    return routes.join(nested.filter("both = sets").select("block"), "block", "left_anti")


def linked(sets: list[np.ndarray], side: np.ndarray, bound: Bound) -> list[tuple[int, int]]:
    """Links among ``sets`` that connect what linking connects (a spanning forest).

    Only pairs of different ``side`` count, or all if there is one side. Each set
    asks, in order of size, for sets at least as large.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, side, docs = sizes[order], side[order], len(order)
    both = len(np.unique(side)) > 1
    token, place = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    by = np.argsort(place, kind="stable")  # postings by token, then by set
    holder = np.repeat(np.arange(docs), sizes)[by]
    frequency = np.bincount(place, minlength=len(token))
    first = np.concatenate([[0], np.cumsum(frequency)])
    probe = place[by] * docs + holder  # sorted: (token, set) pairs
    limit = np.searchsorted(sizes, (sizes * bound.den) // bound.num, side="right")
    root = list(range(docs))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for q in range(docs):
        n, most = int(sizes[q]), int(limit[q])
        if most <= q + 1:
            continue
        need = int(bound.overlap(n, n))
        own = place[ends[q] - n : ends[q]]
        often = frequency[own]
        if np.count_nonzero(often > 1) < need:
            continue
        own = own[np.argsort(often, kind="stable")]
        hits = 1 + need // 32  # what the short lists must give
        short, long_ = own[: n - need + hits], own[n - need + hits :]
        short = short[frequency[short] > 1]
        merged = np.concatenate([holder[first[t] : first[t + 1]] for t in short]) if len(short) else holder[:0]
        merged = merged[(merged > q) & (merged < most)]
        if not len(merged):
            continue
        counts = np.bincount(merged - q)
        found = np.flatnonzero(counts >= hits)
        if both:
            found = found[side[found + q] != side[q]]
        # Nearest first: once linked, what hangs together is not probed again.
        for c in found[np.argsort(-counts[found], kind="stable")] + q:
            if top(int(c)) == top(q):
                continue
            wanted = long_ * docs + c
            at = np.minimum(np.searchsorted(probe, wanted), len(probe) - 1)
            shared = int(counts[c - q]) + int(np.count_nonzero(probe[at] == wanted))
            if shared >= bound.overlap(n, int(sizes[c])):
                root[top(int(c))] = top(q)
                links.append((int(order[q]), int(order[c])))
    return links


def _joined(bound: Bound):
    def joined(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("digest").sort_values("digest", kind="stable")
        names = block["digest"].tolist()
        sets = [np.frombuffer(c, U64) for c in block["cells"]]
        links = linked(sets, block["chunk"].to_numpy(), bound) if len(sets) > 1 else []
        return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype=object)

    return joined


def _links(docs: DataFrame, sets: DataFrame, words: int, bound: Bound, chunk: int) -> DataFrame:
    """Pairs of digests (a, b) that connect all linking sets. ``docs``: doc_id, text, mark; ``sets``: digest, n, doc_id, mark, sid."""
    bits = _key_bits(docs.count())
    keys = docs.select("text").mapInArrow(_signed(words, bound, bits), "key long, sid long")
    # One shuffle of narrow rows; a key that one set has alone ends here.
    least, most = F.expr("min(sid) OVER (PARTITION BY key)"), F.expr("max(sid) OVER (PARTITION BY key)")
    met = keys.select("sid", least.alias("block"), most.alias("last")).filter("block < last")
    routes = stored(met.select("sid", "block").distinct(), "ngram-routes")

    def texts(wanted: DataFrame) -> DataFrame:
        """One text of each set of ``wanted`` (sid, to); sets are made from it anew, they are wider than texts."""
        ids = sets.join(wanted, "sid").select(F.col("doc_id").alias("its"), F.col("mark").alias("its_mark"), "digest", "to")
        return docs.join(ids, _same_row("doc_id", "mark")).select("text", "digest", "to")

    # Lists of one: a set with more shingles that no other has than a linking set
    # may lack links with nothing. Half of the shingles show most such sets.
    half = texts(routes.select("sid", F.col("sid").alias("to")).distinct()).mapInArrow(_half_of_sets(words, bits), "hash long, sid long")
    single = half.groupBy("hash").agg(F.count(F.lit(1)).alias("holders"), F.min("sid").alias("sid")).filter("holders = 1")
    alone = single.groupBy("sid").agg(F.count(F.lit(1)).alias("alone")).join(sets.select("sid", "n"), "sid")
    spare = F.floor(F.col("n") * (bound.den - bound.num) / F.lit(bound.den))
    lone = alone.filter(F.col("alone") > spare).select("sid").distinct()
    met = stored(routes.join(lone, "sid", "left_anti").join(sets.select("sid", "n"), "sid"), "ngram-met")
    left = stored(_not_nested(met), "ngram-left")
    parts = left.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all"))
    parts = parts.filter("sets > 1").select("block", F.ceil(F.col("all") / F.lit(chunk)).cast("int").alias("chunks"))
    per_set = left.join(parts, "block").groupBy("sid").agg(F.collect_set(F.struct("block", "chunks")).alias("to"))
    per_set = stored(per_set, "ngram-blocks")
    cells = texts(per_set).mapInArrow(
        _with_sets(words), T.StructType([T.StructField("digest", T.BinaryType()), per_set.schema["to"], T.StructField("cells", T.BinaryType())])
    )
    # A set goes to its blocks; in a block of several chunks, to each pair of its own chunk with another.
    routed = cells.select("digest", "cells", F.explode("to").alias("to"))
    routed = routed.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("to.chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("to.chunks") - 1))
    placed = routed.select("digest", "cells", "chunk", F.col("to.block").alias("block"), other.alias("other"))
    low, high = F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    tasks = placed.select("block", low, high, "chunk", "digest", "cells")
    return tasks.groupBy("block", "low", "high").applyInPandas(_joined(bound), "a binary, b binary")


def _mark(text: str) -> Column:
    """A hash of the whole text, so that rows are told apart where many have one identifier or none."""
    return F.xxhash64(text)


def _same_row(id_col: str, mark: str) -> Column:
    return F.col(id_col).eqNullSafe(F.col("its")) & (F.col(mark) == F.col("its_mark"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, chunk: int):
    """Rows (doc_id, mark, n, digest) and the groups (digest, its component's first doc_id and digest)."""
    one = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", _mark("text"))
    field = T.StructField("doc_id", one.schema["doc_id"].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("mark", "n")]
    rows = one.mapInArrow(_digests(words), T.StructType([field, *longs, T.StructField("digest", T.BinaryType())]))
    rows = stored(rows, "ngram-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("row")
    sets = rows.filter("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"))
    sets = sets.select("digest", "row.doc_id", "row.mark", "n", _sid(F.col("digest")).alias("sid"))
    sets = stored(sets, "ngram-sets")
    links = stored(_links(one, sets, words, Bound(num, den), chunk), "ngram-links")
    roots = components(links).select(F.col("node").alias("digest"), "root")
    named = sets.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    firsts = named.groupBy("root").agg(F.min(order).alias("first"))
    groups = named.select("digest", "root").join(firsts, "root")
    first = [F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest")]
    return rows, stored(groups.select("digest", *first), "ngram-groups")


def _sid(digest_: Column) -> Column:
    """The first eight bytes as a little-endian long, as ``_short_id`` reads them."""
    total = F.lit(0).cast("bigint")
    for i in range(8):
        byte = F.conv(F.hex(F.substring(digest_, i + 1, 1)), 16, 10).cast("bigint")
        total = total.bitwiseOR(F.shiftleft(byte, 8 * i))
    return total


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5, chunk: int = CHUNK
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    The similarity bound is ``num / den``. A text of fewer words than a shingle
    is one shingle; a null or empty text has none and links with nothing, so its
    component is its own identifier. Equal sets link. A component's identifier
    is its smallest doc_id that is not null. Repeated rows give repeated rows; an
    empty table gives none; other columns are ignored.
    """
    rows, groups = _grouped(docs, id_col, text_col, words, num, den, chunk)
    found = rows.join(groups, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5, chunk: int = CHUNK
) -> DataFrame:
    """The input rows without near copies: of each component the row with its smallest identifier.

    All columns stay. Texts without a word are all kept, except that rows with
    the same identifier and the same set count as one.
    """
    rows, groups = _grouped(docs, id_col, text_col, words, num, den, chunk)
    mine = (F.col("n") == 0) | ((F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    stays = rows.join(groups, "digest", "left").filter(mine).groupBy("doc_id", "digest")
    stays = stays.agg(F.min("mark").alias("its_mark"), F.count(F.lit(1)).alias("same"))
    stays = stored(stays.select(F.col("doc_id").alias("its"), "its_mark", "same"), "ngram-stays")
    same = _same_row("i", "m")
    all_ = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), _mark(text_of(text_col)).alias("m"))
    # What goes is the smaller part; written by itself its true size is known, and where that is small texts need no shuffle.
    goes = rows.select(F.col("doc_id").alias("i"), F.col("mark").alias("m")).distinct().join(stays.filter("same = 1"), same, "left_anti")
    goes = stored(goes.select(F.col("i").alias("its"), F.col("m").alias("its_mark")), "ngram-goes")
    alone = all_.join(goes, same, "left_anti").select("row")
    # Several rows of one identifier and set: one of those with the least mark.
    several = all_.join(stored(stays.filter("same > 1"), "ngram-repeated"), same, "left_semi")
    first = F.expr("row_number() OVER (PARTITION BY i, m ORDER BY to_json(row))")
    once = several.withColumn("place", first).filter("place = 1").select("row")
    return alone.unionByName(once).select("row.*")
