"""Ranked lexical search: every item's best documents, by dual-tree search.

Two hierarchies: one over the items of the query table, one over documents. A
node holds for every term the maximum over its members: of how often an item
names the term, and of what the term adds to a document's score. The product of
two nodes' maxima bounds every score between them. Where that bound lies below
the weakest kth score so far of the node's items, all pairs below it are left
out; equal scores are looked into, as a smaller identifier wins. What reaches
the leaves is scored exactly, in 64-bit integers, so the result is exact.

Documents are tokenised once. What is kept of each is narrow: its number of
terms, and number and count of those terms that occur in items. Every task builds
the hierarchy over its own documents, a bounded number at a time, and returns its
best per item; those few rows are ranked once more. Items come in blocks of a
bounded number of terms, one pass over the narrow rows for each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marketloom.llm.common import text_of
from marketloom.session import stored

TOP = 10
FAN = 8  # children of a node
BLOCK_TERMS = 1 << 16  # terms of the items of one block, on average: bounds what goes to each task
CELLS = 1 << 21  # cells of the matrix (terms x documents) a task builds at a time
BATCH_DOCS = 1 << 11

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(terms_of(c.as_py())) for c in batch.column("text").cast(pa.large_binary())]
        at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item").take(pa.array(at)),
                pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string()),
                pa.array([n for c in counts for n in c.values()], pa.int64()),
            ],
            names=["item", "term", "named"],
        )


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item_id, copies) of the distinct items, and (item, term, named) of their terms.

    Rows equal in identifier and text are one item, counted as copies; ``item``
    is a digest of both.
    """
    parts = [F.col(id_col).cast("string"), text_of(text_col)]
    key = F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)
    one = items.select(key.alias("item"), F.col(id_col).alias("item_id"), text_of(text_col).alias("text"))
    one = one.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    one = stored(one, "items")
    terms = one.select("item", "text").mapInArrow(_item_terms, "item string, term string, named long")
    return one.select("item", "item_id", "copies"), stored(terms, "item-terms")


def _counted(vocabulary: dict[bytes, int], id_type: pa.DataType):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            sizes, cuts, terms, times = [], [0], [], []
            for cell in batch.column("text").cast(pa.large_binary()):
                words = terms_of(cell.as_py())
                sizes.append(len(words))
                counts = Counter(words)
                shared = known & counts.keys()
                terms += [vocabulary[t] for t in shared]
                times += [counts[t] for t in shared]
                cuts.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(id_type), pa.array(sizes, pa.int64()), *lists],
                names=["doc_id", "n", "terms", "times"],
            )

    return count


@dataclass
class Node:
    """Items (numbers in a block) and the maxima over them: term numbers and counts."""

    items: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    below: list[Node] = field(default_factory=list)


def item_tree(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Node:
    """The hierarchy over items given as (terms, counts); alike items stand together."""
    order = sorted(range(len(vectors)), key=lambda i: sorted(vectors[i][0].tolist())[:4])
    level = [Node(np.array([i]), *vectors[i]) for i in order]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FAN):
            some = level[at : at + FAN]
            terms, back = np.unique(np.concatenate([s.terms for s in some]), return_inverse=True)
            most = np.zeros(len(terms), np.int64)
            np.maximum.at(most, back, np.concatenate([s.most for s in some]))
            above.append(Node(np.concatenate([s.items for s in some]), terms, most, some))
        level = above
    return level[0]


def document_tree(impacts: np.ndarray) -> list[np.ndarray]:
    """Levels of the hierarchy over documents (columns of terms x documents), leaves first."""
    levels = [impacts]
    while levels[-1].shape[1] > 1:
        below = levels[-1]
        levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))
    return levels


@dataclass
class Best:
    """The best documents of each item so far: (-score, identifier is null, identifier)."""

    top: int
    rows: list[list[tuple]]
    kth: np.ndarray  # score of the last of ``top``, 1 while there are fewer

    @classmethod
    def of(cls, items: int, top: int) -> Best:
        return cls(top, [[] for _ in range(items)], np.ones(items, np.int64))

    def add(self, item: int, scores: np.ndarray, columns: np.ndarray, names: list, places: np.ndarray) -> None:
        """``places`` order the documents by identifier, so ties are cut as the result is."""
        first = np.lexsort((places[columns], -scores))[: self.top]
        some = [(int(scores[i]), names[columns[i]]) for i in first]
        own = self.rows[item] + [(-score, name is None, 0 if name is None else name) for score, name in some]
        own.sort()
        self.rows[item] = own[: self.top]
        if len(own) >= self.top:
            self.kth[item] = max(1, -own[self.top - 1][0])


def search(tree: Node, levels: list[np.ndarray], names: list, best: Best) -> None:
    """All pairs below the two roots, leaving out node pairs whose bound is too low."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, 0 if names[i] is None else names[i]))
    places = np.empty(len(names), np.int64)
    places[order] = np.arange(len(names))

    pairs = [(tree, len(levels) - 1, np.arange(levels[-1].shape[1]))]
    while pairs:
        node, level, columns = pairs.pop()
        bounds = node.most @ levels[level][np.ix_(node.terms, columns)]
        stay = bounds >= best.kth[node.items].min()
        if not stay.any():
            continue
        columns, bounds = columns[stay], bounds[stay]
        if not level and not node.below:
            best.add(int(node.items[0]), bounds, columns, names, places)
            continue
        if level:
            columns = columns[np.argsort(-bounds, kind="stable")]  # likely ones first
            columns = (columns[:, None] * FAN + np.arange(FAN)).ravel()
            columns = columns[columns < levels[level - 1].shape[1]]
        pairs += [(below, max(0, level - 1), columns) for below in reversed(node.below or [node])]


def _impacts(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """Terms x documents: what each term adds to a document's score per mention in an item."""
    terms, times = batch.column("terms"), batch.column("times")
    cuts = np.diff(terms.offsets.to_numpy())
    column = np.repeat(np.arange(batch.num_rows), cuts)
    row, tf = terms.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sizes = batch.column("n").to_numpy().astype(np.int64)
    # in Python's integers: 75 * n * N may pass 64 bits
    m = np.array([100 - 75 + 75 * n * n_docs // all_terms for n in sizes.tolist()], np.int64)[column]
    out = np.zeros((len(weights), batch.num_rows), np.int64)
    out[row, column] = weights[row] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
    return out


def _alike(impacts: np.ndarray) -> np.ndarray:
    """Documents in an order that puts those of one leading term together."""
    return np.lexsort((impacts.max(0), impacts.argmax(0)))


def _searched(vectors, weights: np.ndarray, n_docs: int, all_terms: int, top: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = item_tree(vectors), Best.of(len(vectors), top)
        width = max(FAN, min(BATCH_DOCS, CELLS // max(1, len(weights))))
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                some = batch.slice(at, width)
                impacts = _impacts(some, weights, n_docs, all_terms)
                order = _alike(impacts)
                names = some.column("doc_id").to_pylist()
                search(tree, document_tree(impacts[:, order]), [names[i] for i in order], best)
        rows = [(i, None if none else name, -score) for i, own in enumerate(best.rows) for score, none, name in own]
        cols = list(zip(*rows)) or [(), (), ()]
        types = (pa.int32(), id_type, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["number", "doc_id", "score"])

    return run


def _block(docs: DataFrame, terms: list[Row], top: int) -> DataFrame | None:
    """(item, doc_id, score) of the best documents in every task, for one block of items."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({r.term.encode() for r in terms}))}
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("times", T.ArrayType(T.IntegerType())),
        ]
    )
    vectors = stored(docs.mapInArrow(_counted(vocabulary, id_type), schema), "vectors")
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals.docs:
        return None
    holding = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r.term] = r["count"]
    weights = np.array([weight(totals.docs, int(df)) for df in holding], np.int64)
    own: dict[str, list[tuple[int, int]]] = {}
    for r in terms:
        own.setdefault(r.item, []).append((vocabulary[r.term.encode()], r.named))
    names = sorted(own)
    pairs = [np.array(sorted(own[name]), np.int64) for name in names]
    run = _searched([(p[:, 0], p[:, 1]) for p in pairs], weights, totals.docs, totals.terms, top, id_type)
    found = T.StructType([T.StructField("number", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    numbers = spark.createDataFrame(list(enumerate(names)), "number int, item string")
    hits = vectors.filter(F.size("terms") > 0).mapInArrow(run, found)
    return hits.join(F.broadcast(numbers), "number").select("item", "doc_id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents of a score above 0.

    Equal scores stand by ascending identifier, null last. Null and empty texts have
    no terms: such documents are never found and such items find nothing. Repeated
    rows of documents are ranked each; repeated rows of items (equal identifier and
    text) repeat their results; one identifier with two texts is two items. Empty
    tables give no rows; other columns are ignored. An item's terms, and the block
    they are in, go to each task: ``block_terms`` bounds a block of several items.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    distinct, terms = item_terms(items, item_col)
    blocks = -(-terms.count() // block_terms)
    empty = T.StructType([T.StructField("item", T.StringType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    found = docs.sparkSession.createDataFrame([], empty)
    for block in range(blocks):
        mine = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        hits = _block(docs, mine, top) if mine else None
        found = found if hits is None else found.unionByName(hits)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    repeated = distinct.select("item", "item_id", copies.alias("copy"))
    return ranked.join(repeated, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
), total AS (
  SELECT count(*) AS docs, sum(len(terms))::HUGEINT AS terms FROM d WHERE len(terms) > 0
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, docs
), q AS (
  SELECT i, item_id, term, count(*) AS named FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
  ) GROUP BY i, item_id, term
), score AS (
  SELECT q.i, q.item_id, d.r, d.doc_id,
         sum(q.named * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * len(d.terms) * total.docs) // total.terms)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.r = tf.r, total
  GROUP BY q.i, q.item_id, d.r, d.doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM score WHERE score > 0
) WHERE rank <= 10
"""
