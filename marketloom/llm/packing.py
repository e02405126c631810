"""Packing tokenised documents into sequences, first-fit decreasing by a tournament tree.

Documents are tokenised in batches, cut into full sequences and one rest, and
dealt to randomised groups of bounded size. Inside a group the rests are packed
largest first, each into the first open sequence with room; a tournament tree
over the free capacities finds that sequence in logarithmic time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import text_of

CAPACITY = 4096
END_ID = 2  # closes every document
GROUP = 2048  # documents of one group, on average
CACHED = 200_000  # words of each of the two generations a task keeps
REMEMBERED = 1_000_000  # rows a task keeps in mind to tell repeated ones apart
BATCH_CHARS = 4 << 20

#: Letters whose lower case is one letter and that no composition changes.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?*%&#$|)"
#: Words that show whether a tokenizer takes runs of letters as they are.
PROBES = ("hello", "abcdefghijklmnopqrstuvwxyz", "straße", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def simple(word: str) -> tuple[str, str] | None:
    """The letters, in lower case, and the closing marks of a word that is nothing else."""
    letters = word.rstrip(MARKS)
    plain = letters.isalpha() if letters.isascii() else SIMPLE.fullmatch(letters)
    return (letters.lower(), word[len(letters) :]) if plain else None


class Words:
    """Token ids of texts as little-endian bytes, one look-up per word.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids in order. A word of letters and closing marks is its
    letters' ids and its marks' ids. The caches are bounded and only save work: a
    full one becomes the old generation, from which what is used again moves on.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.units = {n: as_bytes.pre_tokenize_str(chr(n))[0][0] for n in range(0xC0, 0x100)}
        self.direct = all(self.unit(w) == self.encode(w) for w in PROBES)
        self.cached = cached
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_letters: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, letters: str) -> bytes:
        """Ids of a lower-case run of letters, straight from the model: it is one unit and nothing in it changes."""
        if not letters.isascii():
            letters = letters.translate(self.units)
        ids = [token.id for token in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, fresh: set[str]) -> None:
        split = [(w, simple(w)) for w in fresh]
        wanted = {found[0] for _, found in split if found} - self.letters.keys()
        again = wanted & self.old_letters.keys()
        self.letters.update((w, self.old_letters[w]) for w in again)
        ids_of = self.unit if self.direct else self.encode
        self.letters.update((w, ids_of(w)) for w in wanted - again)
        words, letters = self.words, self.letters
        for word, found in split:
            if found is None:
                words[word] = self.encode(word)
            elif not found[1]:
                words[word] = letters[found[0]]
            else:
                marks = words.get(found[1])
                if marks is None:
                    marks = words[found[1]] = self.encode(found[1])
                words[word] = letters[found[0]] + marks

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > self.cached:
            self.old_words, self.words = self.words, {"": b""}
        if len(self.letters) > self.cached:
            self.old_letters, self.letters = self.letters, {}
        fresh = set().union(*parts) - self.words.keys()
        again = fresh & self.old_words.keys()
        self.words.update((w, self.old_words[w]) for w in again)
        fresh -= again
        if fresh:
            self.learn(fresh)
        words = self.words
        return [b"".join([words[w] for w in p]) for p in parts]


def _some(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of bounded size, so that long texts do not pile up."""
    at, run, chars = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        chars += len(run[-1])
        if chars > BATCH_CHARS:
            yield at, run
            at, run, chars = i + 1, [], 0
    if run:
        yield at, run


def _pieces(path: str, cached: int, groups: int, capacity: int, id_type: pa.DataType, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(path, cached), Counter()
        closing = np.array([END_ID], "<u4").tobytes()
        try:
            for batch in batches:
                names = batch.column(0)
                for at, texts in _some(batch.column(1).to_pylist()):
                    rows: list[tuple] = []
                    for i, ids in enumerate(words.ids(texts)):
                        ids += closing
                        # Repeated rows go to different groups; rows alike are interchangeable,
                        # so numbering them in a task gives the same groups on a retry. A long task
                        # starts numbering anew, as every task does.
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        key = (names[at + i].as_py(), zlib.crc32(ids))
                        seen[key] += 1
                        group = xxhash.xxh3_64_intdigest(repr((key, seen[key]))) % groups
                        total = len(ids) // 4
                        for start in range(0, total, capacity):
                            piece = ids[4 * start : 4 * (start + capacity)]
                            rows.append((at + i, start, len(piece) // 4, zlib.crc32(piece), total, group, piece))
                    cols = list(zip(*rows))
                    out = [names.take(pa.array(cols[0], pa.int64())).cast(id_type)]
                    out += [pa.array(c, pa.int64()) for c in cols[1:6]]
                    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"]
                    if with_ids:
                        out.append(pa.array(cols[6], pa.binary()))
                        fields.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names=fields)
        finally:
            words.forget()  # later stages in this process have the memory back

    return pieces


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """First-fit in the given order: the bin and offset of each size (at most ``capacity``).

    ``tree`` is a tournament: a leaf holds a bin's free room, an inner node the
    larger of its children, so the first bin with room is found going left first.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - tree[node])
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def _pack(capacity: int):
    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        by = ["length", "ids_crc32", "doc_id", "start"]
        rows = rows.sort_values(by, ascending=[False, True, True, True], kind="stable", na_position="last")
        bins, offsets = first_fit(rows["length"].tolist(), capacity)
        rows["sequence_id"] = rows["pack_group"].astype("int64") * (1 << 32) + np.array(bins, "int64")
        rows["offset"] = np.array(offsets, "int64")
        return rows.drop(columns="pack_group")

    return pack_group


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    group: int = GROUP,
    ids: bool = False,
    cached: int = CACHED,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and the ids if asked.

    A document is its text's token ids (null or empty text: none) and the closing
    id. Pieces are full sequences and one rest. Every id lies in exactly one
    piece; in a sequence the pieces lie without gaps from offset 0. Repeated rows
    are packed each; an empty table gives no rows; other columns are ignored.
    ``cached`` words a task keeps: memory against speed, never the result.
    """
    path = path or tokenizer_path()
    one = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    groups = max(1, docs.count() // group)
    longs = ["start", "length", "ids_crc32", "doc_tokens", "pack_group"]
    id_field = one.schema["doc_id"]
    fields = [T.StructField("doc_id", id_field.dataType)] + [T.StructField(n, T.LongType()) for n in longs]
    if ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(id_field.dataType)
    pieces = one.mapInArrow(_pieces(path, cached, groups, capacity, arrow, ids), T.StructType(fields))
    kept = [f for f in fields if f.name != "pack_group"]
    out = T.StructType(kept + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])
    return pieces.groupBy("pack_group").applyInPandas(_pack(capacity), out)
