"""Rows with map columns, null and repeated identifiers go through whole."""

from collections import Counter

import numpy as np
import pytest

from marketloom.llm import jaccard, mixing, packing, sharding, toxicity

SCHEMA = "doc_id long, text string, source string, extra map<string,int>, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", {"x": 1}, "s"), (1, text, "a", {"x": 2}, "s"), (None, text + " end", "a", None, "s"), (None, None, None, {}, "s")]
    rows += [(2, f"other words number {i} of this small table", "b", {"i": i}, "s") for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df):
    return Counter((r.doc_id, r.text, r.source, tuple(sorted((r.extra or {"": 0}).items())), r.shard) for r in df.collect())


def test_written_shards_hold_every_row_once(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), limit=200)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert _rows(back) == _rows(docs)
    assert back.select("shard_").distinct().count() > 3


def test_map_columns_in_mix_and_near_dedup(docs):
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    kept = jaccard.keep_first(docs, words=5)
    assert kept.columns == docs.columns
    assert sum(1 for r in kept.collect() if r.text and r.text.startswith("one two")) == 1


def test_features_of_a_long_text_depend_on_the_text_alone(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    alone = toxicity._sampled(spark.createDataFrame([(1, long)], "toxic int, text string"))
    among = toxicity._sampled(spark.createDataFrame([(0, f"{long} {i}") for i in range(5)] + [(1, long)], "toxic int, text string").coalesce(1))
    assert len(alone[0][1]) == toxicity.SEEN
    assert any(t == 1 and np.array_equal(f, alone[0][1]) for t, f, _ in among)


def test_cached_words_do_not_change_ids():
    words = packing.Words(packing.tokenizer_path(), cached=20)
    texts = ["Hello, World! caf\u00e9 naive 12 a.b", "hello world again; many other words come here now and then", "\u0130x K. HELLO"] * 9
    plain = words.tok
    for _ in range(3):
        assert words.ids(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_near_dedup_of_many_rows_without_identifier(spark):
    def text(i, j):
        return " ".join(f"w{i}x{k}" for k in range(40)) + f" end{j}" * (j > 0)

    texts = [text(i, j) for i in range(60) for j in range(5)] + [text(0, 0)] * 50 + ["", " ", "\n"] * 20
    none = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    one = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    for table in (none, one):
        kept = [r.text for r in jaccard.keep_first(table, words=5).collect()]
        assert sum(1 for t in kept if not t.strip()) == 1
        assert sorted(t.split()[0] for t in kept if t.strip()) == sorted(f"w{i}x0" for i in range(60))
    got = jaccard.ngram_components(none, words=5).collect()
    assert Counter(r.n_shingles for r in got) == Counter([0] * 60 + [36] * 110 + [37] * 240)


def test_runs_of_letters_have_the_tokenizers_ids():
    words = packing.Words(packing.tokenizer_path())
    assert words.direct
    rng = np.random.default_rng(3)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCXYZàéîõüßøæçñÀÉÑÿ")
    made = ["".join(rng.choice(alphabet, rng.integers(1, 14))) + str(rng.choice(["", ".", "?!", "),"])) for _ in range(3000)]
    assert words.ids(made) == [words.encode(w) for w in made]
    words.direct = False
    words.forget()
    assert words.ids(made) == [words.encode(w) for w in made]
