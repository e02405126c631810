"""Periodic runs, ranked search and license scan against brute force and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import dual_tree, licenses, periodic

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_runs(w, least=6):
    found, seen = [], set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 4 * p) and (i, j + p) not in seen:
                seen.add((i, j + p))
                found.append((i, j + p - i, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, letters = rng.randint(0, 260), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 8 else 0):
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 4))
        for i in range(s + p, min(n, s + rng.randint(0, n - s))):
            w[i] = w[i - p]
    if rng.random() < 0.3:  # runs within runs
        w = ([0] * rng.randint(1, 40) + [1]) * rng.randint(1, 8) + w
    return w


def test_runs_of_many_texts():
    rng = random.Random(5)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        ids = np.array([x for w in texts for x in w], np.int64)
        got = [tuple(r) for r in periodic.runs_of(ids, np.array([len(w) for w in texts])).tolist()]
        want, at = [], 0
        for w in texts:
            want += [(s + at, s + n + at, p) for s, n, p in brute_runs(w)]
            at += len(w)
        assert got == want


def test_runs_in_linear_time_and_of_long_periods():
    block = np.arange(50_000)
    ids = np.concatenate([np.zeros(400_000, np.int64), np.tile(block, 5), block])
    assert periodic.runs_of(ids, np.array([len(ids)])).tolist() == [[0, 400_001, 1], [400_000, 700_000, 50_000]]


def test_synchronising_set_depends_on_context_only():
    rng = np.random.default_rng(3)
    part = rng.integers(0, 9, 200).astype(np.uint64)
    both = np.concatenate([part, rng.integers(0, 9, 77).astype(np.uint64), part])
    scale = 8
    hashes = np.array([zlib.crc32(both[i : i + scale].tobytes()) for i in range(len(both) - scale + 1)], np.uint64)
    chosen = set(periodic.synchronising(hashes, np.zeros(len(hashes), bool), scale).tolist())
    inner = range(len(part) - 2 * scale)
    assert [i in chosen for i in inner] == [i + 277 in chosen for i in inner]
    assert all(any(i + k in chosen for k in range(scale)) for i in range(len(part) - 3 * scale))


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op11_digests(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in some_words(rng))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "a " * 500), (None, "b c " * 9), (7, "x\x0by\x0cx y " * 8), (7, "x\x0by\x0cx y " * 8)]
    rows += [(300 + i, "é ü z\x1c " * 6) for i in range(20)] + [(400, " ".join(f"l{i % 5000}" for i in range(40_000)))]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = sorted(tuple(r) for r in periodic.run_digests(periodic.find_runs(periodic.planted(docs))).fillna(-1, ["doc_id"]).collect())
    want = []
    for doc_id, text in rows:
        w = plant(doc_id, words(text))
        runs = brute_runs(w) if len(w) < 5000 else [(0, 40_000, 5000)] if plant(doc_id, [1, 2]) == [1, 2] else None
        assert runs is not None
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        out = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in out)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        milli = None if best is None else 1000 * best[1] // best[2]
        want.append((-1 if doc_id is None else doc_id, len(runs), *(best or (None, None, None)), milli, *sha))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic.run_digests(periodic.find_runs(docs.limit(0))).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_search(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    holding = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(bags, sizes):
            if n:
                m = 100 - 75 + (75 * n * n_docs) // total
                s = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text)
                )
                if s > 0:
                    scored.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return out


def search_tables(spark, seed=0, n=400, types="doc_id long, text string, score string, rank int"):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)] + ["Äpfel", "x1", "It", "s"]
    text = lambda k: " ".join(rng.choice(vocabulary[: rng.choice([5, 60, 64])]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 80))) for i in range(n)]
    docs += [(1000 + i, "same text t1 t2 t3") for i in range(30)] + [(None, "same text t1 t2 t3"), (5, "It's t9-x1"), (5, "It's t9-x1")]
    docs += [(2000, None), (2001, ""), (2002, "--"), (2003, "T7 " * 20_000)]
    items = [(i, text(rng.randint(1, 30))) for i in range(37)]
    items += [(100, "same text t3 t3"), (101, None), (102, ""), (103, "unknown words"), (None, "t4 Äpfel"), (104, "t5"), (104, "t6"), (105, "t8"), (105, "t8")]
    return docs, items, spark.createDataFrame([(*d, "c", 1) for d in docs], types), spark.createDataFrame(items, "item_id long, text string")


ranking = lambda rows: Counter(tuple(r) for r in rows)


def test_op12_against_brute_force(spark):
    docs, items, d, q = search_tables(spark)
    want = brute_search(docs, items)
    assert ranking(dual_tree.ranked_search(d.repartition(5), q).collect()) == ranking(want)
    # several blocks of items, a smaller k
    some = dual_tree.ranked_search(d, q, top=3, block_terms=100)
    assert ranking(some.collect()) == ranking(r for r in want if r[1] <= 3)
    assert dual_tree.ranked_search(d.limit(0), q).count() == 0 and dual_tree.ranked_search(d, q.limit(0)).count() == 0


def test_op12_text_identifiers(spark):
    docs, items, d, q = search_tables(spark, seed=1, n=60)
    named = d.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    got = {(r.item_id, r["rank"]): r.doc_id for r in dual_tree.ranked_search(named, q.filter("item_id < 37")).collect()}
    numbered = [x for x in items if x[0] is not None and x[0] < 37]
    want = {(i, k): None if doc is None else f"d{doc:05d}" for i, k, doc, _ in brute_search(docs, numbered)}
    assert got == want


def test_op12_leaves_out_batches():
    """Bounds spare work: few of the pairs of a clear-cut collection reach the leaves."""
    rng = np.random.default_rng(1)
    impacts = np.zeros((64, 4096), np.int64)
    impacts[rng.integers(0, 64, 4096), np.arange(4096)] = rng.integers(1, 1000, 4096)
    impacts = impacts[:, np.lexsort((impacts.max(0), impacts.argmax(0)))]
    vectors = [(np.array([i]), np.array([1])) for i in range(64)]
    best, seen = dual_tree.Best.of(64, 10), []
    add = best.add
    best.add = lambda item, scores, *rest: (seen.append(len(scores)), add(item, scores, *rest))
    levels = dual_tree.document_tree(impacts)
    dual_tree.search(dual_tree.item_tree(vectors), levels, list(range(4096)), best)
    for i in range(64):
        order = np.lexsort((np.arange(4096), -impacts[i]))[:10]
        assert [(-s, d) for s, _, d in best.rows[i]] == [(impacts[i][d], d) for d in order]
    assert sum(seen) < 0.05 * 64 * 4096


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(text):
    w = WORD.findall((text or "").translate(FOLD))
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = sorted({label for _, label in places})
    more, best = set(base), 0.0
    for t in licenses.templates():
        tokens = set(t.words)
        for b in range(0, len(w) // t.span + 1):
            n = len(tokens & set(w[b * t.span : (b + 2) * t.span]))
            if n * licenses.DEN >= len(tokens) * licenses.NUM:
                more.add(t.label)
                best = max(best, n / len(tokens))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(more)), 1.0 if at else best)


def license_rows():
    rng = random.Random(2)
    filler = "the of work is under license in any copy this free software public and to".split()
    noise = lambda k: " ".join(rng.choice(filler + [f"x{rng.randrange(99)}"]) for _ in range(k))
    rows = [(1, None), (2, ""), (3, "MIT License mit\nlicense, CC-BY cc by cc BY"), (4, "K MİT License. Klicense mit"), (5, noise(3000))]
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        rows.append((10 + i, noise(50) + " " + text + " " + noise(50)))
        w[len(w) // 2] = "changed"
        rows.append((100 + i, noise(rng.randint(0, 40)) + "\n" + " ".join(w)))
        rows.append((200 + i, " ".join(w[: len(w) // 2])))
    rows += [(300, "Licensed under CC BY-NC 4.0.")] * 40 + [(None, "Released under the MIT License."), (301, noise(100) + (" mit license" * 500))]
    return rows


def test_op13_against_brute_force(spark):
    rows = license_rows()
    docs = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, labels string, score double")
    got = Counter(tuple(r) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter((d, *brute_licenses(t)) for d, t in rows)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_op13_finds_changed_notices_and_leaves_prose(spark):
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(license_rows(), "doc_id long, text string")).collect()}
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        assert label in found[10 + i].labels.split(",")
        if len(set(text.split())) >= 20:  # one changed word leaves nine tenths
            assert label in found[100 + i].labels.split(",")
    assert found[5].labels == "" and found[5].score == 0.0


@pytest.mark.parametrize("operator", [periodic.find_runs, licenses.scan_licenses])
def test_map_columns_and_repeated_rows(spark, operator):
    rows = [(1, "mit license " * 4, {"a": 1})] * 300 + [(None, "mit license", {})] * 300
    out = operator(spark.createDataFrame(rows, "doc_id long, text string, hits map<string,int>"))
    assert out.count() == 600 and out.filter("doc_id = 1").distinct().count() == 1
