"""The training-data operators against brute force, on small tables with every awkward row."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, jaccard, mixing, packing, pii, quality_classifier, rules, sharding, toxicity, url_filter
from marketloom.llm.shingles import Shingler

SPACE = re.compile(r"[\x20\x09-\x0d]+")
#: documents, with columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, kept boolean, size int"


def doc(i, text, source="a"):
    return (i, text, "en", source, None, "r", "d", True, 1)


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(200))
ROWS = [
    doc(1, "Hello  big world"), doc(2, "Hello big\tworld\n"), doc(3, "hello big world"), doc(4, None), doc(5, ""),
    doc(6, " \n "), doc(None, "Hello big world", None), doc(7, LONG, "b"), doc(8, BASE), doc(9, BASE + " tail", "b"),
    doc(10, BASE.replace("word100", "other"), None), doc(10, BASE.replace("word100", "other"), None), doc(11, "one two", "c"),
    doc(12, "one two", "c"), doc(13, "ONE two!", "c"), doc(14, "mail a.b@c.de or +1 (438) 555-7372, 4111111111111111 at 1.2.3.4"),
    doc(15, "same line\nsame line\nother same line #$"), doc(16, "é\U0001f600 x@y.z", "ü"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[SPACE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0]))
    assert len(got) == len(ROWS)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    for r in got:
        same = by_sha[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(same), same[0][2])
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_splits_hot_texts(spark):
    rows = [(i, "copy " * (1 + i % 2)) for i in range(3000)] + [(9000 + i, f"own {i}") for i in range(50)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = {r.keep_id: r.group_size for r in got if r.kept}
    assert sizes[0] == 1500 and sizes[1] == 1500 and len(sizes) == 52


def test_rules(docs, empty):
    got = rules.quality_rules(docs).collect()
    want = collections.Counter()
    for r in ROWS:
        w = words(r[1])
        found = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if found[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", r[1] or ""))
        want[(r[0], len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered))] += 1
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.quality_rules(empty).count() == 0


def test_url_filter(spark):
    urls = [
        "http://a.example.org/en/1x?q", "https://WWW.Example.ORG/es/", "http://example.org", "http://org/x", "no url", None, "",
        "x://com/de/a#f", "x://b.com/fr/", "x://com.evil.net/de/", "http://example.org/en/2", "http://example.org/en/1x?q", "://org/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    table = url_filter.rule_table(spark)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, table).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best[1:])
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0
    nested = url_filter.rule_table(spark, [("block", "org", "/e"), ("allow", "org", "/en/"), ("block", "org", "/en/1")])
    verdicts = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, nested).collect()}
    assert verdicts[0] == ("org/en/1", "block") and verdicts[10] == ("org/en/", "allow") and verdicts[1] == ("org/e", "block")


def brute_components(rows, k, num, den):
    sets = []
    for r in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(r[1])]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,num,den,chunk", [(3, 9, 10, 2_000_000), (5, 4, 5, 500)])
def test_ngram_components(spark, docs, empty, k, num, den, chunk):
    rng = np.random.default_rng(5)
    rows = list(ROWS)
    for family in range(12):
        base = [f"f{family}w{rng.integers(400)}" for _ in range(rng.integers(12, 120))]
        for c in range(8):
            text = list(base)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(len(text))] = f"n{rng.integers(10_000)}"
            rows.append(doc(1000 + 10 * family + c, " ".join(text[: len(text) - int(rng.integers(0, 3))])))
    table = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.ngram_components(table, words=k, num=num, den=den, chunk=chunk).collect()
    want = brute_components(rows, k, num, den)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = jaccard.keep_first(table, words=k, num=num, den=den, chunk=chunk)
    assert kept.columns == table.columns
    no_words = {r[0] for r in ROWS if not words(r[1])}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None} | no_words)
    assert jaccard.ngram_components(empty).count() == 0


def test_signatures_meet_for_every_linking_pair():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (4, 5)):
        bound = jaccard.Bound(num, den)
        for n in [1, 2, 5, 9, 10, 13, 14, 19, 27, 40, 55, 100, 333]:
            for _ in range(40):
                pool = rng.integers(0, 2**63, 4 * n + 8, dtype=np.uint64)
                a = np.sort(pool[:n])
                m = int(rng.integers(n, n * den // num + 1))
                both = int(bound.overlap(n, m))
                if both > n:
                    continue
                b = np.sort(np.concatenate([rng.permutation(a)[:both], pool[n : n + m - both]]))
                assert set(jaccard.signatures(a, bound)) & set(jaccard.signatures(b, bound)), (n, m, num)


def test_linked_finds_what_brute_force_finds():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(270, 301))], rng.integers(0, 2**63, int(rng.integers(0, 20)), dtype=np.uint64)])) for _ in range(60)]
    bound = jaccard.Bound(9, 10)
    links = jaccard.linked(sets, np.zeros(60, int), bound)
    assert links and all(10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b])) for a, b in links)


def test_long_texts_shingle_alike():
    import pyarrow as pa

    text = "ab  cd\n" * 200_000 + "Zz" * 10_000
    whole = next(Shingler(3).sets(pa.array([text])))
    w = words(text.lower())
    assert len(whole) == len(set(zip(w, w[1:], w[2:])))


def test_pii(docs, empty):
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )

    def luhn(x):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0

    got = {r.doc_id: r for r in pii.find_pii(docs, None).collect()}
    for r in ROWS:
        out = []
        for kind, p in patterns:
            for m in re.finditer(p, r[1] or ""):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "phone": 8 <= len(digits) <= 15, "card": 16 <= len(digits) <= 19 and luhn(digits)}
                if good.get(kind, kind == "ip" and all(int(x) <= 255 for x in m[0].split(".") if kind == "ip")):
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[r[0]].spans == ",".join(out) and got[r[0]].base_sha256 == hashlib.sha256(",".join(out).encode()).hexdigest()
    assert pii.find_pii(empty, pii.train(empty)).count() == 0
    masked = pii.redact(docs.filter("doc_id = 16"), None).first()
    assert masked.text == "é\U0001f600 [PII]"


def test_pii_model_adds_and_keeps(spark, sf_dir):
    texts = [(i, f"x a{i}@b.com y +1 (438) 555-{1000 + i} z 10.0.0.{i % 250} 300.1.1.{i % 90} and {i}{i + 7}99 12 345") for i in range(200)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    model = pii.train(table)
    base = {r.doc_id: set(r.spans.split(",")) for r in pii.find_pii(table, None).collect()}
    for r in pii.find_pii(table, model).collect():
        assert base[r.doc_id] <= set(r.spans.split(","))


def test_pii_adds_loose_formats(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(400):
        a, b, c = rng.integers(200, 999), rng.integers(100, 999), rng.integers(1000, 9999)
        number = f"call +1 ({a}) {b}-{c} now" if i % 20 else f"call ({a}) {b}-{c} now"
        texts.append((i, f"{number} order {rng.integers(10**7, 10**8)} of 20{rng.integers(10, 25)}-0{rng.integers(1, 9)}-1{rng.integers(9)} ok"))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    model = pii.train(table)
    got = {r.doc_id: r.spans for r in pii.find_pii(table, model).collect()}
    for i, text in texts:
        at = re.search(r"[+(].*? now", text)
        assert got[i] == f"phone:{at.start()}:{at.end() - 4}"  # the local numbers too, orders and dates never
    # a card in other separators stands if its check digit does; parts of an address fit a byte
    assert [r.p for r in spark.sql("VALUES ('4111.1111.1111.1111'), ('4111.1111.1111.1112')").select(pii._possible("card", F.col("col1")).alias("p")).collect()] == [True, False]
    assert [r.p for r in spark.sql("VALUES ('10,0,0,1'), ('1,234,567,890')").select(pii._possible("ip", F.col("col1")).alias("p")).collect()] == [True, False]


def test_pii_samples_all_documents(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLED_SPANS", 1000)
    hot = (-1, " ".join(f"n {10_000_000 + 7919 * i}," for i in range(3000)))
    rest = [(i, f"write a{i}@b.com or call +1 (438) 555-{1000 + i} now") for i in range(200)]
    table = spark.createDataFrame([hot, *rest], "doc_id long, text string").coalesce(1)
    model = pii.train(table)  # the first 1,000 candidates are all of one document
    assert model is not None and set(model.thresholds) == {0, 3}
    spans = [(i, k, s) for i, k, n in ((1, 0, 60), (2, 3, 5000)) for s in range(n)]
    spread = lambda n: {tuple(r) for r in pii._spread(spark.createDataFrame(spans, "i long, kind int, start int").repartition(n), 400).collect()}
    got = spread(1)
    assert got == spread(7) and sum(k == 0 for _, k, _ in got) == 60 and 280 < len(got) - 60 < 400
    assert max(s for _, k, s in got if k == 3) > 4000


def test_pii_learns_from_all_documents(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(pii, "stored", lambda rows, label: learnt.append(rows) or rows)
    text = F.concat(F.lit("write a"), F.col("id"), F.lit("@b.com or 12345678, "))
    model = pii.train(spark.range(24_000).select(F.col("id").alias("doc_id"), text.alias("text")))
    got = {(r.kind, r.label): r.n for r in learnt[0].groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    assert model is not None and got == {(0.0, 1.0): 48_000, (3.0, 0.0): 24_000}  # each address in both its forms
    assert learnt[0].count() < 100


def test_shards(spark, docs, empty):
    rows = [(i, "x" * (i % 90)) for i in range(800)] + [(5000, "same text")] * 300 + [(6000, "y" * 5000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=1000).collect()
    sizes, counts = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
        counts[r.shard] += 1
    assert len(got) == len(rows) and sum(sizes.values()) == sum(len(t) for _, t in rows)
    assert all(b <= 1000 or counts[s] == 1 for s, b in sizes.items())
    plain = [s for s in sizes if "." not in s]
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)  # buckets are apart
    assert sharding.shards(docs).count() == len(ROWS) and sharding.shards(empty).count() == 0


def test_mix(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 40), None if i % 5 == 4 else f"s{i % 5}") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table).collect()), key=str)
    size = collections.Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    out = mixing.mixed_rows(table)
    assert out.columns == table.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_source_caps(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, None, "c")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].target == 30 and got[2].target == pytest.approx(980) and got[3].target == 0 and got[1].taken == 30


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, ids=True).collect()
    whole = collections.Counter()
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        for start in range(0, len(ids), 4096):
            piece = np.array(ids[start : start + 4096], "<u4").tobytes()
            whole[(r[0], start, len(piece) // 4, zlib.crc32(piece), len(ids), piece)] += 1
    assert whole == collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got)
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and packing.pack(empty).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = sorted(map(int, rng.integers(1, 101, 500)), reverse=True)
    room, want = [], []
    for s in sizes:
        at = next((i for i, free in enumerate(room) if free >= s), len(room))
        if at == len(room):
            room.append(100)
        want.append((at, 100 - room[at]))
        room[at] -= s
    assert list(zip(*packing.first_fit(sizes, 100))) == want


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        text = [f"w{rng.integers(300)}" for _ in range(60)]
        toxic, good = i % 6 == 0, i % 4 != 1
        if toxic:
            for _ in range(4):
                text[rng.integers(60)] = ("scumbag", "idiot", "trashy")[rng.integers(3)]
        if not good:
            text = ["###" + w for w in text]
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 10))
        labels.append((i, int(good), int(toxic)))
    rows += [(None, None, None, None, None), (5000, "", "en", "s0", 0), (5000, "", "en", "s0", 0)]
    labels += [(None, 1, 1), (5001, None, None), (99999, 0, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity(judged):
    docs, labels = judged
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    test = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(test)) for i in range(900))
    assert np.mean([got[i].predicted == truth[i] for i in test]) > 0.95
    assert 0 <= got[5000].score < 0.7 and got[None].predicted == 0
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in toxicity.score_toxicity(docs, labels).collect())
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_drops_only_near_copies():
    rng = np.random.default_rng(4)
    # Long texts over a small stock of words: they share their common features, so few minima collide by chance.
    rows = [np.sort(rng.choice(1500, rng.integers(300, 700), replace=False)) for _ in range(300)]
    copies = [np.unique(np.append(r[12:], rng.integers(200_000, 250_000, 5))) for r in rows[:40]]
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert max(alike(a, b) for i, a in enumerate(rows) for b in rows[:i]) < 0.6
    kept = toxicity._unlike([toxicity._minima(r) for r in rows + copies + rows[:20]])
    assert kept == list(range(300))
    none = np.empty(0, np.int64)
    assert toxicity._unlike([toxicity._minima(none)] * 2) == [0] and toxicity._unlike([]) == []


def test_quality_classifier(judged):
    docs, labels = judged
    got = {r.doc_id: r for r in quality_classifier.classify_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].kept == bool(truth[i]) for i in test]) > 0.95
    assert quality_classifier.classify_quality(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in quality_classifier.classify_quality(docs, labels.limit(0)).collect())


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from marketloom.llm.common import table
    from marketloom.session import stored

    docs, columns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents").columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.collect()]
        if name == "exact_dedup":
            texts = {r.doc_id: SPACE.sub("", r.text) for r in before.collect()}
            assert len(kept[name]) == len(set(texts.values())) == len({texts[i] for i in kept[name]})
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(kept[name]) == sorted({c for _, _, c in brute_components(rows, 5, 4, 5)})
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in got} == set(kept["mix"]) and sum(r.start == 0 for r in got) == len(kept["mix"])
