"""Personal data by candidate gradient boosting.

High-recall patterns propose spans, which may overlap. Boosted trees judge each
from its format and context; thresholds calibrated per kind on candidates the
trees have not seen decide which are selected beside the base spans. The trees
are trained by Spark's own boosting and compiled into expressions, so scoring is
one projection over whole texts.

The trees learn from the base rules: valid base spans, also rewritten in the loose
forms that the base patterns do not know, are the positives; candidates apart from
all base spans are the negatives. No feature tells whether a span follows the base
rule (plus sign, check digit, size of a byte, dotted domain), so a candidate is judged
by its format and by what stands around it. What is added must still be possible: a
card number passes its check digit, the parts of an address fit a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.binding import bind
from marketloom.llm.common import text_of
from marketloom.session import stored

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, written so that they take linear time on any text and
# need no deep recursion: a run is only entered at its start (or where the last
# match ended), and loops do not give back. What they match is the same.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_ODD = r"[^\s@<>(),;:\"]"
WIDE = {
    "email": rf"(?:\G|(?<!{_ODD})){_ODD}++@{_ODD}++",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:[.,:][0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])[+(]?[0-9][0-9 ()./-]{6,24}[0-9](?![0-9])",
}
#: Words that announce personal data.
CUES = "(?i)(mail|contact|write|reach|tel|phone|call|fax|mobile|cell|card|visa|account|payment|host|server|address|login|ip)"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FEATURES = (
    "kind", "digits", "chars", "marks", "runs", "bracket", "dots", "letters", "free_before", "free_after", "cue",
)
#: All candidates are learnt from. A caller with no time for that may set about how many at most.
SAMPLED_SPANS: int | None = None
TREES, DEPTH = 8, 3
PRECISION = 0.95  # asked of a threshold on held-out candidates
BLOCK = 256


def _before(lengths: Column) -> Column:
    """Sums of all earlier elements; in blocks, so that long arrays are not copied over and over."""
    empty = F.array().cast("array<int>")
    run = lambda xs, value: F.aggregate(
        xs,
        F.struct(F.lit(0).alias("s"), empty.alias("a")),
        lambda acc, x: F.struct((acc["s"] + value(x)).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")),
    )

    def joined(parts: Column, offsets: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.transform(p["a"], lambda x: x + F.get(offsets, i))))

    def whole(n: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        parts = F.transform(starts, lambda b: run(F.slice(n, b * BLOCK + 1, BLOCK), lambda x: x))
        with_offsets = lambda p: bind(joined, parts=p, offsets=run(p, lambda x: x["s"])["a"])
        return bind(with_offsets, p=parts)

    return bind(lambda n: F.when(F.size(n) > 0, whole(n)).otherwise(empty), n=lengths)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost matches: value, start and end in code points, and the text on both sides."""

    def spans(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))

        def placed(before: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                return F.struct(
                    v.alias("value"),
                    start.alias("start"),
                    (start + F.length(v)).alias("end"),
                    F.right(F.get(gaps, i), F.lit(24)).alias("left"),
                    F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"),
                )

            return F.transform(found, span)

        return bind(placed, before=_before(lengths))

    return bind(spans, found=F.regexp_extract_all(text, F.lit(pattern), 0), gaps=F.split(text, pattern, -1))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _guarded(kind: str, text: Column, spans: Column) -> Column:
    """Most texts have no such character at all; they need no search."""
    has = {"email": text.contains("@"), "phone": text.rlike("[0-9]")}.get(kind, text.rlike("[0-9]"))
    return F.when(has, spans)


def _base(text: Column) -> Column:
    """The contract's spans of all kinds, by kind, then start."""
    def of_kind(number: int, kind: str) -> Column:
        good = F.filter(_matches(text, BASE[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(good, lambda m: _span(number, m))
        return F.coalesce(_guarded(kind, text, spans), F.array().cast("array<struct<kind:int,start:int,end:int>>"))

    return F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])


def _span(kind: int, m: Column, *more: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *more)


def _features(kind: int, m: Column) -> dict[str, Column]:
    value, digits = m["value"], _digits(m["value"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda keep: F.length(F.regexp_replace(value, f"[^{keep}]+", "")).cast("double")
    return {
        "kind": F.lit(float(kind)),
        "digits": F.length(digits).cast("double"),
        "chars": F.length(value).cast("double"),
        "marks": F.length(F.regexp_replace(value, "[A-Za-z0-9]+", "")).cast("double"),
        "runs": F.size(F.array_remove(F.split(value, "[^0-9]+"), "")).cast("double"),
        "bracket": flag(value.contains("(")),
        "dots": count("."),
        "letters": count("A-Za-z"),
        "free_before": flag((m["left"] == "") | m["left"].rlike(r"\s$")),
        "free_after": flag(F.coalesce(m["right"] == "", F.lit(True)) | m["right"].rlike(r"[\s.,;:!?)]")),
        "cue": flag(m["left"].rlike(CUES)),
    }


def _possible(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:[.,:]{BYTE}){{3}}$")
    return _luhn(_digits(value)) if kind == "card" else F.lit(True)


def _loose(kind: str, value: Column) -> list[Column]:
    """A base span as it stands, then in forms that the base pattern does not find."""
    if kind == "email":
        return [value, F.regexp_replace(value, r"(@[^.]+)\..*$", "$1")]
    if kind == "ip":
        return [value, F.translate(value, ".", ","), F.translate(value, ".", ":")]
    if kind == "card":
        digits = _digits(value)
        fours = lambda mark: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{mark}")
        return [value, fours("."), fours("/"), F.left(digits, F.lit(15)), F.left(digits, F.lit(13))]
    local = F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]*", "")
    parted = lambda mark: F.array_join(F.array_remove(F.split(local, "[^0-9]+"), ""), mark)
    return [value, F.regexp_replace(value, r"^\+", ""), local, parted("-"), parted("."), parted(" ")]


_FEATURES = "struct<" + ",".join(f"{k}:double" for k in FEATURES) + ">"


def _described(kind: int, m: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in _features(kind, m).items()])


def _candidates(text: Column) -> Column:
    """Proposed spans of all kinds with their features."""

    def of_kind(number: int, kind: str) -> Column:
        possible = F.filter(_matches(text, WIDE[kind]), lambda m: _possible(kind, m["value"]))
        spans = F.transform(possible, lambda m: _span(number, m, _described(number, m).alias("f")))
        none = F.array().cast(f"array<struct<kind:int,start:int,end:int,f:{_FEATURES}>>")
        return F.coalesce(_guarded(kind, text, spans), none)

    return F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])


def _examples(text: Column) -> Column:
    """The base spans in all their forms: kind, start, features and the form's share of its span."""

    def of_kind(number: int, kind: str) -> Column:
        good = F.filter(_matches(text, BASE[kind]), lambda m: _valid(kind, m["value"]))

        def forms(m: Column) -> Column:
            values = _loose(kind, m["value"])

            def row(value: Column) -> Column:
                written = F.struct(value.alias("value"), m["left"].alias("left"), m["right"].alias("right"))
                f = bind(lambda w: _described(number, w), w=written).alias("f")
                return F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), f, F.lit(1.0 / len(values)).alias("weight"))

            return F.array(*[row(v) for v in values])

        spans = F.flatten(F.transform(good, forms))
        none = F.array().cast(f"array<struct<kind:int,start:int,f:{_FEATURES},weight:double>>")
        return F.coalesce(_guarded(kind, text, spans), none)

    return F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])


def _apart(c: Column, base: Column) -> Column:
    return ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, and a threshold per kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[int, float]

    def margin(self, f: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, at, low, high = node
            return F.when(f[name] <= at, value(low)).otherwise(value(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + value(tree) * weight
        return total

    def selects(self, candidate: Column) -> Column:
        chosen = F.lit(False)
        for kind, least in self.thresholds.items():
            chosen = chosen | ((candidate["kind"] == kind) & (self.margin(candidate["f"]) >= least))
        return chosen


def _tree(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def _spread(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most over all documents, chosen by a hash: small kinds whole, the others equally many."""
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    chosen = F.lit(False)
    for done, (kind, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        share = max(1, most // (len(counts) - done))
        most -= min(n, share)
        # Forms of one span have one hash: they go or stay together.
        part = F.lit(True) if n <= share else F.pmod(F.xxhash64("i", "kind", "start", F.lit(5)), F.lit(n)) < share
        chosen = chosen | ((F.col("kind") == kind) & part)
    return rows.filter(chosen)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model, from the candidates of all documents; None if they are all alike."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    every = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("text"))

    def others(base: Column, wide: Column) -> Column:
        return F.filter(wide, lambda c: _apart(c, base))

    text = F.col("text")
    good = every.select("i", F.explode(_examples(text)).alias("c")).select("i", "c.*", F.lit(1.0).alias("label"))
    wide = every.select("i", F.explode(bind(others, base=_base(text), wide=_candidates(text))).alias("c"))
    wide = wide.select("i", "c.kind", "c.start", "c.f", F.lit(1.0).alias("weight"), F.lit(0.0).alias("label"))
    rows = good.unionByName(wide)
    rows = rows if SAMPLED_SPANS is None else _spread(rows, SAMPLED_SPANS)
    check = F.pmod(F.xxhash64("i", "start"), F.lit(4)) == 0  # all forms of a span on one side
    rows = rows.select("f.*", "weight", "label", check.alias("check"))
    # Candidates alike in all that is learnt are one row of their common weight: the trees hold no copies.
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows.withColumn("weight", F.col("weight") * F.col("n")), "pii-candidates")
    seen = {r[0]: r[1] for r in rows.filter("NOT check").groupBy("label").agg(F.sum("n")).collect()}
    if len(seen) < 2 or min(seen.values()) < 5:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="weight")
    fitted = trees.fit(vectors.filter("NOT check"))
    trees = tuple(_tree(t._java_obj.rootNode()) for t in fitted.trees)
    model = Model(trees, tuple(float(w) for w in fitted.treeWeights), {})
    f = F.struct(*[F.col(k) for k in FEATURES])
    scored = rows.filter("check").select(F.col("kind").cast("int").alias("kind"), bind(lambda f: model.margin(f), f=f).alias("z"), "label", "weight")
    # As many rows as there are kinds and distinct leaves' sums: bounded by the trees.
    counts = scored.groupBy("kind", "z").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).collect()
    thresholds = {}
    for kind in range(len(KINDS)):
        good = every = 0
        for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["z"]):
            good, every = good + r["good"], every + r["all"]
            if good >= PRECISION * every and r["z"] > 0:
                thresholds[kind] = float(r["z"])
    return Model(trees, model.weights, thresholds)


def _all_spans(base: Column, wide: Column, model: Model | None) -> Column:
    if model is None or not model.thresholds:
        return base
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    added = F.filter(wide, lambda c: model.selects(c) & _apart(c, base))
    return F.sort_array(F.concat(base, F.transform(added, plain)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def _found(text: Column, model: Model | None) -> Column:
    def both(base: Column, wide: Column) -> Column:
        return F.struct(base.alias("base"), _all_spans(base, wide, model).alias("spans"))

    return bind(both, base=_base(text), wide=_candidates(text))


def find_pii(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans; ``spans`` has all, base ones always
    included. Positions are code points, end exclusive. Null text counts as empty
    and has none (the digest of the empty string). Without a model only base
    spans are found. Repeated rows repeat; an empty table gives no rows.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), _found(text_of(text_col), model).alias("x"))
    number = lambda k: F.size(F.filter("x.base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [number(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    base = F.sha2(_written(F.col("x.base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, _written(F.col("x.spans")).alias("spans"))


def redact(docs: DataFrame, model: Model | None, text_col: str = "text", mask: str = "[PII]") -> DataFrame:
    """The documents with every found span replaced by ``mask``; overlapping spans by one."""

    def masked(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept, F.lit(mask))).otherwise(acc["out"])
            return F.struct(more.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        done = F.aggregate(spans, start, step)
        return bind(lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))), d=done)

    def by_place(found: Column) -> Column:
        return F.sort_array(F.transform(found["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    text = text_of(text_col)
    return docs.withColumn(text_col, bind(masked, text=text, spans=bind(by_place, found=_found(text, model))))
