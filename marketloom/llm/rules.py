"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure and every rule is a built-in expression over one row's whole text,
so the operator is one scan without a shuffle and without user functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.binding import bind
from marketloom.llm.common import NOT_SPACE, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages handled.
STOP_WORDS = (
    "the of and to in is was that for it on with as be at by this from are or an a "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im "
    "le la les de des et un une est que dans pour par sur au avec qui "
    "el los las del y en una por con se su para como no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails where ``measure`` is outside [least, most]; a null bound is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Shares are of words (or of lines where named so).
THRESHOLDS = (
    Rule("too_long", "n_words", most=1_000_000),
    Rule("word_length", "mean_word_chars", least=2.0, most=14.0),
    Rule("symbols", "symbol_ratio", most=0.2),
    Rule("shouting", "shout_ratio", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.3),
)


def _repeat_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` that occur twice or more in the text, the first included.

    Windows are sorted with their positions, so equal ones stand side by side:
    n log n, whatever the text. Windows are told apart by 64-bit hash.
    """
    n = F.size(words)
    window = lambda w, i: F.struct(
        F.xxhash64(*[F.get(words, i + j) for j in range(size)]).alias("h"), i.alias("p")
    )
    windows = F.when(n >= size, F.transform(F.slice(words, 1, F.greatest(n - (size - 1), F.lit(0))), window))
    empty = F.array().cast("array<int>")

    def repeated(s: Column) -> Column:
        at = lambda x, i: F.when(
            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            x["p"],
        )
        return F.sort_array(F.array_compact(F.transform(s, at)))

    def covered(p: Column) -> Column:
        step = lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))
        return F.aggregate(F.transform(p, step), F.lit(0).cast("bigint"), lambda a, x: a + x)

    found = bind(lambda s: repeated(s), s=F.sort_array(windows))
    return bind(lambda p: covered(p), p=F.coalesce(found, empty))


def _measures(text: Column, words: Column) -> dict[str, Column]:
    symbols = F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    stops = F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": symbols.cast("bigint"),
        "n_shouts": F.length(F.regexp_replace(text, "[^!?]+", "")).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": bind(lambda x: F.size(x) - F.size(F.array_distinct(x)), x=lines).cast("bigint"),
        "n_stop_words": F.size(stops).cast("bigint"),
        "n_repeat_words": _repeat_words(words),
    }


def _ratios(m: Column) -> dict[str, Column]:
    per = lambda a, b: F.when(m[b] > 0, m[a] / m[b])
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "shout_ratio": per("n_shouts", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }


def compiled(m: Column, rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The names of the rules that a row of measures fails, in the order of the table."""
    ratios = _ratios(m)

    def fails(rule: Rule) -> Column:
        value, outside = ratios[rule.measure], F.lit(False)
        if rule.least is not None:
            outside = outside | (value < rule.least)
        if rule.most is not None:
            outside = outside | (value > rule.most)
        return F.when(F.coalesce(outside, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*[fails(r) for r in rules]))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS
) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept and failed_rules.

    A null or empty text has no words, fails the base rule and is not kept. Rows
    repeat as they come; an empty table gives no rows; other columns are ignored.
    """
    text = text_of(text_col)
    measures = bind(
        lambda t, w: F.struct(*[c.alias(k) for k, c in _measures(t, w).items()]), t=text, w=words_of(text)
    )
    verdict = bind(
        lambda m: F.struct(
            *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ((m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])).alias("base_failed"),
            compiled(m, rules).alias("failed_rules"),
        ),
        m=measures,
    )
    out = docs.select(F.col(id_col).alias("doc_id"), verdict.alias("v")).select("doc_id", "v.*")
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select(*[c for c in out.columns if c != "failed_rules"], kept.alias("kept"), "failed_rules")
