"""Document quality rules: a threshold table compiled into Spark projections of built-in functions.

No user function runs. Three projections follow one another only so that the word array, the trigram hashes and the
counts are computed once each; Catalyst keeps them in one stage without a shuffle.

Defined results: a null text has no words, no lines and no symbols, so every count is 0 and base_failed is true. An empty
text is the same. A very long text is counted whole; from 2^24 windows on a wider form of the sort keys is used. Repeated rows
are judged one by one. Other columns of the input are kept and never read, unless their
names clash with a result's: then the result replaces them. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

# Common function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the be to of and that have with a in is it for on as are this was at by an from or which not but his they had you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si es".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a bound of None is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Metric names are keys of ``metrics()``. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_word_share", None, 0.5),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.005, None),
    Rule("dup_line_share", None, 0.5),
    Rule("upper_char_share", None, 0.6),
)


def metrics() -> dict[str, Column]:
    """Ratios over the counts of ``with_counts``; all are 0 for a text without words or lines."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_share": F.col("n_stop_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_char_share": F.col("n_upper") / chars,
    }


def compile_rules(rules=RULES) -> Column:
    """The conjunction of all thresholds as one boolean column."""
    known, verdict = metrics(), F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (known[rule.metric] >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (known[rule.metric] <= F.lit(rule.high))
    return verdict


#: Bits of the sort key that hold a word's position; longer texts take the wide form of the key.
_POSITION_BITS = 24


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _packed() -> Column:
    """The window hashes with their positions in the low bits, as sorted primitive longs; empty where positions need more bits."""
    high = F.lit(-1 << _POSITION_BITS)
    packed = F.transform("_grams", lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("bigint")))
    return F.when(F.size("_grams") < F.lit(1 << _POSITION_BITS), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _near() -> Column:
    """Positions of windows whose high hash bits equal a neighbour's: a superset of the repeated windows, and few."""
    high = lambda i: F.shiftright(F.get("_packed", i), _POSITION_BITS)
    position = lambda i: F.get("_packed", i).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
    same = F.filter(F.sequence(F.lit(0), F.size("_packed") - 1), lambda i: _equal(high(i), high(i - 1)) | _equal(high(i), high(i + 1)))
    return (
        F.when(F.size("_grams") >= F.lit(1 << _POSITION_BITS), F.sequence(F.lit(0), F.size("_grams") - 1))
        .when(F.size("_packed") > 1, F.transform(same, position))
        .otherwise(F.array().cast("array<int>"))
    )


def _pairs() -> Column:
    """Full hash and position of these windows, sorted: equal neighbours are the repeated windows."""
    return F.sort_array(F.transform("_near", lambda i: F.struct(F.get("_grams", i).alias("h"), i.alias("i"))))


def _starts() -> Column:
    hash_at = lambda i: F.get("_pairs", i)["h"]
    repeated = F.filter(F.sequence(F.lit(0), F.size("_pairs") - 1), lambda i: _equal(hash_at(i), hash_at(i - 1)) | _equal(hash_at(i), hash_at(i + 1)))
    starts = F.sort_array(F.transform(repeated, lambda i: F.get("_pairs", i)["i"]))
    return F.when(F.size("_pairs") > 1, starts).otherwise(F.array().cast("array<int>"))


def with_counts(df: DataFrame, text: str = "text", stop_words=None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines and n_upper (long)."""
    stop = sorted({w for ws in (stop_words or STOP_WORDS).values() for w in ws})
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in df.columns if c not in COUNTS]
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE))
    out = df.select(
        *keep,
        F.filter(F.split(body, SPACE), lambda w: w != "").alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
    )
    words = F.col("_words")
    grams = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.select(
        *keep, "word_chars", "n_symbols", "n_upper",
        F.size(words).cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("bigint").alias("n_stop_words"),
        grams.alias("_grams"),
    )
    # Words inside 3-word windows that occur at least twice, found without comparing all windows with each other.
    for name, step in (("_packed", _packed), ("_near", _near), ("_pairs", _pairs), ("_starts", _starts)):
        out = out.withColumn(name, step())
    # Each start covers three words; less where the next start is nearer.
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - s, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x.cast("bigint"),
    )
    return out.select(*keep, *[covered.alias(c) if c == "n_repeat_words" else F.col(c) for c in COUNTS])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_upper")


def judge(df: DataFrame, text: str = "text", rules=RULES, stop_words=None) -> DataFrame:
    """Adds the counts, base_failed and kept. ``kept`` is true where the base holds and every rule of the table does."""
    counted = with_counts(df.drop("base_failed", "kept"), text, stop_words)
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return counted.withColumns({"base_failed": base, "kept": ~base & compile_rules(rules)})


def keep(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that the rules keep, with the input's columns.

    The filter also reads a random column. That changes no row, but it stops the optimizer from moving the filter below the
    projections, where it would write each of their expressions out many times over.
    """
    judged = judge(df.select("*", F.col(text).alias("_text")), "_text", rules).withColumn("_barrier", F.rand(0))
    return judged.where(F.col("kept") & (F.col("_barrier") >= 0)).select(*df.columns)
