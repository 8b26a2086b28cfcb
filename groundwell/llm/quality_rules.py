"""Quality rules: a threshold table compiled into one Spark projection.

No user function runs: word windows, repeated lines and ratios are built-in
array and string functions, evaluated row by row without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which
    a one you were all her she there would their we him been has when who will no more if out so
    le la les de des du un une et est que qui dans pour pas sur au avec ce il elle sont par plus ne se en
    der die das und ist den von zu mit sich auf für nicht dem ein eine als auch es an werden aus im
    el los las y del se con una su al lo como más pero sus""".split()
)
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= numerator / denominator <= high``; an empty denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")


#: What the base measures may be, besides the contract's own base rule.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.5),
)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included.

    Windows are compared by a 64-bit hash of their words. Most texts repeat
    nothing, so the sort that finds the repeats runs only where a hash repeats.
    """

    def in_repeats(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hit(s: Column) -> Column:
            same = lambda k, j: (k + j >= 0) & (k + j < F.size(s)) & (F.get(s, k + j)["h"] == F.get(s, k)["h"])
            at = F.transform(F.filter(s, lambda x, k: same(k, -1) | same(k, 1)), lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bound(placed, hit))

    windows = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_bound(w, lambda v: _bound(windows(v), in_repeats))).cast("long")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds struct column ``q`` with every measure that a rule may name."""
    body = F.coalesce(F.col(text), F.lit(""))
    w, lines = F.col("__w"), F.col("__lines")
    return (
        df.withColumns({"__w": words(body), "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
        .withColumn(
            "q",
            F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(lines).cast("long").alias("n_lines"),
            ),
        )
        .drop("__w", "__lines")
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over ``q``, in products, so that nothing divides by zero."""
    passed = F.lit(True)
    for r in rules:
        num, den = F.col(f"q.{r.numerator}").cast("double"), F.col(f"q.{r.denominator}").cast("double")
        if r.low != float("-inf"):
            passed &= num >= den * F.lit(r.low)
        if r.high != float("inf"):
            passed &= num <= den * F.lit(r.high)
    return passed


def base_failed(least_words: int = 50, most_repeated_percent: int = 50) -> Column:
    return (F.col("q.n_words") < least_words) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * most_repeated_percent)


def quality_rules(df: DataFrame, text: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id, the five base measures, ``base_failed`` and ``kept``.

    A null text is an empty one: no words, so it fails the base rule. An empty
    table gives no rows; repeated rows are judged alike; other columns are
    neither read nor returned, so their names cannot clash.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = measures(slim, "body").select(F.col("id").alias(id_col), *[F.col(f"q.{n}").alias(n) for n in names], base_failed().alias("base_failed"), verdict(rules).alias("__ok"))
    return scored.select(id_col, *names, "base_failed", (~F.col("base_failed") & F.col("__ok")).alias("kept"))


def keep_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, columns unchanged: a filter without a shuffle."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("body"))
    return measures(whole, "body").where(~base_failed() & verdict(rules)).select("row.*")
