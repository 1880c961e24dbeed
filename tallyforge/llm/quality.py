"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps what each rule measured and one failure bit a
rule; policies are versioned sets of rules applied to the bits later, and ablations come from the counts
of distinct bit patterns, so neither touches the texts again. Built-in functions only.

Null and empty texts have no words and fail ``few_words``. Repeated rows are judged one by one. Documents
keep their other columns apart: the ledger has only its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; shares are in hundredths."""

    min_words: int = 10
    max_repeat_share: int = 20
    max_symbols_per_100_words: int = 10
    max_dup_line_share: int = 30
    max_mean_word_chars: int = 25
    max_upper_share: int = 50


#: Rules by bit, in order; the names are the ledger's vocabulary.
RULES = ("few_words", "repeated_windows", "symbols", "dup_lines", "long_words", "upper_case")

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "quality-1": ("few_words", "repeated_windows", "symbols", "dup_lines"),
    "quality-2": RULES,
}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeat_words(list_: Column, k: int = WINDOW) -> Column:
    """How many words lie in a k-word window that occurs twice or more in the same list of words."""
    return let(list_, lambda w: _repeat_words(w, k))


def _repeat_words(w: Column, k: int) -> Column:

    def counted(win: Column) -> Column:
        def covered(pos: Column) -> Column:
            steps = F.transform(pos, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(pos, i + 1) - p, F.lit(k))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        def marked(s: Column) -> Column:
            # Windows of equal hash are neighbours in order; their words decide.
            def same(x: Column, i: Column) -> Column:
                y = F.get(s, i)
                out = y["h"] == x["h"]
                for j in range(k):
                    out = out & (F.get(w, x["i"] + j) == F.get(w, y["i"] + j))
                return F.coalesce(out, F.lit(False))

            twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

        pairs = F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), let(F.sort_array(pairs), marked)).otherwise(0)

    def windows(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])), counted)

    return F.when(F.size(w) >= k, let(F.transform(w, lambda x: F.xxhash64(x)), windows)).otherwise(0).cast("long")


def ledger(docs: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, the measurements and ``fail_bits`` (bit i set: rule i of RULES failed)."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, t.alias("_t"), words(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l"))
    measured = split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    c = F.col
    fails = (
        c("n_words") < limits.min_words,
        100 * c("n_repeat_words") > limits.max_repeat_share * c("n_words"),
        100 * c("n_symbols") > limits.max_symbols_per_100_words * c("n_words"),
        100 * c("n_dup_lines") > limits.max_dup_line_share * c("n_lines"),
        c("word_chars") > limits.max_mean_word_chars * c("n_words"),
        100 * c("n_upper") > limits.max_upper_share * c("word_chars"),
    )
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def failed(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: documents it fails, and those that only it rejects.

    Works on counts of distinct bit patterns (at most 2 to the number of rules), combined bitwise.
    """
    m = mask(policy)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n"))), F.lit(0)).alias("kept_without_rule"),
    )


def keep_good(docs: DataFrame, policy: str = "quality-2", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, all columns, that the policy does not reject."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")
    return ledger(docs.select(row, F.col("text").alias("_text")), limits, ("_row",), "_text").where(~failed(policy)).select("_row.*")
