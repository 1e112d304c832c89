"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text. The ledger keeps all measurements and one integer whose bit i says that rule i
failed. Policies are versioned masks: applying one is a bitwise and, and an ablation counts, from the stored bits alone, how
many texts each rule alone holds back. All of it is DataFrame functions; the ledger needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: name -> whether the rule fails, over the measurements; the order gives the bits and never changes, new rules follow.
RULES = {
    "too_few_words": lambda: F.col("n_words") < 20,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > 6 * F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    "shouting": lambda: 2 * F.col("n_bangs") > F.col("n_words"),
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: What the contract's base is made of.
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
#: Versions of the policy: the rules that hold a text back.
POLICIES = {"base": BASE, "v1": BASE | BITS["symbols"] | BITS["repeated_lines"], "v2": (1 << len(RULES)) - 1}


def _let(value: Column, then) -> Column:
    """`then` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, each counted once, from the hashes of all windows in order."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j).getField("h") == x.getField("h"), F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: (same(x, j - 1) & (j > 0)) | same(x, j + 1)), lambda x: x.getField("i")))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    step = lambda a, x: F.struct(x.alias("last"), (a.getField("total") + F.least(F.lit(WINDOW), x - a.getField("last"))).alias("total"))
    return F.aggregate(_let(ordered, places), start, step, lambda a: a.getField("total"))


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with all measurements, without the text; null counts as empty.

    The steps are columns that later ones use more than once, so the optimizer keeps each of them and none is made twice.
    """
    rest = [c for c in rows.columns if c != text]
    rows = rows.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    count = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    rows = rows.select(
        *rest,
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        count("!").alias("n_bangs"),
    )
    made = ["word_chars", "n_symbols", "n_bangs"]
    rows = rows.select(
        *rest,
        *made,
        F.size("__words").alias("__n"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    made += ["n_lines", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW), lambda i: F.xxhash64(*(F.get("__hashes", i + j) for j in range(WINDOW))))
    rows = rows.select(*rest, *made, F.col("__n").cast("long").alias("n_words"), F.when(F.col("__n") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("__windows"))
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return rows.select(*rest, "n_words", *made, F.when(again, _covered(F.col("__windows"))).otherwise(0).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the measurements, failed (bit i: rule i of RULES failed).

    One row for each row of docs: nulls and repeats stay, a null text is an empty one, which fails too_few_words. Other
    columns are ignored.
    """
    rows = measured(docs.select("doc_id", "text"))
    bits = (F.when(rule(), F.lit(BITS[name])).otherwise(0) for name, rule in RULES.items())
    return rows.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept, the verdict of a policy."""
    has = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumns({"base_failed": has(BASE), "kept": ~has(POLICIES[version] | BASE)})


def ablations(rows: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: how many rows fail it, and how many would be kept without it, from the stored bits."""
    mask = POLICIES[version] | BASE
    own = F.col("failed").bitwiseAND(F.lit(mask))
    counts = rows.groupBy(own.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # as many groups as combinations of bits
    names = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BITS.items() if bit & mask))
    each = counts.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
