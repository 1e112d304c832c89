"""Spelling variants: words one edit apart, found by bands of letter-parity masks, and the form that each word varies.

A word's mask has a bit for each letter (other code points share the bits), set where the letter occurs an odd number of times.
One inserted, deleted or replaced code point flips at most two bits, so of three bands of the mask one is equal in both words.
Words are joined on an equal band and on the length they are compared at. A band alone has few values, so a large vocabulary
would crowd it: its buckets are divided further, exactly, by what one edit leaves whole, the first or the last half of the
shorter word. A pair is verified where it meets first, so none is listed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]"
#: Letters of the three bands, dealt so that each has frequent and rare ones; code points beyond a-z go by their number.
BANDS = ("eoltmjvbw", "anducgkqy", "isrphfxz")
WIDTH = 16
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many, by its crc32, loses a code point.
SLIPS = 31


def word_counts(docs: DataFrame, slips: int = SLIPS) -> DataFrame:
    """docs (doc_id, text) -> word, n: the words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Words are maximal runs of letters, A-Z lower-cased; where `slips` divides h, the crc32 of "<doc_id>:<run>", the run loses its
    code point h modulo its length. A null doc_id counts as no characters there, a null text has no words. Repeated rows count
    again. Runs that cannot give a long enough word are left out before rows are made of them.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), 1)).alias("run"))
    rows = rows.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def band_masks(word: Column) -> list[Column]:
    """The three bands of a word's letter-parity mask, as ints."""
    plain = "".join(BANDS)

    def band(k: int) -> Column:
        letters = BANDS[k]
        parity = [F.shiftleft(F.pmod(F.length(word) - F.length(F.translate(word, c, "")), F.lit(2)), i) for i, c in enumerate(letters)]
        mask = parity[0]
        for p in parity[1:]:
            mask = mask.bitwiseOR(p)
        rest = F.translate(word, plain, "")  # mostly empty
        spare = WIDTH - len(letters)
        others = F.aggregate(
            F.filter(F.split(rest, ""), lambda c: F.pmod(F.ascii(c), F.lit(3)) == k),
            F.lit(0),
            lambda m, c: m.bitwiseXOR(F.element_at(F.array(*(F.lit(1 << (len(letters) + i)) for i in range(spare))), (F.pmod(F.floor(F.ascii(c) / 3), F.lit(spare)) + 1).cast("int"))),
        )
        return F.when(rest == "", mask).otherwise(mask.bitwiseXOR(others))

    return [band(k) for k in range(len(BANDS))]


def _keys(words: DataFrame) -> DataFrame:
    """One row for each word, band, half and length that it is compared at: its own as the shorter, one less as the longer."""
    length = F.length("word")
    small = length - F.col("longer")
    half = F.floor(small / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")),
        F.struct(F.lit(1).alias("side"), F.substring("word", half + 1 + F.col("longer"), length).alias("part")),
    )
    rows = words.select("word", "n", *(m.alias(f"m{k}") for k, m in enumerate(band_masks(F.col("word")))), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = rows.select("word", "n", "m0", "m1", "m2", "longer", small.alias("small"), F.inline(sides))
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("value")) for k in range(len(BANDS))))
    return rows.select("*", F.inline(bands))


def _apart(u: Column, v: Column) -> Column:
    """Whether two words that differ are one edit apart."""
    return F.levenshtein(u, v, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n -> u, n_u, v, n_v: all pairs one edit apart, once each, u the shorter or, of equal lengths, the smaller."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(words.repartition(tasks, "word"))  # twelve keys a word: a small table of many words is no few tasks' work
    on = ["small", "side", "part", "band", "value"]
    a = keys.where("longer = 0").select(*on, F.col("word").alias("u"), F.col("n").alias("n_u"), *(F.col(f"m{k}").alias(f"a{k}") for k in range(3)))
    b = keys.select(*on, F.col("word").alias("v"), F.col("n").alias("n_v"), "longer", *(F.col(f"m{k}").alias(f"b{k}") for k in range(3)))
    flips = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(3)), F.lit(0))
    first_band = F.when(F.col("a0") == F.col("b0"), 0).when(F.col("a1") == F.col("b1"), 1).otherwise(2)
    half = F.floor(F.col("small") / 2).cast("int")
    same_front = F.substring("u", F.lit(1), half) == F.substring("v", F.lit(1), half)
    pairs = a.join(b, on).where((F.col("longer") == 1) | (F.col("u") < F.col("v"))).where((flips <= 2) & (F.col("band") == first_band))
    return pairs.where((F.col("side") == 0) | ~same_front).where(_apart(F.col("u"), F.col("v"))).select("u", "n_u", "v", "n_v")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: how many words are near, and the most frequent of them if it is RATIO times as frequent.

    Of equally frequent ones the smallest in code-point order counts.
    """
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("n_v").alias("m")).unionAll(pairs.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("n_u").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= RATIO * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))


def with_roots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """forms with root: the last word that following forms leads to, by jumps that double.

    Forms grow RATIO-fold, so a chain has no circle and no more links than n has digits; rounds end when nothing moves. Each is
    written, which cuts the lineage.
    """
    links = scratch.write(rows.where("form is not null").select("word", F.col("form").alias("root")), "jumps-0")
    k = 0
    while True:
        jump = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        k += 1
        step = scratch.write(links.join(jump, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), f"jumps-{k}")
        scratch.drop(f"jumps-{k - 1}")
        links = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n: every word of `word_counts` and what it is a variant of.

    Without such words the result is empty. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(word_counts(docs), "words")
    pairs = scratch.write(near_pairs(words), "pairs")
    rows = scratch.write(forms(words, pairs), "forms")
    scratch.drop("pairs")
    return with_roots(rows, scratch).select("word", "form", "root", "n", "n_near", "form_n")
