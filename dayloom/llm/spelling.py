"""Spelling variants: words one edit apart, joined through asymmetric chunks and positional grams.

The shorter word of a pair (either, if equally long) is cut into two disjoint chunks. One edit
leaves a chunk whole, and in the longer word it stands at its own place or one further:
the other word gives its positional grams, and equal strings within shift one meet. Only grams at places
that a chunk of a word of its length or one less can reach are sent. What remains of the word beside
the preserved chunk is one edit from what remains of the other, so the same step is applied to it
again: a key is a chunk of the word together with a chunk of the rest, ``lo`` and ``hi`` being the
stretch that may hold the edit. Keys that would still bring more than ``HOT_PAIRS`` pairs together
go another step, until the stretch is one letter; words that agree in all but one letter are near,
and an alphabet bounds how many there are. Candidates are verified by their edit distance.

Defined cases: a null text has no words; rows with equal ids count twice; texts are taken whole whatever their length;
case and accents are letters like any others (only A-Z are lower-cased); of equally frequent near words the
smallest in code-point order is the form; an empty table gives no words; other columns are not used, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.corpus import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 7, 2
#: A near word is the form of a word that it outnumbers so many times.
TIMES = 10
HOT_PAIRS = 1 << 16
#: Steps taken for every word: two, that is four stretches a word.
FIRST_STEPS = 2
#: A count has at most 19 digits and each form has ten times the count of its word: 2**5 follows every chain.
ROUNDS = 5


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id and ``run``: every maximal run of letters of at least ``min_length``, lower-cased in A-Z."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return found.where(F.length("run") >= min_length).withColumn("run", F.translate("run", UPPER, LOWER))


def counted(rows: DataFrame, column: str = "word", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the distinct long and repeated values of ``column``."""
    words = rows.where(F.length(column) >= min_length).groupBy(F.col(column).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= min_count)


def _part(text: str, begin: Column, end: Column) -> Column:
    return F.substring(F.col(text), begin + 1, end - begin)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: the edit is in the first or in the second half of its stretch."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    cuts = F.array(F.struct(F.col("lo").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("hi").alias("y")))
    rows = rows.withColumn("cut", F.explode(cuts))
    return rows.withColumns({"lo": F.col("cut.x"), "hi": F.col("cut.y")}).drop("cut")


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: what stands before the stretch and what stands behind it, there or ``shift`` further."""
    size, shift = F.col("size"), F.col("shift")
    outside = F.xxhash64("size", "lo", "hi", _part("word", F.lit(0), F.col("lo")), _part("word", F.col("hi") + shift, size + shift))
    return rows.withColumn("key", outside)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two values of ``word`` (distinct) that differ by one inserted, deleted or replaced character."""
    length = F.length("word")
    own = words.select("word", length.alias("size"), F.lit(0).alias("shift"))
    longer = words.select("word", (length - 1).alias("size"), F.lit(1).alias("shift"))
    rows = own.unionByName(longer).where("size > 0").withColumns({"lo": F.lit(0), "hi": F.col("size")})
    for _ in range(FIRST_STEPS):
        rows = _halves(rows)
    found = []
    while True:
        rows = written(_keyed(rows.where("hi > lo")), "spelling_keys")
        sides = rows.groupBy("key").agg(F.count_if(F.col("shift") == 0).alias("own"), F.count(F.lit(1)).alias("both"), F.max(F.expr("hi - lo")).alias("width"))
        hot = written(sides.where((F.col("own") * F.col("both") > HOT_PAIRS) & (F.col("width") > 1)).select("key"), "spelling_hot")
        some = not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if some else rows
        a = cold.where("shift = 0").select("key", F.col("word").alias("a"))
        b = cold.select("key", F.col("word").alias("b"), "shift")
        met = a.join(b, "key").where("shift = 1 or a < b").where(F.levenshtein("a", "b", 1) == 1)
        found.append(met.select("a", "b"))
        if not some:
            break
        rows = _halves(rows.join(hot, "key", "left_semi").drop("key"))
    return reduce(DataFrame.unionByName, found).distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of ``words`` (word, n)."""
    pairs = written(near_pairs(words), "spelling_pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    all_words = words.join(best, "word", "left")
    has = -F.col("best.m") >= TIMES * F.col("n")
    return all_words.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.b")).alias("form"),
        F.when(has, -F.col("best.m")).cast("long").alias("form_n"),
    )


def groups(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root: from each word along forms to the last."""
    found = written(forms(words), "spelling_forms")
    step = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    return found.join(step.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
