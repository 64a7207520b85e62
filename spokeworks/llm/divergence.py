"""Quality rules by distance from a language's usual distributions.

Every language has two references, taken over all its documents: the shares of
character classes, and the shares of its most common words and of all the rest.
A document far from either, by Jensen-Shannon distance (0 to 1), is rejected,
unless it or its language is too short to tell. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.tables import written
from spokeworks.operators.joins import lookup_join

_SPACE = r"[\x20\x09-\x0D]+"
# Positions take the low bits of a packed window; longer texts go the other way.
_BITS = 21
# Languages whose references are sent to all tasks at most: a few KB each.
BROADCAST_LANGUAGES = 1_000

CLASSES = ("lower", "space", "upper", "digit", "symbol", "mark", "other")
_PATTERNS = {"lower": r"\p{Ll}+", "space": _SPACE, "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>\p{S}]+", "mark": r"\p{P}+"}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Add `n_repeat_words`, the words inside 3-word windows that occur twice or more, from column `_w`.

    Windows are hashed; a text whose hashes are all distinct repeats none. Else
    the hashes are sorted with their positions in the low bits, so that equal windows are
    neighbours, and neighbours are compared word by word. Should unequal windows
    share a hash, or positions not fit, the windows themselves are sorted. All
    of it is linear in the text but for the sorting.
    """
    mask = F.lit(-(1 << _BITS))
    at = F.lit((1 << _BITS) - 1)
    w, packed, windows = F.col("_w"), F.col("_packed"), F.col("_windows")
    size = F.size(w)
    places = F.sequence(F.lit(0), size - 3)

    def position(x):
        return x.bitwiseAND(at).cast("int")

    def same_hash(x, y):
        return F.coalesce(x.bitwiseAND(mask) == y.bitwiseAND(mask), F.lit(False))

    def same_words(x, y):
        p, q = position(x), position(y)
        return (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

    def same_window(x, y):
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    # get() is null outside an array, and a comparison with it false.
    def beside(array, same):
        return lambda x, i: same(x, F.get(array, i - 1)) | same(x, F.get(array, i + 1))

    # Each step is a column of its own, so that no loop computes an array anew.
    df = df.withColumn("_hashes", F.when(size >= 3, F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    df = df.withColumn("_again", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)))
    fits = size < 1 << _BITS
    numbered = F.transform("_hashes", lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_packed", F.when(F.col("_again") & fits, F.sort_array(numbered))).drop("_hashes")
    df = df.withColumn("_repeated", F.filter("_packed", beside(packed, same_hash)))
    repeated = F.col("_repeated")
    # Of the neighbours with one hash every one has to be the window before it.
    clash = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("_repeated") - 1, F.lit(1))),
        lambda i: same_hash(F.get(repeated, i), F.get(repeated, i - 1)) & ~same_words(F.get(repeated, i), F.get(repeated, i - 1)),
    )
    df = df.withColumn("_by_words", F.col("_again") & (~fits | F.coalesce(clash, F.lit(False))))
    sorted_windows = F.sort_array(
        F.transform(places, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("bigint").alias("p")))
    )
    df = df.withColumn("_windows", F.when(F.col("_by_words"), sorted_windows))
    marks = F.when(F.col("_by_words"), F.filter(windows, beside(windows, same_window))["p"]).otherwise(F.transform("_repeated", lambda x: x.bitwiseAND(at)))
    covered = F.aggregate(
        F.sort_array(marks),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"), (p + 3).alias("end")),
        lambda s: s["n"],
    )
    counted = df.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("bigint"))
    return counted.drop("_again", "_packed", "_repeated", "_by_words", "_windows")


def _class_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds `_classes`: the text's characters of each class, every class taken from what the earlier ones left."""
    left, counts = text, []
    for name in CLASSES[:-1]:
        after = f"_without_{name}"
        df = df.withColumn(after, F.regexp_replace(left, _PATTERNS[name], ""))
        counts.append((F.length(left) - F.length(after)).cast("double"))
        left = after
    counts.append(F.length(left).cast("double"))
    return df.withColumn("_classes", F.array(*counts)).drop(*(f"_without_{name}" for name in CLASSES[:-1]))


def language_references(docs: DataFrame, text: str, lang: str, common_words: int) -> DataFrame:
    """(lang, classes, words, shares, reference_words): one row for each language, null being one of them.

    `classes` are shares of character classes, `words` the `common_words` most
    frequent lower-cased words (ties by word), `shares` theirs and last the
    share of all other words.
    """
    body = docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sums = [F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    classes = _class_counts(body, "_text").groupBy("lang").agg(*sums)
    all_chars = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    classes = classes.select("lang", F.array(*(F.col(f"c{i}") / F.greatest(all_chars, F.lit(1.0)) for i in range(len(CLASSES)))).alias("classes"))

    counted = body.select("lang", F.explode(_words(F.lower("_text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = written(counted, "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("reference_words"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counted.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= common_words)
    lists = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("t"))
    joined = totals.join(lists, totals["lang"].eqNullSafe(lists["lang"]))
    shares = F.transform("t.n", lambda n: n / F.col("reference_words"))
    words = joined.select(
        totals["lang"],
        F.col("t.word").alias("words"),
        F.concat(shares, F.array(1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))).alias("shares"),
        "reference_words",
    )
    return written(classes.join(words, classes["lang"].eqNullSafe(words["lang"])).select(classes["lang"], "classes", "words", "shares", "reference_words"), "references")


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares: the root of the divergence with logarithms to base 2."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    common_words: int = 24,
    most_class_distance: float = 0.28,
    most_word_distance: float = 0.45,
    least_words: int = 50,
    least_reference_words: int = 2_000,
) -> DataFrame:
    """Counts, distances and verdict for each row.

    A document fails the base rules if it has fewer than `least_words` words or
    more than half of them in repeated 3-word windows. It is kept if it passes
    them and lies within both distances of its language; the distances do not
    count if the language has fewer than `least_reference_words` words. Null is
    the empty text. Rows without language are held against each other. Repeated
    rows give repeated results; other columns are not looked at.
    """
    references = language_references(docs, text, lang, common_words)
    few = references.count() <= BROADCAST_LANGUAGES
    lang_key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    references = references.withColumn("_lang", lang_key).drop("lang")
    body = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    body = body.withColumn("_lang", lang_key).drop("lang")
    joined = body.join(F.broadcast(references), "_lang", "left") if few else lookup_join(body, references, ["_lang"], "left")

    split = _class_counts(joined, "_text").withColumn("_w", _words(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    split = _with_repeat_words(split)
    split = split.withColumn("_spaced", F.concat(F.lit(" "), F.lower(F.array_join("_w", "  ")), F.lit(" ")))
    held = F.transform(
        "words",
        lambda v: (F.octet_length("_spaced") - F.octet_length(F.replace(F.col("_spaced"), F.concat(F.lit(" "), v, F.lit(" ")), F.lit("")))) / (F.octet_length(v) + 2),
    )
    counted = split.select(
        "_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.size(F.regexp_extract_all("_text", F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.length("_text").alias("_chars"),
        "_classes",
        "classes",
        held.alias("_held"),
        "shares",
        "reference_words",
    )
    n = F.greatest("n_words", F.lit(1))
    own = F.transform("_held", lambda x: x / n)
    own = F.concat(own, F.array(F.greatest(1 - F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))
    measured = counted.withColumns(
        {
            "class_distance": jensen_shannon(F.transform("_classes", lambda x: x / F.greatest("_chars", F.lit(1))), F.col("classes")),
            "word_distance": jensen_shannon(own, F.col("shares")),
        }
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.col("class_distance") <= most_class_distance) & (F.col("word_distance") <= most_word_distance)
    unknown = F.coalesce(F.col("reference_words") < least_reference_words, F.lit(True))
    return measured.select(
        F.col("_id").alias(doc_id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        failed.alias("base_failed"),
        (~failed & (unknown | F.coalesce(near, F.lit(True)))).alias("kept"),
    )
