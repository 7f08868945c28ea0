"""Quality rules from distributions: how far a document's characters and common words are from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.llm.common import words
from tablematch.plans.skew import durable

# Frequent words by language; a language without a list is held against all of them.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on with as by",
    "de": "der die und in den von zu das mit ist des im für ein",
    "fr": "de la le et les des en un une du que est pour dans au",
    "es": "de la que el en y los del se las por un con una su",
}
MIN_WORDS, MAX_REPEATED = 50, 50
#: Largest Jensen-Shannon distance of characters and of common words, and the words from which the latter counts.
MAX_CHARS, MAX_WORDS, MIN_WORDS_FOR_COMMON = 0.28, 0.27, 100


def _window_codes(salt: str = "") -> str:
    """SQL: the windows of three words of `_w` that begin at the places `_p`, each as one long, its hash above and its place in
    the lowest `_bits` bits, in order."""
    return f"sort_array(transform(_p, i -> shiftleft(xxhash64({salt}get(_w, i), get(_w, i + 1), get(_w, i + 2)), _bits) | i))"


#: SQL: the places of the windows of `_s` whose hash a neighbour has too.
_TWINS = """transform(
    filter(_s, (x, j) -> coalesce(shiftright(x, _bits) = shiftright(get(_s, j + 1), _bits), false)
                      OR coalesce(shiftright(x, _bits) = shiftright(get(_s, j - 1), _bits), false)),
    x -> CAST(x & _mask AS INT))"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common): one row per row."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_w", words("_text"))
    length = F.length("_text")

    def of(pattern: str) -> Column:
        return length - F.length(F.regexp_replace("_text", pattern, ""))

    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = {lang: text.split() for lang, text in COMMON_WORDS.items()}
    every = sorted({w for ws in known.values() for w in ws})
    lists = F.lit(every)
    for lang, ws in known.items():
        lists = F.when(F.col("_lang") == lang, F.lit(ws)).otherwise(lists)
    longest = max(len(w.encode()) for w in every)
    other = r"[^\p{Ll}\p{Lu}0-9#*$%&|<>.,;:!?'\"()\-\x20\x09-\x0D]+"
    # windows of three words by hash; those with a twin go a second round with another hash, so that the places, which take
    # more bits from the hash in longer texts, never make two windows the same
    rows = (
        rows.withColumn("_bits", F.ceil(F.log2(F.size("_w") + F.lit(1))).cast("int"))
        .withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
        .withColumn("_p", F.expr("CASE WHEN size(_w) >= 3 THEN sequence(0, size(_w) - 3) ELSE CAST(array() AS ARRAY<INT>) END"))
        .withColumn("_s", F.expr(_window_codes())).withColumn("_p", F.expr(_TWINS))
        .withColumn("_s", F.expr(_window_codes("'again', "))).withColumn("_p", F.sort_array(F.expr(_TWINS)))
        .withColumn("_lines", lines).withColumn("_list", lists)
        .withColumn("_common", F.filter("_w", lambda x: (F.octet_length(x) <= longest) & F.array_contains(F.col("_list"), F.lower(x))))
        .withColumn("_common", F.transform("_common", F.lower))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("_upper", of(r"\p{Lu}+")).withColumn("_digit", of("[0-9]+")).withColumn("_other", of(other))
        .withColumn("n_symbols", of(r"[#*$%&|<>]+").cast("long")).withColumn("_point", of(r"[.,;:!?'\"()\-]+"))
    )
    spaces = length - F.col("word_chars")
    lower = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("n_symbols") - F.col("_point") - F.col("_other")
    repeats = F.expr("aggregate(transform(_p, (x, j) -> least(3, coalesce(get(_p, j + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return rows.select(
        "_id", "_lang", F.size("_w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeats.alias("n_repeat_words"),
        F.transform(
            F.array(lower, "_upper", "_digit", "n_symbols", "_point", spaces, "_other"), lambda x: x.cast("double")
        ).alias("chars"),
        F.concat(
            F.transform("_list", lambda x: (F.size("_common") - F.size(F.array_remove("_common", x))).cast("double")),
            F.array((F.size("_w") - F.size("_common")).cast("double")),
        ).alias("common"),
    )


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of one length; null where one is empty."""
    total = "aggregate({0}, 0D, (a, x) -> a + x)".format
    term = "CASE WHEN x.{0} > 0 THEN x.{0} * log2(2 * x.{0} / (x.p + x.q)) ELSE 0D END".format
    pairs = f"zip_with({p}, {q}, (a, b) -> struct(a / nullif({total(p)}, 0D) AS p, b / nullif({total(q)}, 0D) AS q))"
    return F.expr(f"sqrt(greatest(0D, aggregate({pairs}, 0D, (s, x) -> s + ({term('p')} + {term('q')}) / 2)))")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars: float = MAX_CHARS,
    max_words: float = MAX_WORDS, min_words: int = MIN_WORDS, min_words_for_common: int = MIN_WORDS_FOR_COMMON,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept).

    The reference of a language is the sum of the histograms of all its documents. A document fails that has fewer than
    `min_words` words, or more than half of its words in repeated windows of three, or whose characters or (from
    `min_words_for_common` words on) common words are farther from the reference than allowed. Null texts are empty and
    fail; null languages are one language; null ids and repeated rows get a row each; an empty table gives an empty
    result; other columns are not read."""
    rows = durable(measures(docs, id_col, text_col, lang_col))
    parts = rows.select("_lang", F.posexplode(F.concat("chars", "common")).alias("at", "n")).groupBy("_lang", "at").agg(F.sum("n").alias("n"))
    sums = F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"])
    reference = durable(parts.groupBy("_lang").agg(sums.alias("sums"))).select(
        F.col("_lang").alias("_ref"), F.slice("sums", 1, 7).alias("ref_chars"), F.expr("slice(sums, 8, greatest(1, size(sums) - 7))").alias("ref_common")
    )
    far = rows.join(reference, rows._lang == reference._ref).select(
        "*", distance("chars", "ref_chars").alias("char_distance"), distance("common", "ref_common").alias("word_distance")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    near = (F.col("char_distance") <= max_chars) & ((F.col("n_words") < min_words_for_common) | (F.col("word_distance") <= max_words))
    return far.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "char_distance", "word_distance", (~failed & near).alias("kept"),
    )
