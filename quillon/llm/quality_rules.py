"""Quality rules: rule counters and the divergence of a text from its language (operator 4, native).

Every column is a built-in Spark SQL expression over the whole text. A text fails the base rules when it has
under ``min_words`` words or when over ``max_repeat_pct`` percent of its words lie in repeated windows. Other
texts are compared with the reference of their language by Jensen-Shannon distance (square root of the base-2
divergence, 0 to 1), once over character classes and once over common words. The references are sums over all
texts of a language that pass the base rules, so that they follow the corpus, not a sample.

Guards: a histogram under ``min_chars`` characters or ``min_judged_words`` words is not judged; a language
whose reference is under the same minimum times ten is not judged; a null language is a language of its own.
Null and empty texts have no words and fail the base rules. Repeated rows are judged alike, each on its own;
columns of the input other than the text and the language are never looked at and are carried through unless
they clash with a column that the operator adds, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, written

#: Frequent function words of the languages compared.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "as", "with", "be", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: Character classes, as Java character classes. White space, symbols and the rest come with them.
CHAR_CLASSES = ["\\p{Lu}", "0-9", ".,;:'\"()?!-"]
SYMBOLS = "#*$%&|<>"
WINDOW = 8
N_CLASSES = len(CHAR_CLASSES) + 3


def _without(text: Column, chars: str, by: str = "") -> Column:
    """text with each of the characters replaced; plain replacements of one character need no regex."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _pairs_of(marks: str, apart: int) -> Column:
    """A mark of each two marks that lie ``apart`` places from each other."""
    rest = F.greatest(F.size(marks) - apart, F.lit(0))
    return F.zip_with(F.slice(marks, 1, rest), F.slice(marks, apart + 1, rest), lambda a, b: F.xxhash64(a, b))


def rule_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the rule counters n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long).

    A window of eight words is known by a 64-bit mark, made from marks of one, two and four words. The columns
    that begin with an underscore are steps that ``histograms`` goes on with.
    """
    zero = F.lit(0).cast("long")
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_s", _without(F.col("_t"), SPACE_CHARS[1:], " "))
    d = d.withColumn("_h1", F.transform(F.array_remove(F.split("_s", " "), ""), lambda w: F.xxhash64(w)))
    d = d.withColumn("_h2", _pairs_of("_h1", 1)).withColumn("_h4", _pairs_of("_h2", 2))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # Only texts in which four words repeat can repeat eight, and only texts that repeat eight pay for the sort.
    # What a lambda looks up is a column of its own: Spark would evaluate an expression in its place each time.
    d = d.withColumn("_h8", F.when(F.size(F.array_distinct("_h4")) < F.size("_h4"), _pairs_of("_h4", 4)))
    d = d.withColumn(
        "_r",
        F.when(
            F.size(F.array_distinct("_h8")) < F.size("_h8"),
            F.sort_array(F.transform("_h8", lambda m, i: F.struct(m.alias("m"), i.alias("i")))),
        ),
    )
    near = lambda r, k: (F.get("_r", k - 1)["m"] == r["m"]) | (F.get("_r", k + 1)["m"] == r["m"])
    twins = F.filter(F.transform("_r", lambda r, k: F.when(near(r, k), r["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_p", F.sort_array(twins))
    # the union of windows that begin at the sorted places: each reaches to the next one at most
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
        zero, lambda a, x: a + x,
    )
    return d.withColumns({
        "n_words": F.size("_h1").cast("long"),
        "word_chars": F.char_length(F.replace("_s", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.octet_length("_t") - F.octet_length(_without(F.col("_t"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, zero),
    }).drop("_s", "_h2", "_h4", "_h8", "_r", "_l", "_p")


def histograms(d: DataFrame, lang: str) -> DataFrame:
    """Adds the histograms _cc (character classes) and _cw (common words of the language, then all other words),
    arrays of double."""
    n_chars = F.char_length("_t").cast("double")
    classes = [F.regexp_count("_t", F.lit(f"[{c}]")).cast("double") for c in CHAR_CLASSES]
    classes += [n_chars - F.col("word_chars"), F.col("n_symbols").cast("double")]
    mark = {w: F.xxhash64(F.lit(w)) for ws in COMMON_WORDS.values() for w in ws}
    d = d.withColumn("_hits", F.filter("_h1", lambda h: h.isin(list(mark.values()))))
    vocabulary = F.array().cast("array<bigint>")
    for code, ws in COMMON_WORDS.items():
        vocabulary = F.when(F.col(lang) == code, F.array(*[mark[w] for w in ws])).otherwise(vocabulary)
    d = d.withColumn("_v", vocabulary)
    d = d.withColumn("_cw", F.transform("_v", lambda v: F.size(F.filter("_hits", lambda h: h == v)).cast("double")))
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("_cw", F.concat("_cw", F.array(F.col("n_words") - summed("_cw"))))
    d = d.withColumn("_cc", F.array(*classes))
    return d.withColumn("_cc", F.concat("_cc", F.array(F.greatest(n_chars - summed("_cc"), F.lit(0.0))))).drop("_hits", "_v")


def _jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts with positive sums."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    halves = F.zip_with(
        F.transform(p, lambda v: v / total(p)), F.transform(q, lambda v: v / total(q)), lambda a, b: part(a, b) + part(b, a)
    )
    return F.sqrt(F.greatest(total(halves) / 2, F.lit(0.0)))


def language_references(d: DataFrame, lang: str) -> DataFrame:
    """One row for each language: the summed histograms of its texts. A sum for each histogram cell, with
    map-side combine, so that a language of any size is a few numbers from each task."""
    widest = max(map(len, COMMON_WORDS.values())) + 1
    cells = [F.sum(F.get("_cc", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    cells += [F.sum(F.get("_cw", F.lit(i))).alias(f"w{i}") for i in range(widest)]
    sums = d.where(~F.col("base_failed")).groupBy(F.col(lang).alias("_lang")).agg(*cells)
    return sums.select(
        "_lang",
        F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("_rc"),
        F.filter(F.array(*[f"w{i}" for i in range(widest)]), lambda x: x.isNotNull()).alias("_rw"),
    )


def _verdict(d, lang, min_chars, min_judged_words, max_class_distance, max_word_distance) -> DataFrame:
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    refs = language_references(d, lang)
    known = F.broadcast(refs) if refs.limit(1001).count() <= 1000 else refs
    d = d.join(known, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    enough = lambda own, ref, least: (total(own) >= least) & (total(ref) >= 10 * least)
    return d.withColumns({
        "class_distance": F.when(enough(F.col("_cc"), F.col("_rc"), min_chars), _jsd(F.col("_cc"), F.col("_rc"))),
        "word_distance": F.when(enough(F.col("_cw"), F.col("_rw"), min_judged_words), _jsd(F.col("_cw"), F.col("_rw"))),
    }).withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance)
        & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance),
    ).drop("_lang", "_rc", "_rw", "_cc", "_cw")


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = 20,
    max_repeat_pct: int = 30,
    min_chars: int = 200,
    min_judged_words: int = 80,
    max_class_distance: float = 0.28,
    max_word_distance: float = 0.27,
) -> DataFrame:
    """(key, lang, counters, base_failed, class_distance, word_distance, kept), a row for each row of docs.

    A distance is null where a guard held. The texts are read once: their counters and histograms are written
    as a table of numbers, which the references are summed from and the distances are taken over.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    d = rule_columns(d, "text").withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct),
    )
    table = written(histograms(d, "lang").drop("_t", "_h1", "text"), "rules")
    out = _verdict(table, "lang", min_chars, min_judged_words, max_class_distance, max_word_distance)
    return out.withColumnRenamed("doc_id", key)
