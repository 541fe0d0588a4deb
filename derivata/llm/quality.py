"""Quality rules: a table of thresholds, compiled into one projection of Spark expressions.

Measures are columns of built-in functions over one array of words; :data:`RULES` compiles to one boolean each and
``kept`` is their conjunction. No user function takes part.

A null or empty text has no words, so all its counts are 0 and it fails the base rules. Ratios of nothing are null
and break no rule. Columns of the input named like the new ones are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine einen im in ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour qui que sur un une "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()

#: (measure, least, most); None: no bound. Published practice for web text, except that long documents stay.
RULES = (
    ("mean_word_chars", 3.0, 10.0),
    ("symbol_ratio", None, 0.1),
    ("letter_ratio", 0.6, None),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
)
#: The base rules: least words, and most per cent of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = (*MEASURES, *(r[0] for r in RULES), "base_failed", "kept")


def _words(text: Column) -> Column:
    """Words of a text: all white space made blanks, split at blanks, without what is empty between two."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures of :data:`MEASURES` and the ratios that :data:`RULES` names. Its columns must not begin
    with two underscores; :func:`quality_rules` takes any names.

    The steps are projections of their own, so that no array is computed twice, and each drops what later ones
    don't need, so that no text is copied on and on."""
    keep = [c for c in docs.columns if c not in _ADDED]
    ratio = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(*keep, text.alias("__t"))
    df = df.select("*", _words(F.col("__t")).alias("__w"), F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("__l"))
    n, lines, joined = F.size("__w"), F.size("__l"), F.array_join("__w", "")
    df = df.select(
        *keep,
        n.cast("bigint").alias("n_words"),
        F.length(joined).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(joined, r"\P{L}+", "")).alias("__letters"),
        (lines - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        lines.alias("__lines"),
        F.size(F.filter("__w", lambda w: w.isin(STOP_WORDS))).alias("__stops"),
        F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("__ellipses"),
        F.size(F.filter("__l", lambda x: F.substr(F.ltrim(x), F.lit(1), F.lit(1)).isin("-", "*", "•"))).alias("__bullets"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__x"),
    )
    passed = [c for c in df.columns if c != "__x"]
    pairs = "zip_with(slice(__x, 1, size(__x) - 1), slice(__x, 2, size(__x) - 1), (a, b) -> xxhash64(a, b))"
    windows = f"CASE WHEN n_words < 3 THEN CAST(array() AS array<bigint>) ELSE zip_with(slice({pairs}, 1, size(__x) - 2), slice(__x, 3, size(__x) - 2), (a, b) -> xxhash64(a, b)) END"
    df = df.select(*passed, F.expr(windows).alias("__h"))
    # An array of numbers tells fast whether any window repeats; only then the windows are sorted with their places.
    df = df.select(*passed, F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h, (x, i) -> struct(x AS h, i AS i))) END").alias("__s"))
    df = df.select(*passed, F.expr("sort_array(transform(filter(__s, (x, i) -> x.h = get(__s, i - 1).h OR x.h = get(__s, i + 1).h), x -> x.i))").alias("__p"))
    repeated = F.expr("aggregate(transform(__p, (p, i) -> coalesce(least(get(__p, i + 1) - p, 3), 3)), 0L, (a, x) -> a + x)")
    return df.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(repeated, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        ratio(F.col("__letters"), F.col("word_chars")).alias("letter_ratio"),
        ratio(F.col("__stops"), F.col("n_words")).alias("stop_ratio"),
        ratio(F.col("n_dup_lines"), F.col("__lines")).alias("dup_line_ratio"),
        ratio(F.col("__ellipses"), F.col("__lines")).alias("ellipsis_line_ratio"),
        ratio(F.col("__bullets"), F.col("__lines")).alias("bullet_line_ratio"),
    )


def compiled(rules=RULES) -> Column:
    """The conjunction of all rules; a null measure breaks none."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & F.coalesce(F.col(name) >= F.lit(least), F.lit(True))
        if most is not None:
            out = out & F.coalesce(F.col(name) <= F.lit(most), F.lit(True))
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with its measures, base_failed and kept. Names of other columns don't matter."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in _ADDED or c == text_col}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = measures(inner, names[text_col]).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
    return judged.select(*[F.col(n).alias(c) for c, n in names.items() if c not in _ADDED], *_ADDED)


def quality_filter(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    # A row number is not deterministic, so the filter isn't pushed below the measures and they are computed once.
    judged = quality_rules(inner, names[text_col], rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.where("kept AND __row >= 0").select(*[F.col(n).alias(c) for c, n in names.items()])
