"""Quality rules with thresholds that follow the data, in DataFrame functions only.

Every text gets integer metrics.  Per language and source, each metric is summed up in a mergeable
quantile sketch: counts of log-linear buckets that keep the top seven bits of a value, so a quantile is at most
1/64 below the true one, merging is adding counts, and the result doesn't depend on how rows are dealt.
Fences come from the sketch's quantiles alone: the third quartile and ``REACH`` times the distance of the quartiles, or the
quantile that the metric names as its tail, whichever is further out.  So about that tail of a group, and the rest of its bucket, is
the most that goes by a metric: a hundredth by word length (on either side), repeated lines and repeated words, 15 hundredths by symbols.  A metric that
is 0 in nearly all of a group has the fence 0 there.  A group of fewer than ``least`` documents takes the quantiles of its
language, or of all.  The fences are joined to the documents, and what lies outside goes.

Defined results: a null or empty text has no words, fails the base rules and is not kept; null languages
and sources are groups of their own; equal rows get equal verdicts, a row each; further columns
are ignored (or carried, when rows are filtered); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideleaf.llm.common import attach, spool

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"

#: metric: (whether low values are rejected too, the tail's quantile in hundredths)
METRICS = {"word_centi": (True, 99), "symbol_milli": (False, 85), "dup_line_milli": (False, 99), "repeat_milli": (False, 99)}
REACH = 3


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the metrics' columns.

    ``df`` must not have columns of these names, nor such that begin with ``_``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_t", t)
    # Words, and hashes of their 3-word windows; a window's words are joined by a character that no word has.
    df = df.withColumn("_w", F.filter(F.split("_t", _BLANK), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    windows = F.when(F.col("n_words") >= 4, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("_h", windows)
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long"))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0))
    df = df.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l", "_t")
    # Only texts with a window found twice are looked at further: windows with their places, sorted; places whose
    # neighbour is the same window; and the words that these windows cover, overlaps once.
    again = F.size("_h") > F.size(F.array_distinct("_h"))
    placed = F.when(again, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_p", placed).drop("_w", "_h")
    same = lambda e, k: (F.get("_p", k - 1)["h"] == e["h"]) | (F.get("_p", k + 1)["h"] == e["h"])
    df = df.withColumn("_d", F.sort_array(F.transform(F.filter("_p", lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))).drop("_p")
    covered = F.aggregate(F.transform("_d", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_d", k + 1), x + 3) - x)), F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_d")
    return df.withColumns(
        {
            "word_centi": F.expr("100 * word_chars div greatest(n_words, 1)"),
            "symbol_milli": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
            "dup_line_milli": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
            "repeat_milli": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
            "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
        }
    )


def bucket(x: Column) -> Column:
    """The lower end of a value's bucket: the value with its seven top bits only."""
    low = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, low), low)


def sketch(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mergeable sketches as rows: keys, metric, bucket, count.  Sketches of parts merge by adding counts."""
    stacked = ", ".join(f"'{m}', {m}" for m in metrics)
    long = df.select(*keys, F.expr(f"stack({len(metrics)}, {stacked}) AS (metric, value)"))
    return long.groupBy(*keys, "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], hundredths: list[int]) -> DataFrame:
    """keys, metric, n and for each quantile ``q<hundredths>``: the smallest bucket that reaches it.

    A window holds the buckets of one group and metric, whose number the bucket scheme bounds."""
    one = Window.partitionBy(*keys, "metric")
    summed = sketches.withColumns({"total": F.sum("n").over(one), "upto": F.sum("n").over(one.orderBy("bucket"))})
    reached = [F.min(F.when(F.expr(f"100 * upto >= {h} * total"), F.col("bucket"))).alias(f"q{h}") for h in hundredths]
    return summed.groupBy(*keys, "metric").agg(F.max("total").alias("n"), *reached)


def fences(measured: DataFrame, *, least: int = 100, reach: int = REACH) -> DataFrame:
    """A row per language and source: ``n``, its rows, and for each metric the lowest and highest value that stays.

    Learnt from the rows that pass the base rules; a group of which none passes has no fences."""
    passing = measured.where(~F.col("base_failed"))
    fine = spool(sketch(passing, ["_lang", "_source"], list(METRICS)), "sketches")
    by_lang = fine.groupBy("_lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    by_none = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    levels = sorted({25, 75} | {t for _, t in METRICS.values()} | {100 - t for both, t in METRICS.values() if both})
    names = [f"q{h}" for h in levels]
    wide = None
    for keys, table, tag in ((["_lang", "_source"], fine, "f"), (["_lang"], by_lang, "l"), ([], by_none, "a")):
        q = quantiles(table, keys, levels).select(*keys, "metric", F.struct("n", *names).alias(tag))
        wide = q if wide is None else wide.join(q, [*keys, "metric"], "left")
    best = F.when(F.col("f.n") >= least, F.col("f")).when(F.col("l.n") >= least, F.col("l")).otherwise(F.col("a"))
    rows = wide.select("_lang", "_source", "metric", F.col("f.n").alias("n"), best.alias("q"))
    q = lambda h: F.col(f"q.q{h}")
    span = reach * (q(75) - q(25))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    columns = [of(m, F.greatest(q(tail), q(75) + span)).alias(f"_{m}_most") for m, (_, tail) in METRICS.items()]
    columns += [of(m, F.least(q(100 - tail), q(25) - span)).alias(f"_{m}_least") for m, (both, tail) in METRICS.items() if both]
    return rows.groupBy("_lang", "_source").agg(F.max("n").alias("n"), *columns)


def _judged(docs: DataFrame, keep_row: bool) -> DataFrame:
    group = [F.concat(F.lit("="), F.col(c).cast("string")) for c in ("lang", "source")]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else [F.col("doc_id")]
    df = docs.select(*row, F.col("text").alias("text_"), F.coalesce(group[0], F.lit("null")).alias("_lang"), F.coalesce(group[1], F.lit("null")).alias("_source"))
    df = spool(measure(df, "text_").drop("text_"), "quality")
    joined = attach(df, spool(fences(df), "fences"), ["_lang", "_source"])
    good = ~F.col("base_failed")
    for m, (both, _) in METRICS.items():
        good = good & (F.col(m) <= F.col(f"_{m}_most"))
        if both:
            good = good & (F.col(m) >= F.col(f"_{m}_least"))
    return joined.withColumn("kept", F.coalesce(good, F.lit(False)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept, a row per document."""
    return _judged(docs, False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return _judged(docs, True).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
