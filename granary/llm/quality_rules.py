"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets its counts; a KLL quantile sketch per (lang, source) and measure is built from all
documents, partial sketches first, merged by key. The sketches of a language's sources are merged once more, and so
are those of all languages. A group's threshold comes from its own sketch, drawn toward its language's: half-way with
``PRIOR`` documents, with more by the square of their number less. A language's is drawn toward the whole corpus' in the
same way. Large groups stand for themselves, small ones lean on more, without a switch. A threshold is an outer fence: third quartile
plus ``FENCE`` times the spread between quartiles. The small threshold table is joined to the counts
and each measure above its threshold rejects the document, with a reason. There are no fixed cutoffs.

Most rates are zero in most documents, which leaves quartiles no spread. Measures are therefore logarithms of rates
with one added above and below: a document without symbols then counts by its length, and quartiles spread as lengths do.

A group of which junk is more than a quarter would carry its own fence away; a group's fence is therefore held to
its language's fence, moved up as far as the group's median lies above the language's. A group that is
different as a whole gets the looser fence it needs; junk short of half of a group does not move the median far.

Repeated words have a base rule of their own and no fence.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``. Nulls: a null text has no words and fails the base rules; a
null lang or source is a group of its own. Very long texts stay in one row. Repeated rows are judged each. An
empty table gives no rows. ``filtered`` returns the columns of its input, whatever their names; in ``judged`` the counts
and verdicts replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["symbol_rate", "dup_line_rate", "upper_rate", "mean_word"]
PRIOR, FENCE, SKETCH_K = 20, 3.0, 400
_KEYS = ["lang", "source"]


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """Evaluate ``value`` once and pass it on; a plain reference would be computed again at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(found: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. Equal ones are neighbours once sorted; the
    places they start at are sorted again, and each covers what lies before the next, ``width`` at most.
    """

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.transform(starts, lambda p, i: F.when(i + 1 < n, F.least(F.get(starts, i + 1) - p, F.lit(width))).otherwise(F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def marked(windows: Column) -> Column:
        def starts(order: Column) -> Column:
            again = F.filter(order, lambda w, i: (F.get(order, i - 1)["h"] == w["h"]) | F.coalesce(F.get(order, i + 1)["h"] == w["h"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda w: w["p"]))

        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.sort_array(pairs), lambda order: _let(starts(order), covered)))

    def windows(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))

    return F.when(F.size(found) < width + 1, F.lit(0)).otherwise(_let(found, lambda ws: _let(windows(ws), marked)))


def counts(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    found = F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, SPACE, "") != "")
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(found).cast("long"),
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long"),
    }


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``COUNTS``, and n_lines and n_upper, to every row."""
    held = df.withColumn("_words", words(F.coalesce(F.col(text_col), F.lit(""))))
    return held.withColumns(counts(F.col(text_col))).drop("_words")


def measures() -> dict[str, Column]:
    """Logarithms of rates, one added to both counts."""

    def rate(x: str, of: str) -> Column:
        return F.log((F.col(x) + 1) / (F.col(of) + 1))

    return {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "mean_word": rate("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def thresholds(counted: DataFrame, folder: str) -> DataFrame:
    """One row per (lang, source) with ``max_<measure>``."""
    found = MEASURES
    valued = counted.select(*[F.col(k).cast("string").alias(k) for k in _KEYS], *[c.alias(m) for m, c in measures().items()])
    sketched = valued.groupBy(*_KEYS).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in found])
    sketched = stored(sketched, folder, "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in found]]

    def fences(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        def read(m: str) -> list[Column]:
            q = F.kll_sketch_get_quantile_double(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            fence, middle = F.get(q, 2) + FENCE * (F.get(q, 2) - F.get(q, 0)), F.get(q, 1)
            return [F.when(F.col("n") > 0, fence).alias(f"{prefix}_{m}"), F.when(F.col("n") > 0, middle).alias(f"{prefix}_mid_{m}")]

        return df.select(*keys, F.col("n").alias(f"{prefix}_n"), *[c for m in found for c in read(m)])

    groups = fences(sketched, "group", _KEYS)
    langs = fences(sketched.groupBy("lang").agg(*merged), "lang", ["lang"]).withColumnRenamed("lang", "of_lang")
    whole = fences(sketched.agg(*merged), "all", []).first()  # one row
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("of_lang")))

    def chosen(m: str) -> Column:
        def drawn(own: str, n: str, toward: Column) -> Column:
            size = F.col(n).cast("double") * F.col(n)
            return (size * F.col(own) + PRIOR**2 * toward) / (size + PRIOR**2)

        wide, middle = (drawn(f"lang_{x}", "lang_n", F.lit(whole[f"all_{x}"])) for x in (m, f"mid_{m}"))
        own, own_middle = drawn(f"group_{m}", "group_n", wide), drawn(f"group_mid_{m}", "group_n", middle)
        return F.least(own, wide + F.greatest(own_middle - middle, F.lit(0.0)))

    return joined.select(*_KEYS, *[chosen(m).alias(f"max_{m}") for m in found])


def _verdicts(df: DataFrame, folder: str, text_col: str, own: list[str]) -> DataFrame:
    """Counts, base_failed, reasons and kept of every row, beside its columns ``own`` in the struct ``row``."""
    held = df.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text_col}`").alias("text"), *_KEYS)
    counted = stored(with_counts(held).drop("text"), folder, "counts")
    limits = thresholds(counted, folder).select(*[F.col(k).alias(f"of_{k}") for k in _KEYS], *[f"max_{m}" for m in MEASURES])
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    reasons = F.array_compact(F.array(*[F.when(c > F.col(f"max_{m}"), F.lit(m)) for m, c in measures().items()]))
    out = joined.withColumn("base_failed", base_failed()).withColumn("reasons", reasons)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def judged(df: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Every row of ``df``, without its text, with its counts, base_failed, reasons (array) and kept."""
    found = [*COUNTS, "n_lines", "n_upper", "base_failed", "reasons", "kept"]
    own = [c for c in df.columns if c not in (text_col, *found)]
    return _verdicts(df, folder, text_col, own).select(*[F.col(f"row.`{c}`").alias(c) for c in own], *found)


def filtered(df: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    return _verdicts(df, folder, text_col, df.columns).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, shared_folder(spark)).select("doc_id", *COUNTS, "base_failed", "kept", "reasons")


#: The columns that SQL states exactly; the adaptive verdict depends on sketches.
BASE_SQL = """
with w as (
  select doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') as ls
  from documents),
g as (select doc_id, unnest(range(1, len(ws) - 3)) as p, ws from w where len(ws) >= 5),
h as (select doc_id, p, count(*) over (partition by doc_id, ws[p], ws[p+1], ws[p+2], ws[p+3], ws[p+4]) as c from g),
r as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, unnest(range(p, p + 5)) as q from h where c > 1) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words,
       cast(length(array_to_string(ws, '')) as bigint) as word_chars,
       cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
       cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
       coalesce(n_repeat_words, 0) as n_repeat_words,
       len(ws) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) as base_failed
from w left join r using (doc_id)
"""
