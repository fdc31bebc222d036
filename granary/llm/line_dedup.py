"""Line dedup: lines that many documents share go, all their copies included.

Texts are split at line ends and their lines exploded. A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at
both ends and with A-Z in lower case; keys travel as their 128-bit MD5. (key, document) pairs are made distinct, spread over both, before
documents are counted by key, in partial counts: a line that every document holds loads no task. Keys of at least ``LEAST_CHARS``
code points in at least ``LEAST_DOCS`` documents are written to the shared folder, and so are the positions at which each
document holds one. Texts are joined to their positions, and what stays is put together again in order of position. Both joins have
a written table on one side, so Spark broadcasts it where it is small and splits hot partitions where it is not.

A document is one doc_id; rows that repeat a doc_id count once for a key, and a null doc_id is a document of its own. Rows of one
doc_id with other texts each lose their own lines. Null and empty texts are one empty line, which is never dropped. Very
long texts and lines are read whole. An empty table gives no rows. Other columns pass through whatever their names;
``n_lines`` and ``n_dropped`` replace columns of the same name.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

LEAST_DOCS, LEAST_CHARS = 10, 1
_BLANKS = " \t\n\x0b\f\r"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _row(id_col: str, text_col: str) -> Column:
    """Names a row by its document and text; rows that share it have the same lines."""
    doc = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\n", doc, _text(text_col)).cast("binary")))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def hashed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row, doc, pos, key) of every line whose key is long enough; ``pos`` counts from 0."""
    lines = df.select(_row(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("doc"), F.posexplode(F.split(ascii_lower(_text(text_col)), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where(F.length("line") >= least_chars)
    return keyed.select("row", "doc", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))


def common_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(key, n_docs) of keys in at least ``least_docs`` documents."""
    return lines.select("key", "doc").distinct().groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)


def without_lines(text: Column, dropped: Column) -> Column:
    """The text less the lines at the positions ``dropped``, in time linear in its lines."""
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda i: F.get(lines, i)), "\n"))
    return F.when(F.size(dropped) > 0, F.get(kept, F.lit(0))).otherwise(text)


def without_common_lines(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows of ``df``, common lines gone from the text, with n_lines (before) and n_dropped."""
    lines = hashed_lines(df, id_col, text_col, least_chars)
    common = stored(common_keys(lines, least_docs).select("key"), folder, "common_lines")
    places = lines.join(common, "key", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("dropped"))
    places = stored(places, folder, "dropped_lines")
    taken = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), _row(id_col, text_col).alias("row"), _text(text_col).alias("text"))
    found = taken.join(places, "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    new = {text_col: without_lines(F.col("text"), F.col("dropped")), "n_lines": n_lines.cast("long"), "n_dropped": F.size("dropped").cast("long")}
    kept = {c: F.col(f"own.`{c}`") for c in df.columns} | new
    return found.select(*[c.alias(name) for name, c in kept.items()])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as t from documents),
l as (select r, doc_id, unnest(t) as line, unnest(range(len(t))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') as key from l),
c as (select key as common from k where length(key) >= {LEAST_CHARS} group by key having count(distinct coalesce(cast(doc_id as varchar), '')) >= {LEAST_DOCS})
select doc_id, count(*) as n_lines, count(common) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (common is null), '')) as kept_sha256
from k left join c on key = common group by r, doc_id
"""
