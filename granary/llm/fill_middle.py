"""Fill-in-middle: a text's prefix, middle and suffix in another order, between marks.

Run-length class encoding: a text is stored as its maximal runs of one character class, each with its first code point
and the number of units that end before it. Cut k is found by binary search: the first run behind which k units
have ended. In a run where every code point ends a unit the cut's offset is arithmetic; else it is the run's end. A run
table takes room by runs, not by units, and serves any number of cuts (other draws, other epochs) without the text.

Units: ``line``, a line with its line end, or what follows the last one; ``word``, a word with the white space behind it;
``char``, a code point. Draws h1 to h4 come from a hash of seed and id: cuts after h1 and h2 modulo n + 1 units; h3 decides whether a
text is turned at all, h4 between suffix first (spm) and prefix first (psm). Texts that hold a mark, and empty ones, stay plain.

The run table and the search are Arrow functions over numpy; cutting, joining and restoring are Spark's own. Nothing is shuffled.
Null texts are empty and plain, with no units; a null id is hashed as an empty one. Repeated rows turn alike.
Very long texts stay in one row. An empty table gives no rows. Other columns pass through; the added ones replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SUFFIX_FIRST, UNIT = 7, 100, 50, "line"
UNITS = ("line", "word", "char")
RUNS = "struct<first:array<int>,ended:array<int>,each:array<boolean>>"
_BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def class_runs(text: str, unit: str = UNIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, ended, each): the code point that each run begins with, the units ended before it, and whether each of its
    code points ends one. ``first`` and ``ended`` have one more entry, for the text's end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, bool)
    ends = np.ones(n, bool) if unit == "char" else points == 10 if unit == "line" else np.isin(points, _BLANKS)
    first = np.concatenate([[0], np.flatnonzero(ends[1:] != ends[:-1]) + 1, [n]]).astype(np.int32)
    closing = ends[first[:-1]]
    each = closing if unit != "word" else np.zeros(len(closing), bool)
    units = np.where(each, np.diff(first), closing)
    units[-1] += not closing[-1]  # the last unit may lack its end
    return first, np.concatenate([[0], np.cumsum(units)]).astype(np.int32), each


def cut_offset(first: np.ndarray, ended: np.ndarray, each: np.ndarray, k: int) -> int:
    """The code point behind the k-th unit."""
    if k <= 0:
        return 0
    run = int(np.searchsorted(ended[1:], k))
    return int(first[run]) + k - int(ended[run]) if each[run] else int(first[run + 1])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else [], kind))


def run_table(text: Column, unit: str = UNIT) -> Column:
    """The run table of each text, as a struct of arrays."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    @F.arrow_udf(RUNS)
    def encoded(texts: pa.Array) -> pa.Array:
        runs = [class_runs(t.as_py() or "", unit) for t in texts]
        kinds = (pa.int32(), pa.int32(), pa.bool_())
        return pa.StructArray.from_arrays([_lists([r[i] for r in runs], kind) for i, kind in enumerate(kinds)], ["first", "ended", "each"])

    return encoded(text)


def cuts(runs: Column, h1: Column, h2: Column) -> Column:
    """struct<n, low, high>: the number of units, and the offsets of the two cuts that the draws give."""

    @F.arrow_udf("struct<n:int,low:int,high:int>")
    def searched(runs: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        parts = []
        for name in ("first", "ended", "each"):
            column = runs.field(name)
            parts.append((column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()))
        out = np.zeros((3, len(runs)), np.int32)
        for i, draws in enumerate(zip(h1.to_pylist(), h2.to_pylist())):
            first, ended, each = (values[at[i] : at[i + 1]] for values, at in parts)
            n = int(ended[-1])
            low, high = sorted(d % (n + 1) for d in draws)
            out[:, i] = n, cut_offset(first, ended, each, low), cut_offset(first, ended, each, high)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "low", "high"])

    return searched(runs, h1, h2)


def draws(id_col: str = "doc_id", seed: int = SEED) -> list[Column]:
    """h1 to h4: the first 8-digit groups of the SHA-256 of ``seed:id``, as integers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _checked(marks: tuple[str, str, str]) -> None:
    """A mark must not be found across the seam of a text without marks and a mark."""
    for a in marks:
        for b in marks:
            if not a or any(a.endswith(b[:i]) for i in range(1, len(b))) or (a != b and a in b) or len(set(marks)) < 3:
                raise ValueError("marks are three, none of which begins as one ends or lies in another")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, runs_col: str | None = None) -> DataFrame:
    """``df`` with n_units, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of 100 texts are turned, ``suffix_first`` of 100 of these with the suffix first. ``runs_col`` names a column
    that holds stored run tables of the texts.
    """
    _checked(marks)
    if runs_col is not None and df.schema[runs_col].dataType.simpleString() != RUNS:
        raise ValueError(f"{runs_col} holds no run tables")
    text = F.coalesce(F.col("own").getField(text_col).cast("string"), F.lit(""))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.array(*draws(id_col, seed)).alias("h"))
    own = own.withColumn("text", text)
    runs = run_table(F.col("text"), unit) if runs_col is None else F.col("own").getField(runs_col)
    own = own.withColumn("cut", cuts(runs, F.get("h", F.lit(0)), F.get("h", F.lit(1))))
    t, low, high = F.col("text"), F.col("cut.low"), F.col("cut.high")
    p, s, m = map(F.lit, marks)
    plain = (t == "") | F.contains(t, p) | F.contains(t, s) | F.contains(t, m) | (F.get("h", F.lit(2)) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < suffix_first, "spm").otherwise("psm")
    own = own.withColumn("form", form)
    before, middle, after = F.substr(t, F.lit(1), low), F.substr(t, low + 1, high - low), F.substr(t, high + 1)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "spm", F.concat(s, after, p, before, m, middle)).otherwise(F.concat(p, before, s, after, m, middle))
    turned = F.col("form") != "plain"
    new = {"n_units": F.col("cut.n").cast("long"), "form": F.col("form"), "prefix_chars": F.when(turned, low.cast("long")), "middle_chars": F.when(turned, (high - low).cast("long")), "output": output}
    kept = {c: F.col("own").getField(c) for c in df.columns} | new
    return own.select(*[c.alias(name) for name, c in kept.items()])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form alone."""
    _checked(marks)
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column]:
        i, j = F.instr(output, second), F.instr(output, m)
        return F.substr(output, F.lit(len(first) + 1), i - len(first) - 1), F.substr(output, i + len(second), j - i - len(second))

    middle = F.substr(output, F.instr(output, m) + len(m))
    before, after = parts(p, s)
    late, early = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(before, middle, after)).otherwise(F.concat(early, middle, late))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", back))]
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digests)


SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as l, [cast('0x' || substr(h, 8 * i + 1, 8) as ubigint) for i in range(4)] as h from d),
c as (select *, cast(len(l) as bigint) as n, cast(least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) as bigint) as a, cast(greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) as bigint) as b from u),
f as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= {RATE} then 'plain' when h[4] % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form,
  array_to_string(l[1:a], '') as p, array_to_string(l[a+1:b], '') as m, array_to_string(l[b+1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from f
"""
