"""Secret scans over a blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds one row for each
(blob, rule, rule_version) that was ever scanned, with its spans; a scan reads the text of one path of each
blob that lacks a pair, scans it for the lacking rules, and adds the pairs. Findings are then joined back to all
paths of the blob. A changed rule gets a new version and is the only one scanned again.

Spans are code points, end exclusive. Java's ``split`` and ``regexp_extract_all`` by one pattern cut a text
into alternating rests and matches, so a match's place is the length of what lies before it.

Nulls: a null text is an empty text and has no findings; null ids are kept. Copies and repeated rows share a
blob and each get its findings. Very long texts are scanned whole. An empty table gives an empty result and ledger.
``scan`` replaces columns named ``blob`` or ``findings``; others pass through. ``without_secrets`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches left to right; those whose ``group`` is shorter than ``least`` are dropped.
    ``hint`` is a pattern that any text with a kept match contains; ``scan``, where given, finds the kept matches only."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str
    scan: str = ""


_WORDS = "(?i:(password|passwd|secret|token|api_?key))"
BASE_RULES = (
    Rule("assign", 1, _WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, _WORDS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]+", 0, 32, "[0-9a-f]{32}", "[0-9a-f]{32,}"),
)
#: A key block: header fields, base64 and the END line; without an END line, as far as whole lines of base64 go.
_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x20\t\r]*\n(?:Proc-Type|DEK-Info):[^\n]*)*(?:[A-Za-z0-9+/=\x20\t\r\n]*-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\t\r]*\n+[A-Za-z0-9+/=]{16,})*)"
#: What the method adds: key blocks and signed web tokens.
MORE_RULES = (
    Rule("pem", 2, _KEY, 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
)
#: Spans up to which findings are broadcast to where the texts are (about 50 MB with their blobs).
BROADCAST_SPANS = 500_000
LEDGER = "blob binary, rule string, rule_version int, spans array<struct<start:int,end:int>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of one rule; texts without the hint cost one search."""
    pattern = F.lit(rule.scan or rule.pattern)
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, pattern, F.lit(0)))).alias("rest"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["rest"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.array().cast(kind)
    spans = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.hint), spans).otherwise(empty).cast(kind)


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))


def scan(versions: DataFrame, folder: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. Return every version with blob and findings, and the new ledger.

    ``findings`` is array<struct<start, rank, kind, end>> in order of start, then of the rules. The text is
    left out unless it is to be kept; then few findings are broadcast, so that texts stay where they are.
    """
    have = addressed(versions.drop("findings"), text_col)
    wanted = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules]
    one = have.groupBy("blob").agg(F.min(id_col).alias("_id"))
    if ledger is not None:
        pairs = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("done"))
        one = one.join(pairs, "blob", "left").withColumn("todo", F.array_except(F.array(*wanted), F.coalesce("done", F.array().cast("array<struct<rule:string,rule_version:int>>"))))
        one = one.where(F.size("todo") > 0).select("blob", "_id", F.col("todo.rule").alias("todo"))
        one = stored(one, folder, "unseen")
        texts = have.select("blob", F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(one.withColumnRenamed("_id", "_one"), "blob").where("_id <=> _one").drop("_one")
    else:
        # every blob is new: the text goes along with the one shuffle by blob
        texts = have.groupBy("blob").agg(F.first(text_col).alias("_text")).withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    text = F.coalesce(F.col("_text"), F.lit(""))
    scanned = [F.when(F.array_contains("todo", r.kind), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), rule_spans(text, r).alias("spans"))) for r in rules]
    new = texts.select("blob", F.array_compact(F.array(*scanned)).alias("_pairs")).select("blob", F.inline("_pairs"))
    if ledger is not None:  # rows repeated under one id scan alike
        new = new.dropDuplicates(["blob", "rule", "rule_version"])
    grown = stored(new, folder, "ledger")
    if ledger is not None:
        grown = ledger.select(*grown.columns).unionByName(grown)

    order = F.array(*[F.concat_ws("@", F.lit(r.kind), F.lit(r.version)) for r in rules])
    hits = grown.withColumn("rank", F.array_position(order, F.concat_ws("@", "rule", "rule_version")).cast("int")).where((F.size("spans") > 0) & (F.col("rank") > 0))
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), F.col("rule").alias("kind"), s["end"].alias("end"))).alias("f"))
    findings = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("findings"))
    if keep_text:
        size = hits.agg(F.sum(F.size("f"))).first()[0] or 0
        findings = F.broadcast(findings) if size <= BROADCAST_SPANS else findings
    out = (have if keep_text else have.drop(text_col)).join(findings, "blob", "left")
    none = F.array().cast(findings.schema["findings"].dataType)
    return out.withColumn("findings", F.coalesce("findings", none)), grown


def joined(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])))


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark."""

    def step(acc: Column, f: Column) -> Column:
        fresh = f["start"] >= acc["at"]
        put = F.concat(acc["out"], F.substr(text, acc["at"] + 1, f["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], f["end"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def without_secrets(df: DataFrame, folder: str) -> DataFrame:
    """All rows of ``df`` (doc_id, text, ...), secrets in the text replaced and n_chars, where there is one, recounted."""
    rest = [c for c in df.columns if c not in ("doc_id", "text")]
    found, _ = scan(df.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("rest")), folder, keep_text=True)
    out = found.withColumn("text", redacted(F.col("text"), F.col("findings")))
    own = {c: F.col(f"rest.`{c}`") for c in rest} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("findings") > 0, F.length("text")).otherwise(own["n_chars"]).cast(df.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) for c in df.columns])


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark))
    base = F.filter("findings", lambda f: f["kind"].isin(*[r.kind for r in BASE_RULES]))
    counts = [F.expr(f"cast(size(filter(findings, f -> f.kind = '{r.kind}')) as long)").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _spans_sql(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""select doc_id, unnest(range(1, len(m) + 1)) as i, {rank} as rank, '{rule.kind}' as kind, {rule.least} as least, m, v, p
from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {rule.group}) as v, regexp_split_to_array(t, '{pattern}') as p from d)"""


#: All spans in SQL: a match starts after the rests and matches before it.
SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
k as ({" union all ".join(_spans_sql(r, i + 1) for i, r in enumerate(BASE_RULES + MORE_RULES))}),
s as (select doc_id, rank, kind, length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i-1], '')) as st, length(m[i]) as n from k where length(v[i]) >= least),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  coalesce(string_agg(kind || ':' || st || ':' || (st + n), ',' order by st, rank) filter (rank <= {len(BASE_RULES)}), '') as base, string_agg(kind || ':' || st || ':' || (st + n), ',' order by st, rank) as spans from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""
