"""Evaluation: precision and recall, longitudinal repeats, misses, fact equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, urls
from ..functions import text as T
from .history import match


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row from expected_relevant and retained (booleans): counts, precision and recall, null on a zero denominator."""
    hit = F.col("expected_relevant") & F.col("retained")
    totals = df.agg(F.count("*").alias("n"), F.count_if("retained").alias("n_retained"), F.count_if("expected_relevant").alias("n_relevant"), F.count_if(hit).alias("n_hit"))
    return totals.withColumns({"precision": F.try_divide(F.col("n_hit"), F.col("n_retained")), "recall": F.try_divide(F.col("n_hit"), F.col("n_relevant"))})


def validated(cases: DataFrame, frozen: bool = False) -> DataFrame:
    """Cases (_ord, title, url, expected_relevant, human_reason, project_id, documents) with ``problem``, empty where a case is sound.

    A case needs a label with its reason, a public address, a title, and an identity that no case before it has; with ``frozen`` also
    documents (array<struct<url, text, retrieval_method>>) from public addresses, html or pdf, one of them with a text.
    """
    page = urls.fetch_url("url")
    identity = F.coalesce(F.nullif(T.text("project_id"), F.lit("")), page)
    first = Window.partitionBy("_identity").orderBy("_ord")
    rows = cases.withColumn("_identity", identity).withColumn("_n", F.row_number().over(first))
    problem = F.when(F.col("expected_relevant").isNull() | (T.text("human_reason") == ""), "label_missing").when((page == "") | (T.text("title") == ""), "identity_missing").when(F.col("_n") > 1, "duplicate_identity")
    if frozen:
        none = F.array().cast("array<struct<url:string,text:string,retrieval_method:string>>")
        docs = F.coalesce("documents", none)
        strange = F.exists(docs, lambda d: (urls.fetch_url(d["url"]) == "") | ~F.coalesce(d["retrieval_method"], F.lit("html")).isin("html", "pdf"))
        problem = problem.when(~F.exists(docs, lambda d: T.text(d["text"]) != ""), "documents_missing").when(strange, "document_not_original")
    return rows.withColumn("problem", problem.otherwise("")).drop("_identity", "_n")


def frozen(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Cases with the landed documents (url, text, retrieval_method) of their address attached: a benchmark that needs no network."""
    docs = documents.select(urls.fetch_url("url").alias("_page"), F.struct("url", "text", "retrieval_method").alias("_d")).where("_page <> ''").groupBy("_page").agg(F.array_sort(F.collect_list("_d")).alias("documents"))
    return cases.drop("documents").withColumn("_page", urls.fetch_url("url")).join(docs, "_page", "left").drop("_page")


def matched(cases: DataFrame, items: DataFrame) -> DataFrame:
    """(case, item) of each case's first item, in order of ``_ord``, by a shared address, its key, or its title and owner.

    ``cases``: _ord, title, pages (addresses to fetch, aliases too), project_key, expected_owner. ``items``: _ord, title, pages,
    project_key, owner. Each way is an equi-join; no pair is tried that shares nothing.
    """
    c = cases.select(F.col("_ord").alias("case"), "pages", F.col("project_key").alias("_key"), T.identity("title").alias("_title"), T.compact("expected_owner").alias("_owner"))
    i = items.select(F.col("_ord").alias("item"), "pages", F.col("project_key").alias("_key"), T.identity("title").alias("_title"), T.compact("owner").alias("_item_owner"))
    page = lambda df, who: df.select(who, F.explode(F.array_distinct("pages")).alias("_page")).where("_page <> ''")
    by_page = page(c, "case").join(page(i, "item"), "_page").select("case", "item")
    by_key = c.where(T.text("_key") != "").select("case", "_key").join(i.select("item", "_key"), "_key").select("case", "item")
    by_title = c.select("case", "_title", "_owner").join(i.select("item", "_title", "_item_owner"), "_title").where("_owner = '' or _owner = _item_owner").select("case", "item")
    return by_page.union(by_key).union(by_title).groupBy("case").agg(F.min("item").alias("item"))


FACT_FIELDS = ("budget", "owner", "deadline")


def benchmark(cases: DataFrame, items: DataFrame, top: int = 5) -> DataFrame:
    """One row of quality figures of research ``items`` against labelled ``cases``; null on a zero denominator.

    Cases also have expected_relevant, expected_stage, expected_budget, expected_owner, expected_deadline, expected_top5; items stage,
    budget, deadline, official_source_url. Only verified items of full research belong here.
    """
    pairs = matched(cases, items)
    told = cases.withColumnRenamed("_ord", "case").select("case", "expected_relevant", *[T.text(f"expected_{f}").alias(f"expected_{f}") for f in ("stage", *FACT_FIELDS)], F.coalesce("expected_top5", F.lit(False)).alias("expected_top5"))
    found = items.select(F.col("_ord").alias("item"), *[T.text(f).alias(f) for f in ("stage", *FACT_FIELDS, "official_source_url")])
    rows = told.join(pairs, "case", "left").join(found, "item", "left")
    hit, positive = F.col("item").isNotNull(), F.coalesce("expected_relevant", F.lit(False))
    head = items.orderBy("_ord").limit(top)
    shown = matched(cases, head).select("case", F.lit(True).alias("_shown"))
    rows = rows.join(shown, "case", "left")
    sums = [F.count("*").alias("labeled_cases"), F.count_if(hit).alias("matched_predictions"), F.count_if(hit & positive).alias("n_hit"), F.count_if(positive).alias("n_positive")]
    staged = positive & hit & (F.col("expected_stage") != "")
    sums += [F.count_if(staged).alias("stage_denominator"), F.count_if(staged & (F.col("stage") == F.col("expected_stage"))).alias("n_stage"), F.count_if("expected_top5").alias("n_top"), F.count_if(F.col("expected_top5") & F.coalesce("_shown", F.lit(False))).alias("n_shown")]
    for f in FACT_FIELDS:
        asked = positive & (F.col(f"expected_{f}") != "")
        given = asked & hit & (F.col(f) != "")
        sums += [F.count_if(asked).alias(f"{f}_expected"), F.count_if(given).alias(f"{f}_available"), F.count_if(given & same_fact(f, F.col(f"expected_{f}"), F.col(f))).alias(f"{f}_correct")]
    counts = items.groupBy("project_key").agg(F.count("*").alias("c"), F.count_if(T.text("official_source_url") != "").alias("o")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("verified_count"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_copies"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_official"))
    one = rows.agg(*sums).crossJoin(counts)  # one row each
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    rates = {"precision": share("n_hit", "matched_predictions"), "recall": share("n_hit", "n_positive"), "stage_accuracy": share("n_stage", "stage_denominator"), "official_source_rate": share("n_official", "verified_count"), "duplicate_rate": share("n_copies", "verified_count"), "top5_overlap": share("n_shown", "n_top")}
    rates |= {f"{f}_accuracy": share(f"{f}_correct", f"{f}_available") for f in FACT_FIELDS} | {f"{f}_completeness": share(f"{f}_available", f"{f}_expected") for f in FACT_FIELDS}
    return one.withColumns(rates).drop("n_hit", "n_stage", "n_shown", "n_copies", "n_official")


def benchmark_errors(cases: DataFrame, items: DataFrame) -> DataFrame:
    """(case, error) of what a benchmark run got wrong: missed_high_value, false_positive, wrong_stage, official_source_missing, wrong_<fact>."""
    pairs = matched(cases, items)
    told = cases.withColumnRenamed("_ord", "case").select("case", F.coalesce("expected_relevant", F.lit(False)).alias("_yes"), *[T.text(f"expected_{f}").alias(f"expected_{f}") for f in ("stage", *FACT_FIELDS)])
    found = items.select(F.col("_ord").alias("item"), *[T.text(f).alias(f) for f in ("stage", *FACT_FIELDS, "official_source_url")])
    rows = told.join(pairs, "case", "left").join(found, "item", "left")
    hit = F.col("item").isNotNull()
    wrong = [(F.col("_yes") & ~hit, "missed_high_value"), (hit & ~F.col("_yes"), "false_positive"), (hit & (F.col("expected_stage") != "") & (F.col("stage") != F.col("expected_stage")), "wrong_stage"), (hit & (F.col("official_source_url") == ""), "official_source_missing")]
    wrong += [(F.col("_yes") & hit & (F.col(f"expected_{f}") != "") & (F.col(f) != "") & ~same_fact(f, F.col(f"expected_{f}"), F.col(f)), f"wrong_{f}") for f in FACT_FIELDS]
    return rows.select("case", F.explode(F.array_compact(F.array(*[F.when(p, F.lit(n)) for p, n in wrong]))).alias("error"))


def deliveries(df: DataFrame, day: str = "day") -> DataFrame:
    """Per day: recorded delivery events, one for each (project_key, material_hash, last_reported_at), and those of a fingerprint delivered before."""
    events = df.where(F.col("last_reported_at").isNotNull() & (F.col("last_reported_at").cast("string") != "")).groupBy("project_key", "material_hash", "last_reported_at").agg(F.min(F.struct(F.col(day).alias("day"), "_ord")).alias("at"))
    order = Window.partitionBy("project_key", "material_hash").orderBy("at", "last_reported_at")
    return events.withColumn("_n", F.row_number().over(order)).groupBy(F.col("at.day").alias("day")).agg(F.count("*").alias("n_events"), F.count_if(F.col("_n") > 1).alias("n_repeated"))


def longitudinal(df: DataFrame, day: str = "day") -> DataFrame:
    """Per day: rows, and reappearances of an unchanged (project_key, material_hash)."""
    seen = Window.partitionBy("project_key", "material_hash").orderBy(day, "_ord")
    return df.withColumn("_n", F.row_number().over(seen)).groupBy(day).agg(F.count("*").alias("n_rows"), F.count_if(F.col("_n") > 1).alias("n_unchanged"))


def same_fact(kind: str, expected: Column, found: Column) -> Column:
    """Budgets compare as amounts, deadlines as times, where both can be read; all else as compact text."""
    same = T.compact(expected) == T.compact(found)
    if kind == "budget":
        return F.coalesce(facts.amount(expected) == facts.amount(found), same)
    if kind == "deadline":
        a, b = facts.date_ts(expected), facts.date_ts(found)
        return F.when((a > 0) & (b > 0), a == b).otherwise(same)
    return same


def labelled(cases: DataFrame, items: DataFrame) -> DataFrame:
    """Cases with the first item that shares key, page or title."""
    return cases.join(match(cases, items), "_ord", "left")


def misses(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Per target (project_key) its best pipeline row: retained, else without a reason, else the last; none is a search miss."""
    best = Window.partitionBy("project_key").orderBy(F.desc(F.col("retained").cast("int")), F.desc((T.text("drop_reason") == "").cast("int")), F.desc("_ord"))
    top = runs.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("project_key", "retained", "drop_reason")
    outcome = F.when(F.col("retained").isNull(), "search_miss").when(F.col("retained"), "retained").otherwise(F.coalesce("drop_reason", F.lit("")))
    return targets.join(top, "project_key", "left").withColumn("outcome", outcome).select("project_key", "outcome")


def duplicate_rate(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("c"))
    return counts.agg(F.sum(F.col("c") - 1).alias("n_duplicates"), F.sum("c").alias("n_rows"))
