"""Budgets of calls and searches: reservations in order, what they leave, coverage of search channels, waves, and settings.

A run's requests are a sequence, because what one may take depends on those before it. Sequences are folded per run in slices of
bounded size, so that a long history is never one frame.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..streaming.folds import folded

# Search channels, their label, query and days, in the order in which the budget is spent.
CHANNELS = {
    "direct": ("直接采购", "中国 WMS WCS 智能仓储 立体库 堆垛机 AGV 设备采购 重新招标", 30),
    "intention": ("采购意向", "中国 智能仓储管理系统 输送设备 政府采购意向 企业采购计划 需求征集", 30),
    "retrofit": ("改造维保", "老立库 堆垛机 大修 维保 PLC WCS 电控 升级 企业采购公告", 30),
    "production": ("生产物流", "中国 制造企业 车间物流 厂内物流 成品物流 原料物流 物料系统 采购 技改", 30),
    "expansion": ("新建扩产", "制造企业 新工厂 生产基地 扩建 产能提升 自动化物流 建设", 90),
    "warehouse": ("仓库专项", "中国 成品库 原料库 备件库 器材库 粮库 智能化工程 自动化 采购", 30),
    "packaging": ("包装后端", "中国 包装后端 码垛 自动装车 输送 智能配送 设备采购 技改", 30),
    "early": ("早期信号", "制造企业 环评 技改备案 项目签约 建设规划 生产物流 自动化仓库", 90),
}
SUPPLEMENT = " 最新企业公告 项目需求"


@dataclass(frozen=True)
class Settings:
    """Budgets of a run. Costs are per million tokens and per thousand searches; None means unknown."""

    discovery: int = 12
    verification: int = 24
    total: int | None = 36
    tool_calls: int = 36
    model_calls: int = 64
    output_tokens: int = 8000
    input_cost: float | None = None
    output_cost: float | None = None
    search_cost: float | None = None
    pool: int = 60
    soft: int = 12
    hard: int = 18
    wave: int = 6
    target: int = 5

    @property
    def searches(self) -> int:
        return self.tool_calls if self.total is None else self.total


@dataclass
class Meter:
    """What a run has used. A reservation stays charged until its answer says how much of it was needed."""

    calls: int = 0
    reserved: int = 0
    discovery: int = 0
    verification: int = 0

    def remaining(self, phase: str, s: Settings) -> int:
        limit = s.discovery if phase == "discovery" else s.verification
        return max(0, min(limit - getattr(self, phase), s.searches - self.reserved))

    def step(self, phase: str, asked: int, model: bool, used: int | None, s: Settings) -> tuple[int, str]:
        """(allowed, outcome) of one request that asks for so many searches and, if it is answered, used so many."""
        if model and self.calls >= s.model_calls:
            return 0, "llm_call_budget_exhausted"
        allowed = min(asked, self.remaining(phase, s))
        if asked and not allowed:
            return 0, "search_call_budget_exhausted"
        released = max(allowed - used, 0) if used is not None else 0
        self.calls += model
        self.reserved += allowed - released
        setattr(self, phase, getattr(self, phase) + allowed - released)
        return allowed, "unknown" if asked and used is None else "settled"


def metered(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(run, seq, phase, asked, model, used) to run, seq, allowed, outcome, charged: two-phase budgeting of each run, in order of seq.

    ``used`` is null where the answer never came: the searches it may have used stay charged.
    """

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        meter, out = Meter(*map(int, state)), []
        for phase, asked, model, used in zip(rows["phase"], rows["asked"], rows["model"], rows["used"]):
            out.append((*meter.step(phase, int(asked), bool(model), None if pd.isna(used) else int(used), settings), meter.reserved))
        return (meter.calls, meter.reserved, meter.discovery, meter.verification), pd.DataFrame(out, columns=["allowed", "outcome", "charged"])

    return folded(requests, "run", ["seq"], ["phase", "asked", "model", "used"], fold, (0, 0, 0, 0), "allowed int, outcome string, charged int")


def cost(input_tokens: Column, output_tokens: Column, searches: Column, settings: Settings) -> Column:
    """Estimated cost; null unless all three rates are known."""
    rates = (settings.input_cost, settings.output_cost, settings.search_cost)
    if any(r is None for r in rates):
        return F.lit(None).cast("double")
    return F.round(input_tokens * rates[0] / 1e6 + output_tokens * rates[1] / 1e6 + searches * rates[2] / 1000, 6)


def preflight(settings: Settings, configured: bool = True, cost_per_query: int = 1) -> tuple[list[str], list[str], str]:
    """(errors, warnings, mode) of settings before a run: budgets that cannot cover the channels, or exceed the total."""
    errors = [n for n in ("discovery", "verification", "model_calls", "output_tokens", "pool", "soft", "hard", "wave", "target") if getattr(settings, n) <= 0]
    warnings = []
    if settings.discovery < len(CHANNELS) * cost_per_query + 2:
        warnings.append("discovery_budget_below_channels")
    if settings.searches < settings.discovery + settings.verification:
        warnings.append("total_budget_below_phases")
    if settings.soft > settings.hard:
        warnings.append("soft_limit_above_hard")
    return [f"{e}_must_be_positive" for e in errors], warnings, "error" if errors else "research" if configured else "rules"


def planned_searches(spark: SparkSession, today: str, remaining: int, cost_per_query: int = 1) -> DataFrame:
    """One row a channel, in order: position, channel, label, query with its days, status (planned or budget_exhausted)."""
    rows = [(i, k, label, query if query.startswith("中国") else f"中国 {query}", days, "planned" if i < remaining // cost_per_query else "budget_exhausted") for i, (k, (label, query, days)) in enumerate(CHANNELS.items())]
    df = spark.createDataFrame(rows, "position int, channel string, label string, query string, days int, status string")
    return df.withColumn("query", dates.dated_query(F.col("query"), today, F.col("days")))


def coverage(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """Channels with requests, returned and status from answers (channel, returned, error): failed, returned, empty, or not asked."""
    got = answers.groupBy("channel").agg(F.count("*").alias("requests"), F.sum(F.coalesce("returned", F.lit(0))).alias("returned"), F.max(F.when(T.text("error") != "", F.col("error"))).alias("error"))
    out = plan.join(got, "channel", "left").withColumns({"requests": F.coalesce("requests", F.lit(0)), "returned": F.coalesce("returned", F.lit(0))})
    status = F.when(F.col("status") == "budget_exhausted", "budget_exhausted").when(F.col("returned") > 0, "returned").when(F.col("error").isNotNull(), "failed").when(F.col("requests") > 0, "empty").otherwise("not_searched")
    return out.withColumn("status", status)


def supplements(covered: DataFrame, proposed: DataFrame, remaining: int, today: str) -> DataFrame:
    """At most two more searches: the first channel that returned nothing, then new wordings (position, query) in order.

    Returns position, channel (``dynamic`` for a wording) and query.
    """
    most = min(2, remaining)
    gap = covered.where("status <> 'budget_exhausted' and returned = 0").orderBy("position").limit(min(1, most))
    table = F.coalesce(*[F.when(F.col("channel") == k, F.lit(q)) for k, (_, q, _) in CHANNELS.items()])
    first = gap.select(F.lit(-1).alias("position"), "channel", dates.dated_query(F.concat(table, F.lit(SUPPLEMENT)), today, F.col("days")).alias("query"))
    wordings = proposed.select("position", F.trim(T.text("query")).alias("_q")).where("_q <> ''").groupBy("_q").agg(F.min("position").alias("position"))
    more = wordings.select("position", F.lit("dynamic").alias("channel"), dates.dated_query(F.col("_q"), today, 30).alias("query"))
    return first.unionByName(more).orderBy("position", "query").limit(most)


def waves(ranked: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of a research run (rank from 1, priority, verified, failed) with ``wave`` and ``researched``.

    Research goes in waves and stops before a wave once enough verified A or B rows are there, or the hard limit is reached; rows past
    the soft limit are researched only while the target is not met.
    """
    head = ranked.where(F.col("rank") <= settings.hard).withColumn("wave", F.floor((F.col("rank") - 1) / settings.wave).cast("int"))
    good = F.coalesce(F.col("verified") & F.col("priority").isin("A", "B"), F.lit(False)).cast("int")
    done = head.groupBy("wave").agg(F.sum(good).alias("_good"))  # three waves
    before = Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)
    done = done.select("wave", F.coalesce(F.sum("_good").over(before), F.lit(0)).alias("_before"))
    out = ranked.withColumn("wave", F.floor((F.col("rank") - 1) / settings.wave).cast("int")).join(F.broadcast(done), "wave", "left")
    return out.withColumn("researched", F.coalesce((F.col("rank") <= settings.hard) & (F.col("_before") < settings.target), F.lit(False))).drop("_before")


def ordered_sources(documents: DataFrame, most: int = 8) -> DataFrame:
    """Documents of each candidate (project_key, url, original, source_tier, position): the original first, then by tier, ``most`` at most."""
    order = Window.partitionBy("project_key").orderBy(F.desc(F.col("original").cast("int")), "source_tier", "position", "url")
    return documents.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def rescue_searches(queue: DataFrame, strategies: DataFrame, settings: Settings = Settings(), least: float = 75.0, searches: int = 3, query_cost: int = 1) -> DataFrame:
    """(run, page, position, strategy, outcome) of searches for more sources, for well rated candidates that no document names.

    ``queue``: run, page, rank, triage_score, related (a document of its own names it). ``strategies``: run, page, position, strategy, finds (whether what the
    search brings names it). A candidate's searches end with the first find, and at ``searches`` less the one by title. The searches of a run, in order
    of rank, may take what the verification budget holds above one lookup for each place of the hard limit; later ones are not made.
    """
    reserve = max(0, settings.verification - settings.hard * query_cost) // query_cost
    open_ = queue.where(~F.col("related") & (F.col("triage_score") >= least) & (F.col("rank") <= settings.hard)).select("run", "page", "rank")
    place = Window.partitionBy("run", "page").orderBy("position")
    asked = strategies.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= searches - 1).join(open_, ["run", "page"])
    found = F.coalesce(F.max(F.col("finds").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = asked.withColumn("_found", found).where("_found = 0")
    turn = F.row_number().over(Window.partitionBy("run").orderBy("rank", "page", "position"))
    told = wanted.withColumn("_turn", turn)
    # a candidate whose first search past the reserve is told so asks for no other
    over = F.col("_turn") > reserve
    first_over = F.sum(over.cast("int")).over(place)
    outcome = F.when(over, "verification_budget_reserved_or_exhausted").otherwise("searched")
    return told.withColumn("_over", first_over).where("_over <= 1").select("run", "page", "position", "strategy", outcome.alias("outcome"))


def rescue(candidates: DataFrame, documents: DataFrame, least: float = 75.0, remaining: int = 1) -> DataFrame:
    """Candidates (project_key, title, triage_score) worth a search for more sources: well rated, and no document names their title."""
    from .verify import related_documents

    near = related_documents(candidates.select("project_key", "title"), documents)
    lost = candidates.where(F.col("triage_score") >= least).join(near, "project_key", "left_anti")
    return lost.orderBy(F.desc("triage_score"), "project_key").limit(max(0, remaining))

