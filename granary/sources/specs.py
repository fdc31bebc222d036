"""Source specs as data: what each source reads, how its rows are filtered, and which scope they belong to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..lexicon import CONTEXT, CORE, RELATED, _w


@dataclass(frozen=True)
class Feed:
    label: str
    url: str
    publisher: str = ""
    kind: str = ""
    group: str = ""
    pattern: str = ""


@dataclass(frozen=True)
class Source:
    """One source. ``queries`` are (keyword, label); a feed's own address is its keyword."""

    name: str
    scope: str = "national"
    feeds: tuple[Feed, ...] = ()
    queries: tuple[tuple[str, str], ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    per_feed: int = 10
    fallback: str = "RSS"

    def searches(self) -> tuple[tuple[str, str], ...]:
        return self.queries or tuple((f.url, f.label) for f in self.feeds)


# --- fixed values: sources, their addresses, searches and words ----------------------------------
POLICY = Source(
    "政策标准", per_feed=8, fallback="政策标准",
    feeds=(
        Feed("中国政府网政务动态", "https://www.gov.cn/yaowen/liebiao/", "中国政府网政务动态", "official"),
        Feed("工信部要闻", "https://www.miit.gov.cn/xwdt/gxdt/index.html", "工信部要闻", "official"),
        Feed("发改委要闻", "https://www.ndrc.gov.cn/xwdt/", "发改委要闻", "official"),
    ),
    include=_w("智能制造 工业互联网 数字化转型 制造业 物流 仓储 机器人 自动化 新型工业化"),
    exclude=_w("文旅 体育 教育考试 娱乐"),
)
MEDIA = Source(
    "行业媒体", per_feed=10, fallback="行业媒体",
    feeds=(
        Feed("36氪资讯", "https://36kr.com/feed", "36氪资讯", "industry_media"),
        Feed("中国传动网-行业资讯", "https://www.chuandong.com/news/list4.html", "中国传动网", "industry_media"),
        Feed("中国传动网-企业动态", "https://www.chuandong.com/news/list8.html", "中国传动网", "industry_media"),
        Feed("智能制造网-行业动态", "https://www.gkzhan.com/news/t15/list.html", "智能制造网", "industry_media"),
        Feed("智能制造网-市场分析", "https://www.gkzhan.com/news/t14/list.html", "智能制造网", "industry_media"),
    ),
    include=_w("智能制造 制造业 工业自动化 工业互联网 仓储物流 智慧物流 机器人 工业软件 数字化工厂 MES WMS WCS AGV 堆垛机 输送线 立体库 立库 仓储 物流 自动化 伺服 PLC 传感器 运动控制"),
    exclude=_w("明星 娱乐 影视 房产 游戏评测 招聘 求职 培训课程 展会预告"),
)
EXPO = Source(
    "展会协会", per_feed=10, fallback="展会协会",
    feeds=(
        Feed("传动网-展会预告", "https://www.chuandong.com/exhibition/list0.html", "传动网", "association"),
        Feed("传动网-展会报道", "https://www.chuandong.com/news/list5.html", "传动网", "association"),
        Feed("中国物流与采购联合会", "http://www.chinawuliu.com.cn/zixun/", "中国物流与采购联合会", "association"),
        Feed("中国机械工业联合会", "http://www.cmif.org.cn/", "中国机械工业联合会", "association"),
    ),
    include=_w("智能仓储 仓储物流 仓储 物流自动化 物流 供应链 搬运 立体库 堆垛机 输送 传输 AGV AMR WMS WCS 智能制造 工业自动化 工业机器人 机器人 自动化 工博会 物流展 智能装备 工业装备 装配 动力传动 PLC 伺服 传感器"),
    exclude=_w("招聘 培训通知 党建 五金机电 电线电缆 核电 核能 水电站 清洁能源 光伏 储能 商用车 专用车 汽车展 纺织 房地产 家装"),
)
BIDDING = Source(
    "招投标", per_feed=12, fallback="招投标公告",
    feeds=(
        Feed("中国政府采购网采购信息", "https://www.ccgp.gov.cn/cggg/zygg/index.htm", "中国政府采购网采购信息", "official"),
        Feed("中国政府采购网地方采购", "https://www.ccgp.gov.cn/cggg/dfgg/index.htm", "中国政府采购网地方采购", "official"),
        Feed("全国公共资源交易平台", "https://www.ggzy.gov.cn/deal/dealList.html", "全国公共资源交易平台", "official"),
        Feed("中国招标投标公共服务平台", "https://bulletin.cebpubservice.com/", "中国招标投标公共服务平台", "official"),
    ),
    queries=tuple((q, "招投标搜索") for q in ("智能仓储 招标 中标 公告", "立体库 堆垛机 输送线 招标 采购", "WMS WCS AGV 招标 中标", "物流自动化 集成项目 中标", "仓储设备 公开招标 中标候选人")),
    include=_w("招标公告 采购公告 中标 中标候选人 成交 竞争性谈判 竞争性磋商 公开招标 单一来源 EPC 总包 立体库 智能仓储 仓储 物流 自动化 WMS WCS AGV 堆垛机 输送线 集成 中标公示 招标"),
    exclude=_w("医疗耗材 物业管理 食材配送 保洁"),
)
DIRECT = Source(
    "行业直采", per_feed=12, include=CORE + RELATED + CONTEXT,
    feeds=(
        Feed("中国AGV网资讯", "https://www.chinaagv.com/news/", "中国AGV网", "industry_media", "中叉网/AGV网", r"/news/detail/\d{6}/\d+\.html"),
        Feed("掌链物流与供应链资讯", "https://www.i56r.com/", "掌链", "industry_media", "", r"/new/\d+$"),
        Feed("北自科技新闻", "https://www.bzkj.cn/Home.html", "北自科技官网", "vendor", "", r"/News_details/\d+\.html"),
        Feed("兰剑智能公司新闻", "https://www.blueswords.com/company-news_3", "兰剑智能官网", "vendor", "", r"/company-news-\d+$"),
    ),
)
ORGANIZER_ENDPOINT = "https://www.chinalet.cn/home/jiekou/handle.ashx"
ORGANIZER = Source("展会主办方", queries=((ORGANIZER_ENDPOINT, "LET展会官网"),))
NEWS_SEARCH = Source("今日头条", queries=(
    ("智能制造 工业自动化 智能仓储 立库 堆垛机", "智能制造"), ("智能工厂 集成 数字化工厂 AGV", "智能工厂"), ("立库招标 投标 仓储设备 智能仓库 中标", "行业信息"),
    ("制造业 数字化转型 工业互联网", "数字化"), ("工业4.0 数字孪生 MES WMS WCS", "工业技术"), ("工业自动化展 智能制造展 物流展", "工业展览"),
    ("中鼎集成 昆船智能 北自科技 兰剑 今天国际 井松智能 音飞储存 德马科技 极智嘉 海柔创新 快仓", "厂商"),
))
LOCAL_SEARCHES = (("引进项目 最新项目 重大项目 招商引资", "本地项目"), ("新建厂房 扩建 技改项目 项目开工 项目投产", "本地制造项目"), ("产业园 物流园 智能仓储 物流中心 自动化立库", "本地仓储建设"), ("鼓励政策 支持政策 产业政策 制造业政策", "本地政策"))
LOCAL_ACCOUNT_SEARCHES = (("引进项目 最新项目", "本地项目动态"), ("招商引资 项目签约", "本地招商"), ("新建厂房 扩建 开工投产", "本地建设"), ("智能仓储 物流中心", "本地仓储政策"))
ACCOUNT_SEARCH = Source("微信公众号", scope="wechat", queries=(
    ("智能仓储 立体仓库 堆垛机", "智能仓储"), ("智能制造 工业自动化", "智能制造"), ("AGV 物流机器人 仓储机器人", "AGV物流"), ("WMS WCS MES 数字化工厂", "数字化"),
    ("中鼎集成 昆船智能 北自科技 兰剑", "厂商A"), ("今天国际 井松智能 音飞储存 德马科技", "厂商B"), ("极智嘉 海柔创新 快仓 海康机器人", "厂商C"), ("工业自动化展 智能制造展 物流展", "工业展览"),
))
ACCOUNT_FEEDS = Source("公众号RSS", scope="wechat")
ANSWERS = Source("知乎发现", scope="discover", queries=(("智能仓储 立体库 堆垛机", "仓储"), ("WMS WCS AGV AMR", "系统"), ("物流自动化 工厂改造", "改造"), ("仓储项目 招标 中标", "项目")))
VIDEOS = Source("B站发现", scope="discover", queries=(("智能仓储 立体库", "仓储"), ("WMS WCS AGV", "系统"), ("物流自动化 项目案例", "案例"), ("工厂自动化 改造", "改造")))
#: Terms of the news search whose payloads stand for a search of opportunities, and what it costs.
SEARCH_COUNT, SEARCH_COST = 10, 2
# --- end of fixed values ------------------------------------------------------------------------------


def local_source(region: str) -> Source:
    return Source("本地项目", scope="local", queries=tuple((f"{region} {q}", label) for q, label in LOCAL_SEARCHES))


def local_account_source(region: str) -> Source:
    return Source("本地公众号", scope="local", queries=tuple((f"{region} {q}", label) for q, label in LOCAL_ACCOUNT_SEARCHES))


def registry(region: str = "无锡", account_search: bool = False) -> tuple[Source, ...]:
    """The sources in order; with ``account_search`` the two account searches stand at their places."""
    sources = [local_source(region), ANSWERS, VIDEOS, NEWS_SEARCH, ACCOUNT_FEEDS, POLICY, BIDDING, MEDIA, EXPO, DIRECT, ORGANIZER]
    if account_search:
        sources.insert(0, local_account_source(region))
        sources.insert(4, ACCOUNT_SEARCH)
    return tuple(sources)


def in_scope(sources: tuple[Source, ...], scope: str) -> tuple[Source, ...]:
    """Sources of a partial refresh; the local page also needs the accounts' sources."""
    if scope in ("discover", "wechat"):
        return tuple(s for s in sources if s.scope == scope)
    return tuple(s for s in sources if (s.scope in ("local", "wechat") if scope == "local" else s.scope not in ("local", "discover", "wechat")))


def feed_table(spark: SparkSession, sources: tuple[Source, ...]) -> DataFrame:
    """One row a feed: source, position, feed_url, publisher, kind, group, pattern, include, exclude, per_feed, region_scope."""
    rows = [(s.name, i, f.url, f.publisher or f.label or s.fallback, f.kind, f.group, f.pattern, list(s.include), list(s.exclude), s.per_feed, s.scope) for s in sources for i, f in enumerate(s.feeds)]
    return spark.createDataFrame(rows, "source string, position int, feed_url string, publisher string, kind string, group string, pattern string, include array<string>, exclude array<string>, per_feed int, region_scope string")


def query_table(spark: SparkSession, sources: tuple[Source, ...], overrides: dict[str, tuple[tuple[str, str], ...]] | None = None) -> DataFrame:
    """One row a search: source, region_scope, keyword, label, count. ``overrides`` replace a source's searches by its name."""
    rows = [(s.name, s.scope, k, label or k, SEARCH_COUNT) for s in sources for k, label in ((overrides or {}).get(s.name) or s.searches()) if k]
    return spark.createDataFrame(rows, "source string, region_scope string, keyword string, label string, count int")


@dataclass(frozen=True)
class Account:
    name: str
    scopes: tuple[str, ...] = ("wechat",)
    aliases: tuple[str, ...] = ()
    rss_url: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Accounts:
    """Configured accounts and searches; read from a JSON document that is kept beside the data."""

    accounts: tuple[Account, ...] = ()
    queries: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)

    @classmethod
    def read(cls, document: str) -> Accounts:
        """Disabled and nameless accounts go; unknown scopes count as ``wechat``; unreadable documents are empty ones."""
        import json

        try:
            raw = json.loads(document.lstrip("\ufeff"))
        except ValueError:
            return cls()
        if not isinstance(raw, dict):
            return cls()
        known = ("wechat", "local")
        scope = lambda s: s if (s := str(s or "").strip().lower()) in known else "wechat"
        accounts = []
        for x in raw.get("sources") or []:
            if isinstance(x, dict) and x.get("enabled", True) and str(x.get("name", "")).strip():
                scopes = x.get("scopes", ["wechat"])
                scopes = tuple(dict.fromkeys(map(scope, scopes if isinstance(scopes, list) else [scopes]))) or ("wechat",)
                aliases = x.get("aliases", [])
                accounts.append(Account(str(x["name"]).strip(), scopes, tuple(str(a).strip() for a in (aliases if isinstance(aliases, list) else []) if str(a).strip()), str(x.get("rss_url", "")).strip()))
        found = raw.get("queries") if isinstance(raw.get("queries"), dict) else {}
        pairs = lambda rows: tuple((k, str(q.get("label", "")).strip() or k) for q in (rows if isinstance(rows, list) else []) if isinstance(q, dict) and (k := str(q.get("keyword", "")).strip()))
        return cls(tuple(accounts), {s: pairs(found.get(s)) for s in known})

    def of(self, scope: str, feeds_only: bool = False) -> tuple[Account, ...]:
        return tuple(a for a in self.accounts if scope in a.scopes and (a.rss_url or not feeds_only))

    def feeds(self) -> tuple[Account, ...]:
        """Accounts with a feed, one for each name and address."""
        return tuple({(a.name, a.rss_url): a for s in ("wechat", "local") for a in self.of(s, True)}.values())


def account_table(spark: SparkSession, accounts: tuple[Account, ...]) -> DataFrame:
    return spark.createDataFrame([(a.name, list(a.scopes), list(a.aliases), a.rss_url) for a in accounts], "name string, scopes array<string>, aliases array<string>, rss_url string")
