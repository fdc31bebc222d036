"""Default vocabularies and thresholds. All operators take them as parameters.

Fixed values: these lists, weights, limits and patterns must be as they are for right results.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def _w(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# --- fixed values: national news ---------------------------------------------------------------
CORE = _w("智能仓储 智慧仓储 仓储 仓库 立体库 立库 堆垛机 输送 分拣 拣选 搬运 穿梭车 无人叉车 货到人 厂内物流 生产物流 物流自动化 智慧物流 智能物流 物流机器人 物流装备 物流设备 物流技术 物流系统 物流场景 物流中心 冷链 wms wcs agv amr")
RELATED = _w("工业自动化 智能制造 工业机器人 工业软件 工业互联网 数字孪生 运动控制 伺服 传感器 plc mes 工博会")
CONTEXT = _w("物流 供应链 仓配 仓储配送 物料系统")
HARD_EXCLUDE = _w("房价 楼市 明星 综艺 高考 学区 招聘 求职 培训课程 股票涨停 股票跌停 违纪 贪腐 受贿")
UNRELATED = _w("液冷 数据中心 气象科技大楼 住宅 商用车 汽车维修 切削 机床 手机芯片 3d打印鞋")
BID = _w("招标 中标 采购公告 采购意向 成交公告 竞争性磋商 询比采购")
EVENT = _w("展会 博览会 展览会 工博会 物流展 峰会 论坛 大会 cemat let")
POLICY = _w("标准 政策 实施方案 指导意见")
CASE = _w("交付 项目 投产 改造 案例 落地")
AMBIGUOUS_CORE = _w("amr mes plc")
LISTICLE = _w("核心竞争力排名 厂家深度盘点 十大厂家")
GROUPS = {"chinaagv.com": "中叉网/AGV网", "chinaforklift.com": "中叉网/AGV网"}
SOURCE_NAMES = {
    "toutiao.com": "今日头条", "chuandong.com": "中国传动网", "gkzhan.com": "智能制造网", "chinawuliu.com.cn": "中国物流与采购联合会",
    "chinaagv.com": "中国AGV网", "chinaforklift.com": "中国叉车网", "i56r.com": "掌链", "bzkj.cn": "北自科技官网", "blueswords.com": "兰剑智能官网",
    "chinalet.cn": "LET展会官网", "ndrc.gov.cn": "国家发展改革委", "miit.gov.cn": "工业和信息化部", "gov.cn": "中国政府网",
    "ccgp.gov.cn": "中国政府采购网", "ggzy.gov.cn": "全国公共资源交易平台", "cebpubservice.com": "中国招标投标公共服务平台",
}
NEWS_DOMAINS = ("xinhuanet.com", "xinhua.cn")
GENERIC_SOURCES = ("", "行业媒体", "展会协会", "政策标准", "招投标公告")
EVENT_REGIONS = _w("波兰 德国 江苏 广东 上海 北京 辽宁 河北 唐山 西安 长春 苏州 广州 深圳")
EVENT_VERSIONS = _w("二次 重新 变更 澄清 取消")

# --- fixed values: other scopes ------------------------------------------------------------------
REQUIRED = _w("制造 工厂 产线 生产线 车间 加工 自动化 智能 数字化 数智 信息化 仓储 仓库 立库 堆垛机 AGV 物流 工业 PLC MES WMS SCADA ERP 机器人 机械臂 协作机器 装备 设备 仪器 传感器 项目 中标 招标 签约 投产 展会 博览会 论坛 峰会 数字孪生 工业互联网 工业4.0 仿真 中鼎 承亿 昆船 北自院 立库集成 兰剑")
EXCLUDE = _w("村支书 村干部 纪委 反腐 落马 违纪 贪腐 受贿 举报 巡视 处分 房价 楼市 股票 A股 涨停 跌停 明星 综艺 娱乐 电影 电视剧 高考 招生 学区 中考 疫情 核酸 疫苗 以旧换新 人形机器人 具身机器人 机器狗 四足机器人 服务机器人 养老机器人 陪伴机器人 贪污 官员 书记 局长")
PREFILTERED = _w("本地项目 微信公众号 本地公众号 公众号RSS 政策标准 招投标 行业媒体 展会协会 知乎发现 B站发现")
VENDORS = (*_w("中鼎 中鼎集成 承亿 昆船 昆船智能 北自院 北自所 兰剑 今天国际 北自科技 井松智能 音飞储存 德马科技 诺力股份 中科微至 东杰智能 机器人股份 新松 海康机器人 极智嘉 海柔创新 快仓 劢微机器人 库卡 ABB 西门子 施耐德 德马泰克 Dematic 瑞仕格 Swisslog 大福 Daifuku 胜斐迩"), "SSI Schaefer", *_w("KNAPP 范德兰德 Vanderlande TGW"))
ROBOT = _w("机器人 人形机器人 具身智能 机械臂 协作机器人 服务机器人 陪伴机器人 医疗机器人 四足机器人")
WAREHOUSE_CONTEXT = _w("仓储 仓库 立库 堆垛机 物流 供应链 wms wcs mes agv amr 输送线 拣选 分拣 工厂 产线 制造 工业")
DEMAND_STRONG = _w("引进项目 最新项目 重大项目 招商引资 产业园 新建厂房 扩建 开工 投产 落地 签约 物流中心 智能仓储 自动化立库")
DEMAND_MEDIUM = _w("技改 数字化改造 产线升级 设备更新 扩产")
BIDDING = _w("招标 中标 中标候选人 成交公告 采购公告 招标公告 公开招标 竞争性磋商 竞争性谈判 单一来源 EPC 总包 立体库 堆垛机 输送线 WMS WCS AGV 物流自动化")
TRUSTED = _w("新华社 人民日报 央视 新华网 人民网 每日经济新闻 第一财经 经济日报 21世纪经济报道 澎湃新闻 界面新闻 中国工业报 中国工控网 36氪")
LOCAL_INTENT = _w("引进项目 最新项目 重大项目 招商引资 项目签约 签约仪式 项目落地 项目开工 项目投产 开工建设 新建厂房 扩建 增资扩产 产业园 物流园")
LOCAL_INDUSTRY = _w("仓储 物流 供应链 物流中心 仓储中心 智能制造 自动化 数字化改造 技改 产线 工厂 厂房 立库 堆垛机 WMS WCS AGV AMR")
LOCAL_ACCOUNTS = _w("无锡发布 无锡日报 无锡观察 无锡高新区 无锡经开区 新吴发布 锡山发布 惠山发布 滨湖发布 梁溪发布 江阴发布 宜兴发布 无锡商务 无锡工信 无锡发改 无锡招商")

# --- fixed values: opportunities -----------------------------------------------------------------
WAREHOUSE_TERMS = {"智能仓储": 35, "仓储自动化": 35, "自动化立体库": 35, "立体库": 28, "堆垛机": 25, "WMS": 24, "WCS": 24, "AGV": 18, "AMR": 18, "输送线": 16, "输送系统": 18, "分拣系统": 18, "物流自动化": 24, "仓储设备": 18, "物流中心": 12, "智能物流": 18}
INTENT_TERMS = {"招标公告": 18, "采购公告": 18, "公开招标": 18, "竞争性磋商": 14, "询价": 10, "采购": 10, "中标候选人": 8, "中标": 6, "扩建": 13, "新建": 13, "改造": 15, "升级": 10, "维保": 16, "维护": 12}
OPPORTUNITY_EXCLUDES = _w("食材配送 快递服务 运输服务 车辆采购 物业服务 医疗耗材 仓库租赁 装卸服务 保洁服务 物流运输 冷链运输")
EDITORIAL_EXCLUDES = _w("排行榜 榜单 盘点 怎么选 如何选择 供应商对比 厂家对比 选型指南 采购指南 品牌推荐 行业趋势 深度解析 一文看懂 项目一览 中标一览 项目汇总 中标汇总")
NEGATIONS = _w("不含 不包含 不涉及 无需 排除 不提供 非")
STAGES = {
    "CLOSED": _w("废标 终止公告 流标 已结束"),
    "AWARD": _w("中标 成交 中标候选人"),
    "PROCUREMENT": _w("招标公告 采购公告 公开招标 竞争性磋商 询价公告"),
    "EARLY_SIGNAL": _w("拟建 规划 立项 环评 签约 扩产 开工"),
}
TITLE_EARLY = _w("采购意向 意向公开 采购预告 需求征集 技术支持征集")
TITLE_TENDER = _w("招标 询比 询价 采购")
#: Type, words, and whether upper case is compared.
TYPES = (
    ("NEW_BUILD", _w("新建 建设 物流中心 新厂"), False),
    ("RETROFIT", _w("改造 升级 技改 扩建"), False),
    ("MAINTENANCE", _w("维保 维护 维修 保养"), False),
    ("SOFTWARE", _w("WMS WCS 软件 信息系统"), True),
    ("EQUIPMENT", _w("AGV AMR 堆垛机 输送线 货架 设备"), True),
)
AGE_LIMITS = {"PROCUREMENT": 45, "EARLY_SIGNAL": 90, "AWARD": 21}
AGE_LIMIT_ELSE, KEEP_SCORE = 30, 38
KEEP_STAGES = ("EARLY_SIGNAL", "PROCUREMENT", "AWARD")
URGENCY = {"PROCUREMENT": 100, "EARLY_SIGNAL": 75, "AWARD": 35, "UNKNOWN": 25, "CLOSED": 0}
URGENCY_V2 = {"PROCUREMENT": 100, "EARLY_SIGNAL": 85, "AWARD": 25, "CLOSED": 0, "UNKNOWN": 30}
PROVINCES = _w("江苏 上海 浙江 安徽 山东 广东 福建 湖北 北京 天津 重庆 四川")
CITIES = _w("无锡 苏州 常州 南京 南通 上海 杭州 宁波 合肥 青岛 济南 深圳 广州 武汉")
TRUSTED_HINTS = _w("政府采购 公共资源 招标投标公共服务 官网")
TRUSTED_URLS = (".gov.cn", "ggzy", "ccgp")
SECOND_HINTS = _w("招投标 采购")
FIT_CORE = _w("堆垛机 输送 WMS WCS 非标")
FIT_CUSTOMERS = _w("制造 汽车零部件 生产企业 机械厂 电子厂 成品仓 生产物流")
FIT_RETROFIT = _w("改造 维保 大修 非标 中小型")
FIT_PENALTIES = ((_w("机场 行李系统 港口 EPC"), 25), (_w("教学 实训 科研"), 30), (_w("SAAS 纯软件"), 20), (_w("已投产 正式投产"), 30))
ANNOUNCEMENT_WORDS = _w("中标候选人 重新招标 变更公告 二次 澄清 招标 采购 中标 成交 公告 公示 项目 工程")
VERSION_TERMS = _w("二次 重新招标 变更 澄清 延期 重启")
NOTICE_TERMS = _w("二次 重新招标 澄清 变更 重新启动 重启")
AUTH_FAILURE = _w("扫码登录 扫码授权 请扫码 重新扫码 登录过期 登录已过期 请重新登录 重新登录 重新授权 验证码")
# --- end of fixed values ---------------------------------------------------------------------------


@dataclass(frozen=True)
class NewsRules:
    """Vocabulary of the national news rules."""

    core: tuple[str, ...] = CORE
    related: tuple[str, ...] = RELATED
    context: tuple[str, ...] = CONTEXT
    hard_exclude: tuple[str, ...] = HARD_EXCLUDE
    unrelated: tuple[str, ...] = UNRELATED
    bid: tuple[str, ...] = BID
    event: tuple[str, ...] = EVENT
    policy: tuple[str, ...] = POLICY
    case: tuple[str, ...] = CASE
    ambiguous: tuple[str, ...] = AMBIGUOUS_CORE
    listicle: tuple[str, ...] = LISTICLE


@dataclass(frozen=True)
class CompanyProfile:
    """What a company looks for; amounts in yuan."""

    strengths: tuple[str, ...] = ()
    customers: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    ideal_min: float = 500_000
    ideal_max: float = 5_000_000
    accepted_max: float = 10_000_000


@dataclass(frozen=True)
class Limits:
    """Selection limits and cooldowns."""

    national: int = 24
    per_group: int = 6
    unknown_dates: int = 4
    max_age_days: int = 15
    local: int = 12
    discover: int = 18
    account: int = 18
    pool: int = 60
    digest: int = 5
    cache_seconds: int = 1800
    failures: int = 2
    cooldown_seconds: int = 900
    alert_seconds: int = 6 * 3600
    empty_sources: tuple[str, ...] = field(default=GENERIC_SOURCES)
