"""Titles of laws: boards, versions, variants for matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boards with their key words; the first that hits wins.
BOARDS = [
    ("债券固收", ["债券", "可转换", "资产支持", "国债", "回购"]),
    ("基金资管", ["基金", "资产管理", "理财", "私募", "公募", "托管人"]),
    ("投资者保护", ["投资者", "适当性"]),
    ("期货衍生品", ["期货", "衍生品", "期权", "套期保值"]),
    ("并购重组", ["收购", "并购", "重组", "要约", "合并", "分立"]),
    ("信息披露", ["披露", "定期报告", "临时公告"]),
    ("发行上市", ["发行", "上市", "承销", "保荐", "注册"]),
    ("交易结算", ["交易", "结算", "经纪", "融资融券", "转融通"]),
    ("监管执法", ["处罚", "稽查", "监察", "监管", "复议", "诉讼", "最高人民法院", "刑法", "检察", "公安", "赔偿", "执法", "禁入"]),
    ("税收", ["税"]),
    ("数据网络", ["数据", "网络", "密码", "电信", "电子签名", "个人信息"]),
    ("金融基础", ["银行", "货币", "信托", "保险", "票据", "洗钱", "外汇", "支付", "金融"]),
    ("证券综合", ["证券", "证券交易所"]),
    ("公司治理", ["公司", "股东", "董事", "监事", "治理", "章程", "企业", "合伙", "破产", "商事登记"]),
    ("商事通用", ["民法典", "民事", "立法", "竞争", "垄断", "拍卖", "招标", "海商", "产品质量", "广告", "消费者", "标准化", "预算", "贸易", "外商投资", "不正当", "电子商务"]),
]
NO_BOARD = "其他"
#: Trust in sources, and short names.
SOURCE_RANKS = {
    "国家法律法规数据库": 100,
    "中国人大网": 95,
    "中国政府网": 90,
    "最高人民法院": 80,
    "中国证监会": 70,
    "上海证券交易所": 60,
    "深圳证券交易所": 60,
    "北京证券交易所": 60,
}
ALIASES = [("最高检", "最高人民检察院"), ("最高法", "最高人民法院"), ("证监会", "中国证券监督管理委员会")]
COUNTRY = "中华人民共和国"
# Patterns of document numbers, versions and kinds of documents.
DOC_NUMBER = r"[（(](?:证监会令|证监会公告|主席令|国务院令|财政部令|法释|银发|发改)[^）)]*[）)]"
VERSION = r"[（(](\d{4}年(?:修订|修正))[）)]"
ANY_VERSION = r"[（(]\d{4}年?(?:修订|修正)?[）)]"
AMENDING = "修改|证监会令|证监会公告|主席令|国务院令|财政部令|法释"
DOC_TYPES = "规定|办法|条例|准则|通知|解释|意见|决定"


def strip(c: Column, more: str = "") -> Column:
    """Without white space, as Unicode has it, or ``more`` characters at the ends."""
    return F.regexp_replace(c, rf"(?U)^[\s{more}]+|[\s{more}]+$", "")


def classify(title: Column, rules: list[tuple[str, list[str]]] = BOARDS, fallback: str = NO_BOARD) -> Column:
    """The first board one of whose key words the title contains."""
    board = F.lit(fallback)
    for name, keys in reversed(rules):
        board = F.when(title.rlike("|".join(keys)), name).otherwise(board)
    return board


def source_rank(source: Column, ranks: dict[str, int] = SOURCE_RANKS) -> Column:
    rank = F.lit(0)
    for name, value in ranks.items():
        rank = F.when(source == name, value).otherwise(rank)
    return rank


def version_label(title: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), VERSION, 1), F.lit(""))


def normalize_title(title: Column) -> Column:
    """For finding duplicates: without a source in front or a version behind; what stands in book marks, if any."""
    t = strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"^【[^】]*】", ""))
    t = strip(F.regexp_replace(t, r"[（(]\d{4}年(修订|修正)[）)]$", ""))
    first, last = F.instr(t, "《"), F.length(t) - F.instr(F.reverse(t), "》") + 1
    both = (first > 0) & F.contains(t, F.lit("》"))
    t = F.when(both, F.substring(t, first + 1, F.greatest(F.lit(0), last - first - 1))).otherwise(t)
    return strip(F.regexp_replace(t, "^[《》]+|[《》]+$", ""))


def clean_title(title: Column) -> Column:
    """For citations: the first name in book marks, without source or document number."""
    t = strip(F.coalesce(title, F.lit("")))
    inner = F.regexp_extract(t, "《([^》]+)》", 1)
    t = F.when(inner != "", inner).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"^【[^】]*】", ""), DOC_NUMBER, "")
    return strip(F.regexp_replace(strip(t), "^[《》]+|[《》]+$", ""))


def title_variants(title: Column) -> Column:
    """The clean title, its long names, and the title without a year."""
    t = clean_title(title)
    longer = [F.when(F.contains(t, F.lit(a)), F.replace(t, F.lit(a), F.lit(b))) for a, b in ALIASES]
    without = F.nullif(strip(F.regexp_replace(t, ANY_VERSION, "")), F.lit(""))
    return F.when(t != "", F.array_distinct(F.array_compact(F.array(t, *longer, without)))).otherwise(F.array().cast("array<string>"))


def fuzzy_keys(title: Column) -> Column:
    """Parts of a long title, of 4 characters or more; those with a document's type first, then the longer ones."""
    part = lambda p: strip(F.regexp_replace(F.translate(F.regexp_replace(clean_title(p), ANY_VERSION, ""), "（）", "()"), "^[《》]+|[《》]+$", ""))
    keys = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), "[、，,；;]"), part), lambda k: F.length(k) >= 4))
    ranked = F.transform(keys, lambda k, i: F.struct(F.when(k.rlike(DOC_TYPES), 0).otherwise(1).alias("kind"), (-F.length(k)).alias("len"), i.alias("i"), k.alias("key")))
    return F.transform(F.array_sort(ranked), lambda s: s["key"])


def reference_variants(title: Column) -> Column:
    """Titles under which a reference is looked up, in order: as given, unwrapped, without version, without the country."""
    raw = F.coalesce(title, F.lit(""))
    wrapped = F.regexp_extract(raw, "修改[《「]?(.+?)[》》]?的决", 1)
    t = F.regexp_replace(F.when(wrapped != "", wrapped).otherwise(strip(raw)), "^[《》]+|[《》]+$", "")
    core = strip(F.regexp_replace(t, r"[（(][^）)]*[修订修正]{2}[^）)]*[）)]$", ""))
    return F.array_distinct(F.array_remove(F.array(raw, t, core, F.regexp_replace(core, f"^{COUNTRY}", "")), ""))


def match_ok(cited: Column, title: Column) -> Column:
    """A decision to amend a law isn't the law, unless it is what the citation names."""
    return cited.rlike(AMENDING) | ~F.contains(title, F.lit("修改"))
