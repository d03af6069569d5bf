"""Business labels, confidence bands and presentable names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relweave.functions.text import safe_label, search_norm, strip, strip_to_null

UNNAMED = "未命名对象"

# Labels shown for known relation types.
BUSINESS_LABELS = {
    "assembly_containment": "包含",
    "containment": "包含",
    "contains": "包含",
    "包含工序": "包含",
    "包含工步": "包含",
    "foreign_key": "引用",
    "外键关联": "引用",
    "unique_identifier": "对应",
    "relation_table": "连接",
    "关联物料": "使用物料",
    "结构关联": "结构关联",
    "uses": "使用",
    "used_by": "被使用",
    "owns": "拥有",
    "places": "下单",
    "created": "创建",
    "reviews": "审核",
}

# What the client shows beside those for a table edge that has only its relation types.
TABLE_EDGE_LABELS = {
    **BUSINESS_LABELS,
    "人员行为": "关联行为",
    "工艺涉及零件": "工艺涉及零件",
}

# Labels that say no more than "related".
GENERIC_LABELS = (
    "",
    "相关",
    "关联",
    "关系",
    "business_relationship",
    "semantic_relationship",
    "relationship",
    "relation",
    "语义关联",
    "关联关系",
)
DEFAULT_LABEL = "相关"

# Literals that are not names.
EMPTY_LITERALS = (
    "0", "1", "true", "false", "null", "undefined", "nan", "infinity", "+infinity", "-infinity",
)

# Phrases and words that describe a state instead of naming an object.
STATUS_PHRASES = (
    "启用", "禁用", "正常", "异常", "完成", "已完成", "失败", "待处理", "处理中", "已处理", "批准", "已批准",
    "拒绝", "已拒绝", "接受", "已接受", "待审核", "审核中", "已审核", "待审批", "审批中", "已审批", "草稿",
    "已删除", "已归档", "开放", "关闭", "已取消", "排队中", "运行中", "已停止", "暂停", "新建", "未知", "有效",
    "无效", "已发布", "未发布", "已锁定", "未锁定", "已验证", "未验证", "通过", "已通过", "未通过",
)
STATUS_WORDS = (
    "status", "state", "active", "inactive", "enabled", "disabled", "pending", "processing", "processed",
    "approved", "rejected", "accepted", "declined", "queued", "running", "paused", "stopped", "started",
    "finished", "complete", "completed", "failed", "failure", "success", "successful", "error", "ready",
    "draft", "deleted", "archived", "open", "closed", "cancelled", "canceled", "new", "unknown", "valid",
    "invalid", "review", "reviewing", "reviewed", "approval", "awaiting", "scheduled", "published",
    "unpublished", "locked", "unlocked", "verified", "unverified", "passed", "pass", "in", "progress", "not",
    "done", "todo", "hold", "on", "off", "状态",
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def relation_type_label(relation_type: Column) -> Column:
    """Label of a relation type alone, as a table edge shows it."""
    return F.coalesce(_lookup(TABLE_EDGE_LABELS, F.lower(strip(relation_type))), F.lit(DEFAULT_LABEL))


def relation_label(display_label: Column, relation_type: Column) -> Column:
    """The explicit label when it says something, else the label of the type, else the default."""
    candidate = strip(F.coalesce(display_label, F.lit("")))
    key = F.lower(candidate)
    explicit = F.coalesce(_lookup(BUSINESS_LABELS, key), F.when(safe_label(candidate), candidate))
    by_type = _lookup(BUSINESS_LABELS, F.lower(strip(F.coalesce(relation_type, F.lit("")))))
    return F.coalesce(F.when(~key.isin(*GENERIC_LABELS), explicit), by_type, F.lit(DEFAULT_LABEL))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def confidence_band(confidence: Column) -> Column:
    finite = _finite(confidence)
    return (
        F.when(finite & (confidence >= 0.85), F.lit("明确"))
        .when(finite & (confidence >= 0.6), F.lit("较可信"))
        .otherwise(F.lit("可能有关"))
    )


def confidence_percent(confidence: Column) -> Column:
    percent = F.when(F.isnan(confidence), F.lit("NaN")).otherwise(F.floor(confidence * 100 + 0.5).cast("string"))
    return F.concat(percent, F.lit("%"))


def relation_visible(strength: Column, confidence: Column, threshold: float) -> Column:
    """Strong relations always, weak ones from a finite confidence at the threshold."""
    return (strength == "strong") | (_finite(confidence) & (confidence >= threshold))


# One sentence per way of finding a relation, first match wins.
RELATION_SENTENCES = {
    "foreign_key": "两个业务对象通过已确认的数据引用建立关系。",
    "unique_identifier": "两个业务对象通过唯一业务标识建立对应关系。",
    "relation_table": "业务系统记录了这两个对象之间的结构关系。",
}
OTHER_RELATION_SENTENCE = "所选业务信息支持这两个对象之间的关系。"
EVIDENCE_SENTENCES = {
    "foreign_key": "已确认存在稳定的数据引用。",
    "unique_identifier": "唯一业务标识匹配。",
    "relation_table": "业务结构记录提供支持。",
}
OTHER_EVIDENCE_SENTENCE = "所选业务信息能够相互印证。"


def relation_summary(methods: Column) -> Column:
    """A sentence for the most reliable method among ``methods``."""
    sentences = [F.when(F.array_contains(methods, m), F.lit(s)) for m, s in RELATION_SENTENCES.items()]
    return F.coalesce(*sentences, F.lit(OTHER_RELATION_SENTENCE))


def evidence_summary(method: Column) -> Column:
    return F.coalesce(_lookup(EVIDENCE_SENTENCES, method), F.lit(OTHER_EVIDENCE_SENTENCE))


def is_status_only(normalized: Column) -> Column:
    """Whether normalised text only states a status."""
    compact = F.regexp_replace(normalized, r"\s+", "")
    bare = F.regexp_replace(compact, "^(?:当前状态|状态)", "")
    parts = F.filter(F.split(normalized, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    words = STATUS_WORDS + STATUS_PHRASES
    only_status = F.forall(parts, lambda p: p.isin(*words) | p.rlike(r"^\d+$"))
    return bare.isin(*STATUS_PHRASES) | (F.exists(parts, lambda p: p.isin(*words)) & only_status)


def meaningful_text(text: Column) -> Column:
    """Trimmed text, or null when it is blank, a bare literal or only a status."""
    trimmed = strip(text)
    normalized = search_norm(trimmed)
    useless = (trimmed == "") | normalized.isin(*EMPTY_LITERALS) | is_status_only(normalized)
    return F.when(~useless, trimmed)


def business_name(dimension_name: Column, display_name: Column, display_name_source: Column) -> Column:
    """The name to show: an explicit name, a meaningful display name, or the unnamed marker."""
    explicit = strip_to_null(dimension_name)
    from_name = F.when(display_name_source == "name", strip_to_null(display_name))
    return F.coalesce(explicit, from_name, meaningful_text(display_name), F.lit(UNNAMED))
