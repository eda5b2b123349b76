"""Explicit schemas of the tables, for files that do not carry their own (JSON, CSV) and for empty tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()
_STRINGS, _VECTOR = T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


CAPTURES = _schema(
    id=_S, user_id=_S, type=_S, title=_S, content=_S, summary=_S, tags=_STRINGS, created_at=_TS, is_pinned=T.BooleanType(), note=_S, embedding=_VECTOR,
    processing_status=_S, embedding_status=_S, graph_status=_S, processing_error=_S, processed_at=_TS, storage_path=_S, file_name=_S, mime_type=_S, file_size=_L,
)
NODES = _schema(
    id=_S, user_id=_S, scope_id=_S, name=_S, normalized_name=_S, kind=_S, aliases=_STRINGS, source_captured_ids=_STRINGS, val=T.IntegerType(), color=_S,
    embedding=_VECTOR, created_at=_TS, updated_at=_TS,
)
LINKS = _schema(id=_S, user_id=_S, source=_S, target=_S, relation_type=_S, evidence_captured_ids=_STRINGS, confidence=T.DoubleType(), created_at=_TS, updated_at=_TS)
LABELS = _schema(id=_S, scope_id=_S, cluster_key=_S, name=_S, description=_S, created_at=_TS)

# States of a processing step, kinds of nodes, types of links.
STATES = ("pending", "processing", "completed", "failed")
KINDS = ("person", "event", "object", "concept", "view", "conclusion", "todo", "question", "time", "location", "organization", "role")
RELATIONS = ("causes", "part_of", "supports", "happens_at", "located_in", "related_to")
# Rank and display size of a kind; other kinds have 0 and 10.
KIND_PRIORITY = {"person": 10, "event": 9, "object": 8, "concept": 7, "view": 6, "conclusion": 6, "todo": 6, "question": 6, "time": 5, "location": 5}
KIND_SIZE = {"person": 18, "event": 16, "todo": 16, "question": 14, "conclusion": 14, "view": 13, "concept": 12, "object": 12, "location": 11, "time": 10}
KIND_COLOR = {
    "person": "#22C55E", "event": "#F97316", "object": "#14B8A6", "concept": "#3B82F6", "view": "#6366F1", "conclusion": "#A855F7", "todo": "#EF4444",
    "question": "#0EA5E9", "time": "#64748B", "location": "#EAB308",
}
# Broad topics in order, and the fine topics of each.
TOPICS = {
    "学习": "学习方法 知识管理 笔记与整理 阅读与论文 复习与记忆 教育课程",
    "工作": "深度工作 专注力 时间管理 效率方法 会议与沟通 项目管理 职业发展 工作节奏与加班 写作",
    "健康": "睡眠 运动健身 饮食营养 身体保养 作息习惯",
    "家庭": "育儿 喂养与辅食 家庭关系 亲子互动",
    "生活": "极简生活 消费观念 日常安排 家务与整理 居家环境",
    "技术": "前端开发 后端开发 数据库 部署与运维 AI工具 软件工程",
    "财务": "储蓄 预算 投资 收入来源",
    "社交": "沟通技巧 人际关系 社交活动",
    "心理": "情绪管理 压力与焦虑 拖延 习惯与动力 心理成长",
    "认知": "思维方式 认知效率 决策 批判思维 元认知",
    "兴趣": "宠物 美食 旅行 游戏 休闲",
    "其他": "其他",
}
OTHER_TOPIC = "其他"


def topic_rows() -> list[tuple[str, str, int]]:
    """``(fine, broad, order of the broad topic)``."""
    return [(fine, broad, i) for i, (broad, fines) in enumerate(TOPICS.items()) for fine in fines.split()]
