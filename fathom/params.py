"""Typed settings with range checks, and rule packs for language-specific rules."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from fathom.functions.canonical import fingerprint_of


@dataclass(frozen=True)
class RetrievalSettings:
    chunk_size: int = 600
    chunk_overlap: int = 100
    top_k: int = 2
    min_score: float = 0.35
    candidate_k: int = 8
    max_context_tokens: int = 6000
    dedup_threshold: float = 0.85
    query_expansion_enabled: bool = False
    rerank_enabled: bool = False
    context_rewrite_enabled: bool = False
    dynamic_top_k_enabled: bool = False
    parent_context_enabled: bool = False
    dedup_enabled: bool = False
    multi_vector_enabled: bool = False

    def __post_init__(self):
        ranges = {"chunk_size": (200, 1200), "chunk_overlap": (0, 300), "top_k": (1, 10), "min_score": (0, 1), "candidate_k": (2, 50), "max_context_tokens": (100, 50000)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")

    @property
    def fingerprint(self) -> str:
        """Hash of all settings, whatever the order in which they were given."""
        return fingerprint_of(asdict(self))

    def with_switches(self, *on: str) -> RetrievalSettings:
        """These settings with the named switches on and all others off."""
        return replace(self, **{s: s in on for s in SWITCHES})

    def approved(self, approvals: set[str]) -> RetrievalSettings:
        """These settings if their fingerprint was approved or no switch is on; else with all switches off."""
        plain = not any(getattr(self, s) for s in SWITCHES)
        return self if plain or self.fingerprint in approvals else self.with_switches()

    @property
    def candidates(self) -> int:
        """Candidates fetched before rescoring."""
        return max(4 * self.top_k, self.candidate_k)


# The switches, and the profiles that turn on several of them.
SWITCHES = ("query_expansion_enabled", "rerank_enabled", "context_rewrite_enabled", "dynamic_top_k_enabled", "parent_context_enabled", "dedup_enabled", "multi_vector_enabled")
COMBINATIONS = {
    "query_expansion_rerank": ("query_expansion_enabled", "rerank_enabled"),
    "context_rewrite_rerank": ("context_rewrite_enabled", "rerank_enabled"),
    "multi_vector_rerank": ("multi_vector_enabled", "rerank_enabled"),
    "all_enhancements": SWITCHES,
}


def evaluation_profiles(settings: RetrievalSettings) -> dict[str, RetrievalSettings]:
    """Profiles to compare, the baseline first: no switch, each alone, and the combinations. Parent context takes
    parts of documents, so it brings them along."""
    named = {"baseline_new_retrieval": ()} | {s: (s,) for s in SWITCHES} | COMBINATIONS
    more = lambda on: ("multi_vector_enabled",) if "parent_context_enabled" in on else ()
    return {name: settings.with_switches(*on, *more(on)) for name, on in named.items()}


@dataclass(frozen=True)
class RulePack:
    """Rules that depend on the language of a corpus: ordered categories with keywords, terms and hints."""

    categories: dict[str, tuple[str, ...]]
    heading: str
    sentence_end: str
    entities: dict[str, tuple[str, ...]] = field(default_factory=dict)
    clause_signals: tuple[str, ...] = ()
    requirement_signals: tuple[str, ...] = ()


LATIN = RulePack(
    categories={"license": ("license", "licensed", "released"), "romance": ("eau", "ción", "que"), "german": ("keit", "ung", "sch"), "plain": ("the", "and")},
    heading=r"(?:\d+\.|#+) ",
    sentence_end=".!?",
    entities={"apache": ("apache license", "apache"), "token": ("token", "secret"), "mit": ("mit license",)},
    clause_signals=(" and ", ", ", "; "),
    requirement_signals=("must", "should", "compare", "explain", "list"),
)


@dataclass(frozen=True)
class Routing:
    """Rules that route a question: each an intent, a kind of question, a mode, words of which one is enough, and
    entities that it brings along; the first that holds counts."""

    rules: tuple[tuple[str, str, str, tuple[str, ...], tuple[str, ...]], ...]
    follow_up: tuple[str, ...]
    default_intent: str
    default_kind: str
    core_intents: tuple[str, ...]
    simple_kinds: tuple[str, ...]
    hybrid_words: tuple[str, ...]


# The rules for questions in Chinese.
CHINESE_ROUTING = Routing(
    rules=(
        ("业务变更", "关联推理", "hybrid", ("地址迁移", "带宽变更", "移机", "变更"), ("合规审核",)),
        ("退订销户", "关联推理", "hybrid", ("欠费", "销户", "退订", "合同终止"), ("合规审核",)),
        ("故障报修", "关联推理", "hybrid", ("故障", "中断", "报修", "修复"), ()),
        ("资费咨询", "资费标准", "vector", ("资费", "套餐", "月费", "多少钱", "价格"), ()),
        ("办理流程", "流程步骤", "vector", ("流程", "步骤", "申请", "开通", "受理"), ()),
        ("合规审核", "单一规则", "vector", ("一票否决", "合规", "审核", "红线"), ()),
        ("公司法律法规", "单一规则", "vector", ("公司法", "股东", "董事", "法定代表人"), ()),
        ("投诉处理", "流程步骤", "vector", ("投诉", "申诉", "争议", "处理时限"), ()),
        ("客户准入", "单一规则", "vector", ("客户", "材料", "资质", "营业执照", "授权"), ()),
    ),
    follow_up=("这个", "那这种情况", "如果是这样", "如果是"),
    default_intent="客户准入",
    default_kind="单一规则",
    core_intents=("业务变更", "合规审核", "故障报修", "退订销户"),
    simple_kinds=("单一规则", "流程步骤", "资费标准", "标准查询"),
    hybrid_words=("地址迁移", "带宽变更", "欠费", "合同", "设备回收", "故障等级", "时限"),
)

# Fixed value: what begins a section in Chinese: a numeral with its mark, one in brackets, or a number.
CHINESE_HEADING = r"(?:第?[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[）)]|\d+[.．])"

# Entities in Chinese with their other names, and what a question implies: groups of words, of each of which
# one must be said, and the entity that comes along.
CHINESE_ENTITIES = {
    "政企专线": ("专线", "企业专线", "互联网专线", "云专网", "跨地域组网"),
    "企业客户": ("集团客户", "政企客户", "单位客户", "公司客户"),
    "个人客户": ("个人用户", "自然人客户"),
    "业务受理": ("办理", "开通", "申请", "受理"),
    "资费套餐": ("价格", "套餐", "月费", "带宽资费", "费用", "资费"),
    "合规审核": ("审核", "一票否决", "合规", "红线"),
    "业务变更": ("带宽变更", "地址迁移", "变更办理", "移机"),
    "故障报修": ("故障", "报障", "维修", "修复时限", "中断", "报修"),
    "退订销户": ("退订", "销户", "合同终止", "取消业务", "欠费"),
}
CHINESE_IMPLIED = [
    ((("欠费",),), "退订销户"),
    ((("材料", "资质"), ("企业客户", "集团客户")), "合规审核"),
    ((("地址迁移", "带宽变更"),), "合规审核"),
]
# Words in Chinese that ask for relations, those that ask where something is said, what they stand for, and
# words of an intent that is one itself.
CHINESE_HINTS = ("关系", "关联", "影响", "约束", "流程", "先后", "需要", "是否", "审核", "合规", "报告", "在哪", "哪里", "来源", "来源文件", "文件", "材料", "包含", "提及")
CHINESE_PLACES, CHINESE_PLACE_FIELD, CHINESE_INTENTS = ("在哪", "哪里"), "来源文件", ("审核", "流程", "规则", "关系", "分类")

LATIN_ROUTING = Routing(
    rules=(
        ("change", "reasoning", "hybrid", ("compare", "versus", "than "), ("audit",)),
        ("price", "tariff", "vector", ("price", "cost", "que"), ()),
        ("person", "single rule", "vector", ("who", "whom", "eau"), ()),
    ),
    follow_up=("that", "this"),
    default_intent="lookup",
    default_kind="single rule",
    core_intents=("change", "person"),
    simple_kinds=("single rule", "tariff"),
    hybrid_words=("than ", "ung"),
)


def embedding_fingerprint(provider: str, model: str, model_file: str, base_url: str = "", compatible: bool = False, artifacts: dict[str, str] | None = None) -> str:
    """What embeds: provider, model and file, with the hashes of a local model's files or the address of a remote one."""
    local = provider == "local_onnx"
    where = {"local_artifacts": artifacts or {}} if local else {"embedding_base_url": base_url.rstrip("/"), "embedding_openai_compatible": compatible}
    return fingerprint_of({"embedding_provider": provider, "embedding_model": model, "embedding_onnx_model_file": model_file} | where, compact=False)


def pipeline_fingerprint(settings: RetrievalSettings, embedding: str, collection: str, identity_version: int) -> str:
    """What makes chunks: how ids are given, the sizes, several granularities or not, what embeds, and the collection."""
    told = {
        "chunk_identity_schema_version": identity_version,
        "chunk_size": settings.chunk_size,
        "chunk_overlap": settings.chunk_overlap,
        "multi_vector_enabled": settings.multi_vector_enabled,
        "embedding_fingerprint": embedding,
        "collection_name": collection,
    }
    return fingerprint_of(told, compact=False)


# What of a set of questions belongs to a configuration.
DATASET_KEYS = ("mode", "fixed", "gate_eligible", "schema_version", "dataset_id", "dataset_version", "dataset_fingerprint")


def evaluation_fingerprint(generation: str, permission: str, dataset: dict, profiles: dict[str, RetrievalSettings]) -> str:
    """What an evaluation ran with: generation, rights, the set of questions, and every profile with its settings."""
    configs = [{"id": name, "enabled_switches": [x for x in SWITCHES if getattr(s, x)], "collection_name": None, "settings": asdict(s)} for name, s in profiles.items()]
    return fingerprint_of({"generation_id": generation, "permission_fingerprint": permission, "dataset": {k: dataset[k] for k in DATASET_KEYS if k in dataset}, "profiles": configs})
