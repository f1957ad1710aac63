"""Default parameters of a mapping run, with the consistency checks made before it starts."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Default numbers, word lists and ordered tables that results depend on.
STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "shall", "must", "should", "from", "into", "des", "les", "une",
    "dans", "pour", "avec", "qui", "que", "sur", "aux", "du", "de", "la", "le", "et", "ou", "un", "en", "au", "par",
    "est", "sont", "doit", "doivent",
]
SEPARATORS = [";", " and shall ", " and must ", " et doit ", " et doivent "]
OBLIGATION_WORDS = ["shall", "must", "doit", "doivent"]
STRUCTURED_WEIGHTS = {
    "domain": 0.5, "actor": 1.0, "action": 2.5, "object": 3.0, "condition": 1.0,
    "deadline": 1.0, "evidence": 1.5, "obligation_type": 0.8, "control_type": 1.8,
}
ACTION_OBJECT_FIELDS = ["action", "object", "control_type"]
TEXT_FIELDS = ["domain", "actor", "action", "object", "condition", "deadline", "evidence", "control_type"]
CONTROL_FAMILIES = [
    ("access_control", ["access", "accès", "identity", "identité", "authentication", "authent", "authorization",
                        "compte", "account", "privileg", "admin"]),
    ("awareness_training", ["training", "awareness", "sensibilisation", "formation", "skills", "compétence",
                            "qualification"]),
    ("incident", ["incident", "notification", "report", "notify", "alerte"]),
    ("logging_monitoring", ["log", "journal", "monitor", "surveillance", "détection", "trace"]),
    ("cryptography", ["crypto", "encryption", "chiffrement", "key", "clé"]),
    ("backup_continuity", ["backup", "sauvegarde", "continuity", "continuité", "recovery", "restoration", "reprise"]),
    ("asset_inventory", ["asset", "inventory", "inventaire", "actif", "cartographie", "information systems"]),
]
FAMILY_AFFINITY = {
    "GV": [
        "PSSI", "ROLE", "RISKS", "COMPLIANCE", "ECOSYSTEM", "CONTRACT", "AUDIT",
    ],
    "ID": [
        "IS_INVENTORY", "MAPPING", "ECOSYSTEM", "CONTRACT", "RISKS", "MCO_MCS", "AUDIT", "COMPLIANCE", "EXERCISES",
    ],
    "PR": [
        "SEGMENTATION", "FILTERING", "AUTHENTICATION", "ACCESS_RIGHTS", "ADMIN_ACCOUNT", "ADMINISTRATION",
        "CONFIGURATION", "PROT_MALICIOUS_CODE", "PHYSICAL_ACCESS", "REMOTE_ACCESS", "DIRECTORIES", "HR", "RH",
        "BUSINESS_CONTINUITY", "IDENTIFICATION", "IS_INVENTORY", "MCO_MCS",
    ],
    "DE": [
        "MONITORING", "AUDIT", "INCIDENT", "MCO_MCS",
    ],
    "RS": [
        "INCIDENT", "CRISIS_MANAGEMENT",
    ],
    "RC": [
        "BUSINESS_CONTINUITY", "CRISIS_MANAGEMENT", "EXERCISES", "INCIDENT",
    ],
}
MODEL_PRICES = {
    "gpt-5.4-nano": (0.10, 0.40),
    "gpt-5.4-mini": (0.25, 2.00),
    "gpt-5.4": (1.25, 10.00),
    "text-embedding-3-large": (0.13, 0.0),
    "text-embedding-3-small": (0.02, 0.0),
}
MATCH_SCOPES = ("same_enisa_category", "same_category", "soft_enisa", "soft_enisa_category", "all")
GLOBAL_SCOPES = ("all", "soft_enisa", "soft_enisa_category")
GATE_MODES = ("off", "none", "disabled", "hard", "legacy", "score_cap")
TARGET_POLICIES = ("raise", "drop", "sanitize", "convert_to_gap")


@dataclass(frozen=True)
class Params:
    # signals
    use_semantic: bool = True
    use_keyword: bool = False
    use_structured: bool = True
    use_rrf: bool = True
    weight_semantic: float = 0.45
    weight_keyword: float = 0.0
    weight_structured: float = 0.30
    weight_action_object: float = 0.20
    weight_control_type: float = 0.05
    weight_category_prior: float = 0.03
    # cuts
    top_k: int = 8
    review_top_k: int = 10
    rrf_k: int = 60
    min_combined: float = 0.04
    match_scope: str = "soft_enisa"
    secondary_matching: bool = True
    max_secondary: int = 2
    # action/object gate
    gate_enabled: bool = True
    gate_mode: str = "score_cap"
    gate_cap75: float = 0.25
    gate_cap25: float = 0.10
    gate_hard: float = 0.75
    # affinity injection
    affinity_enabled: bool = True
    affinity_count: int = 4
    # decision rules
    obvious_gap_enabled: bool = True
    obvious_gap_combined: float = 0.10
    obvious_gap_semantic: float = 0.20
    obvious_gap_action_object: float = 0.15
    rescue_enabled: bool = True
    rescue_partial_combined: float = 0.55
    rescue_partial_semantic: float = 0.60
    rescue_implementation_combined: float = 0.45
    rescue_indirect_combined: float = 0.35
    rescue_indirect_semantic: float = 0.48
    rescue_min_action_object: float = 0.45
    upgrade_enabled: bool = True
    upgrade_combined: float = 0.58
    upgrade_semantic: float = 0.76
    upgrade_action_object: float = 0.18
    upgrade_structured: float = 0.10
    upgrade_exact_combined: float = 0.68
    upgrade_exact_semantic: float = 0.84
    floor_enabled: bool = True
    floor_combined: float = 0.60
    floor_semantic: float = 0.80
    floor_action_object: float = 0.20
    not_covered_combined: float = 0.50
    not_covered_semantic: float = 0.70
    not_covered_strict_combined: float = 0.45
    not_covered_strict_semantic: float = 0.65
    # categories
    category_strong: float = 0.85
    category_medium: float = 0.60
    category_margin: float = 0.15
    category_force: bool = False
    # review
    review_only_ambiguous: bool = True
    review_confidence: float = 0.80
    review_batch: int = 25
    reevaluate_below: float = 0.65
    # texts
    chunk_words: int = 400
    chunk_overlap: int = 80
    embedding_dims: int = 128
    # consolidation and plan
    orphan_threshold: int = 40
    supplement_below: int = 70
    invalid_target_policy: str = "raise"
    # tables passed by value
    separators: tuple = tuple(SEPARATORS)
    families: tuple = tuple((n, tuple(w)) for n, w in CONTROL_FAMILIES)
    # search layout: rows per target block / source block, and the number of pivots
    target_block_rows: int = 4096
    source_block_rows: int = 1024
    max_pivots: int = 256

    def __post_init__(self):
        if self.match_scope not in MATCH_SCOPES:
            raise ValueError(f"match_scope must be one of {MATCH_SCOPES}")
        if self.gate_mode not in GATE_MODES:
            raise ValueError(f"gate_mode must be one of {GATE_MODES}")
        if self.invalid_target_policy not in TARGET_POLICIES:
            raise ValueError(f"invalid_target_policy must be one of {TARGET_POLICIES}")
        if not (self.use_semantic or self.use_keyword or self.use_structured):
            raise ValueError("at least one retrieval signal must be switched on")
        if self.top_k < 1:
            raise ValueError("top_k must be positive")
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name.startswith("weight_") and v < 0:
                raise ValueError(f"{f.name} must not be negative")
        for name in ("gate_cap25", "gate_cap75", "category_medium", "category_strong", "min_combined"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.gate_cap25 > self.gate_cap75:
            raise ValueError("gate_cap25 must not exceed gate_cap75")

    @property
    def weight_sum(self) -> float:
        return max(self.weight_semantic + self.weight_keyword + self.weight_structured
                   + self.weight_action_object + self.weight_control_type, 0.0001)

    @property
    def review_limit(self) -> int:
        return self.review_top_k if self.review_top_k > 0 else self.top_k


DEFAULTS = Params()
