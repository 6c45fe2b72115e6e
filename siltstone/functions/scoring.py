"""Scalar functions over scores, dates and status: boosts, tiers, labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STATUS_WEIGHTS = {"active": 1.0, "approved": 0.95, "draft": 0.5, "deprecated": 0.2, "archived": 0.1, "superseded": 0.05}
RETIRED = ["deprecated", "archived", "superseded"]
WARNING_POLICY = {
    "stale_source": ("advisory", "inform"),
    "deprecated_source": ("warning", "prefer_other_sources"),
    "conflicting_sources": ("warning", "request_human_review"),
    "weak_evidence": ("warning", "request_human_review"),
    "isolated_match": ("warning", "request_human_review"),
    "prompt_injection_pattern": ("blocking", "refuse_to_synthesize"),
    "sensitive_content": ("blocking", "refuse_to_synthesize"),
    "query_normalized": ("advisory", "rewrite_query"),
    "answer_truncated": ("advisory", "inform"),
}
WARNING_COPY = {
    "weak_evidence": ("Confidence is low —", "I found related content, but no clearly authoritative source."),
    "conflicting_sources": ("Sources disagree —", "I found multiple sources that may conflict. Prefer active/approved docs unless you are researching history."),
    "stale_source": ("Source is stale —", ""),
    "deprecated_source": ("Document is deprecated —", ""),
    "prompt_injection_pattern": ("Caution —", ""),
    "sensitive_content": ("Sensitive content —", ""),
    "query_normalized": ("Query was normalized —", ""),
}
#: Lower bounds of the tiers, and what the marks of a card say.
SCORE_TIERS = [(0.85, 5), (0.65, 4), (0.50, 3), (0.46, 2)]
TIER_LABELS = {5: "strong both-arm match", 4: "cross-arm match", 3: "single-arm match", 2: "at the weak-evidence floor", 1: "below the weak-evidence floor"}
DEPRECATION_LABELS = {"deprecated": "Deprecated · do not cite", "archived": "Archived · historical reference", "superseded": "Superseded · see successor"}
STATUS_GLOSS = {
    "active": "Current — the canonical version.",
    "approved": "Approved — reviewed and signed off.",
    "draft": "Draft — not yet approved as authoritative.",
    "deprecated": "Deprecated — superseded; do not cite as current.",
    "archived": "Archived — kept for historical reference.",
    "superseded": "Superseded — see the linked successor.",
}
AUTHORITY_GLOSS = {
    "platform": "Platform — canonical owner-team doc.",
    "security": "Security — hardening or threat-model authoritative.",
    "standards": "Standards — org-wide policy.",
    "compliance": "Compliance — audit / regulatory backing.",
    "ops": "Ops — operational runbook authoritative.",
    "engineering": "Engineering — practice or pattern authoritative.",
    "operator": "Operator — team-curated, not org-wide canonical.",
    "community": "Community — peer-contributed, less authoritative.",
    "experimental": "Experimental — under evaluation.",
}


@dataclass(frozen=True)
class RankingConfig:
    """Ranking parameters, checked when made."""

    status_weights: dict = field(default_factory=lambda: dict(STATUS_WEIGHTS))
    stale_after_days: int | None = 365
    weak_threshold: float = 0.46
    relevance_floor: float | None = None
    max_warning_rank: int = 3
    isolated_drop: float | None = 0.30

    def __post_init__(self):
        bad = [k for k, w in self.status_weights.items() if not 0 < w <= 1]
        if bad:
            raise ValueError(f"status weights outside (0, 1]: {bad}")
        for name in ("stale_after_days", "weak_threshold", "relevance_floor", "isolated_drop"):
            value = getattr(self, name)
            if value is None and name == "weak_threshold" or value is not None and value <= 0:
                raise ValueError(f"{name} must be over 0")
        if self.max_warning_rank < 1:
            raise ValueError("max_warning_rank must be at least 1")

    @property
    def floor(self) -> float:
        return self.weak_threshold if self.relevance_floor is None else self.relevance_floor


def lookup(key: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def status_weight(status: Column, weights: dict = STATUS_WEIGHTS) -> Column:
    return lookup(status, weights, 1.0)


def freshness_factor(last_reviewed: Column, as_of: Column, days: int | None) -> Column:
    """1 inside the window, falling to 0.3 over the next one; 0.3 for a date unknown; 1 without a window."""
    if days is None:
        return F.lit(1.0)
    age = F.datediff(as_of, last_reviewed)
    decay = F.least(F.lit(1.0), (age - days) / F.lit(float(days)))
    return F.when(last_reviewed.isNull(), 0.3).when(age <= days, 1.0).otherwise(F.greatest(F.lit(0.3), F.lit(1.0) - decay * 0.7))


def boosted(score: Column, status: Column, last_reviewed: Column, as_of: Column, config: RankingConfig) -> Column:
    return score * status_weight(status, config.status_weights) * freshness_factor(last_reviewed, as_of, config.stale_after_days)


def freshness_bucket(last_reviewed: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, last_reviewed)
    return F.when(last_reviewed.isNull(), None).when(age < 0, "stale").when(age < 180, "fresh").when(age < 365, "recent").when(age < 730, "aging").otherwise("stale")


def freshness_label(last_reviewed: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, last_reviewed)
    months, years = F.floor(age / 30).cast("int"), F.floor(age / 365).cast("int")

    def ago(n: Column, unit: str) -> Column:
        return F.concat(F.lit("Reviewed "), n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))

    return (
        F.when(last_reviewed.isNull(), None)
        .when(age < 0, F.concat(F.lit("Reviewed "), last_reviewed.cast("string")))
        .when(age == 0, "Reviewed today")
        .when(age == 1, "Reviewed yesterday")
        .when(age < 60, ago(age, "day"))
        .when(months < 24, ago(months, "month"))
        .otherwise(ago(years, "year"))
    )


def score_tier(score: Column) -> Column:
    out = F.lit(1)
    for limit, tier in reversed(SCORE_TIERS):
        out = F.when(score >= limit, F.lit(tier)).otherwise(out)
    return out


def severity(kind: Column) -> Column:
    return lookup(kind, {k: v[0] for k, v in WARNING_POLICY.items()}, "advisory")


def action(kind: Column) -> Column:
    return lookup(kind, {k: v[1] for k, v in WARNING_POLICY.items()}, "inform")


def humanized(kind: Column, message: Column) -> tuple[Column, Column]:
    """Prefix and text shown for a warning; a kind without copy of its own shows its message."""
    return lookup(kind, {k: v[0] for k, v in WARNING_COPY.items()}, ""), F.coalesce(F.nullif(lookup(kind, {k: v[1] for k, v in WARNING_COPY.items()}), F.lit("")), message)
