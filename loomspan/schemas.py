"""Declared schemas of the rule book, the policy, classifier payloads and labelled cases."""

from __future__ import annotations

RULE_VERSION, PAYLOAD_VERSION = "2.0.0", "1.1.0"

SOURCE = "struct<title:string,url:string,date:string,source_id:string,provenance_status:string>"
CONDITIONS = "struct<all_of:array<struct<group_id:string,any_of:array<string>>>,any_of:array<string>,none_of:array<string>,scope:string,max_distance:int>"

#: A rule as it is exported and stored.
RULE = (
    f"schema_version string, revision int, id string, category string, subcategory string, pattern_type string, conditions {CONDITIONS}, "
    "surface_meaning string, risk_summary string, social_context string, legal_or_ethic_issue string, risk_reason string, severity_floor double, "
    "dominant_risk boolean, confidence double, risk_domain string, recent_context_tags array<string>, safe_rewrite array<string>, "
    f"false_positive_note string, memo string, source {SOURCE}, created_at string, updated_at string, review_status string"
)
#: What a record may hold besides: names of the first version, and camel case of any.
LEGACY = (
    "schemaVersion string, patternType string, surfaceMeaning string, riskSummary string, socialContext string, legalOrEthicIssue string, riskReason string, "
    "severityFloor double, dominantRisk boolean, riskDomain string, recentContextTags array<string>, safeRewrite array<string>, falsePositiveNote string, "
    "createdAt string, updatedAt string, reviewStatus string, trigger_patterns array<string>, triggerPatterns array<string>, context_patterns array<string>, "
    "contextPatterns array<string>, exclusion_patterns array<string>, exclusionPatterns array<string>, any_of_patterns array<string>, anyOfPatterns array<string>, "
    "condition_scope string, conditionScope string, max_distance double, maxDistance double"
)
RULE_INPUT = RULE.replace("revision int", "revision double").replace("max_distance:int", "max_distance:double") + ", " + LEGACY

POLICY = (
    "schema_version string, scoring_strategy string, no_match_score double, category_corroboration_per_pattern double, max_category_corroboration double, "
    "secondary_category_weight double, tertiary_category_weight double, max_cross_category_support double, "
    "grade_thresholds array<struct<grade:string,min:double,max:double>>"
)

# The keys of a payload.
PAYLOAD_KEYS = (
    "schema_version", "risk_intent", "speech_act", "claim_target", "context_relation", "actor", "claim_strength", "policy_relevance", "risk_family",
    "confidence", "evidence_spans", "policy_reason",
)
PAYLOAD = ", ".join(f"{k} string" for k in PAYLOAD_KEYS if k not in ("confidence", "evidence_spans")) + ", confidence double, evidence_spans array<struct<start:int,end:int,text:string>>"

# What each field of a payload may say.
PAYLOAD_VALUES = {
    "risk_intent": ("direct_promotional", "contextual_only", "uncertain"),
    "speech_act": ("claim", "quote", "warning", "criticism", "report", "definition", "condition"),
    "claim_target": ("health", "finance", "education", "legal", "privacy", "general", "none"),
    "context_relation": ("supports", "negates", "warns_about", "reports", "defines", "conditions", "unclear"),
    "actor": ("advertiser", "reporter", "regulator", "consumer", "unknown"),
    "claim_strength": ("absolute", "strong", "limited", "none", "unclear"),
    "policy_relevance": ("none", "substantiation", "potentially_high", "uncertain"),
    "risk_family": ("health_claim", "financial_guarantee", "income_claim", "education_outcome", "legal_outcome", "privacy_intrusion", "urgency", "general_substantiation", "none"),
    "policy_reason": (
        "DIRECT_ABSOLUTE_CLAIM", "DIRECT_STRONG_RESULT", "DIRECT_LIMITED_CLAIM", "CONTRASTED_PROMOTION", "CONTEXT_WARNING", "CONTEXT_CRITICISM", "CONTEXT_REPORT",
        "CONTEXT_QUOTE", "CONTEXT_DEFINITION", "LEGITIMATE_CONDITION", "NO_RISK_CLAIM", "UNCERTAIN_INTENT",
    ),
}

CASE = "case_id string, dataset string, text string, expected_class string, domain string, annotated_speech_act string"
