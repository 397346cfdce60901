"""Lexicons and message texts of the rule-based risk scores.

Every list is a parameter of the operator that uses it; these are the defaults.
All matching is *substring* matching on lower-cased text ("aim" fires inside
"claim", "plan" inside "plant"), which is the specified behaviour.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# These lists and texts must equal the reference's, in its order.
# ---------------------------------------------------------------------------

# Keyword risk v1 (H1)
V1_VAGUE = ["vague", "unclear", "unspecified", "general", "commitment", "will", "plan"]
V1_HIGH = ["guarantee", "promise", "ensure", "definitely", "certainly"]

# Keyword risk v2 (H2)
V2_VAGUE = ["vague", "unclear", "unspecified", "general", "commitment",
            "will", "plan", "aim", "target", "goal", "strive", "endeavor"]
V2_HIGH = ["guarantee", "promise", "ensure", "definitely", "certainly",
           "100%", "fully", "completely", "absolutely", "never", "always"]
V2_EXTREME = ["carbon neutral", "net zero", "zero emissions", "100% renewable",
              "fully sustainable", "completely green"]

# Retrieval risk (H3)
RAG_NEGATIVE = ["vague", "unclear", "unsupported", "risky", "concerning", "problematic"]
RAG_POSITIVE = ["clear", "supported", "compliant", "transparent", "verified"]
RAG_ABSOLUTE = ["100%", "fully", "completely", "guarantee"]

# ESG keyword families (H9)
ESG_KEYWORDS = {
    "environmental": ["carbon", "emissions", "renewable", "sustainable", "green", "eco-friendly",
                      "climate", "energy", "waste", "recycling", "biodiversity", "pollution"],
    "social": ["diversity", "inclusion", "equality", "human rights", "labor", "community",
               "health", "safety", "education", "training", "wellbeing", "fair trade"],
    "governance": ["transparency", "accountability", "ethics", "compliance", "board",
                   "leadership", "risk management", "corruption", "bribery", "stakeholder"],
    "greenwashing_indicators": ["vague", "unsubstantiated", "misleading", "exaggerated", "cherry-picking",
                                "hidden trade-offs", "false labels", "irrelevant claims", "lesser of two evils"],
}
VAGUE_ENV = ["sustainable", "green", "eco-friendly", "environmentally friendly"]
SUPERLATIVES = ["best", "most", "greatest", "highest", "lowest"]

# Text indicators (H4), in order: (label, any-of substrings of lower(text) or raw "100%")
INDICATOR_LABELS = ["Extreme claims (100%)", "Zero claims", "Sustainability claim",
                    "Carbon neutrality claim", "Renewable energy mention", "Vague language"]

# Weighted risk
FACTOR_WEIGHTS = [0.3, 0.25, 0.2, 0.15, 0.1]

# Messages
V2_BANDS = ["High risk indicators detected.", "Moderate risk indicators detected.", "Low risk indicators detected."]
V2_SOURCE = "Keyword analysis (no LLM available)"
ALERT_TEXT = {"HIGH": "HIGH RISK - Immediate review required",
              "MEDIUM": "POTENTIAL RISK - Further investigation recommended",
              "LOW": "CLEAR"}
AGENT_RECS = {
    "high_1": "Urgently verify data with independent third-party sources.",
    "high_2": "Cross-reference claims with financial reports and operational data.",
    "medium": "Request more specific data and clarification from the reporting entity.",
    "vague": "Advise for more quantifiable and specific claims.",
    "extreme": "Review language for extreme or vague claims.",
    "none": "Claim appears to be well-structured and transparent.",
}
ISSUE_TEXT = {
    "greenwash": "Contains {n} potential greenwashing indicators",
    "vague": "Contains multiple vague environmental terms",
    "no_metrics": "No specific metrics or targets mentioned",
    "superlatives": "Contains multiple superlatives without evidence",
}
NOTEBOOK_RECS = {
    "high_1": "High risk: Consider providing specific metrics and evidence",
    "high_2": "Review for potential greenwashing indicators",
    "medium_1": "Medium risk: Add more specific details and targets",
    "medium_2": "Consider third-party verification",
    "low": "Low risk: Claim appears well-supported",
    "terms": "Consider incorporating more ESG-specific terminology",
    "metrics": "Add specific metrics, targets, or timelines",
}
CALIBRATED_RECS_HIGH = ["Review claim accuracy and supporting evidence.",
                        "Consider independent verification of metrics."]
CALIBRATED_RECS_LOW = ["Claim appears to be well-structured and transparent."]
BATCH_DEFAULTS = {"claim_category": "Environmental", "project_location": "Unknown",
                  "claimed_metric_type": "Unknown", "claimed_value": 0.0,
                  "actual_measured_value": 0.0, "report_year": 2024}
VERDICT_LABELS = {"detector": ("GREEN-WASH", "Clean"), "fraud": ("Greenwashing (Fraudulent)", "Legit")}

# ---------------------------------------------------------------------------
# Data lexicons: fragments that do occur in the driver's invented prose, used to
# exercise the same rules on the test tables (the ESG words above are rare there).
# ---------------------------------------------------------------------------
DATA_V2_VAGUE = ["the", "and", "ing", "tion", "ment", "que", "eux", "ent", "ers", "ion", "ich", "con"]
DATA_V2_HIGH = ["with", "for", "that", "les", "une", "der", "und", "los", "las", "this", "nt."]
DATA_V2_EXTREME = ["the the", "de la", "in the", "und die", "of the", "en el"]

# Data polarity lexicon: words of the driver's prose with illustrative polarities (the
# sentiment lexicon is a user parameter; this one exercises the operator on the test tables).
DATA_POLARITY = {"the": 0.1, "and": 0.2, "with": 0.3, "le": -0.1, "la": -0.2, "des": -0.3,
                 "der": 0.4, "die": -0.4, "el": 0.5, "los": -0.5}
