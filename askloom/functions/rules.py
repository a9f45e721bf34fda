"""Word lists, patterns and label rules that decide results."""

# Fixed values. Words ignored by lexical matching (35 entries).
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "how", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "what",
    "when", "where", "which", "who", "why", "with", "would", "should", "could", "can",
)

# Fixed values. The answer side keeps "do" and "their" as terms.
ANSWER_STOPWORDS = tuple(w for w in QUERY_STOPWORDS if w not in ("do", "their"))

# Fixed values. Words dropped when a question is condensed to its key terms.
CONDENSE_STOPWORDS = (
    "about", "after", "also", "and", "are", "for", "from", "into", "that", "the",
    "this", "with",
)

# Fixed values. Entity aliases: (phrase pattern, canonical name).
ENTITY_ALIASES = (
    ("tata communications?", "tata communication"),
    ("tata comms?", "tata communication"),
    ("business to business", "b2b"),
)

# Fixed values. Substrings that decide the intent of a question, checked in this order.
FACTUAL_MARKERS = ("what is", "what are", "who is", "when did", "where is", "define ")
INFERENTIAL_MARKERS = (
    "implication", "infer", "scenario", "if ", "could", "might", "trade-off", "tradeoff",
)
ANSWER_INFERENTIAL_MARKERS = tuple(m for m in INFERENTIAL_MARKERS if m != "infer")

# Fixed values. Query suffixes added when a trigger word occurs.
CONCEPT_TRIGGERS = (
    (("pricing",), ("value-based pricing", "discount governance", "price signaling trust")),
    (("b2b", "business"), (
        "enterprise buyer value quantification", "procurement decision criteria",
    )),
)
INTENT_SUFFIXES = {
    "inferential": "implications and trade-offs",
    "factual": "key facts and evidence",
    "analytical": "strategic principles and practical guidance",
}
ENTITY_SUFFIX = "pricing strategy trust"
VARIANT_SUFFIXES = ("case study", "brand strategy")
CORRECTIVE_SUFFIXES = (
    "case study evidence", "brand positioning differentiation", "pricing trust audience",
)

# Fixed values. Texts that never count as a query variant.
PLACEHOLDERS = ("...", "..", ".", "n/a", "none", "null", "unknown")

# Fixed values. Section headings, tried in this order.
SECTION_HEADINGS = (
    r"(?:Chapter|CHAPTER)\s+[IVX\d]+[.:\s\-]+([^\n]+)",
    r"(?:Part|PART)\s+[A-Z\d]+[.:\s\-]+([^\n]+)",
    r"(?:Section|SECTION)\s+\d+[.:\s\-]+([^\n]+)",
    r"(?:Clause|CLAUSE)\s+\d+[.:\s\-]+([^\n]+)",
    r"(?:Annexure|ANNEXURE|Appendix|APPENDIX)\s*[A-Z0-9]*[.:\s\-]*([^\n]*)",
    r"(?:Schedule|SCHEDULE)\s+[IVX\d]+[.:\s\-]+([^\n]+)",
)

# Fixed values. Substring -> tag, in order.
KEYWORD_TAGS = (
    ("ai", "ai"), ("automation", "automation"), ("saas", "saas"), ("market", "market"),
    ("fin", "fintech"), ("health", "healthtech"), ("edu", "edtech"),
    ("supply", "supply-chain"), ("b2b", "b2b"), ("consumer", "b2c"), ("mobile", "mobile"),
    ("platform", "platform"), ("position", "positioning"), ("message", "messaging"),
    ("trust", "trust"), ("brand", "brand"),
)
CLOSING_TAGS = ("brand-strategy", "execution")

# Fixed values. How a follow-up question shows that it needs the conversation.
FOLLOW_UP_OPENERS = (
    "what about", "how about", "and ", "also ", "more on", "expand", "elaborate",
)
FOLLOW_UP_PRONOUNS = ("it", "this", "that", "these", "those", "they", "them", "its", "their")

# Fixed values. Field order of an answer record as text.
ANSWER_FIELDS = (
    "abstention_message", "brand_diagnosis", "market_insight", "suggested_positioning",
    "risks", "opportunities", "final_positioning", "target_audience", "chosen_strategy",
    "rejected_directions", "trade_offs", "actions", "confidence_score",
    "notion_page_content", "database_metadata",
)
ACTION_FIELDS = ("title", "description", "priority", "decision_type", "impact")
METADATA_FIELDS = ("name", "brand_positioning", "brand_risk_level", "confidence_score", "tags")
PRIMARY_FIELDS = (
    "brand_diagnosis", "market_insight", "final_positioning", "target_audience",
    "chosen_strategy",
)
LIST_FIELDS = ("suggested_positioning", "risks", "opportunities")

# Fixed values. Allowed values of an answer record.
ACTION_TYPES = ("task",)
LEVELS = ("low", "medium", "high")
DECISION_TYPES = (
    "positioning", "differentiation", "messaging", "trust", "audience", "pricing",
    "narrative", "other",
)
RISK_LEVELS = ("Low", "Medium", "High")
FIELD_ALIASES = {
    "brand_diagnosis": "idea_summary",
    "suggested_positioning": "recommendations",
    "trade_offs": "tradeoffs",
}
METADATA_ALIASES = {
    "brand_positioning": "idea_description",
    "brand_risk_level": "risk_level",
}

# Fixed values. Reasons for not answering.
REASON_NO_CONTEXT = "No retrievable context was found for this question."
REASON_FALLBACK_EMPTY = (
    "Local retrieval confidence is below threshold, and fallback retrieval did not produce "
    "usable context."
)
REASON_LOW_CONFIDENCE = "Retrieved context confidence is below threshold for a reliable answer."
REASON_TOO_FEW = "Too few relevant context chunks are available to support a grounded answer."

# Fixed values. Texts shown when a session has no conversation of its own.
DEFAULT_SUMMARY = "Initial brand strategy analysis generated for this decision session."
DEFAULT_QUESTION = "Original brand decision question was not captured."
DEFAULT_FOLLOW_UP = "Updated recommendation generated for this follow-up question."

# Frequent words that tell four languages apart.
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "ein", "nicht", "auf"),
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "with", "as", "this"),
    "es": ("el", "los", "y", "del", "por", "con", "las", "para", "se", "como", "una", "su"),
    "fr": ("le", "les", "des", "et", "du", "est", "pour", "dans", "une", "qui", "sur", "pas"),
}
