"""Rule constants: patterns, word lists and weights. All are fixed values that results depend on."""

# Patterns, written so that Java and RE2 read them alike.
HEADING = r"(?i)^(?:\d+\.\d+(?:\.\d+)*\.?\s+\S.*|[A-Z][A-Z0-9\s\-/]{4,}$|(?:Chapter|Section|Appendix|Part)\s+[\w\.\-]+.*|(?:Procedure|Process|Method)\s*:\s*.+)"
MAJOR_SECTION = r"^\d+\.\d+\s+"
PAGE_MARK = r"(?i)^\s*(?:page\s+)?(\d+)\s*$"
STEP_LINE = r"(?i)^\s*(?:\d+[\.\)]\s+|Step\s+\d+[:\.\s]+|[a-z][\.\)]\s+|[-•▪]\s+)"
LIST_PAREN = r"(?i)^\s*(\([a-z0-9]+\))\s+"
CHUNK_STEP = r"(?im)^\s*(\d+[\.\)]\s+|\d+\.\d+\s+|Step\s+\d+[:\.\s]+|[a-z][\.\)]\s+|[-•▪]\s+)"
STEP_NUM = r"(?i)^\s*(?:step\s+)?(\d+)(?:[\.\)\:]|\.\d+)*\s+"
LIST_SEP = r"(?:\s*[↓↑→←⟶⇒➡➔➜➝➞⇩⇧]\s*|\s*(?:->|=>|-->|==>)\s*|\s+\+\s+)"
CLS_NUMBERED = r"(?i)^\s*(?:\d+[\.\)\:]|\d+\.\d+\s+|step\s+\d+[:\.\s]+|[a-z][\.\)]\s+|[-•▪]\s+)"
CLS_DESC_PREFIX = r"(?i)^\s*(?:this\s+(?:procedure|section|process|method|document)\b|the\s+following\b|note\s+that\b|record\s+all\b|(?:be\s+)?aware\s+that\b|(?:it\s+is\s+)?(?:important|critical)\s+(?:to\s+note|that)\b)"
CLS_COMPARISON = r"(?i)\b(?:differs?\s+from|different\s+from|compared?\s+to|in\s+contrast\s+to|unlike\s+the|as\s+opposed\s+to|versus\b|vs\.?\b)\b"
LIGHT_DESC = r"(?i)(?:^\s*this\s+(?:procedure|section|process|method|document)\b|^\s*the\s+following\b|\b(?:differs?|different)\s+from\b|\bcompared?\s+to\b|\bapplies?\s+to\s+hairline\b|^\s*(?:where|what|which|how)\b.*\?)"
ALLCAPS = r"^[A-Z0-9\s\(\)\-—]+$"
CONDITIONAL = r"(?i)^\s*if\b.*?\b(repeat|redo|re-perform|reperform|re-run|rerun|re-verify|reverify)\b"
UNLESS = r"(?i)^\s*unless\b"
TARGET_RANGE = r"(?i)\bsteps?\s+(\d+)\s*(?:-|–|—|to)\s*(\d+)"
TARGET_ONE = r"(?i)\bsteps?\s+(\d+)"
LOOKUP = r"^(where|which section|what section|locate|find)\b"
DOMAIN_PHRASE = r"(?i)\b(?:major\s+)?(?:weld\s+repair|field\s+repair|weld\s+passes)\b"
COREF_NOUN = r"\b((?:the|a|an)\s+(?:[A-Za-z-]+\s+){0,3}[A-Za-z-]+|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
COREF_PRON = r"(?i)\b(it|its|they|them|their|this|that)\b"
CAUSATIVE = r"(?i)\b(allow|cause|permit|let|make|enable|force|require)(?:s|d|ed)?\s+(?:(?:the|a|an)\s+)?(.+?)\s+to\s+(\w+)"
DURATION = r"(?i)\bfor\s+(\d+\s+\w+)"
ACTOR = r"(?i)^\s*(?:\d+[\.\)]\s*)?(?:the|a|an)\s+(technician|operator|engineer|worker|user)\s+((?:shall|must|should|will|may|can)\s+)?([A-Za-z]+)\s*(.*)$"
BARE_NUMBER = r"^\d+\.\s*$"
ASKS = r"(?i)^(?:where|what|which|how|when|why)\b.*\?"
LEADS = r"(?i)^(?:after|before|once|following|upon|then)\b"
NOISE_LOWER = r"^(?:this section describes|#*\s*(?:sample|synthetic|example)\b)"
PERFORM_NUMBER = r"(?i)^perform \d+$"
LEXICAL = (
    r"(?im)^\d+\.\d+\s+.*Procedure",
    r"(?im)^\d+\.\d+\s+.*Process",
    r"(?im)^Repair of",
    r"(?im)^Procedure\s*:",
    r"(?im)^Method\s*:",
    r"(?im)^\d+\.\s+[A-Z][A-Za-z\s]+Procedure",
    r"(?im)^Appendix\s+[A-Z0-9]",
    r"(?im)^[A-Z][A-Z\s]{4,}$",
)
# Word lists.
MARKERS = {
    "AFTER": ("after", "once", "following", "upon", "subsequent to", "thereafter"),
    "BEFORE": ("before", "prior to", "preceding"),
    "THEN": ("then", "next", "afterward", "afterwards", "subsequently"),
    "IF": ("if", "when", "whenever", "provided that"),
}
IMPERATIVES = [
    "apply", "remove", "inspect", "grind", "preheat", "perform", "clean", "install", "replace", "extract",
    "verify", "check", "use", "do", "ensure", "allow", "record",
]
STOP_VERBS = [
    "be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did", "can",
    "could", "should", "would", "may", "might", "shall", "will", "seem", "appear", "describe", "include",
    "contain", "follow", "follows",
]
NOISE_OBJECTS = [
    "inspection", "preheating", "welding", "grinding", "testing", "removal",
]
HINTS = [
    "inspect", "remove", "grind", "preheat", "apply", "weld", "repair", "perform", "test", "testing", "clean",
    "extract", "install", "replace", "validate", "validation", "role", "context", "objective", "input", "tasks",
    "constraints", "output", "format",
]
QUERY_STOPS = [
    "where", "is", "the", "a", "an", "of", "for", "to", "in", "on", "and", "or", "procedure", "process",
    "workflow", "how", "what", "which", "find", "locate", "show", "me", "about", "does", "do", "are",
]
# Weights and thresholds.
SEGMENT_WEIGHTS, SEGMENT_THRESHOLD, WEAK, WEAK_GAP = (0.35, 0.40, 0.25), 0.45, 0.55, 2
ALIGN_GAP, CLUSTER_THRESHOLD = 0.35, 0.7
EMBED_DIM = 64


def all_markers() -> list[tuple[str, str]]:
    """(marker, relation), longest marker first."""
    return sorted(((m, r) for r, ms in MARKERS.items() for m in ms), key=lambda x: (-len(x[0]), x[0]))
