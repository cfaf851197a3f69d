"""Fixed values of the ranking model: vocabularies, weights, caps and thresholds.

Everything in this module is data.  The values are part of the observable
behaviour (changing one changes results), so they are stated literally and kept
together; the code that uses them lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# vocabularies
# --------------------------------------------------------------------------

STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "what", "where", "when", "how",
    "why", "can", "does", "into", "have", "has", "are", "was", "were", "will", "shall",
    "file", "files", "code", "work", "issue", "bug", "fix",
    "nightmare", "furious", "hostage", "threatening", "physically", "absolutely",
    "completely", "immediately", "worse",
    "horrible", "terrible", "urgent", "critical", "please", "help", "trying",
    "getting", "showing", "saying", "told", "called", "went", "came",
    "police", "security", "family", "management", "hospital", "system", "just",
    "still", "even", "already", "always", "never", "again", "back", "much", "also",
)

OWNERSHIP_TOKENS = (
    "file", "files", "where", "implemented", "implementation", "owner", "ownership", "entity", "entities",
    "dto", "dtos", "service", "services", "controller", "controllers", "api", "type", "types", "ui",
    "frontend", "backend", "component", "components", "page", "pages", "appdbcontext", "dbset",
    "mapper", "mapping", "endpoint", "route",
)
BUSINESS_FLOW_TOKENS = (
    "workflow", "flow", "behavior", "state", "machine", "policy", "decision", "invariant", "scenario",
    "lifecycle", "process", "rule", "rules",
)
RUNTIME_TOKENS = (
    "debug", "runtime", "sql", "config", "permission", "permissions", "production", "verify", "check",
    "failing", "failed", "issue", "bug",
)
CODE_LEVEL_TOKENS = (
    "helper", "helpers", "hook", "hooks", "prop", "props", "parser", "parse", "preview", "sheet",
    "template", "bootstrap", "offline", "serviceworker", "service", "worker", "variable", "variables",
    "function", "functions", "method", "methods", "internal",
)
IMPLEMENTATION_TRACE_TOKENS = (
    "where", "handled", "handle", "implemented", "implementation", "blocked", "wrong", "failing", "failed",
    "reopen", "approval", "approve", "job", "jobs", "scheduler", "scheduled", "background", "controller",
    "controllers", "service", "services", "upload", "delete", "timezone", "batch", "reservation",
    "validation", "permission", "mapping", "owner", "ownership", "flow", "trace", "route", "endpoint",
    "cart", "checkout", "movement", "session", "reminder", "reminders",
    "escalation", "recipient", "recipients", "scope", "preview", "highlight", "remove", "rowversion",
    "queue", "safety", "concurrency", "attachment", "attachments", "uploaded",
    "result", "results", "bridge", "handoff", "selector", "appointment",
    "variance", "quantity", "effective", "access", "evaluator", "catalog", "skipped", "skip",
    "completion", "completed", "running", "report", "open", "logo", "template",
    "print", "profile", "fallback", "store", "switch", "stale", "cleanup", "payment", "failure",
)
CROSS_MODULE_TOKENS = ("bridge", "integration", "cross", "handoff", "sync", "link", "between")

GENERIC_FILE_TOKENS = (
    "main", "service", "services", "controller", "controllers", "dto", "dtos", "entity", "entities",
    "api", "type", "types", "ui", "src", "module", "modules",
    "frontend", "backend", "implemented", "implementation", "where", "file", "files",
)
# Tokens that never count as evidence for a primary owner.
OWNER_EXCLUDED_TOKENS = (
    "tsx", "ts", "jsx", "js", "cs", "py", "java", "go", "rb", "php", "json", "md", "yml", "yaml",
    "is", "in", "to", "of", "as", "on", "at", "or", "an", "no", "so", "up", "us", "we", "by", "if",
    "the", "and", "for", "are", "was", "has", "not", "but", "yet", "nor", "via", "per",
    "our", "you", "his", "her", "its", "who", "why", "from", "this", "that", "into", "than", "then", "with",
)

# Vocabularies of the query profile and of candidate penalties.
CODE_DEBUG_QUERY_TERMS = (
    "bug", "issue", "failing", "failed", "failure", "wrong", "broken", "debug", "runtime",
    "preview", "delete", "remove", "highlight", "attachment", "batch", "reservation", "refund",
    "payment", "permission", "route", "guard", "evaluator", "catalog", "cleanup", "save",
    "persist", "upload", "validation", "submit", "lookup", "reopen", "approval", "concurrency",
    "rowversion", "null", "desync", "drift", "scheduler", "notification", "followup", "follow",
)
WORKFLOW_DISCOVERY_TERMS = (
    "workflow", "flow", "behavior", "state", "lifecycle", "process", "rule", "rules",
    "policy", "decision", "invariant", "scenario", "architecture",
)
INFRA_RUNTIME_TERMS = (
    "scheduler", "job", "jobs", "cron", "middleware", "interceptor", "webhook", "websocket",
    "offline", "bootstrap", "serviceworker", "worker", "auth", "authorization",
    "authentication", "pipeline", "retry", "idempotency", "queue", "background",
    "startup", "warmup", "timeout",
)
BRIDGE_TERMS = ("bridge", "integration", "cross", "handoff", "sync", "link", "between")
LOW_SIGNAL_QUERY_TERMS = (
    "system", "issue", "problem",
    "fails", "failing", "failure", "error", "wrong", "broken", "query", "data", "flow", "module",
)
OVERLOADED_SEMANTIC_TERMS = (
    "index", "search", "permission", "permissions", "job", "jobs", "report", "reports",
    "template", "templates", "settings", "config", "configuration", "pdf", "print", "printing",
    "retry", "retries", "webhook", "webhooks", "timezone", "timezones",
)
OWNER_FILE_HINT_TERMS = (
    "controller", "controllers", "service", "services", "job", "jobs", "worker", "workers",
    "middleware", "handler", "handlers", "repository", "repositories", "provider", "providers",
    "resolver", "resolvers", "engine", "engines", "utility", "utilities", "helper", "helpers",
)
EXPLICIT_API_QUERY_TERMS = (
    "api", "endpoint", "endpoints", "route", "routes", "controller", "controllers",
    "client", "http", "request", "response",
)
OFFLINE_RULE_TERMS = ("offline", "service", "worker", "bootstrap", "offlineenabled", "settingsprovider")

# Words dropped from a gap query built out of an issue text.
GAP_QUERY_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "there", "and",
    "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "it", "its", "this", "that", "these", "those", "also", "not", "no",
    "i", "we", "they", "he", "she", "patient", "staff", "unable", "check",
    "waiting", "want", "please", "now", "then", "just", "so", "very",
    "stuck", "blocked", "cannot", "linked", "valid", "ghost", "session",
)

# --------------------------------------------------------------------------
# patterns
# --------------------------------------------------------------------------

IDENTIFIER_PATTERN = r"\b[A-Za-z_][A-Za-z0-9_.]{2,}\b"
NEGATION_PATTERN = (
    r"(?i)\b(?:not|never|without|except|excluding|neither|nor)\b|n't\b"
    r"|\brather than\b|\binstead of\b|\bno longer\b"
)
NEGATION_WINDOW_CHARS = 40
SOURCE_LINE_EXTENSIONS = r"(?i)\.(cs|tsx|ts|js|json|sql|md|yaml|yml)$"
# A line with one of these states where a fact came from, and is no fact itself.
PROVENANCE_MARKERS = ("source:", "last verified", "graphify-out/")
CODE_FILE_PATTERN = r"\.(cs|tsx|ts|js)$"
KNOWN_FILE_PATTERN = r"\.(cs|tsx|ts|js|json|sql|md|yaml|yml)$"
DECLARATION_KEYWORDS = ("type", "interface", "class", "function", "const", "let", "var", "enum")
# Declarations recognised in live source lines, by language.
TS_DECLARATIONS = (
    r"^\s*export\s+default\s+function\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^\s*(?:export\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*:\s*[^=]+\s*=",
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^\s*(?:export\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=",
)
CS_DECLARATIONS = (
    r"^\s*(?:public|internal|private|protected)?\s*(?:sealed\s+|abstract\s+|partial\s+)*class\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^\s*(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[A-Za-z0-9_<>\[\]\?,\s]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
)

# --------------------------------------------------------------------------
# Paths and source types
# --------------------------------------------------------------------------

OWNER_PATH_MARKERS = (
    "/controllers/", "/services/", "/jobs/", "/dtos/", "/entities/",
    "/api/", "/components/", "/pages/", "/hooks/", "/utils/",
)
OWNERSHIP_LAYER_MARKERS = (
    "/entities/", "/dtos/", "/services/", "/controllers/", "/api/", "/components/", "/pages/", "/jobs/",
)
OWNER_FILE_PATTERNS = ("controller.cs", "service.cs", "job.cs", "dto.cs", "dtos.cs", "entity.cs", ".tsx")
BROAD_FILE_PATTERNS = (
    "capability", "/workflows/", "/decisions/", "/blocker-playbooks/",
    "/chatbot-intents/", "/configs/", "index.md", "scope-summary.md",
)
# Folder / extension -> constant, first match wins.
OWNER_PATH_SCORES = (
    ("contains", "/controllers/", 180.0),
    ("contains", "/services/", 170.0),
    ("contains", "/jobs/", 165.0),
    ("endswith", ".tsx", 155.0),
    ("endswith", ".ts", 125.0),
    ("contains", "/dtos/", 90.0),
    ("contains", "/entities/", 80.0),
)
OWNER_PATH_SCORE_DEFAULT = 40.0

BROAD_SOURCE_TYPES = ("index.md", "scope-summary.md")
OWNER_GRAPH_SOURCE_TYPES = ("graph.json", "dependency-edges.enrichment.json")
NARRATIVE_SOURCE_TYPES = ("GRAPH_REPORT.md", "source-files.txt", "scope-summary.md", "behavior pack", "index.md")
PACK_EVIDENCE_SOURCE_TYPES = (
    "source-files.txt", "behavior pack", "graph_report.md", "manifest.json",
    "graph.json", "dependency-edges.enrichment.json",
)
SUMMARY_SOURCE_TYPES = ("GRAPH_REPORT.md", "index.md", "scope-summary.md", "behavior pack")
CODE_SOURCE_TYPES = (
    "graph chunk", "graph.json", "dependency-edges.enrichment.json", "source-files.txt", "live source",
)
DOC_SOURCE_TYPES = ("behavior pack", "graph_report.md", "index.md", "scope-summary.md", ".md", "manifest.json")
SOURCE_PRIORITY = {
    "GRAPH_REPORT.md": 100,
    "index.md": 90,
    "scope-summary.md": 80,
    "source-files.txt": 75,
    "behavior pack": 70,
    "graph.json": 60,
    "manifest.json": 40,
}
SOURCE_PRIORITY_DEFAULT = 20
WELL_KNOWN_FILE_NAMES = ("GRAPH_REPORT.md", "source-files.txt", "scope-summary.md", "manifest.json", "index.md")
SECONDARY_PACK = "secondary-ownership"
TRACE_BEHAVIOR_MARKERS = ("api-map", "source-files", "data-dictionary", "runtime-verification")
CROSS_MODULE_MARKERS = ("cross-module", "bridge", "bridges", "integration", "integrations")
LAYER_MARKERS = (
    ("data", ("data", "appdbcontext", "dbset", "migration", "migrations")),
    ("dtos", ("dto", "dtos", "type", "types")),
    ("entities", ("entity", "entities")),
    ("services", ("service", "services")),
    ("controllers", ("controller", "controllers", "endpoint", "route")),
    ("api", ("api", "client")),
)

# --------------------------------------------------------------------------
# Symbol and relation weights
# --------------------------------------------------------------------------

SYMBOL_KIND_PRIORITY = {
    "controller_action": 0, "service_method": 0, "job_method": 0, "ui_component": 0,
    "ui_function": 1, "controller_class": 1, "service_class": 1, "job_class": 1,
    "method": 2, "dto_type": 3, "entity_type": 3, "file": 5,
}
SYMBOL_KIND_PRIORITY_DEFAULT = 9
SYMBOL_OWNER_WEIGHT = {
    "controller_action": 1100.0, "service_method": 1050.0, "job_method": 1025.0,
    "ui_component": 1000.0, "ui_function": 900.0, "controller_class": 850.0,
    "service_class": 825.0, "job_class": 800.0, "method": 650.0,
    "dto_type": 350.0, "entity_type": 320.0, "file": 0.0,
}
SYMBOL_OWNER_WEIGHT_DEFAULT = 100.0
CAPTURED_SYMBOL_KINDS = (
    "controller_action", "service_method", "job_method", "ui_function",
    "controller_class", "service_class", "job_class", "ui_component",
)
CAPTURED_RELATIONS = (
    "calls", "uses", "depends_on", "maps", "reads", "writes", "publishes",
    "subscribes", "imports", "imports_from", "references", "inherits",
)
RELATION_WEIGHT = {
    "calls": 600.0, "invokes": 600.0, "inherits": 520.0, "uses": 520.0,
    "depends_on": 500.0, "imports": 480.0, "imports_from": 480.0, "references": 450.0,
    "maps_to": 430.0, "returns": 420.0, "contains": 300.0, "defines": 280.0,
}
RELATION_WEIGHT_DEFAULT = 250.0
HELPER_WORDS = ("helper", "helpers", "status", "statuses", "cancel", "cancelled", "terminal", "active")
STATUS_WORDS = ("status", "cancel", "cancelled", "terminal", "active")
EXECUTABLE_KINDS = ("controller_action", "service_method", "job_method", "ui_component")
CLASS_KINDS = ("controller_class", "service_class", "job_class")
ANCHOR_KINDS = ("controller_class", "service_class", "job_class", "entity_type", "dto_type")

# Field weights of the document score; tf is capped at TF_CAP per field.
FIELD_WEIGHTS = {
    "title": 7.0, "path": 6.0, "module": 8.0, "pack": 8.0,
    "source_type": 2.0, "text": 1.0, "files": 5.0, "facts": 5.0,
}
TF_CAP = 8
PHRASE_FIELDS = ("title", "path", "module", "pack", "facts")
PHRASE_BONUS = 20.0
IDENTIFIER_FIELD_BONUS = 160.0
IDENTIFIER_TEXT_BONUS = 70.0

# Weights of the evidence in cross-pack rebalancing, by peak position.
PACK_PEAK_WEIGHTS = (1.0, 0.35, 0.15)
PACK_PEAK_WEIGHT_FLOOR = 0.08
RESCORE_WINDOW = 10
RESCORE_MARGIN = 0.15
# Second pass over the best owner candidates.
RERANK_WINDOW = 10
RERANK_MARGIN = 0.08
RERANK_WEIGHTS = {
    "identifier_match": 0.40, "kind": 0.40, "label_token_match": 0.15, "path_token_match": 0.05,
}
CONFIRMED_FILE_SYMBOL_CAP = 16

# --------------------------------------------------------------------------
# Event log
# --------------------------------------------------------------------------

OUTCOME_VALUES = ("success", "partial", "failed")
FAILURE_REASONS = (
    "none", "bad_ranking", "stale_graph", "missing_graph_data",
    "unclear_query", "too_few_results", "ai_did_not_use_context",
)
KEYWORD_TOOLS = (
    "search_context", "find_related_files", "find_code_locations", "get_graph_pack", "get_module_summary",
)
FILE_LIST_TOOLS = ("search_context", "find_related_files", "get_graph_pack", "get_module_summary")
RETRIEVAL_MODES = ("keyword", "hybrid_hash", "hybrid_semantic", "other")
RECENT_LIST_CAP = 1000
SAVINGS_SAMPLE_WINDOW = 500
QUALITY_BREAKDOWN_CAP = 50
LOW_CONFIDENCE_CAP = 25
GAP_WINDOW_SECONDS = 900
MAX_QUERY_CHARS = 8000

# --------------------------------------------------------------------------
# Limits of extraction, search and fusion (defaults)
# --------------------------------------------------------------------------

MAX_TEXT_BYTES = 1_048_576
MAX_GRAPH_NODES = 200
MAX_GRAPH_EDGES = 300
MAX_DOC_FILES = 150
MAX_FACTS = 25
MAX_SOURCE_FILES = 100
MAX_SYMBOL_HINTS = 40
MAX_DEPENDENCY_HINTS = 60
MAX_ROUTE_ENTRIES = 500
ROUTE_FIELD_CHARS = 300
MAX_GRAPH_CHUNKS = 250
MAX_CHUNK_NODES = 80
MAX_CHUNK_EDGES = 120
CHUNK_MAX_CHARS = 3200
CHUNK_OVERLAP_CHARS = 200
CHUNK_MIN_CHARS = 200
SPLIT_MARKERS = ("\n## ", "\n### ", "\n# ", "\n- ", ". ", "\n")
EMBED_DIMENSIONS = 384
BIGRAM_WEIGHT = 0.55
RRF_K = 60
CONFIDENCE_SCALE = 45.0
