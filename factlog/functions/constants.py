"""Names, lists and patterns that the data model prescribes."""

from __future__ import annotations

#: Columns of a fact, in the canonical order of the JSON form; checksum follows them.
FACT_COLUMNS = ["tx", "ts", "actor", "op", "e", "a", "v", "src", "invocation_id"]
FACT_SCHEMA = ", ".join(f"{c} string" for c in [*FACT_COLUMNS, "checksum"])

#: Attributes of which replay keeps the last write only.
LWW_ATTRIBUTES = ["base_activation", "retrieval_count", "last_retrieved_at", "evicted_at", "evicted_at_retracted"]

#: Attributes that become edges, and the edges' types.
EDGE_TYPES = {
    "trail": "IN_TRAIL",
    "subject": "ABOUT",
    "derived_from": "DERIVED_FROM",
    "similar_to": "SIMILAR_TO",
    "supersedes": "SUPERSEDES",
    "alias_of": "ALIAS_OF",
    "mentions_concept": "MENTIONS",
}

#: Entity labels by the prefix of the id.
LABELS = {"entry": "Entry", "frame": "Frame", "subject": "Subject", "trail": "Trail", "community": "Community", "psi": "PSI", "concept": "Concept"}

SUBJECT_NAMESPACES = ["lib", "cve", "bugclass", "concept", "principle", "adr", "service"]
WRITABLE_KINDS = ["Observation", "SessionReflection", "ObservedRace"]
REFLECTION_KINDS = ["BugPattern", "LibraryBehavior", "ConceptualModel", "Principle", "ADR", "RefactoringStep", "TroubleshootStep", "Practice"]
REQUIRED_FACETS = ["domain", "project"]

#: Words that are no concepts.
STOPWORDS = (
    "the and for with this that from has have had was were are but not can could will would should may might must into onto"
    " over under above below about your yours mine ours their them they what when where which who whom whose why how here"
    " there some any all none both each every such same other another these those than then too very just also only still"
    " yet because before after during"
).split()

#: Secret rules: name, pattern, least entropy of a match (0: none), severity.
SECRET_RULES = [
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", 0.0, "high"),
    ("aws_secret_key_hint", r"(?i)aws(.{0,20})?(secret|sk)[^A-Za-z0-9]{1,3}[A-Za-z0-9/+=]{40}", 0.0, "high"),
    ("github_pat", r"gh[pousr]_[A-Za-z0-9]{36,}", 0.0, "high"),
    ("gitlab_pat", r"glpat-[A-Za-z0-9\-_]{20,}", 0.0, "high"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9\-]{10,}", 0.0, "high"),
    ("discord_bot_token", r"[MN][A-Za-z\d]{23}\.[\w-]{6}\.[\w-]{27}", 0.0, "high"),
    ("private_key_pem", r"-----BEGIN (RSA|EC|OPENSSH|PGP|DSA) PRIVATE KEY-----", 0.0, "high"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0.0, "warn"),
    ("generic_high_entropy_secret", r"(?i)(password|secret|token|api[_-]?key)[^A-Za-z0-9]{1,5}[A-Za-z0-9/+=]{20,}", 4.5, "warn"),
]

#: Languages of source files: name, grouping strategy, extensions.
LANGUAGES = [
    ("go", "per-package", ["go"]),
    ("java", "per-class", ["java"]),
    ("kotlin", "per-file", ["kt", "kts"]),
    ("python", "per-file", ["py", "pyi"]),
    ("javascript_typescript", "per-file", ["js", "mjs", "cjs", "jsx", "ts", "tsx"]),
    ("rust", "per-module", ["rs"]),
    ("csharp", "per-class", ["cs"]),
    ("ruby", "per-class-or-module", ["rb"]),
    ("c_cpp", "per-pair", ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"]),
    ("docs", "per-file", ["md", "markdown", "txt", "rst"]),
    ("sql", "per-file", ["sql"]),
]

#: Directories that are never scanned, and the size beyond which a file is not read.
PRUNED_DIRECTORIES = [".git", ".hg", ".svn", "node_modules", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", ".gradle", ".tox"]
MAX_FILE_BYTES = 262_144

#: Frame types: name, store, required slots, optional slots, written by reflection only.
FRAME_SCHEMAS = [
    ("Observation", "episodic", ["body"], ["source_ref", "subject"], False),
    ("SessionReflection", "episodic", ["body", "agent"], ["outcomes"], False),
    ("ObservedRace", "episodic", ["body", "participants", "ordering_violation"], ["reproducer"], False),
    ("BugPattern", "semantic", ["name", "symptom", "root_cause", "conditions", "remediation"], ["exemplars", "first_seen", "last_seen"], True),
    ("DesignDecision", "procedural", ["name", "context", "choice", "rationale", "consequences"], ["alternatives", "supersedes"], True),
    ("RetryPattern", "procedural", ["name", "trigger", "strategy", "backoff", "max_attempts", "terminal_error_handling"], ["jitter", "idempotency_note"], True),
    ("ReliabilityPattern", "procedural", ["name", "failure_mode_addressed", "technique", "scope"], ["tradeoffs"], True),
    ("SecurityPattern", "procedural", ["name", "threat_model", "mitigation", "residual_risk"], ["references"], True),
    ("LibraryBehavior", "semantic", ["library_psi", "behavior", "observed_in"], ["version_range", "workaround"], True),
    ("Principle", "procedural", ["name", "statement", "scope"], ["counterexamples"], True),
    ("ArchitectureNote", "semantic", ["subject_psi", "body"], ["diagram_ref"], True),
    ("CommunityBrief", "semantic", ["community_id", "membership_hash", "theme_label", "canonical_insight", "exemplar_entry_id", "summary"], ["alternate_exemplars", "open_questions", "suggested_conflicts", "concept_tags", "coverage_notes"], True),
    ("ProjectBrief", "semantic", ["project", "generated_at", "community_ids", "stitched_narrative"], ["top_themes", "cross_cluster_concepts", "open_questions_project", "coverage_ratio"], True),
]
