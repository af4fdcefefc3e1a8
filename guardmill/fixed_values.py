"""Results only agree when these equal the published contract.

Everything here is data (schemas, lookup tables, word lists, patterns, sentences), kept
together and in natural order. No logic lives in this file.
"""

# --- Table schemas (column DDL) -------------------------------------------------

TABLE_DDL = {
    "bronze_documents": """
        document_id STRING NOT NULL, title STRING, source_path STRING, classification STRING,
        owner STRING, department STRING, allowed_roles ARRAY<STRING>, version STRING,
        created_at STRING, contains_sensitive_info BOOLEAN, document_hash STRING,
        ingestion_timestamp STRING""",
    "silver_chunks": """
        chunk_id STRING NOT NULL, document_id STRING NOT NULL, chunk_index INT NOT NULL,
        chunk_span STRUCT<start: INT, end: INT>, classification STRING,
        allowed_roles ARRAY<STRING>, owner STRING, department STRING, version STRING,
        source_path STRING, document_hash STRING, sensitivity_score FLOAT,
        detected_sensitive_types ARRAY<STRING>, requires_encryption BOOLEAN,
        requires_restricted_access BOOLEAN""",
    "gold_embeddings": """
        embedding_id STRING NOT NULL, chunk_id STRING NOT NULL, document_id STRING NOT NULL,
        embedding_ciphertext BINARY, embedding_nonce BINARY, embedding_algorithm STRING,
        embedding_dim INT, embedding_dtype STRING, embedding_model STRING, key_id STRING,
        classification STRING, allowed_roles ARRAY<STRING>, owner STRING, department STRING,
        source_path STRING, version STRING, document_hash STRING, created_at STRING""",
    "embed_cache": """
        chunk_id STRING NOT NULL, document_hash STRING NOT NULL,
        chunk_span STRUCT<start: INT, end: INT>, embedding_ciphertext BINARY,
        embedding_nonce BINARY, embedding_algorithm STRING, embedding_dim INT, key_id STRING,
        model STRING, created_at STRING""",
    "facts": """
        fact_id STRING NOT NULL, fact_type STRING NOT NULL, subject STRING NOT NULL,
        predicate STRING NOT NULL, object STRING NOT NULL, document_id STRING NOT NULL,
        chunk_id STRING NOT NULL, classification STRING NOT NULL,
        allowed_roles ARRAY<STRING> NOT NULL, department STRING NOT NULL,
        source_path STRING NOT NULL, confidence DOUBLE NOT NULL,
        extraction_method STRING NOT NULL, created_at STRING NOT NULL""",
    "users": """
        user_id STRING, name STRING, role STRING, department STRING, clearance_level STRING""",
    "audit_events": """
        timestamp STRING, request_id STRING, event_type STRING, user_id STRING, role STRING,
        query STRING, mode STRING, returned_ids ARRAY<STRING>, returned_count INT,
        filtered_out_ids ARRAY<STRING>, filtered_out_count BIGINT,
        access_decisions MAP<STRING, BOOLEAN>, decrypted_embedding_count BIGINT,
        status STRING, reason STRING, resource_id STRING, resource_type STRING""",
    "graph_nodes": """
        node_id STRING, node_type STRING, label STRING, classification STRING,
        allowed_roles ARRAY<STRING>, department STRING, source_chunk_id STRING,
        source_document_id STRING, confidence DOUBLE, extraction_method STRING,
        extra MAP<STRING, STRING>""",
    "graph_edges": """
        source_id STRING, target_id STRING, relation_type STRING, confidence DOUBLE,
        extraction_method STRING""",
}

# --- Security contract ------------------------------------------------------------

CLASSIFICATION_LEVELS = ("public", "internal", "confidential", "restricted")

# classification, accessible_to_all, required_clearance_levels, needs role, needs department
ACCESS_POLICIES = (
    ("public", True, (), False, False),
    ("internal", False, ("internal", "confidential", "restricted"), False, False),
    ("confidential", False, ("confidential", "restricted"), True, False),
    ("restricted", False, ("restricted",), True, True),
)

CAPABILITIES = (
    "can_access_all_records",
    "can_decrypt_text",
    "can_view_encrypted_payloads",
    "can_view_secret_keys",
    "can_view_decrypted_embeddings",
)

# role, clearance, then the five capabilities in the order above
ROLES = (
    ("admin", "restricted", True, True, False, False, False),
    ("data_engineer", "internal", False, True, False, False, False),
    ("business_analyst", "internal", False, True, False, False, False),
    ("security_engineer", "confidential", False, True, False, False, False),
    ("finance_manager", "confidential", False, True, False, False, False),
    ("external_viewer", "public", False, False, False, False, False),
    ("compliance_officer", "confidential", False, True, False, False, False),
    ("hr_manager", "confidential", False, True, False, False, False),
)

# Reasons of an access decision; names and lists follow the open ends
REASON_UNAUTHENTICATED = "Unauthenticated user; public records only"
REASON_PUBLIC = "Public record; accessible to everyone"
REASON_UNKNOWN = "Unknown classification: "
REASON_ALL_RECORDS = "User may access all records"
REASON_CLEARANCE = "Insufficient clearance: "
REASON_ROLE = "User role "
REASON_DEPARTMENT = "User department "
REASON_GRANTED = "User has required clearance and role for "

# --- Lineage: source, target, type ------------------------------------------------

LINEAGE = (
    ("landing_documents", "bronze_documents", "ingestion"),
    ("bronze_documents", "silver_chunks", "transformation"),
    ("silver_chunks", "gold_embeddings", "transformation"),
    ("gold_embeddings", "trino_governed_views", "serving"),
    ("gold_embeddings", "chroma_vector_index", "indexing"),
    ("gold_embeddings", "secure_retrieval_service", "service"),
    ("silver_chunks", "graph_index", "indexing"),
    ("chroma_vector_index", "secure_retrieval_service", "candidate_retrieval"),
    ("graph_index", "secure_retrieval_service", "graph_retrieval"),
    ("trino_governed_views", "superset_sql_ui", "presentation"),
    ("secure_retrieval_service", "streamlit_governed_ui", "presentation"),
    ("streamlit_governed_ui", "audit_events", "logging"),
)

# --- Dataset contracts --------------------------------------------------------------
# id, name, layer, classification, tags, required fields, sensitive fields, forbidden fields

DATASETS = (
    (
        "landing_documents", "Landing Documents", "landing", "public",
        ("landing", "source"),
        ("document_id", "path"),
        (),
        (),
    ),
    (
        "bronze_documents", "Bronze Documents", "bronze", "mixed",
        ("bronze", "documents", "metadata"),
        ("document_id", "classification", "owner", "allowed_roles"),
        (),
        (),
    ),
    (
        "silver_chunks", "Silver Chunks", "silver", "mixed",
        ("silver", "chunks", "sensitivity"),
        ("chunk_id", "document_id", "classification"),
        (),
        (),
    ),
    (
        "gold_embeddings", "Gold Encrypted Embeddings", "gold", "confidential",
        ("gold", "embeddings", "encrypted"),
        ("embedding_id", "chunk_id", "document_id", "classification"),
        ("embedding_ciphertext", "embedding_nonce", "key_id"),
        ("embedding_ciphertext", "embedding_nonce", "key_id"),
    ),
    (
        "trino_governed_views", "Trino Governed Views", "serving", "internal",
        ("trino", "sql", "governed", "views"),
        (),
        (),
        ("embedding_ciphertext", "embedding_nonce", "key_id"),
    ),
    (
        "secure_retrieval_service", "Secure Retrieval Service", "serving", "internal",
        ("search", "retrieval", "secure"),
        (),
        (),
        (),
    ),
    (
        "streamlit_governed_ui", "Streamlit Governed UI", "ui", "internal",
        ("ui", "streamlit", "rbac", "demo"),
        (),
        (),
        (),
    ),
    (
        "superset_sql_ui", "Superset SQL UI", "ui", "internal",
        ("superset", "sql_ui", "dashboards", "governed"),
        (),
        (),
        (),
    ),
    (
        "audit_events", "Audit Events Log", "audit", "internal",
        ("audit", "compliance"),
        ("timestamp", "request_id", "event_type", "user_id", "status"),
        (),
        (),
    ),
    (
        "chroma_vector_index", "Chroma Vector Index", "index", "internal",
        ("chroma", "vector", "index", "candidate"),
        ("chunk_id", "document_id", "classification"),
        (),
        ("raw_text", "embedding_ciphertext", "embedding_nonce", "key_id"),
    ),
    (
        "graph_index", "Graph Index", "index", "internal",
        ("graph", "relationships", "explainability", "networkx"),
        ("node_id", "node_type", "classification"),
        (),
        ("raw_text", "sensitive_label"),
    ),
)

# dataset -> field name, type, required, sensitive (and then kept out of safe views)
DATASET_FIELDS = {
    "landing_documents": (
        ("document_id", "STRING", True, False),
        ("path", "STRING", True, False),
    ),
    "bronze_documents": (
        ("document_id", "STRING", True, False),
        ("title", "STRING", True, False),
        ("classification", "STRING", True, False),
        ("owner", "STRING", True, False),
        ("department", "STRING", False, False),
        ("allowed_roles", "ARRAY<STRING>", True, False),
        ("version", "STRING", False, False),
        ("created_at", "STRING", False, False),
        ("contains_sensitive_info", "BOOLEAN", False, False),
        ("document_hash", "STRING", False, False),
        ("ingestion_timestamp", "STRING", False, False),
    ),
    "silver_chunks": (
        ("chunk_id", "STRING", True, False),
        ("document_id", "STRING", True, False),
        ("chunk_index", "INT", True, False),
        ("classification", "STRING", True, False),
        ("allowed_roles", "ARRAY<STRING>", False, False),
        ("owner", "STRING", False, False),
        ("department", "STRING", False, False),
        ("sensitivity_score", "FLOAT", False, False),
        ("requires_encryption", "BOOLEAN", False, False),
    ),
    "gold_embeddings": (
        ("embedding_id", "STRING", True, False),
        ("chunk_id", "STRING", True, False),
        ("document_id", "STRING", True, False),
        ("embedding_ciphertext", "BINARY", False, True),
        ("embedding_nonce", "BINARY", False, True),
        ("key_id", "STRING", False, True),
        ("embedding_algorithm", "STRING", False, False),
        ("embedding_dim", "INT", False, False),
        ("embedding_model", "STRING", False, False),
        ("classification", "STRING", True, False),
        ("allowed_roles", "ARRAY<STRING>", False, False),
        ("owner", "STRING", False, False),
        ("department", "STRING", False, False),
    ),
    "trino_governed_views": (
        ("safe.bronze_documents", "VIEW", False, False),
        ("safe.silver_chunks", "VIEW", False, False),
        ("safe.gold_embedding_catalog", "VIEW", False, False),
    ),
    "audit_events": (
        ("timestamp", "STRING", True, False),
        ("request_id", "STRING", True, False),
        ("event_type", "STRING", True, False),
        ("user_id", "STRING", True, False),
        ("role", "STRING", False, False),
        ("action", "STRING", False, False),
        ("status", "STRING", True, False),
    ),
    "chroma_vector_index": (
        ("chunk_id", "STRING", True, False),
        ("document_id", "STRING", True, False),
        ("classification", "STRING", True, False),
        ("allowed_roles", "ARRAY<STRING>", False, False),
        ("department", "STRING", False, False),
        ("owner", "STRING", False, False),
        ("version", "STRING", False, False),
        ("sensitivity_level", "STRING", False, False),
    ),
    "graph_index": (
        ("node_id", "STRING", True, False),
        ("node_type", "STRING", True, False),
        ("classification", "STRING", True, False),
        ("allowed_roles", "ARRAY<STRING>", False, False),
        ("source_chunk_id", "STRING", False, False),
        ("source_document_id", "STRING", False, False),
        ("confidence", "FLOAT", False, False),
        ("extraction_method", "STRING", False, False),
    ),
}

# layer -> catalogue entity type; anything else is a Table
ENTITY_TYPES = {
    "landing": "Table", "bronze": "Table", "silver": "Table", "gold": "Table",
    "serving": "Database", "ui": "Application", "audit": "Log",
}
ENTITY_TYPE_BY_DATASET = {"secure_retrieval_service": "API", "audit_events": "Log"}

# --- Text and sensitivity -----------------------------------------------------------

# characters that survive cleaning: TAB LF CR, printable ASCII, U+00A0 - U+FFFF
UNWANTED_CHARACTERS = r"[^\x09\x0A\x0D\x20-\x7E\u00A0-\uFFFF]"
# Unicode white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# type, literal that any match must contain, pattern (Java syntax, Unicode classes)
SENSITIVE_PATTERNS = (
    ("email", "@", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("employee_id", "EMP-", r"(?U)\bEMP-\d{6}\b"),
    ("client_id", "CLT-", r"(?U)\bCLT-[A-Z]{2}-\d{5}\b"),
    ("project_code", "PROJ-", r"(?U)\bPROJ-[A-Z]{3}-\d{3}\b"),
    ("financial_amount", "$", r"(?U)\$[\d,]+\.\d{2}\b"),
    ("token", "tok_", r"(?U)\btok_[a-f0-9]{16,}\b"),
)

SENSITIVE_KEYWORDS = (
    "vulnerability", "incident", "audit finding", "secret", "token", "credential", "payroll",
    "contract", "pentest", "penetration test", "exploit", "breach",
)

CLASSIFICATION_BASE_SCORE = {
    "public": 0.0, "internal": 0.1, "confidential": 0.4, "restricted": 0.6,
}
SCORE_PER_TYPE, MAX_TYPE_SCORE, MAX_SCORE = 0.1, 0.5, 1.0
ENCRYPTION_THRESHOLD, RESTRICTED_THRESHOLD = 0.5, 0.7

# --- Facts and answers ----------------------------------------------------------------

INCIDENT_TITLE = r"(?iU)INCIDENT\s+REPORT:\s*([^\n=]+?)(?:\s*={3,}|\s*\n|\s*\z)"
INCIDENT_COMMANDER = r"(?iU)Incident\s+commander:\s*(\S+@\S+)"
FACT_TYPE = "incident_commander"
FACT_PREDICATE = "HAS_INCIDENT_COMMANDER"
FACT_CONFIDENCE = 0.98
CHUNK_METHOD, DOCUMENT_METHOD = "regex:v1", "regex:v1:document_aware"

FACT_QUERY_MARKER = "incident commander"
SUBJECT_MARKER = "incident commander of"

# intent, words that select it (first group that hits wins), answer patterns, sentence
INTENTS = (
    ("incident_commander", ("incident commander", "commander", " ic "),
     (r"(?U)[Ii]ncident\s+[Cc]ommander\s*[:=]\s*(\S+)",
      r"(?U)\bIC\s*[:=]\s*(\S+)",
      r"(?U)\b[Cc]ommander\s*[:=]\s*(\S+)"),
     "The incident commander was %s."),
    ("owner", ("owner",),
     (r"(?U)\b[Oo]wner\s*[:=]\s*([^\n]+?)(?:\n|\z)",), "The owner is %s."),
    ("department", ("department",),
     (r"(?U)\b[Dd]epartment\s*[:=]\s*([^\n]+?)(?:\n|\z)",), "The department is %s."),
    ("affected_system", ("affected system",),
     (r"(?U)[Aa]ffected\s+[Ss]ystem\s*[:=]\s*([^\n]+?)(?:\n|\z)",),
     "The affected system is %s."),
)

OTHER_FACT_SENTENCE = "The answer is %s."
KEYWORD_SENTENCE = "Relevant content found in document %s."
NO_AUTHORIZED_INFORMATION = "No authorized information was found for your query."
NO_FACT_ANSWER = "No extracted fact answer is available for this query."
NO_FACT_BUT_CANDIDATES = (
    "Authorized semantic candidates were found, but no extracted fact answer "
    "is available for this query."
)
CANDIDATES_FOUND = "Authorized semantic candidates were found. Review the sources below."
UNSAFE_MODE_WARNING = (
    "DEMO ONLY: This is unsafe search mode. Use secure_search for production."
)
CONTEXT_NOTE = (
    "Text model integration is disabled by default. "
    "Only authorized context is prepared here. "
    "Enable explicitly and ensure only authorized sources are passed."
)

# --- Field lists ------------------------------------------------------------------------

GOLD_FORBIDDEN = ("embedding_ciphertext", "embedding_nonce", "key_id")
UI_FORBIDDEN = GOLD_FORBIDDEN + (
    "chunk_text_ciphertext", "chunk_text_nonce", "decrypted_embedding", "raw_text",
    "document_hash", "encrypted_text", "secret", "password",
)
SUMMARY_FIELDS = (
    "document_id", "title", "classification", "owner", "department", "version",
    "source_path", "allowed_roles",
)
INDEX_FIELDS = (
    "chunk_id", "document_id", "classification", "allowed_roles", "department", "owner",
    "version", "sensitivity_level",
)
NODE_DEFAULTS = {
    "node_type": "entity", "label": "", "classification": "internal", "department": "",
    "source_chunk_id": "", "source_document_id": "", "confidence": 1.0,
    "extraction_method": "metadata",
}
EDGE_DEFAULTS = {"confidence": 1.0, "extraction_method": "metadata"}
NODE_FORBIDDEN = ("sensitive_label", "raw_text")
AUDIT_FIELDS = (
    "timestamp", "event_type", "user_id", "role", "query", "mode", "returned_count",
    "filtered_out_count", "status", "reason",
)

# --- Safe views: name, table, columns, row filter ---------------------------------------

_DOCUMENT_COLUMNS = (
    "document_id", "title", "source_path", "classification", "owner", "department",
    "allowed_roles", "version", "created_at", "ingestion_timestamp",
)
_FILTERED_CHUNK_COLUMNS = (
    "chunk_id", "document_id", "chunk_index", "classification", "owner", "department",
    "version", "source_path", "sensitivity_score",
)
SAFE_VIEWS = (
    ("bronze_documents", "bronze_documents",
     _DOCUMENT_COLUMNS, ()),
    ("v_bronze_documents_catalog", "bronze_documents",
     _DOCUMENT_COLUMNS, ()),
    ("silver_chunks", "silver_chunks",
     (
         "chunk_id", "document_id", "chunk_index", "chunk_span", "classification",
         "allowed_roles", "owner", "department", "version", "source_path", "document_hash",
         "sensitivity_score",
     ), ()),
    ("v_silver_chunks_catalog", "silver_chunks",
     (
         "chunk_id", "document_id", "chunk_index", "chunk_span", "classification",
         "allowed_roles", "owner", "department", "version", "source_path",
         "sensitivity_score",
     ), ()),
    ("gold_embedding_catalog", "gold_embeddings",
     (
         "embedding_id", "chunk_id", "document_id", "embedding_algorithm", "embedding_dim",
         "embedding_dtype", "embedding_model", "classification", "allowed_roles", "owner",
         "department", "source_path", "version", "document_hash", "created_at",
     ), ()),
    ("v_gold_embedding_catalog", "gold_embeddings",
     (
         "embedding_id", "chunk_id", "document_id", "embedding_algorithm", "embedding_dim",
         "embedding_dtype", "embedding_model", "classification", "allowed_roles", "owner",
         "department", "version", "created_at",
     ), ()),
    ("v_public_chunks", "silver_chunks",
     _FILTERED_CHUNK_COLUMNS, ("public",)),
    ("v_internal_chunks", "silver_chunks",
     _FILTERED_CHUNK_COLUMNS, ("public", "internal")),
)

# --- SQL access grants -------------------------------------------------------------------

BLOCKED_COLUMNS = (
    "embedding_ciphertext", "embedding_nonce", "key_id", "raw_text", "decrypted_embedding",
    "password", "secret",
)
GRANTED_SCHEMAS = {
    "admin": ("raw", "safe"),
    "security_engineer": ("safe",),
    "finance_manager": ("safe",),
    "business_analyst": ("safe",),
    "data_engineer": ("safe",),
    "external_viewer": ("safe",),
}
_ANALYST_TABLES = (
    "bronze_documents", "silver_chunks", "gold_embedding_catalog",
    "v_bronze_documents_catalog", "v_silver_chunks_catalog", "v_gold_embedding_catalog",
    "v_public_chunks", "v_internal_chunks",
)
GRANTED_TABLES = {
    "external_viewer": ("v_public_chunks",),
    "business_analyst": _ANALYST_TABLES,
    "data_engineer": _ANALYST_TABLES,
    "security_engineer": _ANALYST_TABLES,
    "finance_manager": _ANALYST_TABLES,
    "admin": (*_ANALYST_TABLES, "gold_embeddings", "v_audit_events"),
}

SELECT_OPERATION = "SelectFromColumns"

# The active access-control list, first match wins (patterns match the whole name)
# user, catalog, access
CATALOG_RULES = (
    ("admin", ".*", "all"),
    (".*", "lakehouse", "read-only"),
    (".*", "system", "none"),
)
# user, catalog, schema, table, privileges
TABLE_RULES = (
    ("admin", ".*", ".*", ".*", ("SELECT", "INSERT", "DELETE", "UPDATE", "OWNERSHIP")),
    (".*", "lakehouse", "safe", ".*", ("SELECT",)),
)

# --- Quality -----------------------------------------------------------------------------

# checks whose name differs from "<dataset>_have_<field>"
CHECK_NAMES = {
    ("gold_embeddings", "chunk_id"): "gold_embeddings_link_to_chunk",
    ("gold_embeddings", "document_id"): "gold_embeddings_link_to_document",
}
ROLE_CHECK = "silver_chunks_confidential_have_allowed_roles"
KEY_CHECK = "gold_embeddings_have_encryption_metadata"
PLAINTEXT_CHECK = "gold_embeddings_no_plaintext_vectors"

# --- Crypto and embedding ------------------------------------------------------------------

# RFC 4122 name-space for URLs, as hex
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ENCRYPTION_ALGORITHM = "AES-256-GCM"
EMBEDDING_DTYPE = "float32"
DEFAULT_CHUNK_SIZE, DEFAULT_OVERLAP, DEFAULT_TOP_K = 400, 80, 5
DEFAULT_CANDIDATES = 20
DEFAULT_DIM, DEFAULT_BATCH = 384, 64
