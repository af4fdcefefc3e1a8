"""SQL twins of the registered queries (DuckDB dialect), written independently."""

from __future__ import annotations

LEVELS = "['public','internal','confidential','restricted']"
ROLES = ("['admin','data_engineer','business_analyst','security_engineer','finance_manager',"
         "'external_viewer','compliance_officer','hr_manager']")
WS = r"[\t\n\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNWANTED = r"[^\x09\x0A\x0D\x20-\x7E\x{00A0}-\x{FFFF}]"


def role_set(n: str) -> str:
    return (f"CASE {n} WHEN 0 THEN ['security_engineer','compliance_officer'] "
            f"WHEN 1 THEN ['finance_manager','hr_manager','data_engineer'] "
            f"ELSE ['business_analyst','security_engineer'] END")


DOCS = f"""docs AS (
  SELECT doc_id, doc_id::VARCHAR AS document_id, 'Document ' || doc_id AS title,
    source || '/' || doc_id || '.txt' AS source_path,
    {LEVELS}[doc_id % 4 + 1] AS classification, 'owner-' || (doc_id % 7) AS owner,
    source AS department, {role_set('doc_id % 3')} AS allowed_roles,
    '1.' || (doc_id % 5) AS version, '2024-06-01T00:00:00Z' AS created_at,
    doc_id % 2 = 0 AS contains_sensitive_info, sha256(text) AS document_hash, text
  FROM documents)"""

INCIDENTS = DOCS + """, incidents AS (
  SELECT * REPLACE ('INCIDENT REPORT: ' || upper(department) || ' OUTAGE ' || (doc_id % 40)
    || chr(10) || '=====' || chr(10) || text || chr(10) || 'Incident commander: ops'
    || (doc_id % 50) || '@example.org' AS text) FROM docs)"""

USERS = f"""people AS (
  SELECT c_custkey::VARCHAR AS user_id, {ROLES}[c_custkey % 8 + 1] AS role,
    'src' || (c_nationkey % 20) AS department,
    {LEVELS}[c_nationkey % 4 + 1] AS clearance_level FROM customer)"""


def allowed(u: str, r: str) -> str:
    """The access rule for user alias u (user_id null = unknown) and record alias r."""
    return f"""COALESCE(CASE
      WHEN {u}.user_id IS NULL THEN {r}.classification = 'public'
      WHEN {r}.classification = 'public' THEN TRUE
      WHEN {u}.role = 'admin' THEN {r}.classification IN ('internal','confidential','restricted')
      WHEN {r}.classification = 'internal' THEN {u}.clearance_level IN ('internal','confidential','restricted')
      WHEN {r}.classification = 'confidential' THEN {u}.clearance_level IN ('confidential','restricted')
        AND list_contains({r}.allowed_roles, {u}.role)
      WHEN {r}.classification = 'restricted' THEN {u}.clearance_level = 'restricted'
        AND list_contains({r}.allowed_roles, {u}.role)
        AND {u}.department IS NOT DISTINCT FROM {r}.department
      ELSE FALSE END, FALSE)"""


def words_of(text: str) -> str:
    bare = (f"regexp_replace(regexp_replace({text}, '{UNWANTED}', '', 'g'), "
            rf"'^{WS}+|{WS}+\z', '', 'g')")
    return (f"list_filter(string_split_regex({bare}, '{WS}+'), lambda w: w <> '')")


def chunks(source: str, size: int = 400, overlap: int = 80, name: str = "chunks") -> str:
    return f"""{name}_w AS (SELECT * EXCLUDE text, {words_of('text')} AS words FROM {source}),
  {name}_s AS (SELECT *, unnest(range(0, len(words), {size - overlap})) AS start FROM {name}_w),
  {name} AS (SELECT * EXCLUDE (words, start), (start // {size - overlap})::INTEGER AS chunk_index,
      start::INTEGER AS span_start, least(start + {size}, len(words))::INTEGER AS span_end,
      array_to_string(list_slice(words, start + 1, start + {size}), ' ') AS chunk_text
    FROM {name}_s)"""


def uuid5(key: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({key}))"
    return (f"(SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' "
            f"|| translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') "
            f"|| substr(h,18,3) || '-' || substr(h,21,12) FROM (SELECT {h} AS h))")


CHUNK_ID = uuid5("document_id || ':' || document_hash || ':' || chunk_index")

TYPES = r"""list_sort(list_distinct(list_concat(
    list_filter([
      CASE WHEN regexp_matches(chunk_text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') THEN 'email' END,
      CASE WHEN regexp_matches(chunk_text, '\bEMP-\d{6}\b') THEN 'employee_id' END,
      CASE WHEN regexp_matches(chunk_text, '\bCLT-[A-Z]{2}-\d{5}\b') THEN 'client_id' END,
      CASE WHEN regexp_matches(chunk_text, '\bPROJ-[A-Z]{3}-\d{3}\b') THEN 'project_code' END,
      CASE WHEN regexp_matches(chunk_text, '\$[\d,]+\.\d{2}\b') THEN 'financial_amount' END,
      CASE WHEN regexp_matches(chunk_text, '\btok_[a-f0-9]{16,}\b') THEN 'token' END],
      lambda t: t IS NOT NULL),
    list_transform(regexp_extract_all(chunk_text, '(?i)penetration test|audit finding|vulnerability|credential|incident|contract|payroll|pentest|exploit|secret|breach|token'),
      lambda w: 'keyword:' || replace(lower(w), ' ', '_')))))"""

SCORED = f"""typed AS (SELECT *, {TYPES} AS types FROM chunks),
  scored AS (SELECT *, round(least(
      CASE classification WHEN 'internal' THEN 0.1::DOUBLE WHEN 'confidential' THEN 0.4::DOUBLE
        WHEN 'restricted' THEN 0.6::DOUBLE ELSE 0::DOUBLE END
      + least(len(types) * 0.1::DOUBLE, 0.5::DOUBLE), 1::DOUBLE), 3) AS score FROM typed)"""

SILVER = f"{DOCS}, {chunks('docs')}, {SCORED}"

TITLE = r"""trim(regexp_extract({t}, '(?i)INCIDENT\s+REPORT:\s*([^\n=]+?)(?:\s*={{3,}}|\s*\n|\s*\z)', 1))"""
COMMANDER = r"""regexp_extract({t}, '(?i)Incident\s+commander:\s*(\S+@\S+)', 1)"""

FACT_ID = ("'fact-' || substr(sha256(document_id || '|' || chunk_id || '|incident_commander|' "
           "|| lower(title)), 1, 16)")

DOCUMENT_FACTS = f"""{INCIDENTS}, {chunks('incidents')},
  ids AS (SELECT *, {CHUNK_ID} AS chunk_id FROM chunks),
  whole AS (SELECT document_id, any_value(classification) AS classification,
      any_value(allowed_roles) AS allowed_roles, any_value(department) AS department,
      any_value(source_path) AS source_path,
      string_agg(chunk_text, chr(10) ORDER BY chunk_index) AS full_text,
      list(struct_pack(i := chunk_index, id := chunk_id, t := chunk_text) ORDER BY chunk_index) AS pieces
    FROM ids GROUP BY document_id),
  found AS (SELECT *, {TITLE.format(t='full_text')} AS title, {COMMANDER.format(t='full_text')} AS commander FROM whole),
  placed AS (SELECT * REPLACE (pieces AS pieces), COALESCE(
      list_filter(pieces, lambda p: contains(p.t, commander))[1], pieces[1]).id AS chunk_id
    FROM found WHERE title <> '' AND commander <> ''),
  facts AS (SELECT {FACT_ID} AS fact_id, title AS subject, commander AS object, document_id,
      chunk_id, classification, allowed_roles, department, source_path FROM placed)"""

FACT_COLUMNS = """fact_id, subject, object, document_id, chunk_id, classification,
  array_to_string(allowed_roles, ',') AS roles, department, source_path"""

VECTORS = f"""vecs AS (
  SELECT 'c' || vec_id AS chunk_id, 'd' || (vec_id // 4) AS document_id,
    embedding::DOUBLE[] AS v, label, vec_id, {LEVELS}[vec_id % 4 + 1] AS classification,
    {role_set('vec_id % 3')} AS allowed_roles, 'src' || label AS department,
    'v/' || vec_id AS source_path FROM embeddings)"""

LABEL_REQUESTS = """means AS (
  SELECT label, pos, round(avg(x), 6) AS x FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos
    FROM embeddings) GROUP BY label, pos),
  requests AS (SELECT 'q' || label AS request_id, label::VARCHAR AS user_id,
    list(x ORDER BY pos) AS qv, 5 AS top_k FROM means GROUP BY label)"""

VECTOR_SCORES = """scores AS (SELECT r.request_id, c.*, r.top_k,
    round(list_cosine_similarity(r.qv, c.v), 12) + 0.0 AS score
  FROM requests r, vecs c)"""

TURNS = """turns AS (SELECT conv_id || ':' || turn AS request_id,
    CASE WHEN conv_id % 10 = 9 THEN 'guest-' || conv_id
      ELSE ((conv_id * 37 + turn * 11) % 150)::VARCHAR END AS user_id,
    text AS query, 3 AS top_k FROM conversations)"""

QUESTIONS = """questions AS (SELECT doc_id::VARCHAR AS request_id,
    CASE WHEN doc_id % 11 = 10 THEN 'nobody' ELSE (doc_id % 150)::VARCHAR END AS user_id,
    CASE WHEN doc_id % 5 = 3 THEN 'Who was the incident commander?'
      WHEN doc_id % 5 = 4 THEN 'Incident commander of  NOTHING ' || doc_id || ' ?'
      ELSE 'Who  was the Incident commander of ' || upper(source) || ' OUTAGE '
        || (doc_id % 40) || '?' END AS query FROM documents),
  asked AS (SELECT *, trim(regexp_replace(replace(lower(query), '?', ' '), '\\s+', ' ', 'g')) AS folded FROM questions),
  fact_asked AS (SELECT request_id, user_id, query,
    CASE WHEN contains(' ' || folded || ' ', ' incident commander of ')
      THEN trim(split_part(' ' || folded || ' ', ' incident commander of ', 2)) ELSE '' END AS subject FROM asked)"""

FACT_MATCHES = f"""matches AS (SELECT q.request_id, q.user_id, p.user_id IS NOT NULL AS known, f.*,
    {allowed('p', 'f')} AS ok
  FROM fact_asked q LEFT JOIN people p ON p.user_id = q.user_id
  JOIN facts f ON q.subject = '' OR trim(lower(f.subject)) = q.subject),
  fact_result AS (SELECT q.request_id, p.user_id IS NOT NULL AS known,
    COALESCE(any_value(m.n), 0) AS found, COALESCE(any_value(m.ok_n), 0) AS readable,
    any_value(m.first) AS first
    FROM fact_asked q LEFT JOIN people p ON p.user_id = q.user_id
    LEFT JOIN (SELECT request_id, count(*) AS n, count(*) FILTER (ok) AS ok_n,
        arg_min(struct_pack(id := fact_id, o := object, d := document_id, c := chunk_id), fact_id) FILTER (ok) AS first
      FROM matches WHERE known GROUP BY request_id) m ON m.request_id = q.request_id
    GROUP BY q.request_id, p.user_id)"""

REFUSAL = "No authorized information was found for your query."


def word_vectors(source: str, key: str, text: str, name: str, dim: int) -> str:
    """Sparse float32 unit vectors of hashed words: (key, bucket, x)."""
    return f"""{name}_t AS (SELECT {key} AS k, unnest({words_of(text)}) AS w FROM {source}),
  {name}_c AS (SELECT k, ('0x' || substr(md5(lower(w)), 1, 8))::UBIGINT % {dim} AS b,
      count(*)::DOUBLE AS n FROM {name}_t GROUP BY ALL),
  {name}_n AS (SELECT k, sqrt(sum(n * n)) AS norm FROM {name}_c GROUP BY k),
  {name} AS (SELECT c.k, c.b, (c.n / l.norm)::FLOAT::DOUBLE AS x FROM {name}_c c JOIN {name}_n l USING (k)),
  {name}_l AS (SELECT k, sqrt(sum(x * x)) AS norm FROM {name} GROUP BY k)"""


SEMANTIC = f"""{DOCS}, {USERS}, {chunks('docs')},
  ids AS (SELECT * EXCLUDE chunk_text, chunk_text AS body, {CHUNK_ID} AS chunk_id FROM chunks),
  {word_vectors('ids', 'chunk_id', 'body', 'cv', 64)}"""

SEMANTIC_SEARCH = f"""{SEMANTIC}, {TURNS},
  {word_vectors('turns', 'request_id', 'query', 'qv', 64)},
  readable AS (SELECT t.request_id, t.top_k, c.chunk_id, c.document_id, c.classification,
    c.source_path FROM turns t JOIN people p ON p.user_id = t.user_id JOIN ids c ON {allowed('p', 'c')}),
  dots AS (SELECT q.k AS request_id, c.k AS chunk_id, sum(q.x * c.x) AS dot
    FROM qv q JOIN cv c ON q.b = c.b GROUP BY ALL),
  graded AS (SELECT r.*, round(COALESCE(d.dot / (ql.norm * cl.norm), 0), 12) AS score
    FROM readable r LEFT JOIN dots d USING (request_id, chunk_id)
    LEFT JOIN qv_l ql ON ql.k = r.request_id LEFT JOIN cv_l cl ON cl.k = r.chunk_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM graded)"""

GRAPH = f"""nodes AS (
    SELECT 'order:' || o_orderkey AS node_id, {LEVELS}[o_orderkey % 4 + 1] AS classification,
      {role_set('o_orderkey % 3')} AS allowed_roles, 'src' || (o_orderkey % 20) AS department FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, {LEVELS}[c_custkey % 4 + 1], {role_set('c_custkey % 3')},
      'src' || (c_custkey % 20) FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, {LEVELS}[n_nationkey % 4 + 1], {role_set('n_nationkey % 3')},
      'src' || (n_nationkey % 20) FROM nation
    UNION ALL SELECT 'region:' || r_regionkey, {LEVELS}[r_regionkey % 4 + 1], {role_set('r_regionkey % 3')},
      'src' || (r_regionkey % 20) FROM region),
  edges AS (
    SELECT 'order:' || o_orderkey AS s, 'customer:' || o_custkey AS t, 'mentions' AS rel FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'part_of' FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of' FROM nation
    UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'relates_to' FROM nation)"""


def chunk_counts(source: str) -> str:
    """All chunks, and those of the classes that need roles and of documents with roles."""
    return f"""counts AS (SELECT count(*) AS total,
    count(*) FILTER (classification IN ('confidential', 'restricted')) AS guarded FROM {source})"""


def catalog_views(views: dict[str, tuple[str, ...]]) -> str:
    """view, columns and all values of every row of the safe views."""
    tables = {"bronze": "docs", "silver": "named", "gold": "sealed"}
    levels = {"v_public_chunks": " WHERE classification = 'public'",
              "v_internal_chunks": " WHERE classification IN ('public', 'internal')"}
    values = {
        "allowed_roles": "array_to_string(allowed_roles, ',')",
        "ingestion_timestamp": "'2024-06-01T00:00:00Z'",
        "chunk_span": "'start=' || span_start || ',end=' || span_end",
        "sensitivity_score": "printf('%.3f', score)",
        "embedding_id": uuid5("'embedding|' || chunk_id || '|' || sha256(vec_id::VARCHAR)"
                              " || '|2024-06-01T00:00:00Z'"),
        "embedding_algorithm": "'AES-256-GCM'", "embedding_dim": "'64'",
        "embedding_dtype": "'float32'", "embedding_model": "'given'"}
    parts = []
    for view, columns in views.items():
        kind = next((k for k in tables if k in view), "silver")
        shown = ", ".join(values.get(c, f"{c}::VARCHAR") for c in columns)
        parts.append(f"SELECT '{view}' AS view, '{','.join(columns)}' AS columns, "
                     f"concat_ws('|', {shown}) AS shown FROM {tables[kind]}"
                     f"{levels.get(view, '')}")
    return f"""WITH {SILVER}, named AS (SELECT *, {CHUNK_ID} AS chunk_id FROM scored), {VECTORS},
  sealed AS (SELECT *, 'owner-' || (vec_id % 7) AS owner, '1.0' AS version,
    sha256(vec_id::VARCHAR) AS document_hash, '2024-06-01T00:00:00Z' AS created_at FROM vecs)
  {' UNION ALL '.join(parts)}"""
