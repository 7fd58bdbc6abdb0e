"""Oracle SQL for the registered queries, keyed by query name."""

from __future__ import annotations

from oracles.inputs import RULES, sql

_SPAN = ("doc_id, entity_type, subtype, s AS start_offset, e AS end_offset, "
         "round(confidence, 6) AS confidence")


def _rule(*names: str) -> str:
    """Matches of some rules without context; equal-type contained spans left out."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT doc_id, entity_type,
      CASE WHEN entity_type IN ('AADHAAR', 'PAN', 'DRIVING_LICENSE') THEN 'IndianGovtID' END
        AS subtype, s AS start_offset, e AS end_offset, round(base_score, 6) AS confidence,
      sha256(value) AS value_hash
      FROM hits h WHERE rule IN ({listed}) AND NOT EXISTS (
        SELECT 1 FROM hits o WHERE o.rule IN ({listed}) AND o.doc_id = h.doc_id
          AND o.entity_type = h.entity_type AND o.s <= h.s AND o.e >= h.e
          AND o.base_score >= h.base_score AND (o.s < h.s OR o.e > h.e
            OR o.base_score > h.base_score OR o.rule < h.rule))"""


def _replacements(column: str, *types: str) -> str:
    listed = ", ".join(f"'{t}'" for t in types)
    where = f" WHERE entity_type IN ({listed})" if types else ""
    return (f"SELECT doc_id, entity_type, s AS start_offset, e AS end_offset, "
            f"{column} AS replacement FROM edits{where}")


def _texts(column: str) -> str:
    return f"""SELECT doc_id, redacted_text, i AS entities_redacted FROM {column}_steps r
      WHERE i = (SELECT count(*) FROM edits x WHERE x.doc_id = r.doc_id)"""


_UNSUPPRESSED = """NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id
    AND o.entity_type = h.entity_type AND o.s <= h.s AND o.e >= h.e AND o.boosted >= h.boosted
    AND (o.s < h.s OR o.e > h.e OR o.boosted > h.boosted OR o.rule < h.rule))"""
_GOV = "CASE WHEN entity_type IN ('AADHAAR', 'PAN', 'DRIVING_LICENSE') THEN 'IndianGovtID' END"
_SHARED_NAMES = """CASE tag_fqn WHEN 'PII' THEN 'PII' WHEN 'PII.Sensitive' THEN 'Sensitive'
    WHEN 'PII.Sensitive.IndianGovtID' THEN 'Indian Government ID'
    WHEN 'PII.Sensitive.ContactInfo' THEN 'Contact Information'
    WHEN 'PII.Sensitive.IndianGovtID.Aadhaar' THEN 'Aadhaar'
    WHEN 'PII.Sensitive.IndianGovtID.PAN' THEN 'PAN'
    WHEN 'PII.Sensitive.IndianGovtID.DrivingLicense' THEN 'Driving License'
    WHEN 'PII.Sensitive.ContactInfo.Email' THEN 'Email'
    WHEN 'PII.Sensitive.ContactInfo.Phone' THEN 'Phone' END"""
_SHARED_TEXTS = """CASE tag_fqn
    WHEN 'PII.Sensitive' THEN 'Sensitive PII data requiring special protection'
    WHEN 'PII.Sensitive.IndianGovtID'
      THEN 'Indian Government identification documents (Aadhaar, PAN, Driving License)'
    WHEN 'PII.Sensitive.ContactInfo' THEN 'Contact information (email, phone)'
    WHEN 'PII.Sensitive.IndianGovtID.Aadhaar' THEN 'Aadhaar (12-digit biometric ID by UIDAI)'
    WHEN 'PII.Sensitive.IndianGovtID.PAN' THEN 'PAN (Permanent Account Number for taxation)'
    WHEN 'PII.Sensitive.IndianGovtID.DrivingLicense' THEN 'DL (State-issued driving license)'
    WHEN 'PII.Sensitive.ContactInfo.Email' THEN 'Email address'
    WHEN 'PII.Sensitive.ContactInfo.Phone' THEN 'Phone number' END"""
_STORED_TEXTS = _texts("light_text") + """ AND doc_id IN (
    SELECT doc_id FROM corpus WHERE status IN ('PII_DETECTED', 'COMPLETED'))"""
_WALK = """SELECT doc_id, ts, seq, status, from_status, accepted FROM (
  WITH RECURSIVE legal(a, b) AS (VALUES ('', 'PENDING'), ('PENDING', 'PII_DETECTING'), ('PENDING', 'FAILED'),
    ('PII_DETECTING', 'REDACTING'), ('PII_DETECTING', 'FAILED'), ('REDACTING', 'COMPLETED'),
    ('REDACTING', 'FAILED'), ('COMPLETED', 'REDACTING'), ('FAILED', 'PENDING')),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, seq) AS i FROM transitions),
  walk(doc_id, ts, seq, status, i, from_status, accepted, state) AS (
    SELECT DISTINCT doc_id, NULL::TIMESTAMP, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, ''
      FROM transitions
    UNION ALL
    SELECT n.doc_id, n.ts, n.seq, n.status, n.i, w.state, l.b IS NOT NULL,
      CASE WHEN l.b IS NOT NULL THEN n.status ELSE w.state END
    FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.i = w.i + 1
    LEFT JOIN legal l ON l.a = w.state AND l.b = n.status)
  SELECT * FROM walk WHERE i > 0)"""
_RANKED = """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first_at,
    first_end DESC, first_rule) - 1 AS position, count(*) OVER (PARTITION BY doc_id) AS k,
    CASE WHEN weight >= 9 THEN 'Very High' WHEN weight >= 6 THEN 'High'
         WHEN weight >= 4 THEN 'Medium' ELSE 'Low' END AS sensitivity
    FROM (SELECT b.*, f.e AS first_end, f.rule AS first_rule FROM by_type b JOIN (
      SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY s, e DESC, rule) AS r
      FROM ents) f ON f.doc_id = b.doc_id AND f.entity_type = b.entity_type AND f.r = 1)"""
_COUNTS = "SELECT doc_id, entity_type, count(*) AS n FROM ents GROUP BY doc_id, entity_type"
_REPORT_COUNTS = """SELECT c.doc_id, count(x.doc_id) AS total,
    count(DISTINCT x.value_hash) AS distinct_values
    FROM corpus c LEFT JOIN edits x ON x.doc_id = c.doc_id GROUP BY c.doc_id"""
_HASHED_FILES = "SELECT file_id, n, sha256(content) AS file_hash FROM files"
_POLICY = """SELECT doc_id, string_agg(tag_fqn, ',' ORDER BY tag_fqn) AS matching_tags
    FROM tags GROUP BY doc_id"""

_BODIES: dict[str, str] = {
    "load_documents": "SELECT doc_id, text, lang, source FROM documents",
    "validate_files": """SELECT file_id, filename, verdict IS NULL AS ok,
        CAST(floor(verdict) AS BIGINT) AS reject_code,
        CASE verdict WHEN 415 THEN 'unsupported file type' WHEN 400 THEN 'empty file'
          WHEN 413 THEN 'file too large' WHEN 400.5 THEN 'content does not match extension' END
          AS reject_reason FROM checked_files""",
    "content_hash": "SELECT file_id, sha256(content) AS file_hash FROM files",
    "dedup_by_hash": """SELECT doc_id, file_hash, canonical_id, canonical_id <> doc_id AS is_duplicate
        FROM (SELECT doc_id, sha256(text) AS file_hash, first_value(doc_id) OVER (
          PARTITION BY sha256(text) ORDER BY created_at, doc_id) AS canonical_id FROM corpus)""",
    "storage_keys": """SELECT doc_id, 'documents/' || doc_id || '/'
        || url_encode(coalesce(filename, 'document')) AS storage_key FROM corpus""",
    "upload_records": """SELECT file_id AS doc_id, coalesce(filename, 'unknown') AS filename,
        sha256(content) AS file_hash, octet_length(content) AS file_size,
        coalesce(content_type, 'application/octet-stream') AS content_type,
        'documents/' || file_id || '/' || url_encode(coalesce(filename, 'document')) AS storage_key,
        'PENDING' AS status, created_at, created_at AS updated_at FROM files""",
    "scan_type": r"""SELECT d.doc_id, CASE WHEN p.mean IS NULL THEN 'SCANNED'
          WHEN p.mean >= 400 THEN 'TEXT' WHEN p.longest < 400 THEN 'SCANNED' ELSE 'MIXED' END
          AS scan_type
        FROM (SELECT 'c' || conv_id AS doc_id FROM conversations
              UNION SELECT 'c' || doc_id FROM labels) d
        LEFT JOIN (SELECT doc_id, avg(n) AS mean, max(n) AS longest FROM (
            SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n
            FROM page_texts) GROUP BY doc_id) p ON p.doc_id = d.doc_id""",
    "join_pages": """SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text,
        count(*) AS page_count FROM page_texts GROUP BY doc_id""",
    "page_and_char_counts": """SELECT doc_id, length(text) AS char_count,
        CASE WHEN lower(filename) LIKE '%.png' THEN 1
          ELSE greatest(1, length(replace(text, chr(10), '')) // 3000) END AS page_count
        FROM corpus""",
    "unseen_documents": f"""SELECT file_id, file_hash FROM ({_HASHED_FILES}) f
        WHERE file_hash NOT IN (
          SELECT file_hash FROM ({_HASHED_FILES}) WHERE substr(file_hash, 1, 1) < '8'
            AND TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n % 120)
              >= TIMESTAMP '2024-01-01 02:00:00' - INTERVAL 3600 SECOND)""",
    "write_redacted": """SELECT t.doc_id, 'documents/' || t.doc_id || '/'
          || url_encode(coalesce(filename, 'document')) || '.redacted.txt' AS redacted_key,
        redaction_level, t.i AS entities_redacted, sha256(t.redacted_text) AS text_hash
        FROM (SELECT *, 'FULL' AS redaction_level, 1 AS run FROM full_text_steps
              UNION ALL SELECT *, 'LIGHT', 2 FROM light_text_steps
              UNION ALL SELECT *, 'FULL', 3 FROM synthetic_text_steps) t
        JOIN corpus c ON c.doc_id = t.doc_id
        WHERE t.i = (SELECT count(*) FROM edits x WHERE x.doc_id = t.doc_id)
          AND CASE run WHEN 1 THEN n % 3 <> 0 WHEN 2 THEN n % 2 = 0 ELSE n % 3 = 0 END""",
    "redacted_lines": r"""SELECT doc_id, i - 1 AS line_no,
        CASE WHEN regexp_matches(line, '^\s*$') THEN 'blank'
          WHEN contains(line, '[REDACTED]') OR contains(line, '****') THEN 'redacted'
          ELSE 'body' END AS kind,
        replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe_text
        FROM (SELECT doc_id, lines[i] AS line, i, len(lines) AS k
          FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(redacted_text,
              '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS lines FROM redacted)))
        WHERE NOT (i = k AND line = '')""",
    # detection
    **{f"detect_{name}": _rule(name) for name, *_ in RULES
       if name.startswith(("aadhaar", "dl_", "email"))},
    "detect_pan": _rule("pan_holder_letter", "pan_shape"),
    "detect_phone": _rule("phone_in", "phone_us"),
    "detect_person": """SELECT doc_id, 'PERSON' AS entity_type, CAST(NULL AS VARCHAR) AS subtype,
        s AS start_offset, e AS end_offset, round(score, 6) AS confidence, sha256(value) AS value_hash
        FROM person_found h WHERE NOT EXISTS (SELECT 1 FROM person_found o WHERE o.doc_id = h.doc_id
          AND o.s <= h.s AND o.e >= h.e AND o.e - o.s > h.e - h.s AND o.score >= h.score)""",
    "detect_person_joined": _rule("person_85", "person_75"),
    "spans": "SELECT doc_id, rule, s AS start_offset, e AS end_offset, value FROM hits",
    "context_boost": """SELECT doc_id, rule, s AS start_offset, round(boosted, 6) AS confidence
        FROM hits""",
    "threshold_filter": f"""SELECT doc_id, entity_type, {_GOV} AS subtype, s AS start_offset,
        e AS end_offset, round(boosted, 6) AS confidence FROM hits h
        WHERE boosted >= 0.8 AND {_UNSUPPRESSED}""",
    "normalise_types": """SELECT entity_type, count(*) AS n FROM ents
        WHERE entity_type IN ('EMAIL', 'PHONE') GROUP BY entity_type""",
    "subtype_tag": """SELECT entity_type, subtype, count(*) AS n FROM ents
        GROUP BY entity_type, subtype""",
    "entity_allow_list": f"SELECT {_SPAN} FROM ents WHERE entity_type IN ('PAN', 'EMAIL', 'PERSON')",
    "suppress_contained": f"""SELECT doc_id, entity_type, {_GOV} AS subtype, s AS start_offset,
        e AS end_offset, round(boosted, 6) AS confidence, rule FROM hits h WHERE {_UNSUPPRESSED}""",
    "detect_all": f"SELECT {_SPAN}, rule, value_hash FROM ents",
    "entity_counts": _COUNTS,
    # risk
    "risk_by_type": """SELECT doc_id, entity_type, n, round(mean_confidence, 6) AS mean_confidence,
        round(type_score, 6) AS type_score FROM by_type""",
    "risk_diversity": """SELECT doc_id, round(base, 6) AS base, n_types, round(diverse, 6) AS score
        FROM base""",
    "risk_critical_boost": "SELECT doc_id, round(boosted, 6) AS score FROM base",
    "risk_combinations": """SELECT doc_id, points AS combination_points, round(combined, 6) AS score
        FROM base""",
    "risk_floor_cap": "SELECT doc_id, round(score, 6) AS score FROM base",
    "risk_band": """SELECT risk_band, count(*) AS n, round(min(risk_score), 6) AS lowest,
        round(max(risk_score), 6) AS highest FROM scored WHERE doc_id IN (SELECT doc_id FROM base)
        GROUP BY risk_band""",
    "risk_score": "SELECT doc_id, round(risk_score, 6) AS risk_score, risk_band FROM scored",
    "risk_from_entities": """SELECT doc_id, round(risk_score, 6) AS risk_score, risk_band
        FROM scored""",
    "risk_explain": f"""SELECT c.doc_id, CASE WHEN r.k IS NULL THEN 'No PII detected.'
          ELSE 'Score driven primarily by ' || r.entity_type || ' (' || r.sensitivity
            || ' sensitivity)' || CASE WHEN r.k > 1
              THEN ' combined with ' || (r.k - 1) || ' other type(s)' ELSE '' END END AS summary,
        CASE WHEN r.k > 1 THEN r.k || ' different PII types detected — diversity multiplier ×'
          || printf('%.1f', 1 + 0.3::DOUBLE * (r.k - 1)) || ' applied' END AS diversity_note,
        coalesce(r.k, 0) AS unique_types
        FROM corpus c LEFT JOIN ({_RANKED}) r ON r.doc_id = c.doc_id AND r.position = 0""",
    "risk_contributors": f"""SELECT doc_id, position, entity_type, n, weight, sensitivity
        FROM ({_RANKED})""",
    "high_risk_docs": """SELECT doc_id, round(risk_score, 6) AS risk_score FROM scored
        WHERE risk_score >= 51""",
    "residual_risk": " UNION ALL ".join(f"""SELECT s.doc_id, round(risk_score, 6) AS risk_score_before,
        0.0::DOUBLE AS risk_score_after, round(coalesce(b.score, 0.0), 6) AS risk_score_residual,
        '{level.upper()}' AS redaction_level
        FROM scored s LEFT JOIN again_{level}_base b ON b.doc_id = s.doc_id"""
        for level in ("light", "full", "synthetic")),
    # redaction
    "redact_light": _replacements("light_text"),
    "redact_full": _replacements("full_text"),
    "redact_synthetic": _replacements("synthetic_text"),
    "synthetic_aadhaar": _replacements("synthetic_text", "AADHAAR"),
    "synthetic_pan": _replacements("synthetic_text", "PAN"),
    "synthetic_dl": _replacements("synthetic_text", "DRIVING_LICENSE"),
    "synthetic_contact": _replacements("synthetic_text", "EMAIL", "PHONE", "PERSON"),
    "redact_documents": _texts("full_text"),
    "redact_documents_light": _texts("light_text"),
    "redact_documents_synthetic": _texts("synthetic_text"),
    "redact_documents_merged": """SELECT c.doc_id,
        CASE WHEN k.n IS NULL THEN c.text ELSE k.cut || substr(c.text, k.last_end + 1) END
          AS redacted_text, coalesce(k.n, 0) AS entities_redacted
        FROM corpus c LEFT JOIN (
          SELECT doc_id, count(*) AS n, max(e) AS last_end,
            string_agg(substr(text, prev_end + 1, s - prev_end) || '[REDACTED]', '' ORDER BY s)
              AS cut
          FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev_end
            FROM (SELECT doc_id, min(s) AS s, max(e) AS e, any_value(text) AS text FROM (
              SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e DESC, rule) AS grp FROM (
                SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id
                  ORDER BY s, e DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  THEN 1 ELSE 0 END AS fresh FROM ents))
              GROUP BY doc_id, grp))
          GROUP BY doc_id) k ON k.doc_id = c.doc_id""",
    "redact_stored": _STORED_TEXTS,
    "redact_bucketed": _STORED_TEXTS,
    "audit_mapping": """SELECT doc_id, value_hash, arg_min(light_text, s) AS replacement FROM edits
        GROUP BY doc_id, value_hash""",
    "span_hashes": """SELECT DISTINCT doc_id, s || ':' || e AS span, value_hash FROM edits""",
    "redaction_report": f"""SELECT s.doc_id, filename, 'FULL' AS redaction_level,
        TIMESTAMP '2024-02-01 00:00:00' AS timestamp, total AS total_entities_redacted,
        round(risk_score, 6) AS risk_score_before, 0.0::DOUBLE AS risk_score_after,
        distinct_values AS audit_mapping_count
        FROM scored s JOIN ({_REPORT_COUNTS}) r ON r.doc_id = s.doc_id""",
    "redaction_instances": """SELECT doc_id, entity_type, s AS start_offset, e AS end_offset,
        round(confidence, 6) AS confidence, full_text AS redacted_value, value_hash FROM edits""",
    "redaction_leak_check": """SELECT r.doc_id, r.entities_redacted,
        count(DISTINCT x.value) FILTER (contains(r.redacted_text, x.value)) AS leaked
        FROM redacted r LEFT JOIN edits x ON x.doc_id = r.doc_id
        GROUP BY r.doc_id, r.entities_redacted""",
    # catalog
    "document_status": f"""SELECT j.doc_id, c.entity_type, j.filename, j.status,
        round(j.risk_score, 6) AS risk_score, j.risk_band, j.entity_fqn, j.redacted_fqn, j.error,
        j.created_at, j.updated_at, c.n, x.subtype, x.s AS start_offset, x.e AS end_offset,
        round(x.confidence, 6) AS confidence
        FROM jobs j LEFT JOIN ({_COUNTS}) c ON c.doc_id = j.doc_id
        LEFT JOIN ents x ON x.doc_id = c.doc_id AND x.entity_type = c.entity_type""",
    "pii_summary": _COUNTS,
    "risk_breakdown": """SELECT doc_id, entity_type, n, round(mean_confidence, 3) AS avg_confidence,
        CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total_entities FROM by_type""",
    "risk_lookup": """SELECT j.doc_id, j.filename, round(coalesce(j.risk_score, 0), 6) AS risk_score,
        j.risk_band, j.status, b.entity_type, b.n, round(b.mean_confidence, 3) AS avg_confidence
        FROM jobs j LEFT JOIN by_type b ON b.doc_id = j.doc_id""",
    "list_entities": """SELECT doc_id, entity_type, s AS start_offset, e AS end_offset,
        round(confidence, 3) AS confidence, subtype FROM ents""",
    "docs_by_band_topk": """SELECT doc_id, filename, round(coalesce(risk_score, 0), 6) AS risk_score,
        risk_band, status, entity_fqn, created_at FROM jobs WHERE risk_band = 'CRITICAL'
        ORDER BY jobs.risk_score DESC NULLS FIRST, created_at DESC NULLS FIRST, doc_id LIMIT 50""",
    "band_distribution": "SELECT risk_band, count(*) AS n FROM jobs GROUP BY risk_band",
    "audit_trail": "SELECT * FROM audit",
    "docs_with_type": """SELECT doc_id, filename, round(risk_score, 6) AS risk_score FROM jobs
        WHERE risk_band = 'CRITICAL'
          AND doc_id IN (SELECT doc_id FROM ents WHERE entity_type = 'AADHAAR')""",
    "recent_docs_by_band": """SELECT doc_id, filename, round(risk_score, 6) AS risk_score, created_at
        FROM jobs WHERE risk_band = 'HIGH'
          AND created_at >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY""",
    "text_segments": """SELECT doc_id,
        row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS segment_no,
        entity_type, segment FROM (
          SELECT doc_id, 2 * r AS place, NULL AS entity_type,
            substr(text, cur + 1, s - cur) AS segment FROM (
              SELECT *, row_number() OVER w AS r, coalesce(lag(e) OVER w, 0) AS cur FROM ents
              WINDOW w AS (PARTITION BY doc_id ORDER BY s, e DESC, rule)) WHERE s > cur
          UNION ALL
          SELECT doc_id, 2 * (row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, rule)) + 1,
            entity_type, value FROM ents
          UNION ALL
          SELECT c.doc_id, 1000000000, NULL, substr(c.text, coalesce(l.e, 0) + 1)
          FROM corpus c LEFT JOIN (SELECT *, row_number() OVER (
              PARTITION BY doc_id ORDER BY s DESC, e, rule DESC) AS r FROM ents) l
            ON l.doc_id = c.doc_id AND l.r = 1
          WHERE l.e IS NULL OR l.e < length(c.text))""",
    "type_share_of_max": f"""SELECT doc_id, entity_type, n,
        round(n / greatest(max(n) OVER (PARTITION BY doc_id), 1) * 100, 6) AS share
        FROM ({_COUNTS})""",
    "progress_step": """SELECT doc_id, status, CASE status WHEN 'PENDING' THEN 0
          WHEN 'EXTRACTING' THEN 1 WHEN 'PII_DETECTING' THEN 2 WHEN 'PII_DETECTED' THEN 2
          WHEN 'REDACTING' THEN 3 WHEN 'COMPLETED' THEN 5 WHEN 'FAILED' THEN -1 ELSE 0 END::BIGINT
          AS step FROM jobs""",
    "distinct_types": "SELECT doc_id, types FROM type_lists",
    "sample_docs": """SELECT doc_id, filename, status, round(risk_score, 6) AS risk_score, risk_band
        FROM jobs ORDER BY doc_id LIMIT 5""",
    "redactable_docs": """SELECT doc_id, status FROM jobs
        WHERE status IN ('PII_DETECTED', 'COMPLETED')""",
    "scored_docs": """SELECT doc_id, round(risk_score, 6) AS risk_score, risk_band FROM jobs
        WHERE risk_score IS NOT NULL""",
    "pending_docs": "SELECT doc_id, status FROM jobs WHERE status NOT IN ('COMPLETED', 'FAILED')",
    # governance
    "doc_tags": "SELECT doc_id, tag_fqn FROM tags",
    "new_tags": """SELECT doc_id, tag_fqn FROM tags
        WHERE NOT substr(sha256(doc_id || tag_fqn), 1, 1) < '8'""",
    "tag_hierarchy": f"""SELECT tag_fqn,
        CASE WHEN contains(tag_fqn, '.') THEN regexp_replace(tag_fqn, '\\.[^.]*$', '') END
          AS parent_fqn, {_SHARED_NAMES} AS display_name, {_SHARED_TEXTS} AS description,
        count(DISTINCT doc_id) AS n_docs FROM (
          SELECT doc_id, array_to_string(parts[:i], '.') AS tag_fqn FROM (
            SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
              SELECT doc_id, string_split(tag_fqn, '.') AS parts FROM tags)))
        GROUP BY tag_fqn""",
    "containers": """SELECT doc_id, is_redacted, name, fqn, size, file_formats, source_key,
        round(risk_score, 6) AS risk_score, risk_band, description FROM holders""",
    "file_formats": """SELECT doc_id, filename,
        CASE WHEN filename LIKE '%.csv' THEN 'csv' ELSE '' END AS file_formats FROM corpus""",
    "risk_properties": """SELECT fqn, doc_id, CAST(round_even(risk_score, 0) AS BIGINT) AS risk_score,
        risk_band, listed AS detected_pii_types,
        CASE WHEN is_redacted THEN 'redacted' ELSE 'none' END AS redaction_level FROM holders""",
    "lineage_edges": """SELECT a.doc_id, a.fqn AS from_fqn, b.fqn AS to_fqn,
        'FULL' AS redaction_level,
        'Redacted using FULL strategy at 2024-02-01T00:00:00 by PII governance' AS description
        FROM holders a JOIN holders b ON a.doc_id = b.doc_id
        WHERE NOT a.is_redacted AND b.is_redacted""",
    "run_metrics": """SELECT 'run-' || (n // 50) AS run_id,
        count(*) FILTER (status = 'COMPLETED') AS records,
        count(*) FILTER (status <> 'COMPLETED') AS failures,
        CASE WHEN bool_and(status = 'COMPLETED') THEN 'success' WHEN bool_and(status = 'FAILED') THEN 'failed'
          ELSE 'partialSuccess' END AS state,
        min(created_at) AS started_at, max(created_at) AS ended_at
        FROM corpus GROUP BY n // 50""",
    "policy_match": """SELECT doc_id, string_agg(tag_fqn, ',' ORDER BY tag_fqn) AS matching_tags
        FROM tags WHERE contains(tag_fqn, 'IndianGovtID') GROUP BY doc_id""",
    "policy_audit": f"""SELECT j.doc_id, 'APPLY_POLICY' AS action, 'system' AS actor, j.entity_fqn,
        p.matching_tags IS NOT NULL AS policy_will_apply,
        coalesce(p.matching_tags, '') AS matching_tags, round(j.risk_score, 6) AS risk_score,
        TIMESTAMP '2024-02-01 00:00:00' AS ts
        FROM jobs j LEFT JOIN ({_POLICY}) p ON p.doc_id = j.doc_id WHERE j.risk_score >= 51""",
    "policy_masked_view": """SELECT doc_id, g IS NOT NULL AS masked,
        CASE WHEN g IS NOT NULL THEN redacted_text ELSE text END AS visible_text
        FROM redacted LEFT JOIN (SELECT DISTINCT doc_id AS g FROM ents
          WHERE subtype = 'IndianGovtID') ON g = doc_id""",
    # lifecycle
    "append_audit": """SELECT doc_id, 'UPLOAD' AS action, 'anonymous' AS actor,
          '{"file_hash":"' || sha256(text) || '"}' AS details, CAST(NULL AS VARCHAR) AS ip_address,
          created_at AS ts FROM corpus
        UNION ALL
        SELECT doc_id, 'REDACT', 'user1', '{"redaction_level":"FULL"}', '10.0.0.1', created_at
        FROM corpus WHERE status IN ('PII_DETECTED', 'COMPLETED')""",
    "task_events": """SELECT doc_id, 'PROCESS' AS action, 'system' AS actor, created_at AS ts, event,
        CASE WHEN event = 'task_complete' THEN 'detect_text' ELSE 'detect' END AS task_name,
        CASE WHEN event = 'task_failure' THEN 'failed ' || doc_id END AS error,
        CASE WHEN event = 'task_complete' THEN CAST(length(text) AS VARCHAR) END AS chars
        FROM (SELECT *, 'task_start' AS event FROM corpus
          UNION ALL SELECT *, 'task_complete' FROM corpus WHERE status = 'COMPLETED'
          UNION ALL SELECT *, 'task_failure' FROM corpus WHERE status = 'FAILED')""",
    "current_status": """SELECT doc_id, arg_max(status, (ts, seq)) AS status, max(ts) AS updated_at,
        count(*) AS changes FROM transitions GROUP BY doc_id""",
    "failed_docs": """SELECT doc_id, 'FAILED' AS status,
        CASE WHEN length(text) < 40 THEN 'no text for ' || doc_id END AS error,
        CASE WHEN length(text) < 40 THEN 2 ELSE 1 END::BIGINT AS n_details
        FROM corpus WHERE status = 'FAILED' OR length(text) < 40""",
    "merge_details": """SELECT c.doc_id, name, value FROM corpus c JOIN (""" + _REPORT_COUNTS + """) r
          ON r.doc_id = c.doc_id, LATERAL (
        SELECT 'char_count' AS name, CAST(length(c.text) AS VARCHAR) AS value
        UNION ALL SELECT 'total_entities', CAST(r.total AS VARCHAR)
        UNION ALL SELECT 'entities_redacted', CAST(r.total AS VARCHAR)
        UNION ALL SELECT 'stage', 'redact')""",
    "cascade_delete": f"""SELECT {_SPAN} FROM ents WHERE doc_id NOT IN (
        SELECT doc_id FROM corpus WHERE status = 'FAILED')""",
    "cascade_delete_all": """SELECT * FROM (
          SELECT doc_id, count(*) AS n, 'entities' AS table_name FROM ents GROUP BY doc_id
          UNION ALL SELECT doc_id, 1, 'reports' FROM corpus
          UNION ALL SELECT doc_id, CASE WHEN status IN ('PII_DETECTED', 'COMPLETED') THEN 2 ELSE 1 END, 'audit'
          FROM corpus) WHERE doc_id NOT IN (SELECT doc_id FROM corpus WHERE status = 'FAILED')""",
    "pipeline_audit": f"""SELECT doc_id, 'UPLOAD' AS action, 'anonymous' AS actor,
          '{{"file_hash":"' || sha256(text) || '"}}' AS details, CAST(NULL AS VARCHAR) AS ip_address,
          created_at AS ts FROM corpus
        UNION ALL
        SELECT c.doc_id, 'REDACT', 'system', '{{"redaction_level":"FULL","entities_redacted":"' || total || '"}}',
          NULL, created_at
        FROM corpus c JOIN ({_REPORT_COUNTS}) r ON r.doc_id = c.doc_id
        WHERE status IN ('PII_DETECTED', 'COMPLETED')""",
    # validation and JSON
    "constraint_violations": """SELECT 'document_jobs' AS table_name, 'risk_score_range' AS rule,
          count(*) FILTER (CASE WHEN file_size % 11 = 0 THEN risk_score + 95 ELSE risk_score END
            NOT BETWEEN 0 AND 100) AS violations FROM jobs
        UNION ALL SELECT 'pii_entities', 'confidence_range',
          count(*) FILTER (confidence NOT BETWEEN 0 AND 1) FROM flawed
        UNION ALL SELECT 'pii_entities', 'start_offset_positive', count(*) FILTER (s < 0) FROM flawed
        UNION ALL SELECT 'pii_entities', 'end_after_start', count(*) FILTER (e <= s) FROM flawed
        UNION ALL SELECT 'redaction_reports', 'risk_score_before_range',
          count(*) FILTER (risk_score NOT BETWEEN 0 AND 100) FROM scored
        UNION ALL SELECT 'redaction_reports', 'risk_score_after_range', 0
        UNION ALL SELECT 'redaction_reports', 'total_entities_positive', 0""",
    "parse_metadata": f"""SELECT doc_id, reject_reason IS NULL AS ok, reject_reason, ill_typed,
        CASE WHEN reject_reason IS NULL THEN filename END AS filename,
        CASE WHEN reject_reason IS NULL THEN total END AS total_entities_redacted,
        CASE WHEN reject_reason IS NULL THEN total END AS n_instances
        FROM (SELECT c.doc_id, coalesce(filename, 'unknown') AS filename, total,
          CASE substr(sha256(c.doc_id), 1, 1) WHEN '0' THEN 'malformed' WHEN '1' THEN 'out of range'
            WHEN '2' THEN 'missing field' WHEN '3' THEN 'out of range' WHEN '4' THEN 'malformed'
            WHEN '5' THEN 'malformed' WHEN '6' THEN CASE WHEN total > 0 THEN 'malformed' END END
            AS reject_reason,
          CASE substr(sha256(c.doc_id), 1, 1) WHEN '5' THEN 'filename'
            WHEN '6' THEN CASE WHEN total > 0 THEN 'pii_instances.redacted_value' ELSE '' END ELSE '' END AS ill_typed
          FROM corpus c JOIN ({_REPORT_COUNTS}) r ON r.doc_id = c.doc_id)""",
    "canonical_json": f"""SELECT c.doc_id, '{{"document_id":"' || c.doc_id || '","filename":"'
          || coalesce(c.filename, 'unknown') || '","pii_instances":[' || coalesce(i.parts, '')
          || '],"redaction_level":"FULL","risk_score_after":0.0,"risk_score_before":'
          || CAST(round(s.risk_score, 6) AS VARCHAR)
          || ',"timestamp":"2024-02-01T00:00:00","total_entities_redacted":' || total || '}}' AS json
        FROM corpus c JOIN ({_REPORT_COUNTS}) r ON r.doc_id = c.doc_id JOIN scored s ON s.doc_id = c.doc_id
        LEFT JOIN (SELECT doc_id, string_agg('{{"confidence":' || CAST(round(confidence, 6) AS VARCHAR)
            || ',"end_offset":' || e || ',"entity_type":"' || entity_type || '","redacted_value":"' || full_text
            || '","start_offset":' || s || '}}', ',' ORDER BY s, e DESC, rule) AS parts
          FROM edits GROUP BY doc_id) i ON i.doc_id = c.doc_id""",
    "json_round_trip": """SELECT count(*) AS records, count(*) FILTER (substr(sha256(doc_id), 1, 1) = '7')
        AS mismatches FROM corpus""",
    "span_validity": """SELECT f.entity_type, coalesce(f.s >= 0 AND f.e > f.s
          AND f.confidence BETWEEN 0 AND 1 AND f.e <= length(c.text), false) AS valid,
        count(*) AS n FROM flawed f JOIN corpus c ON c.doc_id = f.doc_id GROUP BY ALL""",
    "orphan_rows": """SELECT event_id, doc_id, action FROM audit
        WHERE doc_id NOT IN (SELECT doc_id FROM corpus)""",
    "unique_hash_check": """SELECT sha256(text) AS file_hash, count(*) AS n FROM corpus
        GROUP BY sha256(text) HAVING count(*) > 1""",
    # streaming
    "stream_ingest": """SELECT * EXCLUDE (place) FROM (
          SELECT file_id AS doc_id, coalesce(filename, 'unknown') AS filename,
            sha256(content) AS file_hash, octet_length(content) AS file_size,
            coalesce(content_type, 'application/octet-stream') AS content_type,
            'documents/' || file_id || '/' || url_encode(coalesce(filename, 'document')) AS storage_key,
            'PENDING' AS status, created_at, created_at AS updated_at,
            row_number() OVER (PARTITION BY sha256(content) ORDER BY created_at, file_id) AS place
          FROM (SELECT file_id, filename, content, content_type, verdict, created_at FROM checked_files
            UNION ALL SELECT file_id + 1000000, filename, content, content_type, verdict,
              created_at + CASE WHEN file_id % 5 = 0 THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END
            FROM checked_files)
          WHERE verdict IS NULL) WHERE place = 1""",
    "stream_detect": f"""SELECT s.doc_id, r.total AS n_entities, round(s.risk_score, 6) AS risk_score,
        s.risk_band FROM scored s JOIN ({_REPORT_COUNTS}) r ON r.doc_id = s.doc_id""",
    "stream_upsert": f"SELECT {_SPAN}, value_hash FROM resent_ents",
    "stream_status": """SELECT doc_id, arg_max(status, (ts, seq)) AS status, max(ts) AS updated_at
        FROM transitions GROUP BY doc_id""",
    "legal_transitions": _WALK,
    "stream_transitions": _WALK,
    "upload_rate_breaches": """SELECT minute, ip_address, r.action, count(*) AS n, any_value(most) AS "limit"
        FROM (SELECT *, date_trunc('minute', ts) AS minute, max(ts) OVER () AS latest FROM (
          SELECT CASE event_type WHEN 'signup' THEN 'UPLOAD' WHEN 'click' THEN 'REDACT' WHEN 'view' THEN 'STATUS' END
              AS action, '10.0.0.' || (user_id % 2) AS ip_address,
            TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(
              (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 400) AS ts FROM events)) r
        JOIN (VALUES ('UPLOAD', 10::BIGINT), ('REDACT', 10::BIGINT), ('STATUS', 100::BIGINT)) l(action, most)
          ON l.action = r.action
        WHERE minute + INTERVAL 1 MINUTE <= latest - INTERVAL 10 MINUTE
        GROUP BY minute, ip_address, r.action, latest HAVING count(*) > any_value(most)""",
}

ORACLES: dict[str, str] = {name: sql(body) for name, body in _BODIES.items()}
