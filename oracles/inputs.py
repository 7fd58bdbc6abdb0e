"""Common table expressions for the oracle SQL, and the function that joins them."""

from __future__ import annotations

import re

from piiloom.sources.derived import ACTIONS, CONTENT_TYPE, FILENAME, KYC_TEXT, TRANSITIONS


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


# RE2 spelling of a Unicode word character.
_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_WD = r"[\p{L}\p{M}\p{Nd}\p{Pc}.+-]"

# --- Fixed values: patterns, scores, context words, state codes, stand-in names ---------------
_FIRST = ["Asha", "Ravi", "Meera", "Arjun", "Leela", "Kiran", "Nila", "Dev"]
_LAST = ["Rao", "Sen", "Nair", "Das", "Iyer", "Gill", "Bose", "Shah"]
RULES = (
    ("aadhaar_spaced", "AADHAAR", r"\b[2-9][0-9]{3}\s[0-9]{4}\s[0-9]{4}\b", 0.85),
    ("aadhaar_hyphen", "AADHAAR", r"\b[2-9][0-9]{3}-[0-9]{4}-[0-9]{4}\b", 0.85),
    ("aadhaar_plain", "AADHAAR", r"\b[2-9][0-9]{11}\b", 0.60),
    ("pan_holder_letter", "PAN", r"\b[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\b", 0.85),
    ("pan_shape", "PAN", r"\b[A-Z]{3}[DEIKMNOQRSUVWXYZ][A-Z][0-9]{4}[A-Z]\b", 0.60),
    ("dl_spaced_initials", "DRIVING_LICENSE",
     r"\b[A-Z]{2}[0-9]{2}\s[A-Z]{1,2}\s[0-9]{4}\s[0-9]{7}\b", 0.80),
    ("dl_spaced", "DRIVING_LICENSE", r"\b[A-Z]{2}[0-9]{2}\s[0-9]{4}\s[0-9]{7}\b", 0.75),
    ("dl_hyphen4_initials", "DRIVING_LICENSE",
     r"\b[A-Z]{2}-[0-9]{2}-[A-Z]{1,2}-[0-9]{4}-[0-9]{7}\b", 0.80),
    ("dl_hyphen4", "DRIVING_LICENSE", r"\b[A-Z]{2}-[0-9]{2}-[0-9]{4}-[0-9]{7}\b", 0.75),
    ("dl_hyphen3", "DRIVING_LICENSE", r"\b[A-Z]{2}-[0-9]{2}[A-Z]{0,2}-[0-9]{11}\b", 0.70),
    ("dl_plain", "DRIVING_LICENSE", r"\b[A-Z]{2}[0-9]{2}[A-Z]{0,2}[0-9]{4}[0-9]{7}\b", 0.65),
    ("email", "EMAIL", rf"{_W}{_WD}*@{_W}+(?:-{_W}+)*(?:\.{_W}+(?:-{_W}+)*)+", 1.0),
    ("phone_in", "PHONE", r"(?:\+91[\s-]?|\b)[6-9][0-9]{4}[\s-]?[0-9]{5}\b", 0.40),
    ("phone_us", "PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.75),
    ("person_85", "PERSON", rf"\b(?:{'|'.join(_FIRST)})[ \t]+(?:{'|'.join(_LAST)})\b", 0.85),
    ("person_75", "PERSON", rf"\b(?:{'|'.join(_FIRST)})\b", 0.75),
)
_CONTEXT = {
    "AADHAAR": ["aadhaar", "aadhar", "uid", "uidai", "unique identification",
                "government of india", "भारत सरकार"],
    "PAN": ["permanent account number", "pan"],
    "DRIVING_LICENSE": ["dl", "driving licence", "driving license", "license no", "licence no",
                        "dl no", "driver", "transport"],
    "EMAIL": [],
    "PERSON": [],
    "PHONE": ["phone", "number", "telephone", "cell", "cellphone", "mobile", "call"],
}
STATES = ["AP", "AR", "AS", "BR", "CG", "GA", "GJ", "HR", "HP", "JK", "JH", "KA", "KL", "MP",
          "MH", "MN", "ML", "MZ", "NL", "OD", "PB", "RJ", "SK", "TN", "TS", "TR", "UP", "UK",
          "WB", "AN", "CH", "DN", "DD", "DL", "LD", "PY"]


def _rule_hits(rule: str, entity_type: str, pattern: str, score: float) -> str:
    words = ", ".join(f"' {w} '" for w in _CONTEXT[entity_type])
    near = (f"len(list_filter([{words}], lambda w: contains(words, w))) > 0" if words else "false")
    raised = min(1.0, max(score + 0.35, 0.40))
    return f"""
  SELECT doc_id, text, '{rule}' AS rule, '{entity_type}' AS entity_type, s, e,
         substr(text, s + 1, e - s) AS value, CAST({score} AS DOUBLE) AS base_score,
         CAST(CASE WHEN {near} THEN {raised!r} ELSE {score} END AS DOUBLE) AS boosted
  FROM (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(substr(text, 1, s)),
               '[\\p{{L}}\\p{{M}}\\p{{N}}]+')[-5:], ' ') || ' ' AS words
        FROM (SELECT doc_id, text,
                CAST(list_sum(list_transform(gaps[:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(hits[:i-1], lambda x: length(x))), 0)
                   AS BIGINT) AS s,
                s + length(hits[i]) AS e
              FROM (SELECT doc_id, text, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
                    FROM (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS gaps,
                                 regexp_extract_all(text, '{pattern}') AS hits
                          FROM corpus WHERE regexp_matches(text, '{pattern}')))))"""


def _splice(level: str) -> str:
    """Edits applied one after the other, from the last start to the first."""
    return f"""
  SELECT c.doc_id, c.text AS redacted_text, CAST(0 AS BIGINT) AS i FROM corpus c
  UNION ALL
  SELECT t.doc_id, substr(t.redacted_text, 1, x.s) || x.{level} || substr(t.redacted_text, x.e + 1),
         t.i + 1
  FROM {level}_steps t JOIN edits x ON x.doc_id = t.doc_id AND x.step = t.i + 1"""


def _number(at: int, width: int = 6) -> str:
    return f"('0x' || substr(d, {at}, {width}))::BIGINT"


def _digits(at: int, count: int) -> str:
    return f"lpad(CAST({_number(at, 12)} % {10 ** count} AS VARCHAR), {count}, '0')"


def _letter(at: int) -> str:
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({_number(at, 4)} % 26 + 1 AS INT), 1)"


def _pick(options: list[str], at: int) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[CAST({_number(at)} % {len(options)} + 1 AS INT)]"


_AADHAAR = f"(CAST({_number(1)} % 8 + 2 AS VARCHAR) || {_digits(7, 11)})"
_GAP = f"CASE WHEN {_number(37, 1)} % 2 = 0 THEN ' ' ELSE '' END"
_SYNTHETIC = f"""CASE entity_type
    WHEN 'AADHAAR' THEN CASE
      WHEN contains(value, '-') THEN regexp_replace({_AADHAAR}, '(....)(....)(....)', '\\1-\\2-\\3')
      WHEN contains(value, ' ') THEN regexp_replace({_AADHAAR}, '(....)(....)(....)', '\\1 \\2 \\3')
      ELSE {_AADHAAR} END
    WHEN 'PAN' THEN {' || '.join(_letter(1 + 4 * i) for i in range(5))} || {_digits(21, 4)}
      || {_letter(33)}
    WHEN 'DRIVING_LICENSE' THEN {_pick(STATES, 1)}
      || lpad(CAST({_number(7)} % 99 + 1 AS VARCHAR), 2, '0') || {_GAP}
      || CAST({_number(13)} % 27 + 2000 AS VARCHAR) || {_GAP} || {_digits(19, 7)}
    WHEN 'EMAIL' THEN lower({_pick(_FIRST, 1)}) || '.' || lower({_pick(_LAST, 7)})
      || {_digits(13, 4)} || '@example.com'
    WHEN 'PHONE' THEN '+91 ' || CAST({_number(1)} % 4 + 6 AS VARCHAR) || {_digits(7, 4)} || ' '
      || {_digits(19, 5)}
    WHEN 'PERSON' THEN {_pick(_FIRST, 1)} || ' ' || {_pick(_LAST, 7)}
    ELSE '[REDACTED]' END"""

CTES: dict[str, str] = {
    "kyc": f"""SELECT 'k' || k AS doc_id, k AS n, {KYC_TEXT} AS text
               FROM (SELECT c_custkey AS k FROM customer)""",
    "corpus": f"""SELECT doc_id, n, text, {FILENAME} AS filename, {CONTENT_TYPE} AS content_type,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n) AS created_at,
        ['PENDING', 'EXTRACTING', 'PII_DETECTING', 'PII_DETECTED', 'REDACTING', 'COMPLETED',
         'FAILED'][n % 7 + 1] AS status
        FROM (SELECT * FROM kyc UNION ALL SELECT 'd' || doc_id, doc_id, text FROM documents)""",
    "files": """SELECT page_id AS file_id, page_id AS n,
        CASE page_id % 8 WHEN 0 THEN 'page' || page_id || '.pdf'
          WHEN 1 THEN 'page' || page_id || '.png' WHEN 2 THEN 'page' || page_id || '.JPG'
          WHEN 3 THEN 'page.' || page_id || '.docx' WHEN 4 THEN 'page' || page_id || '.exe'
          WHEN 5 THEN NULL WHEN 6 THEN 'empty' || page_id || '.pdf'
          ELSE 'page' || page_id || '.jpeg' END AS filename,
        CASE page_id % 8 WHEN 0 THEN '\\x25\\x50\\x44\\x46'::BLOB
          WHEN 1 THEN '\\x89\\x50\\x4E\\x47\\x0D\\x0A\\x1A\\x0A'::BLOB
          WHEN 2 THEN '\\xFF\\xD8\\xFF'::BLOB WHEN 3 THEN '\\x50\\x4B\\x03\\x04'::BLOB
          ELSE ''::BLOB END || CASE WHEN page_id % 8 = 6 THEN ''::BLOB
          WHEN page_id % 16 < 4 THEN encode(substr(url, length(url), 1)) ELSE encode(html) END
          AS content,
        CASE WHEN page_id % 3 = 0 THEN 'text/html' END AS content_type,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS created_at FROM pages""",
    "checked_files": """SELECT *, CASE
          WHEN ext IS NULL OR ext NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'docx') THEN 415
          WHEN octet_length(content) = 0 THEN 400
          WHEN octet_length(content) > CASE ext WHEN 'pdf' THEN 1500 WHEN 'png' THEN 800
             WHEN 'jpg' THEN 2000 WHEN 'jpeg' THEN 1200 ELSE 1800 END THEN 413
          WHEN NOT starts_with(hex(content), CASE ext WHEN 'pdf' THEN '25504446'
             WHEN 'png' THEN '89504E470D0A1A0A' WHEN 'docx' THEN '504B0304'
             ELSE 'FFD8FF' END) THEN 400.5 END AS verdict
        FROM (SELECT *, CASE WHEN contains(filename, '.')
                THEN lower(regexp_extract(filename, '\\.([^.]*)$', 1)) END AS ext FROM files)""",
    "page_texts": """SELECT 'c' || conv_id AS doc_id, turn AS page_no,
        CASE WHEN turn % 3 = 1 THEN concat('  ', text, chr(10))
             ELSE text END AS text FROM conversations""",
    "audit": f"""SELECT event_id, 'd' || (user_id * 10) AS doc_id,
        {_case(ACTIONS, 'event_type')} AS action, 'user' || (user_id % 7) AS actor,
        props AS details, '10.0.0.' || (user_id % 50) AS ip_address, ts FROM events""",
    "transitions": f"""SELECT doc_id, {_case(TRANSITIONS, 'action')} AS status, ts,
        event_id AS seq FROM audit""",
    "hits": "\n  UNION ALL".join(_rule_hits(*rule) for rule in RULES),
    "ents": """SELECT doc_id, text, rule, entity_type,
        CASE WHEN entity_type IN ('AADHAAR', 'PAN', 'DRIVING_LICENSE') THEN 'IndianGovtID' END
          AS subtype, s, e, value, boosted AS confidence, sha256(value) AS value_hash
        FROM hits h WHERE boosted >= 0.7 AND NOT EXISTS (
          SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.entity_type = h.entity_type
            AND o.s <= h.s AND o.e >= h.e AND o.boosted >= h.boosted
            AND (o.s < h.s OR o.e > h.e OR o.boosted > h.boosted OR o.rule < h.rule))""",
    "by_type": """SELECT doc_id, entity_type, count(*) AS n, avg(confidence) AS mean_confidence,
        CASE entity_type WHEN 'AADHAAR' THEN 25.0 WHEN 'PAN' THEN 20.0
          WHEN 'DRIVING_LICENSE' THEN 20.0 WHEN 'EMAIL' THEN 5.0 WHEN 'PHONE' THEN 5.0
          WHEN 'PERSON' THEN 3.0 ELSE 1.0 END::DOUBLE AS weight,
        weight * avg(confidence) * log2(1 + count(*)) AS type_score,
        min(s) AS first_at FROM ents GROUP BY doc_id, entity_type""",
    "base": """SELECT doc_id, sum(type_score) AS base, count(*) AS n_types,
        bool_or(entity_type = 'AADHAAR') AS a, bool_or(entity_type = 'PAN') AS p,
        bool_or(entity_type = 'DRIVING_LICENSE') AS l, bool_or(entity_type = 'PHONE') AS t,
        base * (1 + 0.3::DOUBLE * (count(*) - 1)) AS diverse,
        diverse * CASE WHEN a THEN 1.5 ELSE 1.0 END::DOUBLE AS boosted,
        (CASE WHEN a AND p THEN 12 ELSE 0 END + CASE WHEN a AND p AND l THEN 20 ELSE 0 END
          + CASE WHEN a AND t THEN 5 ELSE 0 END + CASE WHEN p AND l THEN 8 ELSE 0 END)::DOUBLE
          AS points,
        boosted + points AS combined,
        least(greatest(combined, CASE WHEN a THEN 30 WHEN p OR l THEN 15 ELSE 0 END), 100)::DOUBLE
          AS score
        FROM by_type GROUP BY doc_id""",
    "scored": """SELECT c.*, coalesce(b.score, 0.0)::DOUBLE AS risk_score,
        CASE WHEN risk_score < 5 THEN 'LOW' WHEN risk_score < 15 THEN 'MEDIUM'
             WHEN risk_score < 30 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band
        FROM corpus c LEFT JOIN base b USING (doc_id)""",
    "type_lists": """SELECT doc_id, string_agg(entity_type, ',' ORDER BY entity_type) AS types
        FROM by_type GROUP BY doc_id""",
    "jobs": """SELECT s.doc_id, coalesce(filename, 'unknown') AS filename, sha256(text) AS file_hash,
        octet_length(encode(text)) AS file_size,
        'documents/' || s.doc_id || '/' || url_encode(coalesce(filename, 'document')) AS storage_key,
        status, status IN ('PII_DETECTED', 'REDACTING', 'COMPLETED') AS is_scored,
        CASE WHEN is_scored THEN s.risk_score END AS risk_score,
        CASE WHEN is_scored THEN s.risk_band END AS risk_band,
        CASE WHEN is_scored THEN 'document-store.' || coalesce(filename, 'unknown') END
          AS entity_fqn,
        CASE WHEN status = 'COMPLETED' THEN 'documents/' || s.doc_id || '/'
          || url_encode(coalesce(filename, 'document')) || '.redacted.txt' END AS redacted_key,
        CASE WHEN status = 'COMPLETED'
          THEN 'document-store.' || coalesce(filename, 'unknown') || '.redacted' END
          AS redacted_fqn,
        CASE WHEN status = 'FAILED' THEN 'extraction failed: ' || length(text) || ' characters' END
          AS error,
        CASE WHEN is_scored THEN coalesce(types, '') END AS types,
        created_at, created_at AS updated_at, text
        FROM scored s LEFT JOIN type_lists t ON t.doc_id = s.doc_id""",
    "edits": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e DESC, rule)
          AS step FROM (
        SELECT *, '[REDACTED]' AS full_text,
          CASE WHEN length(value) < 5 THEN '[REDACTED]' ELSE substr(value, 1, 2)
            || repeat('*', length(value) - 4) || right(value, 2) END AS light_text,
          {_SYNTHETIC} AS synthetic_text
        FROM (SELECT *, sha256('piiloom|' || value) AS d FROM ents))""",
    "full_text_steps": _splice("full_text"),
    "light_text_steps": _splice("light_text"),
    "synthetic_text_steps": _splice("synthetic_text"),
    "redacted": """SELECT r.doc_id, r.redacted_text, r.i AS entities_redacted, c.text
        FROM full_text_steps r JOIN corpus c ON c.doc_id = r.doc_id
        WHERE r.i = (SELECT count(*) FROM edits x WHERE x.doc_id = r.doc_id)""",
    "tags": """SELECT DISTINCT doc_id, CASE entity_type
          WHEN 'AADHAAR' THEN 'PII.Sensitive.IndianGovtID.Aadhaar'
          WHEN 'PAN' THEN 'PII.Sensitive.IndianGovtID.PAN'
          WHEN 'DRIVING_LICENSE' THEN 'PII.Sensitive.IndianGovtID.DrivingLicense'
          WHEN 'EMAIL' THEN 'PII.Sensitive.ContactInfo.Email'
          WHEN 'PHONE' THEN 'PII.Sensitive.ContactInfo.Phone'
          WHEN 'PERSON' THEN 'PII.Sensitive' END AS tag_fqn FROM ents
        WHERE doc_id IN (SELECT doc_id FROM corpus WHERE status IN ('PII_DETECTED', 'REDACTING', 'COMPLETED'))""",
    "holders": """SELECT doc_id, is_redacted, name, 'document-store.' || name AS fqn,
        size, CASE WHEN lower(ext) IN ('csv', 'tsv', 'json', 'parquet', 'avro', 'zip', 'gz')
          THEN lower(ext) ELSE '' END AS file_formats,
        source_key, risk_score, risk_band,
        CASE WHEN coalesce(types, '') = '' THEN 'none' ELSE replace(types, ',', ', ') END AS listed,
        CASE WHEN is_redacted THEN '[REDACTED VERSION] ' ELSE '' END || 'Risk: ' || risk_band
          || ' (' || printf('%.1f', risk_score) || '/100) | PII detected: ' || listed
          || ' | Managed by PII governance | Job: ' || doc_id AS description
        FROM (
          SELECT doc_id, false AS is_redacted, filename AS name, nullif(file_size, 0) AS size,
            regexp_extract(filename, '\\.([^.]*)$', 1) AS ext, storage_key AS source_key,
            coalesce(risk_score, 0.0)::DOUBLE AS risk_score, coalesce(risk_band, 'LOW') AS risk_band,
            types FROM jobs
          UNION ALL
          SELECT doc_id, true, filename || '.redacted', NULL,
            regexp_extract(filename, '\\.([^.]*)$', 1), redacted_key, 0.0, 'LOW', types
          FROM jobs WHERE redacted_key IS NOT NULL)""",
    "person_names": f"""SELECT lower(name) AS name, max(score)::DOUBLE AS score FROM (
        SELECT unnest({[f"{a} {b}" for a in _FIRST for b in _LAST]}) AS name, 0.85 AS score
        UNION ALL SELECT unnest({_FIRST}), 0.75
        UNION ALL SELECT word, 0.85 FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word
          FROM benchmark) WHERE regexp_matches(word, '^\\p{{Lu}}')) GROUP BY 1""",
    "person_words": r"""SELECT doc_id, hit, e - length(hit) AS s, e, lead(hit) OVER w AS next_hit,
        lead(gap) OVER w AS next_gap, lead(e) OVER w AS next_e FROM (
          SELECT doc_id, i, hit, gap, CAST(sum(length(gap) + length(hit)) OVER (
              PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e
          FROM (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i
                FROM (SELECT doc_id, string_split_regex(text, '[\p{L}\p{M}\p{N}]+') AS gaps,
                        regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS hits FROM corpus)))
        WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
    "person_found": r"""SELECT doc_id, s, e, hit AS value, score FROM person_words JOIN person_names ON name = lower(hit)
        UNION ALL SELECT doc_id, s, next_e, hit || next_gap || next_hit, score FROM person_words
          JOIN person_names ON name = lower(hit) || ' ' || lower(next_hit)
          WHERE regexp_full_match(next_gap, '[ \t]+')""",
    "flawed": """SELECT doc_id, entity_type, picked,
        CASE WHEN picked = 1 THEN -s - 1 ELSE s END AS s,
        CASE picked WHEN 2 THEN s WHEN 3 THEN e + 100000 ELSE e END AS e,
        CASE picked WHEN 4 THEN confidence + 1 WHEN 5 THEN NULL ELSE confidence END AS confidence
        FROM (SELECT *, ('0x' || right(value_hash, 1))::BIGINT AS picked FROM ents)""",
}


def _family(prefix: str, corpus: str) -> set[str]:
    """The same detection and scoring over other texts: ``<prefix>_hits`` and so on.  Returns names to store."""
    CTES[f"{prefix}_corpus"] = corpus
    for name in ("hits", "ents", "by_type", "base"):
        CTES[f"{prefix}_{name}"] = re.sub(r"FROM (corpus|hits|ents|by_type)\b",
                                          lambda m: f"FROM {prefix}_{m.group(1)}", CTES[name])
    return {f"{prefix}_corpus", f"{prefix}_hits"}


_STORED = {"corpus", "hits", "ents", "edits", "by_type"}
for _level in ("full", "light", "synthetic"):
    _STORED |= _family(f"again_{_level}", f"""SELECT r.doc_id, r.redacted_text AS text FROM {_level}_text_steps r
        WHERE r.i = (SELECT count(*) FROM edits x WHERE x.doc_id = r.doc_id)""")

_STORED |= _family("resent", f"""SELECT * REPLACE (CASE WHEN doc_id LIKE 'k%' AND n % 3 = 0 THEN next_text ELSE text END
          AS text) FROM (SELECT c.*, x.next_text FROM corpus c LEFT JOIN (
            SELECT k - 1 AS k, {KYC_TEXT} AS next_text FROM (SELECT c_custkey + 1 AS k FROM customer)) x
          ON c.doc_id = 'k' || x.k)""")

_RECURSIVE = {"full_text_steps", "light_text_steps", "synthetic_text_steps"}


def _needs(body: str) -> list[str]:
    """Names of the expressions ``body`` uses, in the order of ``CTES``."""
    seen: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in words & CTES.keys() - seen:
            seen.add(name)
            todo.append(CTES[name])
    return [name for name in CTES if name in seen]


def sql(body: str) -> str:
    """``body`` with the table expressions it uses in front."""
    parts = []
    for name in _needs(body):
        head = f"{name}(doc_id, redacted_text, i)" if name in _RECURSIVE else name
        kind = " MATERIALIZED" if name in _STORED else ""
        parts.append(f"{head} AS{kind} ({CTES[name]})")
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
