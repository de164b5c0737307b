"""The checking SQL for each query, written independently of the operators."""

from __future__ import annotations

from keydrift.functions.text import TRIM_CHARS
from keydrift.plans.workload import HARD_TARGET, SOURCE_JSON, TARGET_JSON

PAIRS = f"""pairs AS (SELECT o_orderkey AS pair_id, {TARGET_JSON} AS target_json,
  {SOURCE_JSON} AS source_json FROM orders)"""


def _walk(name: str, text: str, origin: str = "pairs") -> str:
    return f"""{name}(pair_id, path, ord, j) AS (
  SELECT pair_id, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST({text} AS JSON) FROM {origin}
  UNION ALL
  SELECT pair_id, list_append(path, k), list_concat(ord, [1, i]), json_extract(j, '$.' || k)
  FROM (SELECT pair_id, path, ord, j, unnest(json_keys(j)) AS k,
          unnest(range(len(json_keys(j)))) AS i FROM {name} WHERE json_type(j) = 'OBJECT'))"""


MISSING = """missing AS (
  SELECT s.pair_id, s.ord, s.path, CAST(s.j AS VARCHAR) AS value_json,
    row_number() OVER (PARTITION BY s.pair_id ORDER BY s.ord) - 1 AS seq
  FROM src s
  WHERE len(s.path) > 0
    AND NOT EXISTS (SELECT 1 FROM tgt t WHERE t.pair_id = s.pair_id AND t.path = s.path)
    AND EXISTS (SELECT 1 FROM tgt t WHERE t.pair_id = s.pair_id AND t.path = s.path[1:-2]))"""

DIFF = f"WITH RECURSIVE {PAIRS}, {_walk('src', 'source_json')}, {_walk('tgt', 'target_json')}, {MISSING}"
PATH = "array_to_string(path, ' > ') AS path"
ORDINAL = "array_to_string(ord, '.') AS ordinal"

# The printed result of importing every key, spelled out from the rule that built the pairs.
MERGED = """facts AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s,
    o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS cust_gets, o_orderkey % 5 = 0 AS cust_was_5,
    o_orderkey % 2 = 0 AS no_status, o_orderkey % 7 = 0 AS no_db, o_orderkey % 11 = 0 AS no_flags,
    o_orderkey % 4 = 1 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS extra_first
  FROM orders),
merged AS (
  SELECT *, '{' || chr(10) || CASE WHEN extra_first THEN '  "only_target": null,' || chr(10) ELSE '' END
    || '  "key": ' || k || ',' || chr(10) || '  "cust": {' || chr(10)
    || CASE WHEN cust_gets THEN '    "id": ' || c || ',' || chr(10) || '    "tier": "'
         || CASE WHEN cust_gets THEN p END || '"' ELSE '    "id": 0,' || chr(10) || '    "tier": "x"' END
    || chr(10) || '  },' || chr(10) || '  "status": "' || CASE WHEN no_status THEN s ELSE 'X' END
    || '",' || chr(10) || '  "db": {' || chr(10) || '    "pool": {' || chr(10) || '      "min": 1,'
    || chr(10) || '      "max": ' || (k % 50) || chr(10) || '    }' || chr(10) || '  },' || chr(10)
    || '  "flags": [' || chr(10)
    || CASE WHEN no_flags THEN '    1,' || chr(10) || '    {' || chr(10) || '      "k": 2' || chr(10)
         || '    }' ELSE '    9' END || chr(10) || '  ]'
    || CASE WHEN extra_first THEN '' ELSE ',' || chr(10) || '  "only_target": null' END
    || chr(10) || '}' AS merged_json,
    CASE WHEN cust_was_5 THEN 2 WHEN cust_gets THEN 1 ELSE 0 END + CAST(no_status AS INT)
    + CASE WHEN no_db THEN 1 ELSE 2 END + CAST(no_flags AS INT) AS n_imported
  FROM facts)"""

# Line of each imported key in that text.
EXACT = """exact AS (
  SELECT * FROM (SELECT k AS pair_id, unnest([
    {'path': ['cust', 'id'], 'line_no': 4, 'hit': cust_was_5},
    {'path': ['cust', 'tier'], 'line_no': 5, 'hit': cust_gets},
    {'path': ['status'], 'line_no': 7, 'hit': no_status},
    {'path': ['db'], 'line_no': 8, 'hit': no_db},
    {'path': ['db', 'pool', 'min'], 'line_no': 10, 'hit': NOT no_db},
    {'path': ['db', 'pool', 'max'], 'line_no': 11, 'hit': NOT no_db},
    {'path': ['flags'], 'line_no': 14, 'hit': no_flags}]) AS found,
    CAST(extra_first AS INT) AS shift FROM merged) WHERE found.hit)"""

FIRST = f"""numbered AS (
  SELECT k AS pair_id, unnest(string_split(merged_json, chr(10))) AS line,
    unnest(range(1, len(string_split(merged_json, chr(10))) + 1)) AS line_no FROM merged),
located AS (
  SELECT e.pair_id, e.found.path AS path, min(n.line_no) AS line_no
  FROM exact e JOIN numbered n ON n.pair_id = e.pair_id
    AND starts_with(ltrim(n.line), '"' || e.found.path[-1] || '"')
  GROUP BY ALL)"""

SAVED_QUERIES = """saved AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, text AS query,
  CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS hos_use
  FROM documents)"""
LISTED = """listed AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, props AS query,
  'HOS-' || (user_id % 20) AS hos_use, CASE WHEN event_id % 500 <> 0 THEN ts END AS create_at
  FROM events)"""

PROFILES = """profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS email, c_mktsegment FROM customer
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), c_name || '-2', c_mktsegment FROM customer WHERE c_custkey % 17 = 0),
stored AS (SELECT id, email, CASE WHEN c_mktsegment = 'BUILDING' THEN 'deployer' ELSE 'support' END AS role
  FROM profiles),
logins AS (SELECT o_orderkey AS login_no,
  CASE WHEN o_orderkey % 11 = 0 THEN 'new' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS id,
  CASE WHEN o_orderkey % 6 <> 0 THEN 'mail' || o_orderkey END AS email,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey) AS login_at FROM orders)"""

CHANGES = """feed AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'D' WHEN o_orderkey % 5 = 0 THEN 'I' ELSE 'U' END AS op,
    o_orderkey AS seq,
    CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'system' ELSE o_orderstatus END AS actor,
    o_orderdate AS happened,
    CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'note ' || o_orderkey END AS note,
    o_orderpriority AS description FROM orders)"""

NEW_PROFILES = """ranked AS (SELECT id, coalesce(email, '') AS email, login_at,
    row_number() OVER (PARTITION BY id ORDER BY login_at) AS place
  FROM logins WHERE id NOT IN (SELECT id FROM stored)),
new AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY login_at, id) AS turn,
    email IN (SELECT email FROM stored) AS taken FROM ranked WHERE place = 1)"""

# What the awkward pairs lack, and how they look when everything is imported, spelled out from their rule.
HARD = f"""hard AS (SELECT doc_id AS pair_id, doc_id % 7 AS kind, CAST(doc_id AS VARCHAR) AS id,
  '"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"' AS shown,
  {HARD_TARGET} AS target_json FROM documents),
lacks AS (SELECT * FROM (VALUES
  (0, 0, '2', 's'), (0, 1, '10', 'i'), (0, 2, 'o', 'o'), (0, 3, 'o2', '"w"'),
  (1, 0, '2', 's'), (1, 1, '10', 'i'), (1, 2, 'o > b', '[{{"x":1}}]'), (1, 3, 'o > d1', 'd1'), (1, 4, 'o2', '"w"'),
  (2, 0, '10', 'i'), (2, 1, 'o', 'o'), (2, 2, 'o2', '"w"'),
  (6, 0, '10', 'i'), (6, 1, 'o > a', 'null'), (6, 2, 'o > b', '[{{"x":1}}]'), (6, 3, 'o > d1 > d2 > d3', 'd3'),
  (6, 4, 'o2', '"w"')) t(kind, seq, path, value))"""
HARD_TEXT = """'{' || nl || CASE WHEN kind = 2 THEN '  "0": 1,' || nl || '  "1": 2,' || nl ELSE '' END
  || '  "2": ' || CASE kind WHEN 2 THEN '3' WHEN 6 THEN 'null' ELSE shown END || ',' || nl || '  "10": ' || id || ',' || nl
  || '  "o": {' || nl || '    "a": ' || CASE WHEN kind = 1 THEN '0' ELSE 'null' END || ',' || nl || '    "b": [' || nl
  || '      {' || nl || '        "x": 1' || nl || '      }' || nl || '    ],' || nl || '    "d1": {' || nl
  || '      "d2": {' || nl || '        "d3": {' || nl || '          "d4": {' || nl || '            "d5": {' || nl
  || '              "d6": ' || id || nl || '            }' || nl || '          }' || nl || '        }' || nl || '      }' || nl
  || '    }' || nl || '  },' || nl || '  "o2": "w"' || nl || '}'"""

_BLANK = "trim(text, '" + TRIM_CHARS + "') = ''"
_EVENT_TEXT = """CASE event_id % 5 WHEN 0 THEN props || ' x' WHEN 1 THEN '[' || props || ',null]'
  WHEN 2 THEN '  ' ELSE props END"""


def _applied(feed: str) -> str:
    """Replay row by row: what the last insert or delete before an event left decides its effect."""
    return f"""WITH {feed}, base AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS note,
          c_mktsegment AS description FROM customer),
        seen AS (SELECT f.*, b.id IS NOT NULL AS stored, lag(CASE WHEN op <> 'U' THEN op END IGNORE NULLS)
            OVER (PARTITION BY f.id ORDER BY seq) AS before FROM feed f LEFT JOIN base b ON b.id = f.id),
        judged AS (SELECT *, CASE WHEN before IS NULL THEN stored ELSE before = 'I' END AS existed FROM seen),
        effective AS (SELECT * FROM judged
          WHERE (op = 'I' AND NOT existed) OR (op <> 'I' AND existed)),
        lives AS (SELECT *, count(CASE WHEN op <> 'U' THEN 1 END) OVER (PARTITION BY id ORDER BY seq) AS life
          FROM effective),
        closing AS (SELECT id, max(life) AS life FROM lives GROUP BY id),
        final AS (SELECT l.id, bool_or(op = 'D') AS gone, bool_or(op = 'I') AS made,
            max_by(note, seq) FILTER (WHERE op <> 'D') AS note, max_by(description, seq) FILTER (WHERE op <> 'D') AS description,
            max(actor) FILTER (WHERE op = 'I') AS maker, max(happened) FILTER (WHERE op = 'I') AS made_at,
            max_by(actor, seq) FILTER (WHERE op = 'U') AS updater, max_by(happened, seq) FILTER (WHERE op = 'U') AS updated_at
          FROM lives l JOIN closing c ON c.id = l.id AND c.life = l.life GROUP BY l.id)
        SELECT coalesce(f.id, b.id) AS id, coalesce(f.note, b.note) AS note,
          coalesce(f.description, b.description) AS description,
          coalesce(f.maker, 'system') AS create_by,
          coalesce(f.made_at, TIMESTAMP '2023-01-01 00:00:00') AS create_at, f.updater AS update_by,
          coalesce(f.updated_at, f.made_at, TIMESTAMP '2023-01-01 00:00:00') AS update_at
        FROM base b FULL JOIN final f ON f.id = b.id WHERE NOT coalesce(f.gone, false)"""


ORACLE = {
    "diff_missing_keys": f"{DIFF} SELECT pair_id, seq, {ORDINAL}, {PATH}, value_json FROM missing",
    "diff_counts": f"""{DIFF} SELECT p.pair_id, count(m.pair_id) AS n_missing
        FROM pairs p LEFT JOIN missing m ON m.pair_id = p.pair_id GROUP BY 1""",
    "diff_same_document": "SELECT o_orderkey AS pair_id, CAST(0 AS BIGINT) AS n_missing FROM orders",
    "diff_source_members": f"""WITH RECURSIVE {PAIRS}, {_walk('src', 'source_json')}
        SELECT pair_id, {ORDINAL}, {PATH}, CASE json_type(j) WHEN 'OBJECT' THEN 'object'
          WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
          CAST(j AS VARCHAR) AS value_json FROM src WHERE len(path) > 0""",
    "diff_target_paths": f"""WITH RECURSIVE {PAIRS}, {_walk('tgt', 'target_json')}
        SELECT pair_id, {PATH} FROM tgt""",
    "diff_by_join": f"{DIFF} SELECT pair_id, {ORDINAL}, {PATH}, value_json FROM missing",
    "diff_against_baselines": """SELECT c_custkey AS pair_id, CAST(0 AS BIGINT) AS seq,
          'acct > nation' AS path, CAST(c_nationkey AS VARCHAR) AS value_json FROM customer
        UNION ALL SELECT c_custkey, 1, 'name', '"' || c_name || '"' FROM customer""",
    "merge_import_all": f"""WITH {MERGED} SELECT k AS pair_id, merged_json,
        CAST(n_imported AS BIGINT) AS n_imported FROM merged""",
    "merge_leaves_nothing": "SELECT o_orderkey AS pair_id, CAST(0 AS BIGINT) AS n_missing FROM orders",
    "lines_numbered": """SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
        unnest(string_split(text, chr(10))) AS line FROM documents""",
    "lines_exact": f"""WITH {MERGED}, {EXACT} SELECT pair_id,
        array_to_string(found.path, ' > ') AS path, CAST(found.line_no + shift AS BIGINT) AS line_no
        FROM exact""",
    "lines_first_match": f"""WITH {MERGED}, {EXACT}, {FIRST} SELECT pair_id, {PATH}, line_no FROM located""",
    "lines_highlighted": f"""WITH {MERGED}, {EXACT}, {FIRST} SELECT pair_id,
        array_to_string(list_sort(list_distinct(list(line_no))), ',') AS line_nos
        FROM located GROUP BY pair_id""",
    "history_rows": f"""{DIFF} SELECT pair_id, TIMESTAMP '2024-05-01 00:00:00' AS ts, seq AS batch_seq,
          {PATH}, value_json, 'all' AS type, 'Bulk' AS label FROM missing""",
    "history_single": f"""{DIFF} SELECT pair_id, TIMESTAMP '2024-05-01 00:00:00' AS ts, seq AS batch_seq,
          {PATH}, value_json, 'single' AS type, 'Single' AS label FROM missing WHERE seq = 0""",
    "history_cleared": f"""{DIFF}, kept AS (SELECT seq FROM missing JOIN orders ON o_orderkey = pair_id
          WHERE o_orderstatus <> 'F')
        SELECT 'all' AS type, count(*) AS n_rows FROM kept""",
    "text_validity": f"""WITH texts AS (
          SELECT 'event' AS origin, event_id AS id, {_EVENT_TEXT} AS text FROM events
          UNION ALL SELECT 'document', doc_id, text FROM documents
          UNION ALL SELECT 'page', page_id, html FROM pages)
        SELECT origin, id, {_BLANK} AS blank, json_valid(text) AS valid,
          CASE WHEN NOT ({_BLANK}) AND NOT json_valid(text) THEN 'Invalid JSON' END AS error FROM texts""",
    "pair_status": """WITH c AS (SELECT event_id AS pair_id, event_id % 6 AS t, event_id % 4 AS s FROM events)
        SELECT pair_id, CASE WHEN t = 4 THEN 'Invalid JSON' END AS target_error,
          CAST(NULL AS VARCHAR) AS source_error, t IN (3, 5) AND s <> 0 AS comparable,
          CASE WHEN t = 3 AND s IN (2, 3) THEN 'Target is not an object' END AS error FROM c""",
    "catalog_newest_first": f"""WITH {LISTED} SELECT id, title, create_at,
        row_number() OVER (ORDER BY create_at DESC NULLS FIRST, id) AS place
        FROM (SELECT * FROM listed ORDER BY create_at DESC NULLS FIRST, id LIMIT 1000)""",
    "catalog_listing": f"WITH {LISTED} SELECT id, title, create_at FROM listed",
    "catalog_search_empty_term": f"WITH {SAVED_QUERIES} SELECT id, title, hos_use FROM saved",
    "catalog_search_listed": f"""WITH {LISTED} SELECT id, title, query, hos_use FROM listed
        WHERE (contains(lower(title), 'click') OR contains(lower(query), 'click'))
          AND contains(lower(hos_use), 'hos-1')""",
    "catalog_search_everything": f"""WITH {SAVED_QUERIES} SELECT id, title, hos_use FROM saved
        WHERE (contains(lower(title), 'the ') OR contains(lower(query), 'the '))
          AND hos_use <> '' AND contains(lower(hos_use), 'e')""",
    "catalog_search_literal": f"""WITH {SAVED_QUERIES} SELECT id, title, hos_use FROM saved
        WHERE contains(title, '%') OR contains(query, '%')""",
    "catalog_search_notes": """SELECT conv_id || '-' || turn AS id, role AS note FROM conversations
        WHERE contains(lower(role), 'user') OR contains(lower(text), 'user')""",
    "catalog_facet_values": f"WITH {SAVED_QUERIES} SELECT DISTINCT hos_use FROM saved WHERE hos_use <> ''",
    "catalog_row_counts": """SELECT 'queries' AS catalog, count(*) AS n_rows FROM documents
        UNION ALL SELECT 'notes', count(*) FROM conversations""",
    "changes_checked": f"""WITH {CHANGES} SELECT seq, op, id,
        CASE WHEN op IS NULL OR op = 'X' THEN 'Unknown operation.'
          WHEN op <> 'D' AND (trim(note) = '' OR trim(description) = '')
          THEN 'Title/Note and Description fields are required.'
          WHEN seq IS NULL THEN 'A change needs a seq.' END AS reason
        FROM (SELECT * REPLACE (CASE seq % 23 WHEN 0 THEN NULL WHEN 1 THEN 'X' ELSE op END AS op,
          CASE WHEN seq % 29 <> 5 THEN seq END AS seq) FROM feed)""",
    "changes_inserted_without_id": f"""WITH {CHANGES} SELECT note, description, actor AS create_by,
        happened AS create_at, true AS has_id FROM feed WHERE op = 'I'""",
    "changes_insert_defaults": """SELECT sha256(CAST(doc_id AS VARCHAR)) AS id, source AS title,
          CASE WHEN doc_id % 2 = 0 THEN NULL ELSE nullif(lang, '') END AS hos_use,
          CASE WHEN doc_id % 3 = 1 THEN lang ELSE 'system' END AS create_by,
          TIMESTAMP '2024-01-01 00:00:00' AS create_at, CAST(NULL AS VARCHAR) AS update_by,
          TIMESTAMP '2024-01-01 00:00:00' AS update_at FROM documents""",
    "changes_violations": f"""WITH {PROFILES}
        SELECT 'not null' AS rule, 'email' AS column_name, CAST(NULL AS VARCHAR) AS key, count(*) AS n_rows
          FROM stored WHERE email = 'Customer#000000007'
        UNION ALL SELECT 'unique', 'id', id, count(*) FROM stored GROUP BY id HAVING count(*) > 1""",
    "changes_applied": _applied(CHANGES),
    # Ties are put in order first: by operation, then by content.
    "changes_tied": _applied(f"""{CHANGES.replace("feed AS", "whole AS", 1)}, tied AS (
          SELECT * REPLACE (CASE WHEN seq % 11 = 3 THEN NULL ELSE seq % 40 END AS seq, CAST(CAST(seq AS BIGINT) % 30 AS VARCHAR) AS id) FROM whole),
        feed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY id ORDER BY seq, op, happened NULLS FIRST, actor, note, description) AS seq)
          FROM tied WHERE seq IS NOT NULL)"""),
    "users_profiles": f"""WITH {PROFILES}, n AS (SELECT id, count(*) AS n, min(email) AS email,
          min(role) AS role FROM stored GROUP BY id)
        SELECT login_no, l.id, CASE WHEN n IS NULL THEN 'absent' WHEN n = 1 THEN 'ok' ELSE 'duplicate' END AS status,
          CASE WHEN n = 1 THEN n.email ELSE '' END AS profile_email,
          CASE WHEN n = 1 THEN n.role ELSE 'support' END AS role
        FROM logins l LEFT JOIN n ON n.id = l.id""",
    "users_provisioned": f"""WITH {PROFILES}, {NEW_PROFILES}
        SELECT id, email, role, 'system' AS create_by, TIMESTAMP '2023-01-01 00:00:00' AS create_at FROM stored
        UNION ALL SELECT id, email, 'support', 'system', login_at FROM new WHERE turn = 1 AND NOT taken""",
    "users_refused": f"""WITH {PROFILES}, {NEW_PROFILES}
        SELECT id, email, login_at AS create_at, 'unique: email' AS reason FROM new WHERE turn > 1 OR taken""",
    "users_gate": f"""WITH {PROFILES}, n AS (SELECT id, count(*) AS n, min(role) AS role FROM stored GROUP BY id)
        SELECT login_no, l.id AS actor, coalesce(n = 1 AND role = 'deployer', false) AS allowed
        FROM logins l LEFT JOIN n ON n.id = l.id""",
}

# Only the chosen keys: missing tier or status on every third pair.
ORACLE["merge_import_selected"] = f"""WITH {PAIRS}, facts AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s,
      o_orderkey % 3 = 0 AS tier, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS status,
      chr(10) AS nl FROM orders),
  shown AS (SELECT *, '{{' || nl
      || CASE WHEN k % 4 = 1 THEN '  "only_target": null,' || nl ELSE '' END || '  "key": ' || k || ',' || nl
      || '  "cust": {{' || nl || CASE WHEN k % 5 = 0 THEN '' ELSE '    "id": ' || c || ',' || nl END
      || '    "tier": "' || p || '"' || nl || '  }}'
      || ',' || nl || '  "status": "' || CASE WHEN status THEN s ELSE 'X' END || '"'
      || CASE WHEN k % 7 = 0 THEN '' ELSE ',' || nl || '  "db": {{' || nl || '    "pool": {{}}' || nl || '  }}' END
      || CASE WHEN k % 11 = 0 THEN '' ELSE ',' || nl || '  "flags": [' || nl || '    9' || nl || '  ]' END
      || CASE WHEN k % 4 = 1 THEN '' ELSE ',' || nl || '  "only_target": null' END || nl || '}}' AS text FROM facts)
  SELECT pair_id, CASE WHEN tier THEN text ELSE target_json END AS merged_json,
    CAST(CAST(tier AS INT) + CAST(status AS INT) AS BIGINT) AS n_imported
  FROM pairs JOIN shown ON k = pair_id"""

ORACLE["history_selected"] = """WITH picks AS (SELECT o_orderkey AS pair_id, o_orderpriority AS p, o_orderstatus AS s
    FROM orders WHERE o_orderkey % 3 = 0),
  taken AS (SELECT pair_id, 0 AS batch_seq, 'cust > tier' AS path, '"' || p || '"' AS value_json FROM picks
    UNION ALL SELECT pair_id, 1, 'status', '"' || s || '"' FROM picks WHERE pair_id % 2 = 0)
  SELECT pair_id, TIMESTAMP '2024-05-01 00:00:00' AS ts, CAST(batch_seq AS BIGINT) AS batch_seq, path, value_json,
    'single' AS type, 'Single' AS label FROM taken"""
ORACLE["hard_missing_keys"] = f"""WITH {HARD} SELECT pair_id, CAST(seq AS BIGINT) AS seq, path,
    CASE value WHEN 's' THEN shown WHEN 'i' THEN id
      WHEN 'o' THEN '{{"a":null,"b":[{{"x":1}}],"d1":{{"d2":{{"d3":{{"d4":{{"d5":{{"d6":' || id || '}}}}}}}}}}}}'
      WHEN 'd1' THEN '{{"d2":{{"d3":{{"d4":{{"d5":{{"d6":' || id || '}}}}}}}}}}'
      WHEN 'd3' THEN '{{"d4":{{"d5":{{"d6":' || id || '}}}}}}' ELSE value END AS value_json
  FROM hard JOIN lacks ON lacks.kind = hard.kind"""
ORACLE["hard_counts"] = f"""WITH {HARD} SELECT pair_id,
    CAST((SELECT count(*) FROM lacks WHERE lacks.kind = hard.kind) AS BIGINT) AS n_missing,
    CASE WHEN kind = 3 THEN 'Invalid JSON' END AS status FROM hard"""
ORACLE["hard_import_all"] = f"""WITH {HARD}, lined AS (SELECT *, chr(10) AS nl FROM hard)
  SELECT pair_id, CASE WHEN kind IN (3, 4, 5) THEN target_json ELSE {HARD_TEXT} END AS merged_json,
    CAST((SELECT count(*) FROM lacks WHERE lacks.kind = lined.kind) AS BIGINT) AS n_imported,
    CASE WHEN kind = 3 THEN 'Invalid JSON' END AS status FROM lined"""
ORACLE["hard_status"] = f"""WITH {HARD} SELECT pair_id, CASE WHEN kind = 3 THEN 'Invalid JSON' END AS target_error,
    CAST(NULL AS VARCHAR) AS source_error, kind NOT IN (3, 4) AS comparable,
    CASE WHEN kind = 5 THEN 'Target is not an object' END AS error FROM hard"""
ORACLE["diff_hot_baseline"] = ORACLE["diff_against_baselines"]
ORACLE["diff_shared_baseline"] = """SELECT c_custkey AS pair_id, c_mktsegment AS baseline_id, 'acct > nation' AS path,
      CAST(c_nationkey AS VARCHAR) AS value_json FROM customer
    UNION ALL SELECT c_custkey, c_mktsegment, 'name', '"' || c_name || '"' FROM customer"""
ORACLE["diff_by_digests"] = ORACLE["diff_missing_keys"]
# The root, db and pool of a changed document; nothing of one whose keys only moved.
ORACLE["diff_opened"] = "SELECT o_orderkey AS pair_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 3 END AS BIGINT) AS n_opened FROM orders"
ORACLE["hard_by_digests"] = ORACLE["hard_missing_keys"]
ORACLE["catalog_search_indexed"] = f"""WITH {SAVED_QUERIES}, terms(term) AS (VALUES
    ('the '), ('GNU general public'), ('ver'), ('%'), (chr(10)), ('no such words anywhere'), ('e'))
  SELECT term, id, hos_use FROM saved JOIN terms
    ON contains(lower(title), lower(term)) OR contains(lower(query), lower(term))"""
ORACLE["catalog_pages"] = f"""WITH {LISTED}, placed AS (SELECT id, title, create_at,
    row_number() OVER (ORDER BY create_at DESC NULLS FIRST, id) AS place,
    row_number() OVER (PARTITION BY create_at IS NULL ORDER BY create_at DESC, id) AS own FROM listed)
  SELECT CAST((place - 1) // 100 AS INT) AS page, id, title, create_at FROM placed WHERE place <= 200
  UNION ALL SELECT 2, id, title, create_at FROM placed WHERE create_at IS NOT NULL AND own <= 100"""
ORACLE["changes_tally"] = f"""SELECT description AS facet_value, count(*) AS n_rows
  FROM ({ORACLE["changes_applied"]}) GROUP BY 1"""
ORACLE["history_tombstones"] = f"""{DIFF} SELECT pair_id, CASE WHEN pair_id % 3 = 0
    THEN TIMESTAMP '2024-05-02 00:00:00' ELSE TIMESTAMP '2024-05-01 00:00:00' END AS ts,
    seq AS batch_seq, {PATH}, value_json FROM missing JOIN orders ON o_orderkey = pair_id
  WHERE pair_id % 10 <> 0 AND (pair_id % 3 = 0 OR o_orderstatus <> 'F')"""

# Two feeds in batches give what all logins together give.
ORACLE["users_streamed"] = ORACLE["users_provisioned"]
ORACLE["users_streamed_refused"] = ORACLE["users_refused"]
