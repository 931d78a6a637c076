"""Queries and SQL of the general training-data operators (problems 3 and 6)."""

from __future__ import annotations

from quern.operators import nested, units

QUERIES = {
    "p3_found": nested.p3_found,
    "p3_entries": nested.p3_entries,
    "p3_items": nested.p3_items,
    "p6_found": units.p6_found,
    "p6_unknown": units.p6_unknown,
    "p6_units": units.p6_units,
}

_TEXT = "CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' THEN {c}::JSON->>'$' ELSE {c} END END"
_SOLID = "(e IS NOT NULL AND json_type(e) <> 'NULL' AND (json_type(e) <> 'VARCHAR' OR regexp_matches(e->>'$', '[^\\s\\p{Z}]')))"


def _newer(*names: str) -> str:
    """The value under the first of names that isn't absent or null, in JSON e or j."""
    return "coalesce(" + ", ".join(f"CASE WHEN coalesce(json_type(j->'$.{n}'), 'NULL') <> 'NULL' THEN j->'$.{n}' END" for n in names) + ")"


#: Rows record_kind, record_id, section, entry_no, item_kind, item_no of resumes, by the JSON functions of SQL.
_ROWS = f"""
    WITH raw AS (SELECT 'master' AS record_kind, id AS record_id, {_TEXT.format(c='content')} AS t FROM master_resumes
                 UNION ALL SELECT 'tailored', id, {_TEXT.format(c='tailored_content')} FROM tailored_resumes),
    doc AS (SELECT record_kind, record_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t::JSON END END AS j FROM raw),
    val AS (SELECT record_kind, record_id, 'work_experience' AS section, {_newer('work_experience', 'experience')} AS v FROM doc
            {' '.join(f"UNION ALL SELECT record_kind, record_id, '{s}', {_newer(s)} FROM doc" for s in ('education', 'projects', 'certifications', 'skills'))}),
    ent AS (SELECT record_kind, record_id, section, unnest(range(len(v::JSON[])))::INT AS entry_no, unnest(v::JSON[]) AS e, false AS category FROM val WHERE json_type(v) = 'ARRAY'
            UNION ALL SELECT record_kind, record_id, section, unnest(range(len(json_keys(v))))::INT, unnest(list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"'))), true
              FROM val WHERE section = 'skills' AND json_type(v) = 'OBJECT'
            UNION ALL SELECT record_kind, record_id, section, 0, v, false FROM val WHERE json_type(v) <> 'ARRAY' AND NOT (section = 'skills' AND json_type(v) = 'OBJECT')),
    solid AS (SELECT *, e AS j FROM ent WHERE {_SOLID}),
    list AS (SELECT record_kind, record_id, section, entry_no, 'category_items' AS item_kind, e AS v FROM solid WHERE category
             {' '.join(f"UNION ALL SELECT record_kind, record_id, section, entry_no, '{k}', {_newer(*n)} FROM solid WHERE NOT category AND json_type(e) = 'OBJECT'" for k, n in (('bullets', ('bullets',)), ('coursework', ('coursework',)), ('technologies', ('technologies', 'tech'))))}),
    item AS (SELECT * EXCLUDE v, unnest(range(len(v::JSON[])))::INT AS item_no, unnest(v::JSON[]) AS e FROM list WHERE json_type(v) = 'ARRAY'
             UNION ALL SELECT * EXCLUDE v, 0, v FROM list WHERE json_type(v) <> 'ARRAY')
    SELECT record_kind, record_id, section, entry_no, '' AS item_kind, -1 AS item_no, e FROM solid
    UNION ALL SELECT record_kind, record_id, section, entry_no, item_kind, item_no, e FROM item WHERE {_SOLID}
"""

SQL = {
    "p3_found": f"SELECT record_kind, record_id, section, entry_no, item_kind, item_no FROM ({_ROWS})",
    "p3_items": f"SELECT record_kind, record_id, section, entry_no, item_kind, item_no, e->>'$' AS item_text FROM ({_ROWS}) WHERE item_no >= 0",
    "p3_entries": f"SELECT record_kind, record_id, section, entry_no, e::VARCHAR AS entry_json FROM ({_ROWS}) WHERE item_no < 0",
    "p6_units": """
        SELECT c.code || '/' || p.code || coalesce('/' || s.code, '') AS unit,
               (c.factor * p.factor * coalesce(s.factor, 1))::DOUBLE AS a,
               0.0::DOUBLE AS b,
               ((c.code <> 'USD')::INT + (p.code <> 'year')::INT + (s.code IS NOT NULL)::INT)::INT AS steps
        FROM unit_factors c CROSS JOIN unit_factors p CROSS JOIN (SELECT code, factor FROM unit_factors WHERE kind = 'scale' UNION ALL SELECT NULL, NULL) s
        WHERE c.kind = 'currency' AND p.kind = 'period'
    """,
}
