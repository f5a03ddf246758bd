"""The canonical-list query in the SQL of another engine: every value against every name, without segments.

It shares the word lists with ``canonical`` but none of the joins.
"""

from __future__ import annotations

from .canonical import ALIASES, EDITS, NOISE

_PATTERN = "|".join(sorted((w.replace("/", " ") for w in NOISE), key=len, reverse=True))


def _clean(column: str) -> str:
    base = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({column}), '^([^,]+),([^,]+)$', '\\2 \\1'), '[(\\[][^)\\]]*[)\\]]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
    out = f"' ' || {base} || ' '"
    for _ in range(4):  # words before words before the name
        out = f"regexp_replace({out}, ' ({_PATTERN}) ', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_EDITS = "CASE " + " ".join(f"WHEN length(n.s) <= {n} THEN {k}" for n, k in EDITS[:-1]) + f" ELSE {EDITS[-1][1]} END"
_ALIASES = ", ".join(f"('{name}', '{alias}')" for name, aliases in ALIASES.items() for alias in aliases)
_ABBREVIATED = """coalesce(CASE WHEN v.w[i] LIKE '%.' AND length(v.w[i]) > 2 THEN starts_with(n.w[i], rtrim(v.w[i], '.'))
  WHEN contains(v.w[i], '''') THEN starts_with(n.w[i], string_split(v.w[i], '''')[1]) AND ends_with(n.w[i], string_split(v.w[i], '''')[2])
  ELSE levenshtein(rtrim(v.w[i], '.'), n.w[i]) <= CASE WHEN length(n.w[i]) <= 4 THEN 1 ELSE 2 END END, false)"""

P3_SQL = f"""
WITH vals AS (
  SELECT case_id record_key, arg_min(crime_type, ingested_at) AS "value" FROM case_records WHERE case_id IS NOT NULL GROUP BY case_id
  UNION ALL SELECT case_id || '#' || (i - 1), gold.crime_types[i] FROM (SELECT case_id, gold, unnest(range(1, len(gold.crime_types) + 1)) i FROM gold_cases WHERE case_id IS NOT NULL)
), kept AS (SELECT * FROM vals WHERE trim(coalesce("value", '')) <> ''),
named AS (
  SELECT crime_type_id entry_id, {_clean('name')} s, 0 p FROM crime_type_list WHERE name IS NOT NULL
  UNION ALL SELECT r.crime_type_id, {_clean('a.alias')}, 1 FROM crime_type_list r JOIN (VALUES {_ALIASES}) a(name, alias) ON lower(r.name) = lower(a.name)
), parts AS (SELECT entry_id, s, p, string_split(s, ' ') w FROM named WHERE s <> ''),
forms AS (
  SELECT entry_id, s, p FROM parts
  UNION ALL SELECT entry_id, w[2] || ' ' || w[1], p FROM parts WHERE len(w) = 2
  UNION ALL SELECT entry_id, w[2] || ' ' || w[3] || ' ' || w[1], p FROM parts WHERE len(w) = 3 AND p = 0
  UNION ALL SELECT entry_id, w[3] || ' ' || w[1] || ' ' || w[2], p FROM parts WHERE len(w) = 3 AND p = 0
  UNION ALL SELECT entry_id, array_to_string(w, ''), 2 FROM parts WHERE len(w) > 1
), names AS (SELECT s, arg_min(entry_id, (p, entry_id)) entry_id, min(p) p FROM forms GROUP BY s),
d AS (SELECT "value", {_clean('"value"')} s, trim(regexp_replace(regexp_replace(lower("value"), '[^a-z0-9.'']+', ' ', 'g'), ' +', ' ', 'g')) dotted FROM (SELECT DISTINCT "value" FROM kept)),
codes AS (
  SELECT "value", regexp_replace(c, '[^a-z0-9]', '', 'g') c FROM (SELECT "value", unnest(regexp_extract_all(lower("value"), '([a-z]+[- ]?[0-9]+)', 1)) c FROM d)
  UNION ALL SELECT "value", regexp_replace(lower(c), '([0-9]+)[^a-z0-9]+([a-z]+)', '\\2\\1') FROM (SELECT "value", unnest(regexp_extract_all(lower("value"), '([0-9]+[- ]?[a-z]+)', 1)) c FROM d)),
by_code AS (SELECT "value", min(crime_type_id) entry_id FROM codes JOIN crime_type_list ON c = regexp_replace(lower(legal_code), '[^a-z0-9]', '', 'g') WHERE legal_code <> '' GROUP BY 1),
by_edits AS (SELECT d."value", arg_min(n.entry_id, (levenshtein(d.s, n.s), n.p, n.entry_id)) entry_id FROM d JOIN names n ON d.s <> '' AND levenshtein(d.s, n.s) <= {_EDITS} GROUP BY 1),
v AS (SELECT "value", string_split(regexp_replace(trim(regexp_replace(dotted, '\\b({_PATTERN})\\b', ' ', 'g')), ' +', ' ', 'g'), ' ') w FROM d WHERE contains(dotted, '.') OR contains(dotted, '''')),
n AS (SELECT entry_id, p, string_split(s, ' ') w FROM names WHERE p < 2),
by_abbreviation AS (SELECT v."value", arg_min(n.entry_id, (n.p, n.entry_id)) entry_id FROM v JOIN n ON len(v.w) = len(n.w) WHERE len(list_filter(range(1, len(n.w) + 1), lambda i: NOT {_ABBREVIATED})) = 0 GROUP BY 1),
matched AS (SELECT "value", arg_min(entry_id, (rank, entry_id)) entry_id FROM (SELECT "value", 0 rank, entry_id FROM by_code UNION ALL SELECT "value", 1, entry_id FROM by_abbreviation UNION ALL SELECT "value", 2, entry_id FROM by_edits) GROUP BY 1)
SELECT record_key, coalesce(entry_id, 'unmatched') crime_type_id FROM kept LEFT JOIN matched USING ("value")
"""
