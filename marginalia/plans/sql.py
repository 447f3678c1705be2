"""SQL of the general queries, for DuckDB over the same tables."""

from __future__ import annotations

from marginalia.functions.ranking import BOOSTS
from marginalia.functions.text import STOP_WORDS_EN, STOP_WORDS_ZH


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


NOTES = "notes AS (SELECT note_id, any_value(vault) vault, any_value(path) path, any_value(basename) basename, any_value(folder) folder, any_value(aliases) aliases, any_value(tags) tags, any_value(headings) headings, any_value(content) content FROM indexed_documents GROUP BY note_id)"
NAME = "string_split(path, '/')[-1]"
EXT = f"regexp_extract({NAME}, '\\.([^.]*)$', 1)"
BASE = f"CASE WHEN {NAME} LIKE '_%.%' AND NOT regexp_matches({NAME}, '^\\.[^.]*$') THEN regexp_replace({NAME}, '\\.[^.]*$', '') ELSE {NAME} END"
#: Fixed value: how many characters are kept as parts of words though they are punctuation.
KEPT, SHIELDS = "!\"&''-_\\", "".join(chr(0xE000 + k) for k in range(7))
DOCS = f"""{NOTES},
docs AS (SELECT note_id, vault, path, coalesce(basename, {BASE}) basename, folder, coalesce(aliases, '') aliases, coalesce(tags, '') tags, coalesce(headings, '') headings, content
  FROM notes WHERE {EXT} = 'md' AND NOT contains(path, 'excalidraw.md'))"""


def tokens(table: str) -> str:
    """CTEs that end in ``tok(note_id, field, token)`` of ``table(note_id, field, txt)``."""
    return f"""
word AS (SELECT note_id, field, translate(unnest(regexp_split_to_array(translate(regexp_replace(txt, '[一-龥]+', ' ', 'g'), '{KEPT}', '{SHIELDS}'), '[\\s\\x0b\\p{{Z}}\\x{{FEFF}}^=`<>\\p{{P}}]+')), '{SHIELDS}', '{KEPT}') AS w FROM {table}),
kept AS (SELECT note_id, field, w FROM word WHERE length(w) >= 2 AND w NOT IN ({_list(STOP_WORDS_EN)})),
part AS (SELECT note_id, field, unnest(string_split(regexp_replace(regexp_replace(w, '[-_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ')) AS w FROM kept WHERE length(w) > 3),
run AS (SELECT note_id, field, unnest(regexp_extract_all(txt, '[一-龥]+')) AS r FROM {table}),
pair AS (SELECT note_id, field, unnest(CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END) AS w FROM run),
tok AS (SELECT DISTINCT note_id, field, w AS token FROM (SELECT * FROM kept UNION ALL SELECT * FROM part WHERE length(w) > 1 UNION ALL SELECT * FROM pair WHERE w NOT IN ({_list(STOP_WORDS_ZH)})) WHERE length(w) < 30)"""


FIELDS = "fields AS (" + " UNION ALL ".join(f"SELECT note_id, '{f}' AS field, {f} AS txt FROM docs" for f in BOOSTS) + ")"
INDEX = f"WITH {DOCS}, {FIELDS},{tokens('fields')},\npost AS (SELECT note_id, field, lower(token) AS term, count(*) AS tf FROM tok GROUP BY ALL),\nlens AS (SELECT f.note_id, f.field, count(t.token) AS length FROM fields f LEFT JOIN tok t ON t.note_id = f.note_id AND t.field = f.field GROUP BY ALL)"
CONTENT = f"WITH {DOCS}, body AS (SELECT note_id, 'content' AS field, content AS txt FROM docs),{tokens('body')}"
BOOST = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in BOOSTS.items()) + " END"


def expansions(terms: list[str], prefix: bool, fuzzy: bool, vocabulary: str = "post") -> str:
    """A CTE ``expand(term, query_term, kind, weight)`` over the distinct terms of ``vocabulary``."""
    parts = []
    for q in terms:
        k = 0 if len(q) <= 3 else min(6, int(0.2 * len(q) + 0.5))
        kind = f"CASE WHEN term = '{q}' THEN 'exact'" + (f" WHEN starts_with(term, '{q}') THEN 'prefix'" if prefix and len(q) >= 2 else "") + (f" WHEN levenshtein(term, '{q}') BETWEEN 1 AND {k} THEN 'fuzzy'" if fuzzy and k else "") + " END"
        parts.append(f"SELECT term, '{q}' AS query_term, {kind} AS kind FROM (SELECT DISTINCT term FROM {vocabulary})")
    weight = "CASE kind WHEN 'exact' THEN 1.0 WHEN 'prefix' THEN 0.375 * length(term)::DOUBLE / (length(term) + 0.3 * (length(term) - length(query_term))) ELSE 0.45 * length(term)::DOUBLE / (length(term) + levenshtein(term, query_term)) END"
    return f"expand AS (SELECT term, query_term, kind, {weight} AS weight FROM ({' UNION ALL '.join(parts)}) WHERE kind IS NOT NULL)"


def search(terms: list[str], prefix: bool, fuzzy: bool, limit: int, every_term: bool = True, boosts: str = BOOST, fields: str = "true") -> str:
    having = f"HAVING count(DISTINCT query_term) = {len(terms)}" if every_term else ""
    return f"""{INDEX}, {expansions(terms, prefix, fuzzy)},
hit AS (SELECT * FROM post JOIN expand USING (term) WHERE {fields}),
df AS (SELECT field, term, count(DISTINCT note_id) AS df FROM hit GROUP BY ALL),
avgs AS (SELECT field, avg(length) AS average FROM lens GROUP BY field),
n AS (SELECT count(*) AS n FROM docs),
scored AS (SELECT note_id, query_term, term, weight * ({boosts}) * ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * length / average))) AS s
  FROM hit JOIN lens USING (note_id, field) JOIN df USING (field, term) JOIN avgs USING (field), n),
top AS (SELECT note_id, round(sum(s) * count(DISTINCT query_term), 6) AS score, array_to_string(list_sort(list(DISTINCT query_term)), ' ') AS query_terms, array_to_string(list_sort(list(DISTINCT term)), ' ') AS matched_terms
  FROM scored GROUP BY note_id {having})
SELECT note_id, path, row_number() OVER (ORDER BY score DESC, note_id) AS rank, score, query_terms, matched_terms FROM top JOIN docs USING (note_id) ORDER BY score DESC, note_id LIMIT {limit}"""
