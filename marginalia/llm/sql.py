"""SQL of the pN_ queries, for DuckDB over the same tables."""

import unicodedata

NOTES = "notes AS (SELECT note_id, any_value(content) AS content, any_value(tags) AS tags, any_value(headings) AS headings FROM indexed_documents GROUP BY note_id)"
TAGS = "tagged AS (SELECT DISTINCT note_id, lower(ltrim(t, '#')) AS tag FROM (SELECT note_id, unnest(regexp_split_to_array(tags, '\\s+')) AS t FROM notes WHERE tags IS NOT NULL) WHERE ltrim(t, '#') <> '')"
FREQUENCY = f"""WITH {NOTES},
tokens AS (
  SELECT 'content' AS field_name, note_id, lower(t) AS term FROM (SELECT note_id, unnest(regexp_extract_all(content, '[A-Za-zÀ-ÖØ-öø-ÿ]{{3,}}')) AS t FROM notes)
  UNION ALL
  SELECT 'tags', note_id, lower(ltrim(t, '#')) FROM (SELECT note_id, unnest(regexp_split_to_array(tags, '\\s+')) AS t FROM notes) WHERE ltrim(t, '#') <> ''),
n AS (SELECT count(content) AS n_content, count(*) AS n_all FROM notes),
counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT note_id) AS notes FROM tokens GROUP BY ALL),
marked AS (SELECT field_name, term, occurrences, notes,
  CASE WHEN notes = 1 THEN 'rare' WHEN 5 * notes >= CASE field_name WHEN 'content' THEN n_content ELSE n_all END THEN 'common' END AS mark FROM counts, n)
"""
PAIRS = f"""WITH {NOTES}, {TAGS},
n AS (SELECT count(*) AS n_notes FROM notes),
item AS (SELECT tag, count(*) AS k FROM tagged GROUP BY tag),
pair AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS notes_ab FROM tagged a JOIN tagged b ON a.note_id = b.note_id AND a.tag < b.tag GROUP BY ALL),
scored AS (SELECT tag_a, tag_b, x.k AS notes_a, y.k AS notes_b, notes_ab, n_notes FROM pair JOIN item x ON x.tag = tag_a JOIN item y ON y.tag = tag_b, n)
"""
TERMS = f"""WITH {NOTES},
tokens AS (SELECT note_id, lower(unnest(regexp_extract_all(concat_ws(' | ', content, headings, tags), '[A-Za-zÀ-ÖØ-öø-ÿ]{{5,}}'))) AS term FROM notes),
tf AS (SELECT note_id, term, count(*) AS k FROM tokens GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term)
"""
LONG = """SELECT DISTINCT '{0}' AS table_name, path, CASE WHEN len(list_filter(regexp_split_to_array(content, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}.!?\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}]'), lambda x: length(x) > 4000)) > 0 THEN 'unbounded' ELSE 'bounded' END AS kind
FROM {0} WHERE length(content) > 4000"""

#: Letters and signs that look like others, written down here apart from the operator's table.
LOOKS = (
    ("АВЕЅІЈКМНОРСТУХҮҺԀԌԚԜӀаеѕіјорсухһԁԛԝүӏѵ", "ABESIJKMHOPCTYXYhdGQWIaesijopcyxhdqwylv"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονΑαιρϲϳ", "ABEZHIKMNOPTYXovAaipcj"), ("օոսհցՕɑɡɩı", "onuhgOagii"), ("‐‑−˗∕⁄∶։ʼˈ‚∗", "----//::’',*"),
)


def _same_look(column: str) -> str:
    """A value in the form in which equal-looking ones are equal, as far as SQL has the functions."""
    own = {a: b for old, new in LOOKS for a, b in zip(old, new, strict=True)}
    table = own | {chr(n + 0xFEE0): chr(n) for n in range(0x21, 0x7F)} | {c: " " for c in "\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))}
    for c in map(chr, range(0x370, 0x530)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in own and len(whole := unicodedata.normalize("NFC", own[parts[0]] + parts[1:])) == 1:
            table[c] = whole
    old, new = ("".join(x).replace("'", "''") for x in (table.keys(), table.values()))
    hidden = "[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}\\x{fe00}-\\x{fe0f}]"
    return f"nfc_normalize(translate(regexp_replace(regexp_replace({column}, '\\r\\n?', chr(10), 'g'), '{hidden}', '', 'g'), '{old}', '{new}'))"


LOOK = "WITH value AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field_name, note_id, {c} AS stored, {_same_look(c)} AS look FROM indexed_documents WHERE note_id IS NOT NULL" for c in ("basename", "aliases", "content")) + ")"

SQL = {
    "p2_found": LOOK + " SELECT DISTINCT a.field_name, a.note_id AS note_a, b.note_id AS note_b FROM value a JOIN value b ON a.field_name = b.field_name AND a.look = b.look AND a.note_id < b.note_id AND a.stored <> b.stored WHERE trim(a.look, ' ' || chr(9) || chr(10)) <> ''",
    "p2_classes": LOOK + """, held AS (SELECT * FROM value WHERE trim(look, ' ' || chr(9) || chr(10)) <> ''), n AS (SELECT field_name, look, count(DISTINCT stored)::INT AS n_forms, count(*) AS n_notes FROM held GROUP BY ALL HAVING count(DISTINCT stored) > 1)
SELECT field_name, note_id, n_forms, n_notes, min(note_id) OVER (PARTITION BY field_name, look) AS first_of_class, min(note_id) OVER (PARTITION BY field_name, look, stored) AS first_of_form FROM held JOIN n USING (field_name, look)""",
    "p4_found": FREQUENCY + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_term_frequency": FREQUENCY + "SELECT * FROM marked",
    "p5_found": PAIRS + "SELECT tag_a, tag_b FROM scored WHERE notes_ab >= 5 AND 1000 * notes_ab >= n_notes AND notes_ab * n_notes >= 4 * notes_a * notes_b",
    "p5_tag_pairs": PAIRS + """SELECT tag_a, tag_b, notes_a, notes_b, notes_ab, n_notes, notes_ab * n_notes / (notes_a * notes_b) AS lift,
  CASE WHEN notes_a > notes_ab THEN (notes_a / n_notes) * (1 - notes_b / n_notes) / ((notes_a - notes_ab) / n_notes) END AS conviction FROM scored""",
    "p6_found": TERMS + "SELECT note_id, term FROM tf JOIN df USING (term) WHERE k >= 5 AND n <= 3",
    "p6_term_weights": f"""WITH {NOTES},
field AS (SELECT note_id, 1 AS f, content AS t FROM notes UNION ALL SELECT note_id, 2, headings FROM notes UNION ALL SELECT note_id, 3, tags FROM notes),
list AS (SELECT note_id, f, regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ]{{5,}}') AS words FROM field WHERE t IS NOT NULL),
token AS (SELECT note_id, f, unnest(range(1, length(words) + 1)) AS at, lower(unnest(words)) AS term FROM list),
near AS (SELECT a.note_id, a.term, b.term AS other FROM token a JOIN token b ON a.note_id = b.note_id AND a.f = b.f AND b.at BETWEEN a.at - 3 AND a.at + 3 AND a.term <> b.term),
degree AS (SELECT note_id, term, count(DISTINCT other) AS degree FROM near GROUP BY ALL),
tf AS (SELECT note_id, term, count(*) AS occurrences FROM token GROUP BY ALL),
df AS (SELECT term, count(*) AS notes FROM tf GROUP BY term)
SELECT note_id, term, occurrences, coalesce(degree, 0) AS degree, df.notes, coalesce(degree, 0) * ln(((SELECT count(*) FROM notes) + 1) / df.notes) AS score FROM tf JOIN df USING (term) LEFT JOIN degree USING (note_id, term)""",
    "p7_found": LONG.format("indexed_documents") + "\nUNION\n" + LONG.format("semantic_documents"),
    "p7_rebuilt": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, path, length(content) AS n_chars, length(content) > 4000 AS several, true AS within, true AS overlapping, md5(content) AS text FROM (SELECT path, {pick} FROM {name} GROUP BY path) WHERE content <> ''"
        for name, pick in (("indexed_documents", "arg_min(content, indexed_at) AS content"), ("semantic_documents", "any_value(content) AS content"))
    ),
    "p8_found": """WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
passage AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS p FROM item, unnest(range(1, length(w) - 10)) AS g(k)),
span AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS p FROM doc, unnest(range(1, length(w) - 10)) AS g(k))
SELECT DISTINCT doc_id, item_id FROM span JOIN passage USING (p)""",
}
