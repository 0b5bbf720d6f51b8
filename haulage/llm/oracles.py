"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from haulage.llm import chat, licenses, line_dedup, variants


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_dedup_sql() -> str:
    """Windows of two lines with words compared by text; runs by window functions."""
    word, long, run = r"[^\x20\x09-\x0D]", line_dedup.LONG_CHARS, line_dedup.RUN_CHARS
    return rf"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
said AS (
  SELECT doc_id, i AS s, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next, line FROM (
    SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM texts)
  WHERE regexp_matches(line, '{word}')),
spans AS (
  SELECT doc_id, s, next AS e FROM said WHERE next IS NOT NULL
  UNION ALL SELECT doc_id, s, s FROM said WHERE length(line) >= {long}),
chunks AS (
  SELECT doc_id, s, e, array_to_string(x[s + 1:e + 1], chr(10)) AS chunk FROM spans JOIN texts USING (doc_id)),
places AS (
  SELECT *, first_value(doc_id) OVER w AS d0, first_value(s) OVER w AS s0, count(*) OVER (PARTITION BY chunk) AS n
  FROM chunks WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, s)),
begun AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM places WHERE n > 1),
numbered AS (
  SELECT *, sum((before IS NULL OR s > before)::INT) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run
  FROM begun),
runs AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY doc_id, run
  HAVING NOT bool_or(d0 = doc_id AND s0 = s) AND min(s0 - s) = max(s0 - s) AND min(d0) = max(d0)),
gone AS (
  SELECT doc_id, unnest(range(s, e + 1)) AS i FROM (
    SELECT r.*, x[s + 1:e + 1] AS part FROM runs r JOIN texts USING (doc_id))
  WHERE len(list_filter(part, lambda y: regexp_matches(y, '{word}'))) >= 2 AND length(array_to_string(part, chr(10))) >= {run}
     OR length(array_to_string(part, chr(10))) >= {long}),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS text,
         count(*) AS n, count(g.i) AS removed
  FROM (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM texts) l LEFT JOIN gone g USING (doc_id, i)
  GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""


def minhash_sql() -> str:
    """All pairs by common shingles, and reachability."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                 ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN component c USING (doc_id)"""


def decontaminate_sql() -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
         lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS x FROM items WHERE len(w) > 0),
docs AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) AS w FROM documents),
places AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i,
         unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS x
  FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
found AS (SELECT doc_id, i, p.m, item FROM places p JOIN windows USING (m, x)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
  SELECT doc_id, unnest(range(i, i + m)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
          FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)"""


def warc_sql() -> str:
    return """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS largest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM q"""


def chat_sql() -> str:
    def escaped(x: str) -> str:  # RE2 has no lookahead; no control string starts inside another's rest
        return rf"regexp_replace({x}, '([<\[]\\*)({chat._REST})', '\1\\\2', 'g')"

    other = sum(map(len, chat.OTHER_MARKS))
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.MARKS.items())
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length({escaped("text")}) + CASE role {marks} ELSE {other} + length({escaped("role")}) END AS chars FROM turns),
placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_examples,
       coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS example_chars
FROM placed GROUP BY conv_id"""


def licenses_sql() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for i, s in licenses.SENTENCES)
    clean = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    # RE2 has no lookahead: the end of a sentence is marked first
    cut = r"regexp_replace(regexp_replace(text, '[.;!?]+(\s|$)', chr(1) || '\1', 'g'), '\n[ \t\r]*\n', chr(1), 'g')"
    steps, left = [], "found"
    for n, (name, ids) in enumerate(licenses.RULES):
        pattern = licenses._pattern(ids)
        rest = "," + "".join(rf"\{k}," for k in range(1, len(ids)))
        steps.append(f"""r{n} AS (SELECT doc_id, ids, n,
          CASE WHEN regexp_matches(x, {_quoted(pattern)}) AND NOT list_contains(names, {_quoted(name)})
               THEN list_append(names, {_quoted(name)}) ELSE names END AS names,
          regexp_replace(x, {_quoted(pattern)}, {_quoted(rest)}, 'g') AS x FROM {left})""")
        left = f"r{n}"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, unnest(string_split({cut}, chr(1))) AS raw, unnest(range(len(string_split({cut}, chr(1))))) AS a
  FROM documents),
trimmed AS (SELECT doc_id, a, trim(raw, ' ' || chr(9) || chr(13) || chr(10)) AS raw FROM parts),
lines AS (
  SELECT doc_id, a, 0 AS b, raw FROM trimmed UNION ALL
  SELECT doc_id, a, unnest(range(1, len(string_split(raw, chr(10))) + 1)), unnest(string_split(raw, chr(10)))
  FROM trimmed WHERE contains(raw, chr(10))),
hits AS (SELECT doc_id, a, b, id FROM lines JOIN known ON {clean("raw")} = sentence),
found AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY a, b) AS ids, count(*) AS n, []::VARCHAR[] AS names,
         ',' || string_agg(',' || id || ',', '' ORDER BY a, b) || ',' AS x FROM hits GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, coalesce(array_to_string(r.names, ','), '') AS licenses, coalesce(r.ids, '') AS sentence_ids,
       coalesce(r.n, 0)::BIGINT AS n_sentences
FROM documents d LEFT JOIN {left} r USING (doc_id)"""


def variants_sql() -> str:
    """CRC-32 by its table of 256 entries, over each run's UTF-8 bytes (all
    runs are Latin-1); near words by the words with one letter left out."""
    v = variants
    steps, left = [], "SELECT range AS x, range AS i FROM range(256)"
    for n in range(8):
        steps.append(f"t{n} AS (SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({left}))")
        left = f"SELECT * FROM t{n}"
    code = "CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END"
    return rf"""
WITH RECURSIVE {", ".join(steps)},
crcs AS (SELECT list(x ORDER BY i) AS t FROM t7),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
many AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {v.LEAST_CHARS} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: {code})),
         lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) AS h FROM many, crcs),
spelt AS (
  SELECT CASE WHEN h % {v.DROP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {v.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {v.LEAST_COUNT}),
less AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS form, max(w.n) AS form_n
  FROM pairs JOIN words w ON pairs.b = w.word GROUP BY a),
rows AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {v.TIMES} * n THEN form END AS form,
         CASE WHEN form_n >= {v.TIMES} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
path(word, root) AS (
  SELECT word, word FROM rows UNION ALL SELECT p.word, r.form FROM path p JOIN rows r ON p.root = r.word WHERE r.form IS NOT NULL)
SELECT r.word, r.form, p.root, r.n, r.n_near, r.form_n
FROM rows r JOIN (SELECT p.word, p.root FROM path p JOIN rows e ON p.root = e.word WHERE e.form IS NULL) p USING (word)"""


def build() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup_sql(),
        "op2_minhash_dedup": minhash_sql(),
        "op6_decontaminate": decontaminate_sql(),
        "op8_warc": warc_sql(),
        "op9_chat_format": chat_sql(),
        "op10_license_scan": licenses_sql(),
        "op11_spelling_variants": variants_sql(),
    }
