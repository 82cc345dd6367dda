"""The queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from seqcast.llm.licenses import LOWER, RULES, UPPER, known_sentences

_SAID = known_sentences()
_NUMBER = {name: i + 1 for i, name in enumerate(dict.fromkeys(_SAID.values()))}
_KNOWN = ", ".join(f"('{s}', {_NUMBER[name]})" for s, name in _SAID.items())
_RULES = ", ".join(f"('{rule}', '{license}', {[_NUMBER[s] for s in run]}, {k})"
                   for k, (rule, (license, run)) in enumerate(sorted(RULES.items(), key=lambda r: -len(r[1][1]))))
_LONGEST = max(len(run) for _, run in RULES.values())
_MOST_LINES = max(s.count(" ") + 1 for s in _SAID)

OP1 = f"""
WITH known(sentence, n) AS (VALUES {_KNOWN}),
rules(rule, license, run, k) AS (VALUES {_RULES}),
normal AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '([.!?;:])(?:[ \t\r\x0B\x0C]+|\n)', '\1\n\n', 'g'),
                                       '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM documents),
paragraphs AS (SELECT r, doc_id, unnest(regexp_split_to_array(t, '\n\n+')) AS p, generate_subscripts(regexp_split_to_array(t, '\n\n+'), 1) AS a FROM normal),
cut AS (SELECT r, doc_id, a, list_filter(list_transform(string_split(p, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM paragraphs),
lines AS (SELECT r, doc_id, a, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut),
runs AS (SELECT r, a, i, k, array_to_string(lines[i : i + k - 1], ' ') AS sentence
         FROM (SELECT *, unnest(range(1, least({_MOST_LINES}, len(lines) - i + 1) + 1)) AS k FROM lines)),
said AS (SELECT r, a, i, max(k) AS k, max_by(n, k) AS n FROM runs JOIN known USING (sentence) GROUP BY ALL),
reached AS (SELECT r, doc_id, a, i, said.k, said.n, max(i + said.k) OVER (PARTITION BY r, a ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over
            FROM lines LEFT JOIN said USING (r, a, i)),
sentences AS (SELECT r, doc_id, n, row_number() OVER (PARTITION BY r ORDER BY a, i) AS place FROM reached WHERE over IS NULL OR over <= i),
hits AS (SELECT r, doc_id, place, n FROM sentences WHERE n IS NOT NULL),
following AS (
  SELECT r, doc_id, place, list(n) OVER w AS ns, list(place) OVER w AS ats
  FROM hits WINDOW w AS (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND {_LONGEST - 1} FOLLOWING)),
fits AS (
  SELECT f.r, f.doc_id, f.place, u.license, u.rule, len(u.run) AS n,
         row_number() OVER (PARTITION BY f.r, f.place ORDER BY u.k) AS best
  FROM following f JOIN rules u
    ON f.ns[1:len(u.run)] = u.run AND f.ats[len(u.run)] = f.place + len(u.run) - 1),
chosen AS (
  SELECT *, max(place + n) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM fits WHERE best = 1)
SELECT doc_id, license, rule, CAST(place AS BIGINT) AS first_sentence, CAST(n AS BIGINT) AS n_sentences
FROM chosen WHERE reached IS NULL OR reached < place + n
"""

OP5 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
           FROM pages),
q AS (SELECT *, coalesce(payload_bytes >= 1000 AND page_id <> keeper, FALSE) AS again FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to
FROM q
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(text, '{_TERM}'), lambda t: translate(t, '{UPPER}', '{LOWER}')) AS terms
               FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct(list_transform(regexp_extract_all(text, '{_TERM}'), lambda t: translate(t, '{UPPER}', '{LOWER}'))) AS terms
          FROM benchmark WHERE text IS NOT NULL),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // total.terms)))) AS BIGINT) AS score
  FROM (SELECT i, item_id, unnest(terms) AS term FROM items) JOIN tf USING (term) JOIN w USING (term), total GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}'), []) AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}') AS words FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, words[p : p + least(len(words), 10) - 1] AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS p FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(w) AS size FROM windows),
runs AS (SELECT r, p, size, words[p : p + size - 1] AS w
         FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM d, sizes)),
hits AS (SELECT r, p, size, item_id FROM runs JOIN windows USING (w)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

ORACLES = {"op1_license_scan": OP1, "op5_warc": OP5, "op6_exact_dedup": OP6, "op11_lexical_search": OP11, "op13_decontamination": OP13}
