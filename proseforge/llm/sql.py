"""DuckDB SQL that states the same results as some of the queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

HOST_RULES = rf"""
WITH split AS (
  SELECT doc_id, coalesce('h:' || source, 'none') AS host, coalesce(text, '') AS text, {WORDS} AS words
  FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM split
), windows AS (
  SELECT doc_id, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d, lead(w, 4) OVER p AS e
  FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n FROM windows WHERE e IS NOT NULL
), reach AS (
  SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS words FROM twice WHERE n > 1
), repeated AS (
  SELECT doc_id, sum(words)::BIGINT AS n FROM reach GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM split
), measured AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
), failures AS (
  SELECT host, unnest(['base', 'word_length', 'symbols', 'dup_lines']) AS rule,
    unnest([base_failed, word_chars < 3 * n_words OR word_chars > 10 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines]) AS failed
  FROM based
), rates AS (
  SELECT host, rule, count(*) AS n, sum(failed::BIGINT) AS failed FROM failures GROUP BY host, rule
), moments AS (
  SELECT rule, sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) AS square FROM rates GROUP BY rule
), prior AS (
  SELECT rule, mean, CASE WHEN square - mean * mean > 1e-12
    THEN least(greatest(mean * (1 - mean) / (square - mean * mean) - 1, 1.0), 10000.0) ELSE 10000.0 END AS texts FROM moments
), verdicts AS (
  SELECT host, bool_or((failed + mean * texts) / (n + texts) > 0.5) AS host_rejected FROM rates JOIN prior USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM based JOIN verdicts USING (host)
"""


def mixing(entropy: float, max_epochs: float, block_tokens: int, seed: int, table: str = "documents") -> str:
    """(doc_id, source, n_tokens, epoch, slot) of the temperature mixture of ``table``."""
    def order(epoch: str) -> str:
        return f"md5(concat_ws(':', '{seed}:order', s, block::VARCHAR, ({epoch})::VARCHAR))"

    def at(x: str) -> str:
        """Entropy and most epochs at an exponent."""
        z = f"(SELECT sum(exp(({x}) * ln(n))) FROM usable)"
        return (f"ln({z}) - ({x}) * (SELECT sum(exp(({x}) * ln(n)) * ln(n)) FROM usable) / {z}",
                f"(SELECT sum(n) FROM usable) * (SELECT max(exp((({x}) - 1) * ln(n))) FROM usable) / {z}")

    middle = "(low + high) / 2"
    first = "SELECT s, block, whole + 1 AS epoch, n, rest FROM block_sizes JOIN shares USING (s) WHERE rest > 0"
    again = """SELECT f.s, f.block, f.epoch, f.n, f.rest - coalesce(u.used, 0)::BIGINT AS rest FROM {0} f
      LEFT JOIN (SELECT s, sum(n) AS used FROM {0} WHERE running <= rest GROUP BY s) u USING (s) WHERE f.running > f.rest"""
    fills = "".join(f"""), fill{i} AS (
  SELECT *, sum(n) OVER (PARTITION BY s ORDER BY {order("epoch")}) AS running FROM ({again.format(f"fill{i - 1}") if i else first}) WHERE n <= rest
""" for i in range(3)).rstrip()
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('s:' || source, 'none') AS s, len({WORDS})::BIGINT AS n FROM {table}
), sizes AS (
  SELECT s, sum(n)::BIGINT AS n, greatest(1, ceil(sum(n) / {block_tokens}.0))::BIGINT AS blocks FROM docs GROUP BY s
), usable AS (SELECT s, n::DOUBLE AS n FROM sizes WHERE n > 0
), target AS (SELECT {entropy} * ln(count(*)) AS h FROM usable
), even(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN h >= (SELECT h FROM target) THEN middle ELSE low END, CASE WHEN h >= (SELECT h FROM target) THEN high ELSE middle END
  FROM (SELECT step, low, high, {middle} AS middle, {at(middle)[0]} AS h FROM even WHERE step < 30)
), aimed AS (
  SELECT CASE WHEN {at("1.0")[0]} >= (SELECT h FROM target) THEN 1.0 ELSE (SELECT low FROM even WHERE step = 30) END AS x
), rare(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0 - (SELECT x FROM aimed)
  UNION ALL
  SELECT step + 1, CASE WHEN e <= {max_epochs} THEN middle ELSE low END, CASE WHEN e <= {max_epochs} THEN high ELSE middle END
  FROM (SELECT step, low, high, {middle} AS middle, {at("1.0 - " + middle)[1]} AS e FROM rare WHERE step < 30)
), found AS (
  SELECT CASE WHEN {at("(SELECT x FROM aimed)")[1]} > {max_epochs} THEN 1.0 - (SELECT low FROM rare WHERE step = 30) ELSE x END AS x FROM aimed
), quotas AS (
  SELECT s, n::BIGINT AS n, round(exp(ln(n) * x) / (SELECT sum(exp(ln(n) * x)) FROM usable, found) * (SELECT sum(n) FROM usable))::BIGINT AS quota FROM usable, found
), shares AS (SELECT s, quota // n AS whole, quota - (quota // n) * n AS rest FROM quotas
), dealt AS (
  SELECT docs.*, ('0x' || substr(md5(concat_ws(':', '{seed}:block', coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT % blocks AS block
  FROM docs JOIN sizes USING (s)
), block_sizes AS (SELECT s, block, sum(n)::BIGINT AS n FROM dealt GROUP BY s, block
), fully AS (
  SELECT s, block, unnest(range(1, whole + 1)) AS epoch FROM block_sizes JOIN shares USING (s)
{fills}
), taken AS (
  SELECT s, block, epoch FROM fully {"".join(f"UNION ALL SELECT s, block, epoch FROM fill{i} WHERE running <= rest " for i in range(3))}
), slots AS (SELECT s, block, epoch, row_number() OVER (ORDER BY {order("epoch")}) AS slot FROM taken)
SELECT doc_id, source, n AS n_tokens, epoch::BIGINT AS epoch, slot::BIGINT AS slot FROM dealt JOIN slots USING (s, block)
"""


WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""

NEAR_COPIES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), lists AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS s FROM words
), sets AS (SELECT doc_id, len(list_distinct(s))::BIGINT AS n FROM lists
), shingles AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM lists
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other
), parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN parts USING (doc_id)
"""

FIM = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS h FROM units
), placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""

_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

LEAKS = rf"""
WITH texts AS (SELECT doc_id, {_LETTERS} AS w FROM documents
), items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_LETTERS} AS w FROM benchmark
), begins AS (
  SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM items WHERE len(w) > 0
), windows AS (SELECT DISTINCT item, m, j, array_to_string(w[j:j + m - 1], ' ') AS g FROM begins
), sizes AS (SELECT DISTINCT m FROM windows
), places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM texts, sizes WHERE len(w) >= m
), found AS (
  SELECT doc_id, m, i, item, j FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM places) JOIN windows USING (m, g)
), hits AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM found)) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
), runs AS (
  SELECT doc_id, m, count(*) + m - 1 AS n FROM (
    SELECT DISTINCT doc_id, m, item, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, m, item, i - j ORDER BY i) AS run, i FROM found)
  GROUP BY doc_id, m, item, d, run
), longest AS (SELECT doc_id, max(CASE WHEN m < 10 THEN m ELSE n END)::BIGINT AS longest_words FROM runs GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_words, 0) AS longest_words
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

REPAIR = r"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS name
  FROM conversations
), coded AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(name, lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS code
  FROM plain
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, left(role, 1) AS r,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS words
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN words = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), leads(q, symbol, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserts(q, q2, k, lines) AS (
  VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (3, 2, 1, ['user:']),
    (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, i, 'D' AS e, 3 AS c, q, q AS q2, []::VARCHAR[] AS line FROM judged, (SELECT DISTINCT q2 AS q FROM inserts)
  UNION ALL SELECT conv_id, i, 'K', (fault = 't')::INT, q, q2, [role || ':' || text] FROM judged JOIN leads ON symbol = r WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, 'R', 2 + (fault = 't')::INT, q, q2, [CASE symbol WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
    FROM judged, leads WHERE symbol <> 's' AND fault NOT IN ('b', 'd')
), ways(conv_id, i, q, c, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT conv_id, i, q, w.c, w.audit, w.lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.q2 AS q,
      min({'c': w.c + 2 * s.k + e.c, 'audit': w.audit || repeat('I', s.k) || e.e, 'lines': w.lines || s.lines || e.line}) AS w
    FROM ways w JOIN inserts s ON s.q = w.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = s.q2
    GROUP BY 1, 2, 3)
), ended AS (
  SELECT w.conv_id, min({'c': w.c + 2 * s.k, 'audit': w.audit || repeat('I', s.k), 'lines': w.lines || s.lines}) AS w
  FROM ways w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN inserts s ON s.q = w.q WHERE s.q2 IN (0, 3) GROUP BY 1
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit,
  sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""
