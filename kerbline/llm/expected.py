"""The expected result of the queries that SQL can state."""

_TRANSLATE = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Template of the formatted text: <|turn|>role<|says|>text<|done|>, control strings inside escaped.
_CONTROLS = sorted(
    ["<|turn|>", "<|says|>", "<|done|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"],
    key=len,
    reverse=True,
)


def _escaped_length(column: str) -> str:
    text = f"replace({column}, '&', '&amp;')"
    for i, control in enumerate(_CONTROLS):
        text = f"replace({text}, '{control}', '&c{i};')"
    return f"length({text})"


_WORDS = f"regexp_extract_all({_TRANSLATE}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# Check sums in SQL: a table of 256 numbers, then one step per byte.
_CRC_TABLE = (
    "list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
)
# Letters of words are below U+0100, so a character is one or two bytes.
_BYTES = (
    "flatten(list_transform(string_split({0}, ''), lambda c: "
    "CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END))"
)

EXPECTED = {
    "op1_chat_format": f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum({_escaped_length('role')} + {_escaped_length('text')} + 24) AS formatted_chars
    FROM said GROUP BY conv_id
), walked AS (
    SELECT conv_id, role, row_number() OVER w AS nth, coalesce(lag(role) OVER w, '(start)') || '>' || role AS step
    FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), ended AS (
    SELECT conv_id, arg_max(role, nth) IN ('user', 'assistant') AS may_end, (min(nth) FILTER (step NOT IN (
        '(start)>system', '(start)>user', 'system>user', 'user>assistant', 'assistant>user')) - 1)::INT AS bad_turn
    FROM walked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars,
    sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
    bad_turn IS NULL AND may_end AS valid, bad_turn
FROM joined JOIN ended USING (conv_id)""",
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s
    FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM items)
), places AS (
    SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
    FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM windows))
), hits AS (SELECT doc_id, l, i, item_id FROM places JOIN windows USING (l, s)),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_exact_dedup": f"""
WITH normed AS (SELECT doc_id, {_TRANSLATE} AS norm FROM documents),
groups AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM normed GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM normed JOIN groups USING (norm)""",
    "op11_spelling": f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all({_TRANSLATE}, '[a-z\u00C0-\u00FF]+')) AS word FROM documents
), counted AS (SELECT doc_id, word, count(*) AS times FROM runs GROUP BY ALL),
steps AS (SELECT {_CRC_TABLE} AS t),
marked AS (
    SELECT word, times, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, {_BYTES.format("doc_id::VARCHAR || ':' || word")}),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
    )) AS h
    FROM counted, steps
), written AS (
    SELECT CASE WHEN h % 97 = 0 THEN word[:h % length(word)] || word[h % length(word) + 2:] ELSE word END AS word, times FROM marked
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), places AS (
    SELECT word, n, p, word[:p - 1] AS a, word[p + 1:] AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), shorter AS (SELECT DISTINCT word, n, a || z AS near FROM places),
near AS (
    SELECT x.word, y.word AS other, y.n AS other_n
    FROM places x JOIN places y ON x.p = y.p AND x.a = y.a AND x.z = y.z AND x.word <> y.word
    UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.near = w.word
    UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.near = w.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
        CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
), ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
    "op12_search": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
terms AS (SELECT doc_id, unnest(w) AS term FROM d),
whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(w) AS term FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) GROUP BY ALL
), bags AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM bags GROUP BY term), whole
), sizes AS (SELECT doc_id, 25 + (75 * len(w) * docs) // total AS m FROM d, whole WHERE len(w) > 0),
scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN bags USING (term) JOIN sizes USING (doc_id) GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10""",
    "op13_embedding_dedup": """
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings
    UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), labels AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
degrees AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM labels LEFT JOIN degrees USING (vec_id)""",
}
