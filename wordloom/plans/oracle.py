"""SQL that says what each query must return, for an independent engine (DuckDB).

Written from the rules, not from the DataFrame code: sentences are matched, not split;
"first" and "last" are ordered aggregates; lookups are joins on (word OR lemma).
"""

from __future__ import annotations

from wordloom.functions import html as H
from wordloom.functions.text import HIRAGANA, KATAKANA, WHITE_SPACE
from wordloom.plans.corpus import KANA_OF_LETTERS, LETTERS, WORD_PAIR


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"trim({x}, {_q(WHITE_SPACE)})"


def _kana(x: str) -> str:
    return f"translate(lower({x}), '{LETTERS}', '{KANA_OF_LETTERS}')"


def _hira(x: str) -> str:
    return f"translate({x}, '{KATAKANA}', '{HIRAGANA}')"


def _drop_ruby(x: str) -> str:
    for tag in ("rt", "rp"):
        x = f"regexp_replace({x}, '(?si)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    return x


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, {_q(H.ANY_TAG)}, '', 'g')"
    code = """CASE WHEN r[3:3] IN ('x', 'X') THEN ('0x' || r[4:-2])::INT ELSE r[3:-2]::INT END"""
    valid = f"(({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111)"
    named = " ".join(f"WHEN r = {_q(k)} THEN {_q(v)}" for k, v in H.ENTITIES)
    one = f"CASE {named} WHEN NOT starts_with(r, '&#') OR len(r) < 4 THEN r WHEN {valid} THEN chr({code}) ELSE chr(65533) END"
    pieces = f"regexp_extract_all({x}, {_q(H.REFERENCE_OR_TEXT)})"
    x = f"coalesce(array_to_string(list_transform({pieces}, lambda r: {one}), ''), '')"
    return _trim(f"regexp_replace({x}, '[ \\t\\n\\r\\f\\x{{a0}}]+', ' ', 'g')")


def _content(x: str) -> str:
    for element, _ in H.NON_CONTENT:
        x = f"regexp_replace({x}, {_q(element)}, ' ', 'g')"
    return x


def _key(*parts: str) -> str:
    framed = [f"length({p})::VARCHAR || ':' || {p}" for p in parts]
    return "md5(" + " || ".join(framed) + ")"


PIECE = _q("[^。！？\n]*[。！？\n]|[^。！？\n]+")
SPACE_CLASS = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = _q(r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}" + SPACE_CLASS + "]")
ASCII = _q(r"\A[\t\n\f\r\x20-\x7e]+\z")
IS_WORD = r"regexp_matches(surface, '\A[\p{L}\p{M}]')"
IS_NUMBER = r"regexp_matches(surface, '\A\p{N}')"
NOT_ASCII = f"NOT regexp_matches(surface, {ASCII})"


def _sentences(name: str, table: str, key: str, part: str | None = None) -> str:
    offset = f" + {part} * 4294967296" if part else ""
    columns = f"{key} AS source_id" + (f", {part}" if part else "")
    pieces = f"list_transform(regexp_extract_all(text, {PIECE}), lambda p: {_trim('p')})"
    return f"""
{name}_kept AS (
  SELECT {columns}, list_filter({pieces}, lambda p: p <> '') AS ps FROM {table}),
{name} AS (
  SELECT source_id, sentence, pos{offset} AS sentence_idx, md5(sentence) AS sentence_id FROM (
    SELECT *, unnest(ps) AS sentence, unnest(range(len(ps)))::BIGINT AS pos FROM {name}_kept))"""


def _tokens(name: str, sentences: str) -> str:
    return f"""
{name} AS (
  SELECT source_id, sentence_idx, sentence_id, unnest(ts) AS surface,
         unnest(range(len(ts)))::BIGINT AS token_idx
  FROM (SELECT *, regexp_extract_all(sentence, {TOKEN}) AS ts FROM {sentences}))"""


def _words(name: str, tokens: str, keep: str) -> str:
    return f"""
{name} AS (
  SELECT source_id, sentence_idx, sentence_id, token_idx, lower(surface) AS word
  FROM {tokens} WHERE {IS_WORD} AND {keep})"""


def _facts(name: str, words: str) -> str:
    return f"""
{name} AS (
  SELECT source_id, sentence_idx, sentence_id, word, count(*) AS n, min(token_idx) AS first_token_idx
  FROM {words} GROUP BY ALL)"""


DOC_SENTENCES = _sentences("ds", "documents", "doc_id")
TURN_SENTENCES = _sentences("ts", "conversations", "conv_id", "turn")
DOC_TOKENS = DOC_SENTENCES + "," + _tokens("dt", "ds")
TURN_TOKENS = TURN_SENTENCES + "," + _tokens("tt", "ts")
DOC_WORDS = DOC_TOKENS + "," + _words("dw", "dt", NOT_ASCII)
DOC_WORDS_ALL = DOC_TOKENS + "," + _words("dw", "dt", "true")
DOC_FACTS = DOC_WORDS + "," + _facts("df", "dw")
DOC_FACTS_ALL = DOC_WORDS_ALL + "," + _facts("df", "dw")
TURN_WORDS = TURN_TOKENS + "," + _words("tw", "tt", "true")
TURN_FACTS = TURN_WORDS + "," + _facts("tf", "tw")

TAGGED = (
    TURN_TOKENS
    + f""",
shaped AS (
  SELECT *, length(surface) AS size, {IS_WORD} AS is_word, {IS_NUMBER} AS is_number FROM tt),
tagged AS (
  SELECT source_id, sentence_idx, sentence_id, token_idx, surface,
    CASE WHEN is_number THEN '名詞' WHEN surface = '.' THEN '記号' WHEN NOT is_word THEN '補助記号'
         WHEN size <= 2 THEN '助詞' WHEN size = 3 THEN '助動詞' WHEN size = 5 THEN '動詞'
         ELSE '名詞' END AS primary_pos,
    (is_number OR (is_word AND size = 4)) AS numeral,
    CASE WHEN is_word THEN 8 ELSE 2 END AS n_features,
    CASE WHEN NOT is_word OR size >= 10 THEN surface WHEN size = 9 THEN ''
         ELSE lower(surface) END AS base_form,
    CASE WHEN NOT is_word OR surface <> lower(surface) THEN ''
         ELSE {_kana('surface')} END AS reading
  FROM shaped),
canonical AS (
  SELECT *, CASE WHEN base_form IN ('', '*') THEN surface ELSE base_form END AS word FROM tagged),
kept AS (
  SELECT * FROM canonical
  WHERE primary_pos NOT IN ('記号', '補助記号', '助詞', '助動詞') AND NOT numeral),
tagged_facts AS (
  SELECT source_id, sentence_idx, word, count(*) AS n, min(token_idx) AS first_token_idx,
    coalesce(first({_hira('reading')} ORDER BY token_idx) FILTER (WHERE reading <> ''), '') AS reading
  FROM kept GROUP BY ALL)"""
)

UPSERTED = (
    TAGGED
    + f""",
shaped_words AS (
  SELECT *, CASE WHEN length(reading) > 6 THEN '[' || reading || ']' ELSE '' END AS definitions
  FROM tagged_facts),
upserted AS (
  SELECT {_key('word', 'word', "'ja'")} AS word_id, word, word AS lemma, 'ja' AS language,
    coalesce(last(reading ORDER BY source_id, sentence_idx, first_token_idx)
             FILTER (WHERE reading <> ''), '') AS pronunciation,
    coalesce(last(definitions ORDER BY source_id, sentence_idx, first_token_idx)
             FILTER (WHERE definitions <> ''), '') AS definitions
  FROM shaped_words GROUP BY word)"""
)

_LINES = "string_split(text, chr(10))"
DICTIONARY = f"""
items AS (
  SELECT item_id::VARCHAR AS id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws,
    flatten(list_transform({_LINES}, lambda l: regexp_split_to_array(l, '[.] *'))) AS senses,
    flatten(list_transform({_LINES}, lambda l:
      CASE WHEN length(l) > 100 THEN ['n', 'vs'] ELSE ['n'] END)) AS pos
  FROM benchmark),
kanas AS (
  SELECT id, w, i, {_kana('w')} AS k
  FROM (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM items)),
terms AS (
  SELECT unnest(ws) AS term, id FROM items WHERE length(text) >= 150
  UNION SELECT k, id FROM kanas),
readings AS (SELECT DISTINCT id, {_hira('k')} AS reading FROM kanas),
primaries AS (
  SELECT id, {_hira("coalesce(first(k ORDER BY i) FILTER (WHERE length(w) % 2 = 0), first(k ORDER BY i))")} AS reading
  FROM kanas GROUP BY id)"""

CORPUS_WORDS = (
    DOC_WORDS_ALL
    + f""",
plain AS (SELECT DISTINCT word AS w FROM dw),
words AS (
  SELECT CASE WHEN length(w) % 5 = 0 THEN {_kana('w')} ELSE w END AS word,
    regexp_replace(w, '(s|ed|ing)$', '') AS lemma,
    CASE length(w) % 3 WHEN 0 THEN '' WHEN 1 THEN {_kana('w')} ELSE {_kana('reverse(w)')} END
      AS pronunciation,
    CASE WHEN length(w) % 2 = 0 THEN {_kana('w')} ELSE '' END AS reading
  FROM plain)"""
)

_FOUND = """
found AS MATERIALIZED (
  SELECT DISTINCT word, lemma, pronunciation, id FROM words JOIN terms ON term = word
  UNION
  SELECT DISTINCT word, lemma, pronunciation, id FROM words JOIN terms ON term = lemma)"""
LOOKUPS = CORPUS_WORDS + "," + DICTIONARY + "," + _FOUND
STRICT = (
    LOOKUPS
    + f""",
strict AS MATERIALIZED (
  SELECT DISTINCT f.* FROM found f LEFT JOIN readings r
    ON r.id = f.id AND r.reading = {_hira('f.pronunciation')}
  WHERE pronunciation = '' OR r.id IS NOT NULL)"""
)


def _json(x: str) -> str:
    x = f"to_json({x})::VARCHAR"
    for char in "&<>":
        x = f"replace({x}, '{char}', '\\u{ord(char):04x}')"
    return x


_DEFS = _json("list({'senses': i.senses, 'pos': i.pos} ORDER BY i.id)")
STRICT_DEFS = (
    STRICT
    + f""",
defs AS MATERIALIZED (
  SELECT word, lemma, pronunciation, {_DEFS} AS definitions
  FROM strict s JOIN items i ON i.id = s.id GROUP BY ALL)"""
)
BACKFILL = (
    STRICT_DEFS
    + """,
before AS (
  SELECT word, lemma, pronunciation,
    CASE length(word) % 4 WHEN 0 THEN '[{"senses":["kept"],"pos":null}]'
      WHEN 1 THEN NULL ELSE '' END AS old FROM words),
backfilled AS (
  SELECT b.word, b.lemma, b.pronunciation,
    CASE WHEN coalesce(old, '') <> '' THEN old ELSE coalesce(d.definitions, '') END AS definitions,
    CASE WHEN coalesce(old, '') = '' AND d.definitions IS NOT NULL THEN 1 ELSE 0 END AS updated
  FROM before b LEFT JOIN defs d
    ON d.word = b.word AND d.lemma = b.lemma AND d.pronunciation = b.pronunciation)"""
)

# From each position the longest term, else one character; a step leads to the next position.
LONGEST_MATCH = rf"""
runs AS (
  SELECT source_id, sentence_idx, regexp_replace(lower(sentence), '\s+', '', 'g') AS run FROM ts),
lexicon AS (
  SELECT DISTINCT term, length(term) AS size FROM terms WHERE term <> ''
  UNION SELECT regexp_replace(pair, '\s+', '', 'g'), length(regexp_replace(pair, '\s+', '', 'g'))
  FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD_PAIR}')) AS pair FROM benchmark)),
sizes AS (SELECT DISTINCT size FROM lexicon),
starts AS (SELECT *, unnest(range(1, length(run) + 1)) AS spot FROM runs),
longest AS (
  SELECT source_id, sentence_idx, spot, max(l.size) AS size
  FROM (SELECT *, substring(run, spot, size) AS span FROM starts, sizes) s
  JOIN lexicon l ON l.term = s.span AND l.size = s.size GROUP BY ALL),
walk AS (
  SELECT source_id, sentence_idx, run, 1::BIGINT AS spot FROM runs WHERE run <> ''
  UNION ALL
  SELECT w.source_id, w.sentence_idx, w.run, w.spot + coalesce(l.size, 1)
  FROM walk w LEFT JOIN longest l USING (source_id, sentence_idx, spot)
  WHERE w.spot + coalesce(l.size, 1) <= length(w.run)),
steps AS (
  SELECT w.*, l.size FROM walk w LEFT JOIN longest l USING (source_id, sentence_idx, spot)),
grouped AS (
  SELECT *, count(size) OVER (
    PARTITION BY source_id, sentence_idx ORDER BY spot) AS terms_before FROM steps),
cut AS (
  SELECT source_id, sentence_idx, spot, 0::BIGINT AS piece_no,
    substring(run, spot, size) AS surface, true AS in_lexicon,
    {_kana("substring(run, spot, size)")} AS reading
  FROM grouped WHERE size IS NOT NULL
  UNION ALL
  SELECT source_id, sentence_idx, spot, unnest(range(len(ps)))::BIGINT, unnest(ps), false, ''
  FROM (SELECT source_id, sentence_idx, min(spot) AS spot,
          regexp_extract_all(string_agg(substring(run, spot, 1), '' ORDER BY spot),
            '[\p{{L}}\p{{M}}]+|\p{{N}}+|[^{SPACE_CLASS}]') AS ps
        FROM grouped WHERE size IS NULL
        GROUP BY source_id, sentence_idx, terms_before))"""

_HOST = f"lower(regexp_extract(url, {_q(H.URL_HOST)}, 1))"
ARTICLES = f"""
marked AS (
  SELECT page_id, {_HOST} AS host,
    regexp_split_to_array({_content(_drop_ruby('html'))}, {_q(H.BLOCK_TAG)}) AS ms
  FROM pages WHERE strlen(html) < 10485760),
pieces AS (
  SELECT page_id, host, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM marked),
blocks AS (
  SELECT page_id, host, i, {_plain('m')} AS block,
    coalesce(list_sum(list_transform(regexp_extract_all(m, {_q(H.LINK)}),
      lambda a: length({_plain('a')}))), 0) AS link_chars
  FROM pieces),
texts AS (SELECT * FROM blocks WHERE block <> ''),
contents AS (
  SELECT page_id, host, string_agg(block, chr(10) ORDER BY i) AS content FROM texts GROUP BY page_id, host),
repeats AS (
  SELECT host, block FROM texts JOIN contents USING (page_id, host)
  JOIN (SELECT host, count(DISTINCT content) AS of FROM contents GROUP BY host) USING (host)
  GROUP BY host, block, of HAVING count(DISTINCT content) >= 3 AND count(DISTINCT content) > 0.1 * of),
candidates AS (
  SELECT t.*, r.block IS NULL AS own FROM texts t LEFT JOIN repeats r USING (host, block)
  WHERE link_chars <= 0.5 * length(t.block)),
variants AS (
  SELECT page_id, coalesce(sum(length(block)) FILTER (own), 0) < 0.3 * sum(length(block)) AS whole
  FROM candidates GROUP BY page_id),
kept_blocks AS (SELECT * FROM candidates JOIN variants USING (page_id) WHERE own OR whole),
articles AS (
  SELECT m.page_id, count(k.block) AS n_blocks,
    coalesce(string_agg(k.block, chr(10) ORDER BY k.i), '') AS text
  FROM marked m LEFT JOIN kept_blocks k USING (page_id) GROUP BY m.page_id)"""

PAGE_FACTS = ",".join(
    [
        _sentences("ps", "articles", "page_id"),
        _tokens("pt", "ps"),
        _words("pw", "pt", "true"),
        _facts("page_facts", "pw"),
    ]
)

_META = "regexp_extract(regexp_extract(html, {0}), " + _q(H.CONTENT) + ", 1)"
_PAGE_SOURCES = f"""
  SELECT page_id AS source_id, 'website_article' AS source_type,
    {_plain(f"regexp_extract(html, {_q(H.TITLE)}, 1)")} AS title,
    {_plain(_META.format(_q(H.META_AUTHOR)))} AS author,
    CASE WHEN {_plain(_META.format(_q(H.META_SITE)))} <> ''
      THEN {_plain(_META.format(_q(H.META_SITE)))} ELSE {_HOST} END AS website,
    url, '' AS meta
  FROM pages"""

_WORD_SOURCES = """
  SELECT source_id, word, sum(n)::BIGINT AS occurrence_count,
    min(sentence_idx) AS first_sentence_idx, max(sentence_idx) AS last_sentence_idx
  FROM df GROUP BY ALL"""
_LATEST = """
  SELECT source_id, word, arg_max(sentence_id, sentence_idx) AS context_sentence_id
  FROM df GROUP BY ALL"""
_LIVE = """(source_id % 2 = 0 OR source_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
_COUNTS = "SELECT source_id, word, sum(n)::BIGINT AS occurrence_count FROM {0} GROUP BY ALL"
_FIRST_FIVE = """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, word ORDER BY sentence_idx) AS context_no
    FROM (SELECT source_id, word, sentence_id, min(sentence_idx) AS sentence_idx
          FROM {0} GROUP BY ALL))
  WHERE context_no <= 5"""
_IN_ORDER = """
  SELECT source_id, word, row_number() OVER (PARTITION BY source_id ORDER BY s, t) AS word_no
  FROM (SELECT source_id, word, min(sentence_idx) AS s,
          arg_min(first_token_idx, sentence_idx) AS t FROM {0} GROUP BY ALL)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def oracle_sql() -> dict[str, str]:
    doc_counts = _with(DOC_FACTS, _COUNTS.format("df"))
    sql = {
        "src_pages_gate": """
            SELECT page_id, strlen(html)::BIGINT AS html_bytes,
              CASE WHEN strlen(html) < 10485760 THEN 'accepted' ELSE 'rejected' END AS status
            FROM pages""",
        "src_raw_pages": """
            WITH p AS (
              SELECT page_id, page_id % 6 AS kind, coalesce(html, '') AS html,
                page_id % 7 = 3 AS refused, NOT regexp_matches(coalesce(html, ''), '[^\\x00-\\xFF]') AS narrow FROM pages),
            told AS (
              SELECT *, CASE WHEN refused THEN 'status' WHEN kind = 3 THEN 'unknown charset'
                  WHEN kind IN (4, 5) THEN 'undecodable' ELSE 'accepted' END AS status,
                CASE kind WHEN 1 THEN CASE WHEN narrow THEN 'iso-8859-1' ELSE 'utf-8' END
                  WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'x-unheard-of' WHEN 4 THEN 'utf-16be' ELSE 'utf-8' END AS charset
              FROM p)
            SELECT page_id, charset, status, CASE WHEN status = 'accepted' THEN
              md5(CASE WHEN kind = 1 AND narrow THEN '<meta charset="iso-8859-1">' || html ELSE html END) END AS html_id
            FROM told""",
        "src_documents": """
            SELECT doc_id AS source_id, length(text)::BIGINT AS n_chars, md5(text) AS content_id
            FROM documents""",
        "dict_load": _with(
            DICTIONARY,
            """SELECT i.id AS entry_id,
                 CASE WHEN length(text) >= 150 THEN len(ws) ELSE 0 END::BIGINT AS n_kanji,
                 (SELECT string_agg(k, ' ' ORDER BY n.i) FROM kanas n WHERE n.id = i.id) AS kana,
                 (SELECT count(*) FROM kanas n WHERE n.id = i.id AND length(w) % 2 = 0) AS n_common,
                 array_to_string(senses, '|') AS senses, array_to_string(pos, '|') AS pos
               FROM items i""",
        ),
        "sink_roundtrip": _with(
            DOC_FACTS_ALL,
            f"""SELECT {_key('word', 'word', 'lang')} AS word_id, source_id, word,
                 sum(n)::BIGINT AS occurrence_count,
                 arg_max(sentence_id, sentence_idx) AS context_sentence_id,
                 arg_max(sentence_id, sentence_idx) AS example_sentence_id
               FROM df JOIN documents ON doc_id = source_id GROUP BY source_id, word, lang""",
        ),
        "view_words": _with(
            DOC_FACTS_ALL,
            f"""SELECT DISTINCT {_key('word', 'word', 'lang')} AS word_id, word, word AS lemma,
                 lang AS language, '' AS pronunciation FROM df JOIN documents ON doc_id = source_id""",
        ),
        "view_contexts": _with(DOC_FACTS_ALL, _FIRST_FIVE.format("df")),
        "view_sentences": _with(DOC_SENTENCES, "SELECT DISTINCT sentence_id, sentence FROM ds"),
        "view_sources": f"""
            SELECT {_key('url', 'title', 'author')} AS source_id, source_type, title, author, website, url, meta
            FROM ({_PAGE_SOURCES}) GROUP BY ALL""",
        "pages_ingest": _with(
            ARTICLES + "," + PAGE_FACTS,
            """SELECT word, 2 * sum(n)::BIGINT AS occurrences, 2 * count(DISTINCT url) AS sources
               FROM page_facts JOIN pages ON page_id = source_id GROUP BY word""",
        ),
        "stream_replay": _with(DOC_FACTS_ALL, _COUNTS.format("df")),
        "resume_edited": _with(
            DOC_FACTS_ALL,
            """SELECT source_id, word, sum(n)::BIGINT AS occurrence_count FROM (
                 SELECT source_id, word, n FROM df
                 UNION ALL SELECT source_id, word, n FROM df JOIN documents ON doc_id = source_id WHERE lang = 'de'
                 UNION ALL SELECT doc_id, unnest(['étrange', 'ajout']), 1 FROM documents WHERE lang = 'fr'
                 UNION ALL SELECT doc_id, 'ünd', 1 FROM documents WHERE lang = 'de') GROUP BY ALL""",
        ),
        "retract_store": _with(
            DOC_FACTS_ALL,
            """SELECT 'words' AS view, count(DISTINCT (word, lang)) AS n, count(DISTINCT (word, lang))::BIGINT AS total
               FROM live_facts JOIN documents ON doc_id = source_id
               UNION ALL SELECT 'word_sources', count(DISTINCT (source_id, word)), sum(n)::BIGINT FROM live_facts
               UNION ALL SELECT 'word_contexts', sum(least(c, 5))::BIGINT, sum(least(c, 5))::BIGINT FROM (
                 SELECT source_id, word, count(DISTINCT sentence_id) AS c FROM live_facts GROUP BY ALL)
               UNION ALL SELECT 'sentences', count(DISTINCT sentence), count(DISTINCT sentence)::BIGINT FROM live_ds
               UNION ALL SELECT 'sources', 0, 0""".replace("live_facts", f"(SELECT * FROM df WHERE {_LIVE}) x")
            .replace("live_ds", f"(SELECT * FROM ds WHERE {_LIVE}) x"),
        ),
        "store_backfill": _with(
            DOC_WORDS_ALL + "," + DICTIONARY,
            f"""SELECT {_key('word', 'word', 'lang')} AS word_id, word, {_DEFS} AS definitions
               FROM (SELECT DISTINCT word, lang, t.id FROM dw JOIN documents ON doc_id = source_id
                     JOIN terms t ON term = word) f JOIN items i ON i.id = f.id GROUP BY word, lang""",
        ),
        "strip_ruby": r"""
            SELECT doc_id AS source_id, {0} AS html FROM (
              SELECT doc_id, regexp_replace(text, '(\p{{L}}{{5,}})',
                '<ruby>\1<rp>(</rp><rt class="r">\1</rt><rp>)</rp></ruby>', 'g') AS html
              FROM documents)""".format(_drop_ruby("html")),
        "main_text_blocks": _with(ARTICLES, "SELECT * FROM articles"),
        "page_metadata": _PAGE_SOURCES,
        "split_sentences_raw": f"""
            WITH kept AS (
              SELECT doc_id AS source_id, list_filter(regexp_extract_all(text, {PIECE}),
                lambda p: {_trim('p')} <> '') AS ps FROM documents)
            SELECT source_id, unnest(range(len(ps)))::BIGINT AS sentence_idx,
              unnest(ps) AS sentence FROM kept""",
        "split_sentences": _with(
            DOC_SENTENCES, "SELECT source_id, sentence_idx, sentence FROM ds"
        ),
        "to_hiragana": f"SELECT doc_id AS source_id, {_hira(_kana('text'))} AS text FROM documents",
        "unicode_trim": f"""
            SELECT source_id, piece_no, {_trim('piece')} AS text, length(piece) + 7 AS padded_chars
            FROM (SELECT doc_id AS source_id, unnest(ps) AS piece,
                    unnest(range(len(ps)))::BIGINT AS piece_no
                  FROM (SELECT doc_id, regexp_extract_all(text, {PIECE}) AS ps FROM documents))""",
        "tokenize_spaced": _with(
            DOC_TOKENS,
            f"""SELECT source_id, sentence_idx, token_idx, surface, lower(surface) AS base_form,
                 CASE WHEN {IS_WORD} OR {IS_NUMBER} THEN '名詞' ELSE '記号' END AS primary_pos
               FROM dt""",
        ),
        "tokenize_lexicon": "WITH RECURSIVE "
        + (TURN_SENTENCES + "," + DICTIONARY + "," + LONGEST_MATCH).strip()
        + """
            SELECT source_id, sentence_idx,
              row_number() OVER (
                PARTITION BY source_id, sentence_idx ORDER BY spot, piece_no) - 1 AS token_idx,
              surface, in_lexicon, reading FROM cut""",
        "tokenize_plugged": _with(
            TURN_SENTENCES,
            f"""SELECT source_id, lower(t) AS word, count(*) AS occurrence_count
               FROM (SELECT source_id, unnest(regexp_extract_all(sentence, '[^{SPACE_CLASS}]+')) AS t
                     FROM ts) GROUP BY ALL""",
        ),
        "analysed_word_counts": _with(
            TURN_SENTENCES,
            f"""SELECT source_id, sentence_idx, lower(t) AS word, count(*) AS n,
                 min(i) AS first_token_idx, '' AS reading
               FROM (SELECT source_id, sentence_idx, unnest(xs) AS t,
                       unnest(range(len(xs)))::BIGINT AS i
                     FROM (SELECT *, regexp_extract_all(sentence, '[^{SPACE_CLASS}]+') AS xs FROM ts))
               GROUP BY ALL""",
        ),
        "token_features": _with(
            TAGGED,
            """SELECT source_id, sentence_idx, token_idx, surface, base_form, reading, primary_pos,
                 n_features::BIGINT AS n_features FROM tagged""",
        ),
        "canonical_word": _with(
            TAGGED, "SELECT source_id, sentence_idx, token_idx, word FROM canonical"
        ),
        "pos_filter": _with(
            TAGGED, "SELECT source_id, sentence_idx, token_idx, surface FROM kept"
        ),
        "ascii_filter": _with(
            DOC_TOKENS,
            f"SELECT source_id, sentence_idx, token_idx, surface FROM dt WHERE {NOT_ASCII}",
        ),
        "sentence_word_counts": _with(
            DOC_FACTS, "SELECT source_id, sentence_idx, word, n, first_token_idx FROM df"
        ),
        "sentence_word_counts_all": _with(
            DOC_FACTS_ALL, "SELECT source_id, sentence_idx, word, n, first_token_idx FROM df"
        ),
        "first_reading": _with(
            TAGGED,
            "SELECT source_id, sentence_idx, word, n, first_token_idx, reading FROM tagged_facts",
        ),
        "resume_filter": _with(
            DOC_SENTENCES,
            """SELECT source_id, sentence_idx FROM ds
               JOIN (SELECT source_id, max(sentence_idx) AS last FROM ds GROUP BY 1) USING (source_id)
               JOIN documents ON doc_id = source_id
               WHERE sentence_idx > CASE WHEN lang IN ('de', 'fr') THEN -1 ELSE last // 2 END""",
        ),
        "validate_facts": r"""
            SELECT conv_id AS source_id, turn AS n, word, count(*) AS times,
              CASE WHEN role = 'system' THEN 'source_type must be non-empty'
                WHEN word = '' THEN 'word must be non-empty'
                WHEN conv_id <= 0 THEN 'source_id must be positive'
                WHEN turn < 1 THEN 'increment must be positive' ELSE '' END AS reason
            FROM (SELECT *, unnest(regexp_split_to_array(text, '[^\p{L}]')) AS word
                  FROM conversations) GROUP BY ALL""",
        "occurrence_counts": doc_counts,
        "occurrence_counts_all": _with(DOC_FACTS_ALL, _COUNTS.format("df")),
        "total_links_all": _with(DOC_FACTS_ALL, "SELECT sum(n)::BIGINT AS links FROM df"),
        "word_sources_all": _with(DOC_FACTS_ALL, _WORD_SOURCES),
        "latest_context_all": _with(DOC_FACTS_ALL, _LATEST),
        "top_contexts_all": _with(DOC_FACTS_ALL, _FIRST_FIVE.format("df")),
        "words_in_order_all": _with(DOC_FACTS_ALL, _IN_ORDER.format("df")),
        "total_links": _with(DOC_FACTS, "SELECT sum(n)::BIGINT AS links FROM df"),
        "source_progress": _with(
            DOC_SENTENCES + "," + TURN_SENTENCES,
            """SELECT source_id, max(sentence_idx) AS last_processed, 'document' AS kind
               FROM ds GROUP BY source_id
               UNION ALL
               SELECT source_id, max(sentence_idx), 'conversation' FROM ts GROUP BY source_id""",
        ),
        "word_sources": _with(DOC_FACTS, _WORD_SOURCES),
        "latest_context": _with(DOC_FACTS, _LATEST),
        "top_contexts": _with(DOC_FACTS, _FIRST_FIVE.format("df")),
        "top_contexts_turns": _with(TURN_FACTS, _FIRST_FIVE.format("tf")),
        "words_in_order": _with(DOC_FACTS, _IN_ORDER.format("df")),
        "words_in_order_turns": _with(TURN_FACTS, _IN_ORDER.format("tf")),
        "words_upsert": _with(UPSERTED, "SELECT * FROM upserted"),
        "words_by_source": _with(
            UPSERTED,
            """SELECT u.*, '' AS image_url, l.source_id FROM upserted u
               JOIN (SELECT DISTINCT source_id, word FROM tagged_facts) l USING (word)""",
        ),
        "sources_dedup": f"""
            SELECT {_key('url', 'title', 'author')} AS source_key, url, title, author,
              'document' AS source_type, 'https://' || title AS website,
              first(n_chars ORDER BY doc_id)::VARCHAR AS meta
            FROM (SELECT doc_id, '' AS url, source AS title, lang AS author, n_chars
                  FROM documents WHERE lang <> 'es')
            GROUP BY url, title, author""",
        "page_sources": f"""
            SELECT {_key('url', 'title', 'author')} AS source_key, url, title, author,
              first(source_type ORDER BY source_id) AS source_type,
              first(website ORDER BY source_id) AS website, first(meta ORDER BY source_id) AS meta
            FROM ({_PAGE_SOURCES}) GROUP BY url, title, author""",
        "sentences_distinct": _with(
            DOC_SENTENCES + "," + TURN_SENTENCES,
            """SELECT sentence_id, sentence FROM ds UNION SELECT sentence_id, sentence FROM ts""",
        ),
        "insert_ignore": _with(
            DOC_WORDS_ALL + "," + TURN_WORDS,
            """SELECT word, min(source_id) AS first_source, 'document' AS origin
               FROM dw GROUP BY word
               UNION ALL
               SELECT word, min(source_id), 'conversation' FROM tw
               WHERE word NOT IN (SELECT word FROM dw) GROUP BY word""",
        ),
        "orphan_check": _with(
            DOC_FACTS,
            _COUNTS.format("(SELECT * FROM df WHERE source_id NOT IN (SELECT doc_id FROM labels))"),
        ),
        "retract_source": _with(
            DOC_FACTS,
            """SELECT word, sum(n)::BIGINT AS occurrences, count(DISTINCT source_id) AS sources
               FROM df WHERE source_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
               GROUP BY word""",
        ),
        "dict_index": _with(DICTIONARY, "SELECT term, id AS entry_id FROM terms"),
        "format_definitions": _with(
            DICTIONARY,
            f"""SELECT id AS entry_id, {_json("[{'senses': senses, 'pos': pos}]")} AS definitions
                FROM items""",
        ),
        "primary_reading": _with(
            DICTIONARY,
            "SELECT i.id AS entry_id, p.reading FROM items i LEFT JOIN primaries p USING (id)",
        ),
        "dict_lookup": _with(
            LOOKUPS,
            """SELECT word, lemma, id AS entry_id,
                 row_number() OVER (PARTITION BY word, lemma ORDER BY id) AS match_no FROM found""",
        ),
        "dict_lookup_reading": _with(
            STRICT,
            """SELECT word, lemma, pronunciation, id AS entry_id, row_number()
                 OVER (PARTITION BY word, lemma, pronunciation ORDER BY id) AS match_no
               FROM strict""",
        ),
        "definitions_json": _with(
            STRICT_DEFS,
            """SELECT w.word, w.lemma, w.pronunciation, coalesce(definitions, '') AS definitions
               FROM words w LEFT JOIN defs d ON d.word = w.word AND d.lemma = w.lemma
                 AND d.pronunciation = w.pronunciation""",
        ),
        "enrich_words": _with(
            CORPUS_WORDS
            + ","
            + DICTIONARY
            + f""",
lax AS (
  SELECT t.term, {_DEFS} AS definitions, min(i.id) AS first_id
  FROM terms t JOIN items i ON i.id = t.id GROUP BY t.term)""",
            """SELECT w.word, coalesce(p.reading, w.reading) AS pronunciation,
                 coalesce(l.definitions, '') AS definitions
               FROM words w LEFT JOIN lax l ON l.term = w.word
               LEFT JOIN primaries p ON p.id = l.first_id""",
        ),
        "backfill_definitions": _with(BACKFILL, "SELECT * FROM backfilled"),
        "backfill_count": _with(BACKFILL, "SELECT sum(updated)::BIGINT AS updated FROM backfilled"),
        "page_vocabulary": _with(
            ARTICLES
            + ","
            + _sentences("ps", "articles", "page_id")
            + ","
            + _tokens("pt", "ps")
            + ","
            + _words("pw", "pt", "true"),
            "SELECT source_id, word, count(*) AS occurrence_count FROM pw GROUP BY ALL",
        ),
        "stream_ingest": doc_counts,
        "stream_running_counts": doc_counts,
        "stream_running_vocabulary": _with(
            TURN_FACTS,
            f"""SELECT c.*, p.occurrence_count, p.context_sentence_id FROM ({_FIRST_FIVE.format("tf")}) c JOIN (
                  SELECT source_id, word, sum(n)::BIGINT AS occurrence_count,
                    arg_max(sentence_id, sentence_idx) AS context_sentence_id
                  FROM tf GROUP BY ALL) p USING (source_id, word)""",
        ),
    }
    # Other ways to the same rows.
    sql["dict_load_split"] = sql["dict_load"]
    sql["enrich_words_sifted"] = sql["enrich_words"]
    # A view kept up by deltas is the view of the whole log.
    sql["view_refreshed_links"] = sql["sink_roundtrip"]
    for view in ("contexts", "words", "sentences"):
        sql[f"view_refreshed_{view}"] = sql[f"view_{view}"]
    return sql
