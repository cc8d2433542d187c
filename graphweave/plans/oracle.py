"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from graphweave.functions.text import TOKEN
from graphweave.operators import context, search
from graphweave.operators.metadata import SMALL_WORDS

WS = r"[\s\x0B\x{85}\pZ]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def name_key(x: str) -> str:
    return sub(sub(strip(f"lower({x})"), r"[^\pL\pN_\s\x0B\x{85}\pZ-]"), WS + "+", " ")


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def weight(x: str) -> str:
    return f"greatest(0.0, least(1.0, CASE WHEN coalesce({x}, 0.8) > 1 THEN {x} / 10 ELSE coalesce({x}, 0.8) END))"


def kind(x: str) -> str:
    return f"coalesce(nullif(replace(upper({strip(x)}), ' ', '_'), ''), 'RELATED_TO')"


def label(x: str) -> str:
    return f"coalesce(nullif({sub(sub(sub(f'upper({strip(x)})', '[^A-Za-z0-9_]', '_'), '_+', '_'), r'^_|_\z')}, ''), 'RELATED_TO')"


CHUNKS = "chunks1 AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
EDGES = f"""edges AS (
  SELECT rel_id, source_entity, target_entity, {kind('relation_type')} AS relation_type, {label('relation_type')} AS label, description,
         {weight('weight')} AS weight, extracted_at
  FROM relationships QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY extracted_at DESC) = 1)"""
NAMED = "named AS (SELECT * FROM entities WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY entity_id) = 1)"
SEEDS = "seeds AS (SELECT entity_id AS question_id, name, 'What is ' || name || '?' AS question FROM entities WHERE entity_id % 50 = 0 AND name IS NOT NULL)"
LINKS = "links AS (SELECT * FROM (SELECT chunk_id AS a, lead(chunk_id) OVER (PARTITION BY file_hash ORDER BY chunk_index, chunk_id) AS b FROM chunks1 WHERE chunk_index IS NOT NULL) WHERE b IS NOT NULL)"
PROVENANCE = "provenance AS (SELECT DISTINCT e.name AS entity_name, c.chunk_id FROM (SELECT name, unnest(source_chunk_ids) AS chunk_id FROM entities WHERE name IS NOT NULL) e SEMI JOIN chunks1 c2 USING (chunk_id) JOIN chunks1 c USING (chunk_id))"
LINES = r"""rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"""


def _stripped_lines(x: str) -> str:
    return f"list_transform(string_split({x}, chr(10)), lambda l: {strip('l')})"


def _clean() -> str:
    x = sub("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    x = sub(x, r"([\pL\pN_]+)-\n([\pL\pN_]+)", r"\1\2")
    x = f"replace({x}, chr(9), ' ')"
    x = sub(x, rf"(?mi)^{WS}*(?:page{WS}+\p{{Nd}}+(?:{WS}+of{WS}+\p{{Nd}}+)?|confidential|draft|©.*\p{{Nd}}{{4}}){WS}*$")
    x = sub(x, rf"(?m)^{WS}*\p{{Nd}}{{1,5}}{WS}*$")
    x = sub(sub(x, " {2,}", " "), r"\n{3,}", r"\n\n".replace(r"\n", "\n"))
    return strip(f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {strip('l')} <> ''), chr(10))")


def _votes() -> str:
    cases = []
    for code, small in sorted(SMALL_WORDS.items()):
        words = ", ".join(f"'{w}'" for w in small.split())
        cases.append(f"len(list_filter(ws, lambda w: list_contains([{words}], w))) AS {code}_n")
    codes = sorted(SMALL_WORDS)
    most = "greatest(" + ", ".join(f"{c}_n" for c in codes) + ")"
    pick = " ".join(f"WHEN {c}_n = {most} THEN '{c}'" for c in codes)
    return rf"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(substring(text, 1, 2000)), '[^\pL]+') AS ws, text FROM documents),
n AS (SELECT doc_id, text, {", ".join(cases)} FROM w)
SELECT doc_id, CASE WHEN text IS NULL OR {most} = 0 THEN 'en' {pick} END AS language FROM n"""


def _title() -> str:
    s = _stripped_lines("text")
    bare = lambda x: strip(f"regexp_replace({x}, '^#+', '')")
    top = f"list_filter(list_transform(list_filter({s}, lambda l: starts_with(l, '# ')), lambda l: {bare('l')}), lambda l: length(l) BETWEEN 3 AND 200)[1]"
    other = f"list_filter(list_transform({s}, lambda l: {bare('l')}), lambda l: length(l) BETWEEN 3 AND 200 AND NOT starts_with(l, '<!--') AND NOT ends_with(l, '-->'))[1]"
    return rf"SELECT doc_id, coalesce({top}, {other}) AS title, len(regexp_extract_all(text, '[^\s\x0B\x{{85}}\pZ]+')) AS words FROM documents"


def _sections() -> str:
    s = strip("line")
    heading = rf"'^(#{{1,6}}){WS}+(.+)\z'"
    held, names = [], []
    for n in range(1, 7):
        held.append(f"max(CASE WHEN level = {n} THEN pos END) OVER upto AS p{n}, coalesce(max(CASE WHEN level < {n} THEN pos END) OVER upto, -1) AS q{n}, arg_max(title, CASE WHEN level = {n} THEN pos END) OVER upto AS t{n}")
        names.append(f"CASE WHEN p{n} > q{n} THEN t{n} END")
    return rf"""WITH {LINES}, marked AS (
  SELECT doc_id, pos, line, CASE WHEN regexp_matches({s}, {heading}) THEN length(regexp_extract({s}, {heading}, 1)) END AS level,
         {strip(f"regexp_extract({s}, {heading}, 2)")} AS title FROM rows),
held AS (
  SELECT doc_id, pos, line, level, count(level) OVER upto AS section_no,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, {", ".join(held)}
  FROM marked WINDOW upto AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, section_no::INT AS section_no, arg_min(concat_ws(' > ', {", ".join(names)}), pos) AS headings,
       coalesce(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY pos), '') AS body_text, min(start)::INT AS start_char
FROM held GROUP BY doc_id, section_no"""


def _units() -> str:
    """Tables are taken out line by line; stretches between them are cut at sentence ends and blank lines."""
    table = r"regexp_matches(line, '^\|.+\|$')"
    text = rf"""regexp_replace(regexp_replace(piece, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\n', chr(10) || chr(10) || chr(1), 'g')"""
    return rf"""{LINES}, runs AS (
  SELECT doc_id, pos, line, {table} AS tab, pos - row_number() OVER (PARTITION BY doc_id, {table} ORDER BY pos) AS run FROM rows),
pieces AS (SELECT doc_id, tab, min(pos) AS pos0, string_agg(line, chr(10) ORDER BY pos) AS piece FROM runs GROUP BY doc_id, tab, run),
cut AS (SELECT doc_id, pos0, unnest(CASE WHEN tab THEN [piece] ELSE string_split({text}, chr(1)) END) AS unit,
               generate_subscripts(CASE WHEN tab THEN [piece] ELSE string_split({text}, chr(1)) END, 1) AS k FROM pieces),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos0, k) - 1)::INT AS unit_no, u AS unit, {tokens('u')}::INT AS tokens
          FROM (SELECT doc_id, pos0, k, {strip('unit')} AS u FROM cut) WHERE u <> '')"""


def _chunks(size: int, overlap: int) -> str:
    """Sections led by their headings, units of them, oversized units cut, then for every unit as a first one the last that fits and
    where the next chunk starts; the walk over these from unit 0 gives the chunks."""
    units = _units().replace("FROM documents", "FROM src")
    found = "strpos(substring(d.text, p.start_char + 1), substring(f.text, 1, 50))"
    return rf"""WITH RECURSIVE sec AS ({_sections()}),
src AS (SELECT doc_id || '/' || section_no AS doc_id, doc_id AS doc, section_no, start_char, CASE WHEN headings <> '' THEN '[' || headings || ']' || chr(10) ELSE '' END || body_text AS text, headings
  FROM sec WHERE {strip('body_text')} <> ''), {units},
toks AS (SELECT doc_id, unit_no, regexp_extract_all(unit, '(?:{TOKEN}){WS}*') AS t FROM units WHERE tokens > {size}),
flat0 AS (SELECT doc_id, unit_no, 0 AS j, unit AS text, tokens FROM units WHERE tokens <= {size}
  UNION ALL SELECT doc_id, unit_no, j, {strip(f"array_to_string(t[j * {size} + 1:(j + 1) * {size}], '')")}, least({size}, len(t) - j * {size}) FROM (SELECT *, unnest(range((len(t) + {size - 1}) // {size})) AS j FROM toks)),
flat AS (SELECT doc_id AS k, row_number() OVER w - 1 AS n, text, tokens, sum(tokens) OVER w - tokens AS s0 FROM flat0 WINDOW w AS (PARTITION BY doc_id ORDER BY unit_no, j)),
nexts AS (SELECT a.k, a.n AS first, greatest(a.n + 1, coalesce(max(b.n) + 1, 0)) AS last FROM flat a LEFT JOIN flat b ON a.k = b.k AND b.n >= a.n AND b.s0 + b.tokens - a.s0 <= {size} GROUP BY a.k, a.n),
back AS (SELECT x.k, x.first, min(b.n) AS n FROM nexts x JOIN flat l ON l.k = x.k AND l.n = x.last JOIN flat b ON b.k = x.k AND b.n > x.first AND b.n < x.last AND l.s0 - b.s0 <= {overlap} GROUP BY x.k, x.first),
steps AS (SELECT x.k, x.first, CASE WHEN l.s0 - coalesce(b.s0, l.s0) + l.tokens <= {size} THEN coalesce(b.n, x.last) ELSE x.last END AS nxt
  FROM nexts x JOIN flat l ON l.k = x.k AND l.n = x.last LEFT JOIN back c ON c.k = x.k AND c.first = x.first LEFT JOIN flat b ON b.k = x.k AND b.n = c.n),
walk AS (SELECT DISTINCT k, 0::BIGINT AS part, 0::BIGINT AS first FROM flat UNION ALL SELECT w.k, w.part + 1, s.nxt FROM walk w JOIN steps s ON s.k = w.k AND s.first = w.first),
parts AS (SELECT w.k, w.part, w.first, string_agg(f.text, chr(10) ORDER BY f.n) AS text FROM walk w JOIN nexts x ON x.k = w.k AND x.first = w.first JOIN flat f ON f.k = w.k AND f.n >= w.first AND f.n < x.last GROUP BY ALL),
placed AS (SELECT q.*, p.doc, p.headings, p.start_char, row_number() OVER (PARTITION BY p.doc ORDER BY p.section_no, q.part) - 1 AS idx FROM parts q JOIN src p ON p.doc_id = q.k)
SELECT p.doc AS doc_id, substring(p.doc::VARCHAR, 1, 12) || '_' || lpad(idx::VARCHAR, 4, '0') AS chunk_id, idx::INT AS chunk_index, p.text AS text, {tokens('p.text')}::INT AS token_count, p.headings AS headings,
       (CASE WHEN {found} > 0 THEN p.start_char + {found} - 1 ELSE p.start_char END)::INT AS start_char, (CASE WHEN {found} > 0 THEN p.start_char + {found} - 1 ELSE p.start_char END + length(p.text))::INT AS end_char
FROM placed p JOIN flat f ON f.k = p.k AND f.n = p.first JOIN documents d ON d.doc_id = p.doc"""


def _keywords(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
    kept = f"list_filter(regexp_extract_all({x}, '[a-zA-Z0-9_''-]+'), lambda t: NOT list_contains([{stop}], lower(t)) AND length(t) > 1)"
    return kept


def _keyword_sql(source: str, key: str, column: str) -> str:
    grams = " || ".join(
        f"list_transform(generate_series(1, greatest(len(k) - {n - 1}, 0)), lambda i: array_to_string(k[i:i + {n - 1}], ' '))" for n in (1, 2, 3)
    )
    return f"kept AS (SELECT {key}, {_keywords(column)} AS k FROM {source}), every AS (SELECT {key}, {grams} AS e FROM kept), keys AS (SELECT {key}, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS keywords FROM every)"


def _intent() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower(description), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in search.INTENTS.items())
    return f"WITH {EDGES} SELECT rel_id, CASE {cases} ELSE 'factual' END AS intent FROM edges WHERE description IS NOT NULL"


VECTOR = """vec AS (
  SELECT DISTINCT entity_id, embedding::DOUBLE[] AS e FROM entities
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
vector AS (
  SELECT a.entity_id AS question_id, b.entity_id, round(list_cosine_similarity(a.e, b.e), 6) AS score
  FROM vec a SEMI JOIN seeds ON a.entity_id = seeds.question_id JOIN vec b ON len(a.e) = len(b.e)
  QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.entity_id) <= 10)"""
EXACT = """exact AS (
  SELECT DISTINCT s.question_id, e.name, 1.0::DOUBLE AS score FROM seeds s
  JOIN (SELECT name, lower(unnest([name] || coalesce(aliases, []))) AS key FROM entities) e ON e.key = """ + strip("lower(s.name)") + ")"
FUZZY = f"""{_keyword_sql('seeds', 'question_id', 'question')},
fuzzy AS (
  SELECT DISTINCT q.question_id, e.name FROM (SELECT question_id, lower(unnest(keywords)) AS word FROM keys) q
  JOIN (SELECT DISTINCT name, lower(concat_ws(chr(10), name, description)) AS text FROM entities WHERE name IS NOT NULL) e ON contains(e.text, q.word)),
fuzzy10 AS (SELECT question_id, name, 0.7::DOUBLE AS score FROM fuzzy QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY name) <= 10)"""

GROUPED = f"""m AS (SELECT *, {name_key('name')} AS key FROM entities WHERE {name_key('name')} <> ''),
best AS (SELECT key, arg_max(name, (n, -f)) AS name FROM (SELECT key, name, count(*) AS n, min(entity_id) AS f FROM m GROUP BY ALL) GROUP BY key)"""


RESOLVED = f"""{GROUPED}, kinds AS (SELECT key, arg_max(type, (n, -f)) AS type FROM (SELECT key, type, count(*) AS n, min(entity_id) AS f FROM m WHERE type IS NOT NULL GROUP BY ALL) GROUP BY key),
told AS (SELECT key, arg_max(description, (length(description), -entity_id)) AS description FROM m WHERE description <> '' GROUP BY key),
spelled AS (SELECT key, list(DISTINCT a) AS al FROM (SELECT key, unnest(coalesce(aliases, []) || [name]) AS a FROM m) WHERE a IS NOT NULL GROUP BY key),
held AS (SELECT key, list(DISTINCT c) AS ch FROM (SELECT key, unnest(source_chunk_ids) AS c FROM m) WHERE c IS NOT NULL GROUP BY key),
counted AS (SELECT key, count(*) AS mentions, min(entity_id) AS first, bool_or(len(embedding) > 0) AS embedded FROM m GROUP BY key),
ge AS (SELECT key, name, type, coalesce(description, '') AS description, list_filter(al, lambda x: x <> name) AS aliases, coalesce(ch, []) AS ch, mentions, first, embedded
  FROM counted JOIN best USING (key) LEFT JOIN kinds USING (key) LEFT JOIN told USING (key) LEFT JOIN spelled USING (key) LEFT JOIN held USING (key)),
al AS (SELECT DISTINCT key, {name_key('a')} AS other FROM (SELECT key, unnest(aliases) AS a FROM ge)),
l AS (SELECT key AS a, other AS b FROM al WHERE other <> key AND other IN (SELECT key FROM ge)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), comp AS (SELECT a AS key, min(b) AS component FROM reach GROUP BY a),
mg AS (SELECT ge.*, coalesce(component, key) AS c FROM ge LEFT JOIN comp USING (key)),
tops AS (SELECT c, arg_min(struct_pack(key := key, name := name, type := type), (-mentions, first)) AS top, arg_min(description, (-length(description), first)) AS description,
  sum(mentions)::BIGINT AS mentions, min(first) AS first, bool_or(embedded) AS embedded FROM mg GROUP BY c),
sp AS (SELECT DISTINCT c, a FROM (SELECT c, unnest(aliases || [name]) AS a FROM mg)), chs AS (SELECT DISTINCT c, x FROM (SELECT c, unnest(ch) AS x FROM mg)),
resolved AS (SELECT c, top.key AS key, top.name AS name, top.type AS type, description, mentions, first, embedded FROM tops)"""


def _context(budget: int = 2500) -> str:
    """Every step of the flagship over resolved entities: vector, exact and fuzzy hits, their fusion, what is one edge away, and the
    three parts of a context within the budget."""
    entity, edge, chunk = (f"'{h}'" for h in (context.ENTITY_HEADER, context.EDGE_HEADER, context.CHUNK_HEADER))
    parts = {"entity": (entity, "o0, o1, line", 4), "edge": (edge, "o0, o1, o2, line", 8)}
    cut = "".join(
        f"""{n}_cut AS (SELECT * FROM (SELECT *, row_number() OVER w AS n, coalesce(sum({tokens('line')}) OVER (PARTITION BY question_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {n}_lines WHERE line IS NOT NULL WINDOW w AS (PARTITION BY question_id ORDER BY {order})) WHERE n <= {budget // least + 1} AND before < {budget}),
{n}_part AS (SELECT question_id, {header} || chr(10) || string_agg(line, chr(10) ORDER BY {order}) AS part FROM {n}_cut GROUP BY question_id),
"""
        for n, (header, order, least) in parts.items()
    )
    return rf"""WITH RECURSIVE {CHUNKS}, {LINKS}, {EDGES}, {RESOLVED}, {SEEDS},
forms AS (SELECT key, arg_max(name, (first, name)) AS name FROM (SELECT r.first, r.name, {name_key('sp.a')} AS key FROM sp JOIN resolved r USING (c)) WHERE key <> '' GROUP BY key),
moved AS (SELECT rel_id, coalesce(s.name, source_entity) AS s, coalesce(t.name, target_entity) AS t, relation_type, description, extracted_at
  FROM edges LEFT JOIN forms s ON s.key = {name_key('source_entity')} LEFT JOIN forms t ON t.key = {name_key('target_entity')}),
fold AS (SELECT s, t, relation_type, list(description ORDER BY length(coalesce(description, '')) DESC, extracted_at, rel_id)[1] AS description, max((extracted_at, rel_id)) AS arrived FROM moved
  WHERE s <> t AND s IN (SELECT name FROM resolved) AND t IN (SELECT name FROM resolved) GROUP BY s, t, relation_type),
typed AS (SELECT s, {label('relation_type')} AS label, t, description FROM fold QUALIFY row_number() OVER (PARTITION BY s, {label('relation_type')}, t ORDER BY arrived DESC) = 1),
emb AS (SELECT key, arg_min(embedding, entity_id) AS e, min(mc) AS first FROM (SELECT *, min(entity_id) OVER (PARTITION BY key) AS mc FROM m) WHERE len(embedding) > 0 GROUP BY key),
ents AS (SELECT r.*, x.e AS embedding FROM resolved r LEFT JOIN (SELECT c, arg_min(emb.e, emb.first) AS e FROM mg JOIN emb USING (key) GROUP BY c) x USING (c)),
qv AS (SELECT DISTINCT e.entity_id AS question_id, e.embedding::DOUBLE[] AS e FROM entities e SEMI JOIN seeds ON e.entity_id = seeds.question_id
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ev AS (SELECT first AS entity_id, name, embedding::DOUBLE[] AS e FROM ents
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
vector AS (SELECT q.question_id, v.name, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM qv q JOIN ev v ON len(q.e) = len(v.e)
  QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.entity_id) <= 10),
exact AS (SELECT DISTINCT v.question_id, r.name FROM vector v JOIN (SELECT r.name, lower(sp.a) AS key FROM sp JOIN resolved r USING (c)) r ON r.key = {strip('lower(v.name)')}),
{_keyword_sql('seeds', 'question_id', 'question')},
words AS (SELECT DISTINCT question_id, word FROM (SELECT question_id, {strip('lower(w)')} AS word FROM (SELECT question_id, unnest(keywords) AS w FROM keys)) WHERE length(word) >= 2),
fuzzy AS (SELECT * FROM (SELECT DISTINCT q.question_id, r.name FROM words q JOIN (SELECT name, lower(concat_ws(chr(10), name, description)) AS text FROM ents) r ON contains(r.text, q.word))
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY name) <= 10),
hits AS (SELECT question_id, name, round(max(g) * 0.6 + max(v) * 0.4, 6) AS score FROM (SELECT question_id, name, 1.0::DOUBLE AS g, 0.0::DOUBLE AS v FROM exact UNION ALL SELECT question_id, name, 0.7, 0.0 FROM fuzzy
  UNION ALL SELECT question_id, name, 0.0, score FROM vector) GROUP BY question_id, name),
near AS (SELECT DISTINCT question_id, name FROM (SELECT question_id, t AS name FROM hits JOIN typed ON s = name UNION ALL SELECT question_id, s FROM hits JOIN typed ON t = name)
  WHERE (question_id, name) NOT IN (SELECT (question_id, name) FROM hits)),
entity_lines AS (SELECT question_id, -score AS o0, r.name AS o1, '- ' || r.name || ' (' || coalesce(r.type, '') || '): ' || coalesce(r.description, '') AS line
  FROM (SELECT * FROM hits UNION ALL SELECT question_id, name, 0.0 FROM near) h JOIN ents r ON r.name = h.name),
edge_lines AS (SELECT DISTINCT question_id, s AS o0, t AS o1, label AS o2, '- ' || s || ' --[' || label || ']--> ' || t || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END AS line
  FROM hits JOIN typed ON name = s OR name = t),
{cut}both_parts AS (SELECT q.question_id, coalesce(a.part, {entity}) AS a, coalesce(b.part, {edge}) AS b FROM (SELECT DISTINCT question_id FROM seeds) q LEFT JOIN entity_part a USING (question_id) LEFT JOIN edge_part b USING (question_id)),
room AS (SELECT *, greatest(0, {budget} - {tokens('a')} - {tokens('b')}) AS room FROM both_parts),
found AS (SELECT DISTINCT h.question_id, chs.x AS chunk_id FROM hits h JOIN resolved r ON r.name = h.name JOIN chs USING (c) WHERE chs.x IN (SELECT chunk_id FROM chunks1)),
wide AS (SELECT question_id, chunk_id, min(hop) AS hop FROM (SELECT question_id, chunk_id, 0 AS hop FROM found UNION ALL SELECT f.question_id, l.b, 1 FROM found f JOIN links l ON f.chunk_id = l.a
  UNION ALL SELECT f.question_id, l.a, 1 FROM found f JOIN links l ON f.chunk_id = l.b) GROUP BY question_id, chunk_id),
entry AS (SELECT w.question_id, w.chunk_id, w.hop, '[Chunk ' || w.chunk_id || '] (Source: ' || coalesce(c.file_hash, '') || '):' || chr(10) || c.text AS entry FROM wide w JOIN chunks1 c USING (chunk_id)),
spent AS (SELECT *, sum({tokens('entry')}) OVER (PARTITION BY question_id ORDER BY hop, chunk_id ROWS UNBOUNDED PRECEDING) + {tokens(chunk)} AS spent FROM entry),
passages AS (SELECT question_id, {chunk} || chr(10) || chr(10) || string_agg(entry, chr(10) || chr(10) ORDER BY hop, chunk_id) AS part FROM spent JOIN room USING (question_id) WHERE spent <= room GROUP BY question_id),
whole AS (SELECT question_id, a || chr(10) || chr(10) || b || chr(10) || chr(10) || coalesce(part, {chunk}) AS text FROM room LEFT JOIN passages USING (question_id)),
counted2 AS (SELECT *, {tokens('text')} AS n FROM whole)
SELECT question_id, CASE WHEN n > {budget} THEN array_to_string(regexp_extract_all(text, '{WS}*(?:{TOKEN})')[1:{budget}], '') ELSE text END AS context, least(n, {budget})::INT AS tokens FROM counted2"""


def _valid() -> str:
    b = strip("text")
    behind = f"CASE WHEN starts_with(body, '[') AND contains(body, ']' || chr(10)) THEN substring(body, position(']' || chr(10) IN body) + 2) ELSE body END"
    lines = "string_split(body, chr(10))"
    reference = rf"len(list_filter({lines}, lambda l: regexp_matches(l, '^{WS}*(?:\[\p{{Nd}}+\]|\p{{Nd}}+\.){WS}+[A-Z]')))"
    boiler = rf"""(regexp_matches({strip(behind)}, '(?i)^{WS}*(?:table{WS}+of{WS}+contents|references|bibliography|index){WS}*\z')
 OR regexp_matches(array_to_string({lines}[1:3], chr(10)), '(?i)table{WS}+of{WS}+contents|contents|list{WS}+of{WS}+(?:figures|tables)')
 OR (len({lines}) > 3 AND {reference} / len({lines}) > 0.6))"""
    seen, digits = f"length({sub('body', WS)})", f"length({sub('body', r'[^' + chr(92) + 'p{Nd}]')})"
    return rf"""{CHUNKS}, body AS (SELECT *, coalesce({b}, '') AS body FROM chunks1),
judged AS (SELECT *, list_filter([CASE WHEN coalesce(token_count, 0) < 30 THEN 'too short' END, CASE WHEN regexp_matches(body, '^\[[^\n]+\]{WS}*\z') THEN 'heading only' END,
  CASE WHEN {boiler} THEN 'boilerplate' END, CASE WHEN {seen} > 0 AND {digits} > 0.8 * {seen} THEN 'numeric' END], lambda x: x IS NOT NULL) AS r0 FROM body),
final AS (SELECT chunk_id, CASE WHEN len(r0) = 0 AND row_number() OVER (PARTITION BY file_hash, body ORDER BY chunk_index NULLS LAST, chunk_id) > 1 THEN ['duplicate'] ELSE r0 END AS reasons FROM judged)"""


def sql() -> dict[str, str]:
    s = _stripped_lines("text")
    often = f"list_distinct(list_filter({s}, lambda l: l <> '' AND len(list_filter({s}, lambda k: k = l)) > 2))"
    return {
        "doc_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
        "clean_regex": f"SELECT doc_id, {_clean()} AS text FROM documents",
        "repeated_lines": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains({often}, {strip('x')})), chr(10)) END AS text FROM documents",
        "doc_metadata": _title(),
        "language_vote": _votes(),
        "current_metadata": "SELECT file_hash, title, author, language, page_count FROM document_metadata QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY ingested_at DESC) = 1",
        "sections": _sections(),
        "sentences": f"WITH {_units()} SELECT * FROM units",
        "token_counts": f"SELECT doc_id, {tokens('text')}::INT AS tokens FROM documents",
        "chunk_pack": f"""WITH RECURSIVE {_units()}, packs AS (
            SELECT doc_id, unit_no, unit, tokens AS total, 0 AS part_no FROM units WHERE unit_no = 0
          UNION ALL
            SELECT u.doc_id, u.unit_no, u.unit, CASE WHEN p.total + u.tokens <= 100 THEN p.total + u.tokens ELSE u.tokens END,
                   CASE WHEN p.total + u.tokens <= 100 THEN p.part_no ELSE p.part_no + 1 END
            FROM packs p JOIN units u ON u.doc_id = p.doc_id AND u.unit_no = p.unit_no + 1)
          SELECT doc_id, part_no, string_agg(unit, chr(10) ORDER BY unit_no) AS text FROM packs GROUP BY doc_id, part_no""",
        "chunk_overlap": _chunks(60, 12),
        "chunk_validate": f"WITH {_valid()} SELECT chunk_id, array_to_string(reasons, ',') AS reasons FROM final",
        "reject_histogram": f"WITH {_valid()} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM final) GROUP BY reason",
        "json_mentions": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
        "weight_normalize": f"SELECT rel_id, extracted_at, round({weight('weight')}, 6) AS weight FROM relationships",
        "label_sanitize": f"SELECT {kind('relation_type')} AS type, {label('relation_type')} AS label, count(*) AS n FROM relationships GROUP BY ALL",
        "entity_group": f"""WITH {GROUPED}, kinds AS (SELECT key, arg_max(type, (n, -f)) AS type FROM (SELECT key, type, count(*) AS n, min(entity_id) AS f FROM m WHERE type IS NOT NULL GROUP BY ALL) GROUP BY key),
            told AS (SELECT key, arg_max(description, (length(description), -entity_id)) AS description FROM m WHERE description <> '' GROUP BY key),
            spelled AS (SELECT key, list(DISTINCT a) AS al FROM (SELECT key, unnest(coalesce(aliases, []) || [name]) AS a FROM m) WHERE a IS NOT NULL GROUP BY key),
            held AS (SELECT key, list(DISTINCT c) AS ch FROM (SELECT key, unnest(source_chunk_ids) AS c FROM m) WHERE c IS NOT NULL GROUP BY key),
            counted AS (SELECT key, count(*) AS mentions FROM m GROUP BY key)
          SELECT key, name, type, coalesce(description, '') AS description, array_to_string(list_sort(list_filter(al, lambda x: x <> name)), '|') AS aliases,
                 coalesce(array_to_string(list_sort(ch), '|'), '') AS source_chunk_ids, mentions
          FROM counted JOIN best USING (key) LEFT JOIN kinds USING (key) LEFT JOIN told USING (key) LEFT JOIN spelled USING (key) LEFT JOIN held USING (key)""",
        "type_conflict": f"SELECT {name_key('name')} AS key, count(DISTINCT type) AS types FROM entities WHERE {name_key('name')} <> '' GROUP BY 1 HAVING count(DISTINCT type) > 1",
        "alias_components": f"""WITH RECURSIVE {GROUPED}, al AS (SELECT DISTINCT m.key, {name_key('a')} AS other FROM (SELECT key, unnest(coalesce(aliases, []) || [name]) AS a FROM m) m JOIN best b ON m.key = b.key WHERE a <> b.name),
            l AS (SELECT key AS a, other AS b FROM al WHERE other <> key AND other IN (SELECT key FROM best)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
          SELECT a AS key, min(b) AS component FROM reach GROUP BY a""",
        "resolved_entities": f"""WITH RECURSIVE {RESOLVED}
          SELECT key, name, type, name || ': ' || coalesce(type, '') || '. ' || description AS embedding_text, mentions,
                 (SELECT count(*) FROM sp WHERE sp.c = r.c AND a <> r.name)::INT AS n_aliases, (SELECT count(*) FROM chs WHERE chs.c = r.c)::INT AS n_chunks FROM resolved r""",
        "resolved_edges": f"""WITH RECURSIVE {EDGES}, {RESOLVED},
            forms AS (SELECT key, arg_max(name, (first, name)) AS name FROM (SELECT r.first, r.name, {name_key('sp.a')} AS key FROM sp JOIN resolved r USING (c)) WHERE key <> '' GROUP BY key),
            moved AS (SELECT rel_id, coalesce(s.name, source_entity) AS source_entity, coalesce(t.name, target_entity) AS target_entity, relation_type, weight, extracted_at
              FROM edges LEFT JOIN forms s ON s.key = {name_key('source_entity')} LEFT JOIN forms t ON t.key = {name_key('target_entity')})
          SELECT source_entity, target_entity, relation_type, round(list_reduce(list(weight ORDER BY extracted_at, rel_id), lambda a, x: (a + x) / 2), 6) AS weight, count(*) AS mentions FROM moved
          WHERE source_entity <> target_entity AND source_entity IN (SELECT name FROM resolved) AND target_entity IN (SELECT name FROM resolved) GROUP BY source_entity, target_entity, relation_type""",
        "reply_entities": f"""SELECT entity_id::VARCHAR AS chunk_id, 0::BIGINT AS pos, {strip('name')} AS name, coalesce(nullif({strip('type')}, ''), 'CONCEPT') AS type, coalesce(description, '') AS description,
            array_to_string(coalesce(aliases, []), '|') AS aliases FROM entities WHERE {strip('name')} <> ''""",
        "reply_relationships": f"""SELECT rel_id || '/' || epoch_us(extracted_at) AS chunk_id, {strip('source_entity')} AS source_entity, {strip('target_entity')} AS target_entity, {kind('relation_type')} AS relation_type,
            coalesce(description, '') AS description, round({weight('weight')}, 6) AS weight FROM relationships WHERE {strip('source_entity')} <> '' AND {strip('target_entity')} <> ''""",
        "reply_tuples": f"""SELECT entity_id::VARCHAR AS chunk_id, 0 AS pos, 'entity|' || {sub(strip("coalesce(name, '')"), '^"|"' + chr(92) + 'z')} || '|' || {sub(strip("coalesce(type, '')"), '^"|"' + chr(92) + 'z')} AS fields FROM entities""",
        "edge_remap": f"""WITH {EDGES}, {GROUPED}, f AS (SELECT key, min(entity_id) AS first FROM m GROUP BY key),
            sp AS (SELECT b.name, f.first, {name_key('s.a')} AS key FROM (SELECT key, unnest(coalesce(aliases, []) || [name]) AS a FROM m) s JOIN best b USING (key) JOIN f USING (key)),
            forms AS (SELECT key, arg_max(name, (first, name)) AS name FROM sp WHERE key <> '' GROUP BY key)
          SELECT rel_id, coalesce(s.name, source_entity) AS source_entity, coalesce(t.name, target_entity) AS target_entity
          FROM edges LEFT JOIN forms s ON s.key = {name_key('source_entity')} LEFT JOIN forms t ON t.key = {name_key('target_entity')}""",
        "edge_fold": f"""WITH {EDGES} SELECT source_entity, target_entity, relation_type, round(list_reduce(list(weight ORDER BY extracted_at, rel_id), lambda a, x: (a + x) / 2), 6) AS weight,
            list(description ORDER BY length(coalesce(description, '')) DESC, extracted_at, rel_id)[1] AS description, count(*) AS mentions FROM edges GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY source_entity, target_entity, relation_type"),
        "dangling_edges": f"WITH {EDGES} SELECT rel_id FROM edges WHERE source_entity NOT IN (SELECT name FROM entities WHERE name IS NOT NULL) OR target_entity NOT IN (SELECT name FROM entities WHERE name IS NOT NULL)",
        "orphans": f"WITH {EDGES} SELECT DISTINCT name FROM entities WHERE name IS NOT NULL AND name NOT IN (SELECT source_entity FROM edges UNION SELECT target_entity FROM edges)",
        "typed_edges": f"""WITH {EDGES}, {NAMED} SELECT source_entity, label, target_entity, description, round(weight, 6) AS weight FROM edges
            WHERE source_entity IN (SELECT name FROM named) AND target_entity IN (SELECT name FROM named)
            QUALIFY row_number() OVER (PARTITION BY source_entity, label, target_entity ORDER BY extracted_at DESC, rel_id DESC) = 1""",
        "extracted_from": f"WITH {CHUNKS}, {PROVENANCE} SELECT * FROM provenance",
        "next_chunk": f"WITH {CHUNKS}, {LINKS} SELECT a AS current_chunk_id, b AS next_chunk_id FROM links",
        "part_of": "SELECT DISTINCT chunk_id, file_hash FROM chunks WHERE file_hash IN (SELECT file_hash FROM document_metadata)",
        "type_quality": f"SELECT upper(type) AS type, coalesce(upper(type) IN {('PERSON', 'ORGANIZATION', 'CONCEPT', 'TECHNOLOGY', 'LOCATION', 'EVENT', 'DATE', 'METRIC', 'DOCUMENT', 'LAW', 'PRODUCT')}, false) AS known, count(*) AS n FROM entities GROUP BY 1, 2",
        "node_counts": f"""WITH RECURSIVE {EDGES}, {RESOLVED} SELECT 'Chunk' AS label, count(DISTINCT chunk_id) AS n FROM chunks UNION ALL SELECT 'Entity', count(*) FROM resolved
            UNION ALL SELECT 'Embedded', count(*) FROM resolved WHERE embedded UNION ALL SELECT 'Document', count(DISTINCT file_hash) FROM document_metadata UNION ALL SELECT 'Edge', count(*) FROM edges""",
        "upsert_last_wins": "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id",
        "keyword_ngrams": f"WITH {EDGES}, src AS (SELECT rel_id, description FROM edges WHERE description IS NOT NULL), {_keyword_sql('src', 'rel_id', 'description')} SELECT rel_id, array_to_string(keywords, '|') AS keywords FROM keys",
        "question_intent": _intent(),
        "vector_topk": f"WITH {SEEDS}, {VECTOR} SELECT * FROM vector",
        "exact_match": f"WITH {SEEDS}, {EXACT} SELECT * FROM exact",
        "fuzzy_match": f"WITH {SEEDS}, {FUZZY} SELECT * FROM fuzzy10",
        "score_fusion": f"""WITH {SEEDS}, {VECTOR}, {EXACT}, {FUZZY}, hits AS (SELECT question_id, name, score AS g, 0.0::DOUBLE AS v FROM exact UNION ALL SELECT question_id, name, score, 0.0 FROM fuzzy10
            UNION ALL SELECT question_id, e.name, 0.0, score FROM vector JOIN entities e USING (entity_id))
          SELECT question_id, name, max(g) AS graph_score, max(v) AS vector_score, round(max(g) * 0.6 + max(v) * 0.4, 6) AS combined_score FROM hits GROUP BY question_id, name""",
        "neighbours_1hop": f"""WITH {SEEDS}, {EDGES}, ways AS (SELECT source_entity AS a, target_entity AS b FROM edges UNION SELECT target_entity, source_entity FROM edges)
          SELECT DISTINCT question_id, b AS name FROM seeds JOIN ways ON a = name WHERE b IS NOT NULL AND (question_id, b) NOT IN (SELECT (question_id, name) FROM seeds)""",
        "incident_edges": f"WITH {SEEDS}, {EDGES} SELECT DISTINCT question_id, rel_id FROM seeds JOIN edges ON name = source_entity OR name = target_entity",
        "connected_chunks": f"WITH {SEEDS}, {CHUNKS}, {PROVENANCE} SELECT DISTINCT question_id, chunk_id FROM seeds JOIN provenance ON name = entity_name",
        "chunk_expand": f"""WITH {SEEDS}, {CHUNKS}, {PROVENANCE}, {LINKS}, found AS (SELECT DISTINCT question_id, chunk_id FROM seeds JOIN provenance ON name = entity_name),
            every AS (SELECT question_id, chunk_id, 0 AS hop FROM found UNION ALL SELECT question_id, b, 1 FROM found JOIN links ON chunk_id = a UNION ALL SELECT question_id, a, 1 FROM found JOIN links ON chunk_id = b)
          SELECT question_id, chunk_id, min(hop) AS hop FROM every GROUP BY question_id, chunk_id""",
        "rag_context": _context(),
        "context_budget": f"WITH {CHUNKS}, s AS (SELECT file_hash, chunk_id, (sum({tokens('text')}) OVER (PARTITION BY file_hash ORDER BY chunk_id ROWS UNBOUNDED PRECEDING))::BIGINT + {tokens(chr(39) + '=== RELEVANT TEXT PASSAGES ===' + chr(39))} AS spent FROM chunks1) SELECT * FROM s WHERE spent <= 2500",
    }
