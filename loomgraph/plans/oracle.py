"""The queries in DuckDB's SQL, over views named as the tables; lists are comma-joined, doubles are rounded to six places."""

from __future__ import annotations

from .tables import CLAUSES, LEXICON, NEGATES, PHRASES

_PRESENT = "present AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS e FROM lineitem)"
_PAIRS = f"{_PRESENT}, pairs AS (SELECT a.s, a.e AS source_id, b.e AS target_id FROM present a JOIN present b ON a.s = b.s AND a.e < b.e)"
_EDGES = f"{_PAIRS}, edges AS (SELECT source_id, target_id, count(*) AS weight FROM pairs GROUP BY ALL)"
_SECTIONS = """sections AS (SELECT 'fifths' AS division, r_name AS section, floor(last * r_regionkey / 5)::BIGINT + 1 AS lo, floor(last * (r_regionkey + 1) / 5 + last / 50)::BIGINT AS hi
  FROM region, (SELECT max(o_orderkey) AS last FROM orders))"""
_ROLES = """agents AS (SELECT c_nationkey AS left_id, o_orderkey AS i, o_custkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey),
patients AS (SELECT s_nationkey AS right_id, l_orderkey AS i, l_linenumber::BIGINT AS pos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
both_roles AS (SELECT left_id, a.i AS "index", right_id, a.pos AS pos_left, p.pos AS pos_right, row_number() OVER (PARTITION BY left_id, a.i, right_id ORDER BY a.pos, p.pos) AS k
  FROM agents a JOIN patients p ON a.i = p.i AND left_id <> right_id),
triples AS (SELECT * EXCLUDE (k) FROM both_roles WHERE k = 1)"""
_TOKENS = "order_tokens AS (SELECT l_orderkey AS token_id, p_name AS lemma, l_orderkey // 7 AS sentence_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1)"
_TRADE = """trade AS (SELECT year(o_orderdate)::INTEGER AS year, c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)"""
_RING = """ring AS (SELECT section, n_nationkey::VARCHAR AS a, b::VARCHAR AS b FROM (
    SELECT 'all' AS section, n_nationkey, (n_nationkey * n_nationkey + 1) % 25 AS b FROM nation
    UNION ALL SELECT 'all', n_nationkey, (n_nationkey + 7) % 25 FROM nation
    UNION ALL SELECT 'half', n_nationkey, (n_nationkey + 7) % 25 FROM nation WHERE n_nationkey < 13) WHERE n_nationkey <> b),
links AS (SELECT section, a, b FROM ring UNION SELECT section, b, a FROM ring),
ring_nodes AS (SELECT DISTINCT section, a AS node FROM links),
sizes AS (SELECT section, count(*) AS n FROM ring_nodes GROUP BY ALL)"""
_HOPS = """walk(section, s, t, h) AS (SELECT section, node, node, 0 FROM ring_nodes UNION SELECT w.section, w.s, l.b, h + 1 FROM walk w JOIN links l ON w.section = l.section AND w.t = l.a WHERE h < 24),
hops AS (SELECT section, s, t, min(h) AS h FROM walk GROUP BY ALL)"""
_VALUE = "CASE WHEN sum(h) > 0 AND any_value(n) > 1 THEN round((count(*) - 1) / sum(h) * (count(*) - 1) / (any_value(n) - 1), 6) ELSE 0.0 END"
_MATCHED = """matched AS (SELECT p_partkey AS character_id, p_type AS name, trim(regexp_replace(regexp_replace(lower(p_name), '[.,"-]', '', 'g'), '\\s+', ' ', 'g')) AS fullname,
  CASE WHEN p_size > 25 THEN p_size END AS matched_id, p_size * 2.0 AS score, p_brand AS word, p_size AS i FROM part),
leasts AS (SELECT fullname, min(character_id) AS least FROM matched WHERE matched_id IS NOT NULL GROUP BY ALL),
canonical AS (SELECT m.*, coalesce(least, character_id) AS canonical_id FROM matched m LEFT JOIN leasts USING (fullname))"""
_SPANS = """covered AS (SELECT user_id AS coref, event_id AS pos, unnest(range(event_id, event_id + CAST(trunc(abs(value)) AS BIGINT) % 5 + 1)) AS token_id FROM events),
token_map AS (SELECT token_id, arg_max(coref, pos) AS coref FROM covered GROUP BY ALL)"""
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_LCS = """lcs(a, b, i, p) AS (
  SELECT a, b, 0, list_transform(range(length(b) + 1), lambda z: 0) FROM q UNION ALL
  SELECT a, b, i + 1, list_reduce(list_prepend([0]::BIGINT[], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda r, e: list_append(r, CASE WHEN substring(b, e[1]::INT, 1) = substring(a, (i + 1)::INT, 1) THEN p[e[1]::INT] + 1 ELSE greatest(p[e[1]::INT + 1], r[len(r)]) END))
  FROM lcs WHERE i < length(a)),
scored AS (SELECT a, b, 200.0 * p[length(b) + 1] / (length(a) + length(b)) AS score FROM lcs WHERE i = length(a))"""


def _clauses() -> str:
    """The tokens of tables.clause_tokens()."""
    words = {"<brand>": "p_brand", "<one>": "t[1]", "<two>": "coalesce(t[2], 'lots')", "<three>": "coalesce(t[3], 'goods')"}
    rows = [
        f"SELECT s, s * 10 + {o} AS id, {words.get(word, repr(word))} AS word, '{pos}' AS pos, '{dep}' AS dep, s * 10 + {head} AS head FROM clause WHERE p_size % {len(CLAUSES)} = {kind}"
        for kind, clause in enumerate(CLAUSES)
        for o, (word, pos, dep, head) in enumerate(clause)
    ]
    rows += [f"SELECT s, s * 10 + 9, 'not', 'PART', 'neg', s * 10 + {head} FROM clause WHERE p_size % {len(CLAUSES)} = {kind} AND p_size % 7 = 0" for kind, head in enumerate(NEGATES)]
    return "clause AS (SELECT p_partkey AS s, p_brand, p_size, string_split(p_type, ' ') AS t FROM part), tokens AS (" + " UNION ALL ".join(rows) + ")"


_CLAUSE = _clauses()
#: Subjects, objects and verbs from tokens and their heads. `up` has every token's heads, all levels up, with the relations on the way.
_SVO = """verbs AS (SELECT * FROM tokens WHERE pos = 'VERB' AND dep NOT IN ('aux', 'auxpass')),
subject0 AS (SELECT v.id AS verb, t.id AS noun FROM verbs v JOIN tokens t ON t.head = v.id AND t.dep IN ('nsubj', 'nsubjpass')),
heir(verb, source) AS (SELECT DISTINCT verb, verb FROM subject0 UNION SELECT v.id, h.source FROM heir h JOIN verbs v ON v.head = h.verb AND v.dep = 'conj' AND v.id <> v.head WHERE v.id NOT IN (SELECT verb FROM subject0)),
subject1 AS (SELECT h.verb, s.noun FROM heir h JOIN subject0 s ON s.verb = h.source),
object0 AS (SELECT v.id AS verb, t.id AS noun FROM verbs v JOIN tokens t ON t.head = v.id AND t.dep IN ('dobj', 'obj')
  UNION SELECT v.id, p.id FROM verbs v JOIN tokens a ON a.head = v.id AND a.dep = 'agent' JOIN tokens p ON p.head = a.id AND p.dep = 'pobj'),
subjects(verb, noun) AS (SELECT * FROM subject1 UNION SELECT s.verb, t.id FROM subjects s JOIN tokens t ON t.head = s.noun AND t.dep = 'conj'),
objects(verb, noun) AS (SELECT * FROM object0 UNION SELECT o.verb, t.id FROM objects o JOIN tokens t ON t.head = o.noun AND t.dep = 'conj'),
clauses AS (SELECT v.id AS verb, t.id AS noun FROM verbs v JOIN tokens t ON t.head = v.id AND t.dep IN ('xcomp', 'ccomp') WHERE v.id NOT IN (SELECT verb FROM objects)),
noun(root, id) AS (SELECT DISTINCT noun, noun FROM (SELECT noun FROM subjects UNION SELECT noun FROM objects) UNION SELECT n.root, t.id FROM noun n JOIN tokens t ON t.head = n.id AND t.dep = 'compound' AND t.id <> t.head),
whole(root, id) AS (SELECT DISTINCT noun, noun FROM clauses UNION SELECT w.root, t.id FROM whole w JOIN tokens t ON t.head = w.id AND t.id <> t.head),
members AS (SELECT root, 'noun' AS kind, id, word, pos FROM noun JOIN tokens USING (id) UNION ALL SELECT root, 'clause', id, word, pos FROM whole JOIN tokens USING (id)),
info AS (SELECT root, kind, string_agg(word, ' ' ORDER BY id) AS text, list(id ORDER BY id) AS ids, max(pos) FILTER (id = root) AS pos FROM members GROUP BY root, kind),
complements AS (SELECT verb, noun, 'noun' AS kind FROM objects UNION ALL SELECT verb, noun, 'clause' FROM clauses),
negations AS (SELECT DISTINCT coalesce(x.head, n.head) AS verb FROM tokens n LEFT JOIN tokens x ON x.id = n.head AND x.dep IN ('aux', 'auxpass') WHERE n.dep = 'neg'),
svo AS (SELECT v.s, v.id AS verb, v.word AS vw, a.text AS st, a.ids AS si, a.pos AS sp, a.root AS sroot, b.text AS ot, b.ids AS oi, b.pos AS op, b.root AS oroot, b.kind AS okind, v.id IN (SELECT verb FROM negations) AS negated
  FROM verbs v JOIN subjects s ON s.verb = v.id JOIN info a ON a.root = s.noun AND a.kind = 'noun' JOIN complements c ON c.verb = v.id JOIN info b ON b.root = c.noun AND b.kind = c.kind)"""
_COREF = "CASE WHEN word LIKE 'Brand#%' THEN substr(word, 7)::INT ELSE ascii(word) * 100 + length(word) END"
_NOUNS = f"""nouns AS (SELECT s, id, word, dep, head, ({_COREF})::BIGINT AS coref FROM tokens WHERE pos IN ('NOUN', 'PROPN')),
live AS (SELECT DISTINCT coref FROM nouns WHERE dep IN ('nsubj', 'dobj', 'nsubjpass'))"""
#: The same with nouns that a clause modifies as subjects of its verb, recipients, and objects after prepositions.
_SVO_MORE = _SVO.replace("subject0 AS (", """bare AS (SELECT v.id FROM verbs v WHERE NOT EXISTS (SELECT 1 FROM tokens t WHERE t.head = v.id AND t.dep IN ('nsubj', 'nsubjpass'))),
subject0 AS (SELECT v.id AS verb, v.head AS noun FROM verbs v JOIN bare USING (id) WHERE v.dep IN ('relcl', 'acl') AND v.head <> v.id UNION ALL """, 1).replace("object0 AS (", """object0 AS (SELECT t.head AS verb, t.id AS noun FROM tokens t JOIN verbs v ON v.id = t.head WHERE t.dep IN ('dative', 'iobj')
  UNION SELECT a.head, p.id FROM tokens a JOIN verbs v ON v.id = a.head JOIN tokens p ON p.head = a.id AND p.dep = 'pobj' WHERE a.dep = 'prep' UNION """, 1)
#: Runs of a side's tokens with the entity of the first token that has one, and both sources of triples as one.
_EXTRACTED = f"""{_NOUNS}, runs AS (SELECT root, kind, arg_min(coref, m.id) FILTER (coref IN (SELECT coref FROM live)) AS coref
  FROM (SELECT m.*, id - row_number() OVER (PARTITION BY root, kind ORDER BY id) AS g FROM members m) m LEFT JOIN nouns USING (id) GROUP BY root, kind, g),
sides AS (SELECT verb, vw, negated, a.coref AS l, b.coref AS r FROM svo JOIN runs a ON a.root = sroot AND a.kind = 'noun' JOIN runs b ON b.root = oroot AND b.kind = okind WHERE a.coref IS NOT NULL AND b.coref IS NOT NULL),
avp AS (SELECT DISTINCT a.coref AS l, a.head AS verb, p.coref AS r, a.head IN (SELECT head FROM tokens WHERE dep = 'neg') AS negated FROM nouns a JOIN nouns p ON a.head = p.head AND a.dep = 'nsubj' AND p.dep IN ('dobj', 'nsubjpass') AND a.coref <> p.coref),
combined AS (SELECT min(source) AS source, l AS canonical_id_left, 'agent' AS role_left, verb AS "index", bool_or(negated) AS negated, r AS canonical_id_right, 'patient' AS role_right
  FROM (SELECT 'avp' AS source, l, verb, r, negated FROM avp UNION ALL SELECT 'svo', l, verb, r, negated FROM sides) GROUP BY l, verb, r)"""
_WORDS = "words AS (SELECT doc_id, source, lang, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS k FROM documents)"
_NEGATED = "('not', 'no', 'never', 'none', 'nor', 'neither', 'nothing', 'nowhere', 'cannot', 'without', 'hardly', 'rarely', 'seldom')"
_BOOST = "CASE WHEN w IN ('very', 'really', 'extremely', 'so', 'totally', 'absolutely', 'most') THEN 1.0 WHEN w IN ('slightly', 'somewhat', 'barely', 'partly', 'almost') THEN -1.0 ELSE 0.0 END"
_LAGS = " + ".join(f"coalesce(lag(neg, {k}) OVER o, 0)" for k in (1, 2, 3))
_PUSH = " + ".join(f"{f} * coalesce(lag(boost, {k}) OVER o, 0.0)" for k, f in ((1, 1.0), (2, 0.95), (3, 0.9)))
_SCORES = f"""{_WORDS}, lexicon(word, valence) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON)}),
marked AS (SELECT doc_id, k, w, (w IN {_NEGATED} OR ends_with(w, 'n''t'))::INT AS neg, {_BOOST} AS boost FROM (SELECT doc_id, k, lower(word) AS w FROM words)),
pushed AS (SELECT doc_id, w, {_LAGS} AS negations, {_PUSH} AS push FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
valences AS (SELECT doc_id, sum(CASE WHEN valence IS NULL THEN 0.0 ELSE (valence + sign(valence) * 0.293 * push) * pow(-0.74::DOUBLE, negations) END) AS valence FROM pushed LEFT JOIN lexicon ON w = word GROUP BY ALL),
scores AS (SELECT doc_id, valence, valence / sqrt(valence * valence + 15.0) AS compound FROM valences)"""


_LIKELIHOOD = "2 * (({0}) * ln(greatest({3}, 1e-9)) + (({1}) - ({0})) * ln(greatest(1 - {3}, 1e-9)) - ({0}) * ln(greatest({2}, 1e-9)) - (({1}) - ({0})) * ln(greatest(1 - {2}, 1e-9)))"
_SHORT = f"""seen AS (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS x FROM documents),
types AS (SELECT regexp_replace(x, '^[^\\p{{L}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS w, count(*) FILTER (regexp_matches(x, '\\.[^\\p{{L}}\\p{{N}}]*$'))::DOUBLE AS stopped, count(*)::DOUBLE AS own FROM seen WHERE regexp_matches(x, '\\p{{L}}') GROUP BY 1),
rate AS (SELECT sum(stopped) / sum(own) AS chance FROM types WHERE w <> ''),
short AS (SELECT w, ({_LIKELIHOOD.format("stopped", "own", "chance", "0.99::DOUBLE")}) * (length(w) - length(replace(w, '.', '')) + 1) * exp(-length(replace(w, '.', ''))) * pow(length(replace(w, '.', ''))::DOUBLE, stopped - own) AS score FROM types, rate WHERE w <> '' AND stopped > 0)"""
_LEARNT = f"""{_SHORT}, known AS (SELECT w FROM short WHERE score >= 0.3),
cuts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS every FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(range(len(every))) AS i, unnest(every) AS piece, unnest(list_prepend(NULL, every[:-2])) AS before FROM cuts),
ended AS (SELECT *, regexp_extract(before, '(\\S+)\\s*$', 1) AS word, regexp_extract(piece, '^[^\\p{{L}}\\p{{N}}]*([\\p{{L}}\\p{{N}}]+)', 1) AS first FROM pieces),
parts AS (SELECT *, CASE WHEN regexp_matches(word, '\\.[^\\p{{L}}\\p{{N}}]*$') THEN regexp_replace(word, '^[^\\p{{L}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') END AS ending FROM ended),
begun AS (SELECT lower(first) AS w, count(*)::DOUBLE AS n FROM parts WHERE ending IS NOT NULL AND first <> '' AND length(ending) > 1 AND lower(ending) NOT IN (FROM known) GROUP BY 1),
begins AS (SELECT w, least(n, own) AS n, own FROM begun JOIN types USING (w)),
odds AS (SELECT (SELECT sum(n) FROM begins) / (SELECT sum(own) FROM types) AS chance),
starters AS (SELECT w FROM begins, odds WHERE n / own > chance AND {_LIKELIHOOD.format("n", "own", "chance", "(n / own)")} >= 30),
joined AS (SELECT doc_id, i, piece, i > 0 AND (((coalesce(lower(ending) IN (FROM known), FALSE) OR coalesce(regexp_matches(ending, '^\\p{{Lu}}$'), FALSE)) AND (lower(first) NOT IN (FROM starters) OR NOT regexp_matches(first, '^\\p{{Lu}}')))
  OR (ending IS NOT NULL AND regexp_matches(first, '^\\p{{Ll}}'))) AS goes_on FROM parts),
numbered AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM joined)"""


def _all_rules() -> str:
    """Scores by all rules, with every word's three words before it."""
    acts = [f"(b{k}.w IS NOT NULL AND b{k}.own IS NULL)" for k in (1, 2, 3)]
    never = ["FALSE", "b2.w = 'never' AND b1.w IN ('so', 'this')", "b3.w = 'never' AND (b1.w IN ('so', 'this') OR b2.w IN ('so', 'this'))"]
    steps = ""
    for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
        push = f"CASE WHEN {acts[k - 1]} AND b{k}.boost <> 0 THEN {fade}::DOUBLE * sign(v{k - 1}) * (b{k}.boost * 0.293::DOUBLE + CASE WHEN b{k}.loud AND mixed THEN 0.733::DOUBLE ELSE 0.0 END) ELSE 0.0 END"
        turned = f"CASE WHEN {acts[k - 1]} AND coalesce({never[k - 1]}, FALSE) THEN 1.25::DOUBLE WHEN {acts[k - 1]} AND b{k}.neg = 1 THEN -0.74::DOUBLE ELSE 1.0 END"
        steps += f", r{k} AS (SELECT *, (v{k - 1} + {push}) * {turned} AS v{k} FROM r{k - 1})"
    return f"""{_WORDS}, lexicon(w, valence) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON)}), phrases(phrase, valence) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in PHRASES)}),
plain AS (SELECT doc_id, k, word, lower(regexp_replace(word, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS w, upper(word) = word AND lower(word) <> word AS loud FROM words),
facts AS (SELECT doc_id, count(*) FILTER (loud) > 0 AND count(*) FILTER (loud) < count(*) AS mixed, min(k) FILTER (w = 'but') AS but, sum(length(word) - length(replace(word, '!', ''))) AS calls, sum(length(word) - length(replace(word, '?', ''))) AS asks FROM plain GROUP BY doc_id),
near AS (SELECT *, lag(w) OVER o || ' ' || w AS ending, w || ' ' || lead(w) OVER o AS beginning FROM plain WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
valued AS (SELECT n.doc_id, k, n.w, loud, (n.w IN {_NEGATED} OR ends_with(n.w, 'n''t'))::INT AS neg, {_BOOST.replace("WHEN w IN", "WHEN n.w IN")} AS boost,
  CASE WHEN l.valence IS NOT NULL THEN CASE WHEN a.phrase IS NOT NULL AND (b.phrase IS NULL OR a.phrase < b.phrase) THEN a.valence WHEN b.phrase IS NOT NULL THEN b.valence ELSE l.valence END END AS own
  FROM near n LEFT JOIN lexicon l ON l.w = n.w LEFT JOIN phrases a ON a.phrase = ending LEFT JOIN phrases b ON b.phrase = beginning),
backed AS (SELECT *, {", ".join(f"lag({{'w': w, 'own': own, 'loud': loud, 'neg': neg, 'boost': boost}}, {k}) OVER o AS b{k}" for k in (1, 2, 3))} FROM valued WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r0 AS (SELECT *, own + CASE WHEN loud AND mixed THEN sign(own) * 0.733::DOUBLE ELSE 0.0 END AS v0 FROM backed JOIN facts USING (doc_id) WHERE own IS NOT NULL){steps},
turned AS (SELECT doc_id, v3 * CASE WHEN b1.w = 'least' AND coalesce(b2.w, '') NOT IN ('at', 'very') THEN -0.74::DOUBLE ELSE 1.0 END * CASE WHEN k < but THEN 0.5::DOUBLE WHEN k > but THEN 1.5::DOUBLE ELSE 1.0 END AS v FROM r3),
sums AS (SELECT doc_id, coalesce(sum(v), 0.0) AS total, any_value(least(calls, 4) * 0.292::DOUBLE + CASE WHEN asks > 3 THEN 0.96::DOUBLE WHEN asks > 1 THEN asks * 0.18::DOUBLE ELSE 0.0 END) AS marks FROM facts LEFT JOIN turned USING (doc_id) GROUP BY doc_id),
scores AS (SELECT doc_id, total + sign(total) * marks AS valence FROM sums)
SELECT doc_id, round(valence, 6) AS valence, round(valence / sqrt(valence * valence + 15.0), 6) AS compound FROM scores"""


def _closing(steps: int = 5) -> str:
    """All-pairs distances of the weighted trade graph, by min-plus squaring."""
    out = """, d0 AS (SELECT year, s, t, min(d) AS d FROM (SELECT year, a::VARCHAR AS s, b::VARCHAR AS t, 1.0 / w AS d FROM both_ways UNION ALL SELECT DISTINCT year, a::VARCHAR, a::VARCHAR, 0.0 FROM both_ways) GROUP BY ALL)"""
    for k in range(steps):
        out += f", d{k + 1} AS (SELECT x.year, x.s, y.t, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.year = y.year AND x.t = y.s GROUP BY ALL)"
    return out


def _levels(count: int = 8) -> str:
    """Hops between all nodes of the customers' and suppliers' graph, level by level."""
    out = """deal AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
e AS MATERIALIZED (SELECT a, b FROM deal UNION ALL SELECT b, a FROM deal), f0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS t, 0 AS h FROM e), seen0 AS MATERIALIZED (SELECT s, t, h FROM f0)"""
    for k in range(1, count + 1):
        out += f""", f{k} AS MATERIALIZED (SELECT s, t, {k} AS h FROM (SELECT DISTINCT s, b AS t FROM f{k - 1} JOIN e ON t = a) ANTI JOIN seen{k - 1} USING (s, t)),
seen{k} AS MATERIALIZED (SELECT * FROM seen{k - 1} UNION ALL SELECT * FROM f{k})"""
    return out


SQL: dict[str, str] = {
    "edge_sentence_chunks": f"""WITH {_PAIRS}, placed AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY s) - 1 AS k FROM pairs)
SELECT source_id, target_id, k // 5 AS chunk, string_agg(s::VARCHAR, ',' ORDER BY s) AS sentence_ids FROM placed GROUP BY ALL""",
    "occurrence_sentence_chunks": f"""WITH {_PRESENT}, placed AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s) - 1 AS k FROM present)
SELECT e AS canonical_id, k // 50 AS chunk, string_agg(s::VARCHAR, ',' ORDER BY s) AS sentence_ids FROM placed GROUP BY ALL""",
    "marker_ranges": """WITH marks AS (SELECT row_number() OVER w - 1 AS section, event_id AS begin, lead(event_id) OVER w - 1 AS next FROM events WHERE event_type = 'signup' WINDOW w AS (ORDER BY event_id))
SELECT section::INTEGER AS section, begin + CASE WHEN section = 0 THEN 3 ELSE 1 END AS lo, coalesce(next, (SELECT max(event_id) FROM events)) AS hi FROM marks""",
    "span_runs": f"""WITH {_SPANS}, placed AS (SELECT *, token_id - row_number() OVER (PARTITION BY coref ORDER BY token_id) AS g FROM token_map)
SELECT min(token_id) AS lo, max(token_id) AS hi, coref FROM placed GROUP BY coref, g""",
    "closeness_of_traders": f"WITH {_levels()} SELECT t AS node, round((count(*) - 1) / sum(h) * (count(*) - 1) / ((SELECT count(*) FROM f0) - 1), 6) AS closeness FROM seen8 GROUP BY t",
    "cooccurrence_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "occurrence_counts": f'WITH {_PRESENT} SELECT e AS canonical_id, count(*) AS "count" FROM present GROUP BY ALL',
    "edges_with_sentence_list": f"WITH {_PAIRS} SELECT source_id, target_id, count(*) AS weight, string_agg(s::VARCHAR, ',' ORDER BY s) AS sentence_ids FROM pairs GROUP BY ALL",
    "top_pairs": f"WITH {_EDGES} SELECT * FROM edges ORDER BY weight DESC, source_id, target_id LIMIT 10",
    "named_edges": f"WITH {_EDGES} SELECT e.*, a.s_name AS source_name, b.s_name AS target_name FROM edges e LEFT JOIN supplier a ON source_id = a.s_suppkey LEFT JOIN supplier b ON target_id = b.s_suppkey",
    "mentions_in_sentences": "SELECT user_id AS coref, count(DISTINCT event_id // 10) AS n_sentences FROM events GROUP BY ALL",
    "section_edges": f"WITH {_PAIRS}, {_SECTIONS} SELECT section, count(*) AS instances, count(DISTINCT (source_id, target_id)) AS edges FROM pairs JOIN sections ON s BETWEEN lo AND hi GROUP BY ALL",
    "chapter_ranges": """WITH ends AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY ALL),
marks AS (SELECT user_id, row_number() OVER w - 1 AS section, event_id AS begin, lead(event_id) OVER w - 1 AS next FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, section::INTEGER AS section, begin + CASE WHEN section = 0 THEN 3 ELSE 1 END AS lo, coalesce(next, last) AS hi FROM marks JOIN ends USING (user_id)""",
    "directed_labelled_edges": f"""WITH {_ROLES}, {_TOKENS}, {_SECTIONS} SELECT section, lemma AS label, count(*) AS n, count(DISTINCT (left_id, right_id)) AS pairs
FROM triples JOIN order_tokens ON "index" = token_id JOIN sections ON "index" BETWEEN lo AND hi GROUP BY ALL""",
    "avp_triples": f"WITH {_ROLES} SELECT * FROM triples",
    "avp_token_range": f'WITH {_ROLES} SELECT left_id, "index", right_id FROM triples WHERE "index" BETWEEN 100 AND 900',
    "lemma_left_join": f'WITH {_ROLES}, {_TOKENS} SELECT lemma, count(*) AS n, count(DISTINCT sentence_id) AS n_sentences FROM triples LEFT JOIN order_tokens ON "index" = token_id GROUP BY ALL',
    "negation_exists": "SELECT event_id AS token_id, EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND (c.event_id // 10) * 10 = e.event_id) AS negated FROM events e",
    "combined_triples": """WITH u AS (SELECT event_type AS source, user_id % 20 AS left_id, event_id % 50 AS "index", CAST(trunc(value) AS BIGINT) % 10 AS right_id, event_id AS pos, 'subject' AS role_left FROM events WHERE event_type IN ('view', 'click')),
k AS (SELECT *, row_number() OVER (PARTITION BY left_id, "index", right_id ORDER BY source = 'click', pos) AS k FROM u) SELECT * EXCLUDE (k) FROM k WHERE k = 1""",
    "allow_list": "SELECT doc_id AS character_id FROM documents WHERE n_chars > 3000 OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "conditional_update": "SELECT CASE WHEN n_regionkey IN (1, 3) THEN -1 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN 'GROUP' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "flatten_nested": """SELECT conv_id AS character_id, CASE WHEN role = 'user' THEN 'agent' ELSE 'patient' END AS role, turn::BIGINT AS "index", p::INTEGER AS name_pos,
CASE WHEN p = 0 THEN 'c' || (conv_id % 9) ELSE 'talk' END AS name, length(text)::INTEGER AS length FROM conversations, (VALUES (0), (1)) AS names(p)""",
    "normalize_name": """SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower('The ' || p_name || ', "' || p_type || '-x.'), '[.,"-]', '', 'g'), '\\s+', ' ', 'g')), '^the ', ''), '^a ', ''), '^an ', '') AS name FROM part""",
    "clean_tokens": """SELECT p_partkey, coalesce(array_to_string(list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '),
lambda w: w IN ('red', 'of', 'st', 'mr', 'lady') OR (w NOT IN ('polished', 'steel', 'economy') AND length(w) > 2)), ' '), '') AS name FROM part""",
    "gender_class": "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'f' WHEN 'BUILDING' THEN 'm' ELSE 'u' END AS gender FROM customer",
    "preprocess_text": """WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\bIll\\b\\s+', '', 'g'), '\\s+', ' ', 'g')) AS x FROM documents) SELECT doc_id, length(x) AS length, md5(x) AS digest FROM c""",
    "sentence_lines": """WITH c AS (SELECT trim(regexp_replace(regexp_replace(text, '\\bIll\\b\\s+', '', 'g'), '\\s+', ' ', 'g')) AS x FROM documents)
SELECT unnest(string_split(regexp_replace(x, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))) AS line FROM c""",
    "whole_texts": "SELECT url AS line FROM pages WHERE url <> ''",
    "raw_tokens": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '"' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN 'nan' ELSE p_name END || CASE WHEN p_size % 3 = 0 THEN '"' ELSE '' END AS word, p_size FROM part""",
    "quoted_columns": """SELECT p_partkey, 'a' || chr(9) || p_name || '"' || p_type AS name FROM part""",
    "edge_file": f"WITH {_PAIRS} SELECT source_id, target_id, count(*) AS weight, string_agg(s::VARCHAR, ',' ORDER BY s) AS sentence_ids FROM pairs GROUP BY ALL",
    "character_records": """SELECT conv_id AS id, count(*) AS "count", count(*) FILTER (role = 'user') AS n_agent, count(*) FILTER (role <> 'user') AS n_patient,
  coalesce(string_agg(turn::VARCHAR, ',' ORDER BY text, turn) FILTER (role <> 'user'), '') AS turns FROM conversations GROUP BY conv_id""",
    "graph_file": f"""WITH {_EDGES} SELECT 'node' AS element, s_suppkey::VARCHAR AS id, s_name || ' &lt;&amp;&quot;&gt;' AS label, '' AS a, '' AS b, '' AS weight FROM supplier
UNION ALL SELECT 'edge', '', '', source_id::VARCHAR, target_id::VARCHAR, weight::VARCHAR FROM edges UNION ALL SELECT e, '', '', '', '', '' FROM (VALUES ('gexf'), ('/nodes'), ('/edges')) t(e)""",
    "degree_report": """WITH ends AS (SELECT 'c' || o_custkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 's' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
degrees AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT (row_number() OVER (ORDER BY degree DESC, node) - 1)::INTEGER AS place, node || ';' || degree AS line FROM degrees ORDER BY place LIMIT 20""",
    "sentence_segments": """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, unnest(range(len(s)))::INTEGER AS sentence_id, unnest(s) AS sentence FROM s""",
    "abbreviations": f"WITH {_SHORT} SELECT w, round(score, 6) AS score FROM short WHERE score >= 0.3",
    "learnt_sentences": f"WITH {_LEARNT} SELECT doc_id, k::INTEGER AS sentence_id, string_agg(piece, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY doc_id, k",
    "joined_words": "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY ALL",
    "literal_lists": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN '' ELSE n_nationkey || ',' || n_regionkey END AS ids, n_name || ',x' AS names, n_name || ',b,' || n_regionkey AS parts FROM nation",
    "fuzzy_score": f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name AS x, lower(p_type) AS y FROM part), named AS (SELECT x, y, {_SORTED.format("x")} AS a, {_SORTED.format("y")} AS b FROM names),
q AS (SELECT DISTINCT a, b FROM named), {_LCS} SELECT x AS a, y AS b, round(score, 6) AS score FROM named JOIN scored USING (a, b)""",
    "name_variants": """WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'f' ELSE 'm' END AS gender, trim(regexp_replace(regexp_replace(lower(n_name), '[.,"-]', '', 'g'), '\\s+', ' ', 'g')) AS s, lower(r_name) AS f FROM nation JOIN region ON n_regionkey = r_regionkey),
v AS (SELECT id, gender, unnest([s, f, f || ' ' || s, s || ' land', 'old' || s, f || ' trader'] || CASE WHEN gender = 'm' THEN ['mr ' || s, 'mister ' || s, 'mr ' || s, 'mister ' || s] ELSE ['mrs ' || s, 'ms ' || s, 'miss ' || s] END) AS variant FROM n)
SELECT DISTINCT variant, id, gender FROM v""",
    "fuzzy_topk_match": f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name FROM part), asked AS (SELECT DISTINCT query FROM (SELECT regexp_replace(p_name, '[aeiou]([b-df-hj-np-tv-z]*)$', '\\1') AS query FROM names)),
named AS (SELECT query, p_name AS variant, {_SORTED.format("query")} AS a, {_SORTED.format("p_name")} AS b FROM asked, names), q AS (SELECT DISTINCT a, b FROM named), {_LCS},
ranked AS (SELECT query, variant, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(variant), variant) AS place FROM named JOIN scored USING (a, b) WHERE score >= 60)
SELECT query, variant, round(score, 6) AS score, place::INTEGER AS place FROM ranked WHERE place <= 3""",
    "canonical_ids": f"WITH {_MATCHED} SELECT character_id, canonical_id FROM canonical",
    "canonical_summary": f"WITH {_MATCHED} SELECT canonical_id, arg_min(fullname, character_id) AS fullname, string_agg(character_id::VARCHAR, ',' ORDER BY character_id) AS original_ids, round(avg(score), 6) AS avg_score FROM canonical GROUP BY ALL",
    "variants_seen": f"WITH {_MATCHED}, firsts AS (SELECT canonical_id, name, min(character_id) AS p FROM canonical GROUP BY ALL) SELECT canonical_id, string_agg(name, ',' ORDER BY p) AS name_variants FROM firsts GROUP BY ALL",
    "merged_events": f"""WITH {_MATCHED}, k AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, word, i ORDER BY character_id) AS k FROM canonical),
s AS (SELECT canonical_id, arg_min(fullname, character_id) AS name, count(DISTINCT character_id) AS n_ids FROM canonical GROUP BY ALL HAVING avg(score) <> 0)
SELECT canonical_id, word, i AS "index", s.name, n_ids, character_id AS pos FROM k JOIN s USING (canonical_id) WHERE k = 1""",
    "span_token_map": f"WITH {_SPANS} SELECT token_id, coref FROM token_map",
    "coref_lookup": """WITH f AS (SELECT n_regionkey AS r, min(n_name) AS fullname FROM nation GROUP BY ALL), l AS (SELECT n_nationkey AS coref, n_regionkey AS canonical_id, fullname FROM nation JOIN f ON r = n_regionkey WHERE n_regionkey <> 0),
x AS (SELECT c_custkey, unnest([c_nationkey % 3, c_nationkey, 7]) AS coref, unnest([0, 1, 2]) AS p FROM customer)
SELECT c_custkey, arg_min(canonical_id, p) AS canonical_id, arg_min(fullname, p) AS fullname FROM x JOIN l USING (coref) GROUP BY ALL""",
    "ids_to_corefs": f"""WITH {_SPANS}, x AS (SELECT o_orderkey, unnest(range(o_orderkey, o_orderkey + 4)) AS token_id FROM orders), f AS (SELECT o_orderkey, coref, min(token_id) AS t FROM x JOIN token_map USING (token_id) GROUP BY ALL),
g AS (SELECT o_orderkey, string_agg(coref::VARCHAR, ',' ORDER BY t) AS corefs FROM f GROUP BY ALL) SELECT o_orderkey, coalesce(corefs, '') AS corefs FROM orders LEFT JOIN g USING (o_orderkey)""",
    "islands": """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events),
r AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids, min(p) AS start, max(p) + 1 AS stop FROM p GROUP BY user_id, event_id - p)
SELECT user_id, ids, start::INTEGER AS start, stop::INTEGER AS stop, (row_number() OVER (PARTITION BY user_id ORDER BY start) - 1)::INTEGER AS run FROM r""",
    "turn_runs": """WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p)
SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM g GROUP BY conv_id, g""",
    "name_gender": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'f' ELSE 'm' END END AS gender FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "heads_in_sentence": f"""WITH {_CLAUSE}, placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS place FROM tokens)
SELECT a.id AS token_id, a.place::INTEGER AS place, b.place::INTEGER AS head_place FROM placed a JOIN placed b ON a.s = b.s AND a.head = b.id""",
    "svo_extract": f"""WITH RECURSIVE {_CLAUSE}, {_SVO} SELECT s AS sentence_id, st AS subject_text, list_aggregate(si, 'string_agg', ',') AS subject_ids, sp AS subject_pos, vw AS verb_text, lower(vw) AS verb_lemma, verb AS verb_id,
ot AS object_text, list_aggregate(oi, 'string_agg', ',') AS object_ids, op AS object_pos, negated FROM svo""",
    "svo_patterns": f"""WITH RECURSIVE {_CLAUSE}, {_SVO_MORE} SELECT s AS sentence_id, st AS subject_text, list_aggregate(si, 'string_agg', ',') AS subject_ids, sp AS subject_pos, vw AS verb_text, lower(vw) AS verb_lemma, verb AS verb_id,
ot AS object_text, list_aggregate(oi, 'string_agg', ',') AS object_ids, op AS object_pos, negated FROM svo""",
    "svo_chunks": f"""WITH RECURSIVE {_CLAUSE}, {_SVO}, runs AS (SELECT root, kind, string_agg(id, ',' ORDER BY id) AS ids, string_agg(word, ' ' ORDER BY id) AS words FROM (
  SELECT m.*, id - row_number() OVER (PARTITION BY root, kind ORDER BY id) AS g FROM members m) GROUP BY root, kind, g)
SELECT s AS sentence_id, a.ids AS subject_ids, b.words AS object_text, b.ids AS object_ids FROM svo JOIN runs a ON a.root = sroot AND a.kind = 'noun' JOIN runs b ON b.root = oroot AND b.kind = okind""",
    "extraction_triples": f"""WITH RECURSIVE {_CLAUSE}, {_SVO}, {_EXTRACTED} SELECT * FROM combined""",
    "extraction_statistics": f"""WITH RECURSIVE {_CLAUSE}, {_SVO}, {_EXTRACTED}, every AS (SELECT * FROM combined UNION ALL SELECT * REPLACE ('all' AS source) FROM combined),
entities AS (SELECT source, count(DISTINCT e) AS n_entities FROM (SELECT source, unnest([canonical_id_left, canonical_id_right]) AS e FROM every) GROUP BY source)
SELECT source, count(*) AS n, count(*) FILTER (negated) AS negated, count(DISTINCT canonical_id_left) AS n_left, count(DISTINCT canonical_id_right) AS n_right,
  count(*) FILTER (canonical_id_left = canonical_id_right) AS n_loops, any_value(n_entities) AS n_entities FROM every JOIN entities USING (source) GROUP BY source""",
    "extraction_edges": f"""WITH RECURSIVE {_CLAUSE}, {_NOUNS}, present AS (SELECT DISTINCT s, coref FROM nouns WHERE coref IN (SELECT coref FROM live)), names AS (SELECT coref, min(word) AS name FROM nouns GROUP BY coref)
SELECT a.coref AS source_id, m.name AS source_name, b.coref AS target_id, n.name AS target_name, count(*) AS weight FROM present a JOIN present b ON a.s = b.s AND a.coref < b.coref
JOIN names m ON m.coref = a.coref JOIN names n ON n.coref = b.coref GROUP BY ALL""",
    "triples_without_mappings": f"""WITH RECURSIVE {_CLAUSE}, {_SVO}, {_EXTRACTED} SELECT 'svo' AS source, l AS canonical_id_left, vw AS word, lower(vw) AS lemma, verb AS "index", r AS canonical_id_right FROM sides""",
    "compound_closure": f"""WITH RECURSIVE {_CLAUSE}, c(root, id) AS (SELECT id, id FROM tokens WHERE dep = 'dobj' UNION SELECT c.root, t.id FROM c JOIN tokens t ON t.head = c.id AND t.dep = 'compound' AND t.id <> t.head)
SELECT root, id AS token_id FROM c""",
    "event_value_counts": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY ALL",
    "stats_report": "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg((event_type = 'error')::INT), 6) AS errors_share, count(*) FILTER (value > 50) AS large, round(avg(coalesce(value > 50, false)::INT), 6) AS large_share FROM events",
    "distinct_over": f"WITH {_TRADE} SELECT count(DISTINCT v) AS n FROM (SELECT a AS v FROM trade UNION ALL SELECT b FROM trade)",
    "induced_subgraph": f"WITH {_EDGES}, main AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) SELECT source_id AS a, target_id AS b, weight FROM edges WHERE source_id IN (FROM main) AND target_id IN (FROM main)",
    "degree_centrality": f"""WITH {_TRADE}, d AS (SELECT year, unnest([a, b]) AS node FROM trade), c AS (SELECT year, node, count(*) AS degree FROM d GROUP BY ALL)
SELECT year, node, degree, CASE WHEN count(*) OVER (PARTITION BY year) = 1 THEN 1.0 ELSE round(degree / (count(*) OVER (PARTITION BY year) - 1), 6) END AS centrality FROM c""",
    "weighted_graph": f"WITH {_TRADE} SELECT year, least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight, round(1.0 / count(*), 6)::DOUBLE AS distance FROM trade WHERE a <> b GROUP BY year, least(a, b), greatest(a, b)",
    "graph_summary": f"""WITH {_TRADE}, w AS (SELECT year, least(a, b) AS x, greatest(a, b) AS y, count(*) AS weight FROM trade WHERE a <> b GROUP BY ALL), n AS (SELECT year, count(DISTINCT v) AS n_nodes FROM (SELECT year, unnest([a, b]) AS v FROM trade) GROUP BY ALL)
SELECT year, n_nodes, sum(weight)::BIGINT AS n_edges, count(*) AS n_pairs, max(weight) AS max_weight FROM w JOIN n USING (year) GROUP BY ALL""",
    "closeness": f"WITH RECURSIVE {_RING}, {_HOPS} SELECT section, t AS node, {_VALUE} AS value FROM hops JOIN sizes USING (section) GROUP BY ALL",
    "closeness_by_joins": f"WITH RECURSIVE {_RING}, {_HOPS} SELECT section, t AS node, {_VALUE} AS closeness FROM hops JOIN sizes USING (section) GROUP BY ALL",
    "closeness_directed": f"""WITH RECURSIVE {_RING}, walk(section, s, t, h) AS (SELECT section, node, node, 0 FROM ring_nodes UNION SELECT w.section, w.s, r.b, h + 1 FROM walk w JOIN ring r ON w.section = r.section AND w.t = r.a WHERE h < 25),
hops AS (SELECT section, s, t, min(h) AS h FROM walk GROUP BY ALL) SELECT section, t AS node, {_VALUE} AS value FROM hops JOIN sizes USING (section) GROUP BY ALL""",
    "closeness_evolution": f"""WITH {_TRADE}, w AS (SELECT year, least(a, b) AS a, greatest(a, b) AS b, count(*) AS w FROM trade WHERE a <> b GROUP BY year, least(a, b), greatest(a, b)),
both_ways AS (SELECT year, a, b, w FROM w UNION ALL SELECT year, b, a, w FROM w){_closing()}, n AS (SELECT year, count(DISTINCT s) AS n FROM d0 GROUP BY ALL),
c AS (SELECT year, t AS node, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / (any_value(n) - 1) ELSE 0.0 END AS value FROM d5 JOIN n USING (year) GROUP BY ALL)
SELECT g.year, g.node, round(coalesce(value, 0.0), 6) AS value FROM (SELECT DISTINCT year, n_nationkey::VARCHAR AS node FROM trade, nation) g LEFT JOIN c ON g.year = c.year AND g.node = c.node""",
    "betweenness": f"""WITH RECURSIVE {_RING}, {_HOPS}, paths(section, s, t, h, c) AS (SELECT section, node, node, 0, 1.0::DOUBLE FROM ring_nodes UNION ALL
  SELECT p.section, p.s, l.b, p.h + 1, sum(p.c) FROM paths p JOIN links l ON p.section = l.section AND p.t = l.a JOIN hops x ON x.section = p.section AND x.s = p.s AND x.t = l.b AND x.h = p.h + 1 GROUP BY p.section, p.s, l.b, p.h),
through AS (SELECT x.section, x.t AS v, sum(x.c * y.c / z.c) AS b FROM paths x JOIN paths y ON x.section = y.section AND x.t = y.s JOIN paths z ON z.section = x.section AND z.s = x.s AND z.t = y.t AND z.h = x.h + y.h
  WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY ALL)
SELECT r.section, r.node, round(coalesce(b, 0.0) / ((n - 1) * (n - 2)), 6) AS value FROM ring_nodes r JOIN sizes USING (section) LEFT JOIN through x ON x.section = r.section AND x.v = r.node""",
    "eigenvector": f"""WITH RECURSIVE {_RING}, x(k, section, node, v) AS (SELECT 0, section, node, 1.0::DOUBLE FROM ring_nodes UNION ALL
  SELECT k, section, node, v / sqrt(sum(v * v) OVER (PARTITION BY section)) FROM (SELECT x.k + 1 AS k, l.section, l.b AS node, sum(x.v) AS v FROM x JOIN (SELECT section, a, b FROM links UNION ALL SELECT section, node, node FROM ring_nodes) l ON x.section = l.section AND x.node = l.a WHERE x.k < 900 GROUP BY x.k, l.section, l.b))
SELECT section, node, round(v, 6) AS value, true AS converged FROM x WHERE k = 900""",
    "katz": f"""WITH RECURSIVE {_RING}, x(k, section, node, v) AS (SELECT 0, section, node, 0.0::DOUBLE FROM ring_nodes UNION ALL
  SELECT x.k + 1, x.section, l.b, 0.1 * sum(x.v) + 1.0 FROM x JOIN links l ON x.section = l.section AND x.node = l.a WHERE x.k < 300 GROUP BY x.k, x.section, l.b)
SELECT section, node, round(v / sqrt(sum(v * v) OVER (PARTITION BY section)), 6) AS value, true AS converged FROM x WHERE k = 300""",
    "contraction_hypothesis": f"""WITH RECURSIVE {_RING}, merged AS (SELECT l.section, n.node AS candidate, CASE WHEN a = '5' THEN n.node ELSE a END AS a, CASE WHEN b = '5' THEN n.node ELSE b END AS b FROM links l JOIN ring_nodes n ON l.section = n.section),
ml AS (SELECT DISTINCT section, candidate, a, b FROM merged WHERE a <> b), mn AS (SELECT DISTINCT section, candidate, a AS node FROM ml), ms AS (SELECT section, candidate, count(*) AS n FROM mn GROUP BY ALL),
walk(section, candidate, s, t, h) AS (SELECT section, candidate, node, node, 0 FROM mn UNION SELECT w.section, w.candidate, w.s, l.b, h + 1 FROM walk w JOIN ml l ON w.section = l.section AND w.candidate = l.candidate AND w.t = l.a WHERE h < 24),
hops AS (SELECT section, candidate, s, t, min(h) AS h FROM walk GROUP BY ALL),
c AS (SELECT section, candidate, t AS node, CASE WHEN sum(h) > 0 THEN (count(*) - 1) / sum(h) * (count(*) - 1) / (any_value(n) - 1) ELSE 0.0 END AS value FROM hops JOIN ms USING (section, candidate) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY section, candidate ORDER BY value DESC, node) AS rank FROM c)
SELECT section, candidate, rank::INTEGER AS rank, round(value, 6) AS value, rank = 1 AS possible FROM r WHERE node = candidate""",
    "display_scale": f"""WITH {_TRADE}, w AS (SELECT year, least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight FROM trade WHERE a <> b GROUP BY year, least(a, b), greatest(a, b))
SELECT *, round(weight / max(weight) OVER (PARTITION BY year), 6) AS scaled FROM w""",
    "document_sentiment_by_all_rules": f"WITH {_all_rules()}",
    "document_sentiment": f"WITH {_SCORES} SELECT doc_id, round(valence, 6) AS valence, round(compound, 6) AS compound FROM scores",
    "sentiment_by_pair": f"WITH {_SCORES} SELECT least(source, lang) AS a, greatest(source, lang) AS b, round(sum(compound), 6) AS total, round(avg(compound), 6) AS mean FROM documents JOIN scores USING (doc_id) GROUP BY least(source, lang), greatest(source, lang)",
    "incident_sentiment": f"""WITH {_TRADE}, e AS (SELECT year, a, b, (a - b) / 25.0 AS s FROM trade), i AS (SELECT year, a AS node, s FROM e UNION ALL SELECT year, b, s FROM e), m AS (SELECT year, node, avg(s) AS mean FROM i GROUP BY ALL)
SELECT g.year, g.node, round(coalesce(mean, 0.0), 6) AS mean FROM (SELECT DISTINCT year, n_nationkey AS node FROM trade, nation) g LEFT JOIN m USING (year, node)""",
    "window_pairs": """WITH p AS (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) AS w, user_id AS e FROM events) SELECT a.e AS source_id, b.e AS target_id, count(*) AS weight FROM p a JOIN p b ON a.w = b.w AND a.e < b.e GROUP BY ALL""",
    "stream_pairs": """WITH p AS (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) AS w, user_id AS e FROM events), c AS (SELECT * FROM p WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
SELECT a.e AS source_id, b.e AS target_id, count(*) AS weight FROM c a JOIN c b ON a.w = b.w AND a.e < b.e GROUP BY ALL""",
}

SQL["section_analysis"] = f"""SELECT section, node, 'closeness' AS measure, value FROM ({SQL["closeness"]})
UNION ALL SELECT section, node, 'betweenness', value FROM ({SQL["betweenness"]})
UNION ALL SELECT section, node, 'eigenvector', value FROM ({SQL["eigenvector"]})
UNION ALL SELECT section, node, 'katz', value FROM ({SQL["katz"]})
UNION ALL SELECT section, node, 'degree', round(count(*) / any_value(n - 1), 6) FROM (WITH {_RING} SELECT section, unnest([a, b]) AS node FROM ring) JOIN (WITH {_RING} SELECT section, count(*) AS n FROM ring_nodes GROUP BY section) USING (section) GROUP BY section, node"""

SQL["match_names"] = f"""WITH RECURSIVE v AS ({SQL["name_variants"]}), known AS (SELECT DISTINCT unnest(string_split(variant, ' ')) AS w FROM v),
asked AS (SELECT n_nationkey AS character_id, 'that ' || lower(substr(n_name, 1, 4)) || lower(substr(n_name, 6)) || ' man' AS name, CASE n_nationkey % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'f' ELSE 'm' END AS gender FROM nation),
split AS (SELECT character_id, unnest(string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ')) AS w, unnest(range(len(string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ')))) AS p FROM asked),
kept AS (SELECT character_id, w, row_number() OVER (PARTITION BY character_id ORDER BY p) AS turn, w IN (FROM known) AS known FROM split WHERE w IN (FROM known) OR w IN ('mr', 'mrs') OR (w NOT IN ('that', 'man') AND length(w) > 2)),
tries AS (SELECT character_id, 0 AS turn, string_agg(w, ' ' ORDER BY turn) AS query, 1.0 AS factor FROM kept GROUP BY character_id UNION ALL SELECT character_id, turn, w, 0.9 FROM kept WHERE known AND length(w) > 2),
listed AS (SELECT variant, min(id) AS id_order FROM v GROUP BY ALL),
named AS (SELECT query, variant, id_order, {_SORTED.format("query")} AS a, {_SORTED.format("variant")} AS b FROM (SELECT DISTINCT query FROM tries), listed), q AS (SELECT DISTINCT a, b FROM named), {_LCS},
ranked AS (SELECT query, variant, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id_order, variant) AS place FROM named JOIN scored USING (a, b) WHERE score >= 60),
gated AS (SELECT character_id, turn, factor * score AS score, id, v.gender AS own, a.gender, row_number() OVER (PARTITION BY character_id ORDER BY turn, place, id) AS k
  FROM tries JOIN asked a USING (character_id) JOIN ranked USING (query) JOIN v USING (variant) WHERE place <= 10 AND a.gender <> 'u' AND (a.gender = v.gender OR score * 0.8 >= 60))
SELECT name, a.gender, character_id, coalesce(id, -1) AS matched_id, coalesce('The ' || n_name, name) AS matched_fullname, round(coalesce(score, 0.0), 6) AS match_score, CASE WHEN own <> g.gender THEN own END AS corrected_gender
FROM asked a LEFT JOIN (SELECT * FROM gated WHERE k = 1) g USING (character_id) LEFT JOIN nation ON n_nationkey = id"""
