"""SQL twins of the queries, for any engine with ANSI SQL, windows and list functions (written for DuckDB)."""

from __future__ import annotations

from kindred.options import BUDGET as BUDGET_OF
from kindred.options import SAMPLE, Budget


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[^\p{{L}}\p{{M}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def trim(x: str) -> str:
    return rf"coalesce(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '')"


_BASE = {
    "part": "SELECT p_partkey AS row_id, p_name AS business_name, p_brand || ', ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS business_address, p_type AS country FROM part",
    "doc": "SELECT doc_id AS row_id, split_part(text, chr(10), 1) AS business_name, substr(text, length(split_part(text, chr(10), 1)) + 2) AS business_address, lang AS country FROM documents",
    "bench": "SELECT item_id * 3 AS row_id, text AS business_name, '' AS business_address, '' AS country FROM benchmark UNION ALL SELECT doc_id + doc_id // 2 + 1, text, '', lang FROM documents",
}
RUNS = r"regexp_extract_all(business_address, '\p{Nd}+')"


def view(name: str) -> str:
    """WITH e (entities) and n (with normal forms)."""
    return f"""WITH base AS ({_BASE[name]}),
e AS (SELECT 'S' || (row_id % 3 + 1) || '-' || row_id AS entity_id, CAST(row_id % 3 + 1 AS INTEGER) AS source, row_id, {trim('business_name')} AS business_name, {trim('business_address')} AS business_address, {trim('country')} AS country FROM base),
n AS (SELECT *, {norm('business_name')} AS name_norm, {norm('business_address')} AS address_norm, array_to_string({RUNS}, ' ') AS address_dig FROM e)
"""


TRUTH = """, same AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, CAST(doc_id % 3 + 1 AS INTEGER) AS source, md5(text) AS h FROM documents),
truth AS (SELECT a.id AS s1_id, b.id AS candidate_id, b.source FROM same a JOIN same b USING (h) WHERE a.source = 1 AND b.source > 1)
"""
#: Tokens of both fields: entity, source, row, field, token and where it is first seen.
TOKENS = """, spread AS (SELECT entity_id, source, row_id, 'name_norm' AS field, unnest(string_split(name_norm, ' ')) AS token, generate_subscripts(string_split(name_norm, ' '), 1) AS pos FROM n
UNION ALL SELECT entity_id, source, row_id, 'address_norm', unnest(string_split(address_norm, ' ')), generate_subscripts(string_split(address_norm, ' '), 1) FROM n),
tok AS (SELECT entity_id, source, row_id, field, token, min(pos) AS pos FROM spread WHERE length(token) >= 3 GROUP BY ALL),
df AS (SELECT source, field, token, count(*) AS df FROM tok GROUP BY ALL)
"""
CHANNELS = "concat_ws('|', CASE WHEN bits & 1 > 0 THEN 'exact_name' END, CASE WHEN bits & 2 > 0 THEN 'exact_address' END, CASE WHEN bits & 4 > 0 THEN 'address_digits' END, CASE WHEN bits & 8 > 0 THEN 'rare_token' END, CASE WHEN bits & 16 > 0 THEN 'ngram' END)"

ENTITIES = view("part") + "SELECT entity_id, source, business_name, business_address, country FROM e"
NORM = view("doc") + "SELECT entity_id, name_norm, address_norm FROM n"
DIGITS = view("part") + f"SELECT entity_id, array_to_string({RUNS}, ' ') AS address_dig, CAST(len({RUNS}) AS INTEGER) AS n_runs, CAST(len(list_distinct({RUNS})) AS INTEGER) AS n_distinct FROM e"
TOKEN_SETS = view("doc") + TOKENS + "SELECT n.entity_id, coalesce(string_agg(token, ' ' ORDER BY token), '') AS tokens, CAST(count(token) AS INTEGER) AS n_tokens FROM n LEFT JOIN tok ON n.entity_id = tok.entity_id AND field = 'name_norm' GROUP BY n.entity_id"
COMPACT = view("part") + r"SELECT entity_id, regexp_replace(lower(business_name), '[^\p{L}\p{N}_]+', '', 'g') AS compact FROM e"


def _channel(key: str, bit: int, cap: int) -> str:
    return f"""SELECT q.entity_id AS s1_id, t.entity_id AS candidate_id, t.source, {bit} AS bits FROM n q
JOIN (SELECT *, row_number() OVER (PARTITION BY {key}, source ORDER BY row_id) AS place FROM n WHERE source > 1 AND {key} <> '') t ON q.{key} = t.{key} WHERE q.source = 1 AND place <= {cap}"""


def exact(key: str, cap: int) -> str:
    return view("part") + f"SELECT s1_id, candidate_id, source FROM ({_channel(key, 0, cap)})"


def exact_union(name: str, budget: Budget) -> str:
    parts = " UNION ALL ".join(_channel(k, b, c) for k, b, c in (("name_norm", 1, budget.exact_cap), ("address_norm", 2, budget.exact_cap), ("address_dig", 4, budget.digit_cap)))
    return view(name) + f", found AS (SELECT s1_id, candidate_id, source, CAST(bit_or(bits) AS INTEGER) AS bits FROM ({parts}) GROUP BY ALL)\n"


EVIDENCE = "100 * CAST(bit_count(bits) AS INTEGER) + CASE WHEN bits & 1 > 0 THEN 30 ELSE 0 END + CASE WHEN bits & 2 > 0 THEN 30 ELSE 0 END + CASE WHEN bits & 4 > 0 THEN 10 ELSE 0 END"
BUDGET = f"SELECT s1_id, candidate_id, source, bits FROM found QUALIFY row_number() OVER (PARTITION BY source, s1_id ORDER BY {EVIDENCE} DESC, candidate_id) <= {{per_s1}}"
TOKEN_DF = view("doc") + TOKENS + "SELECT * FROM df"
POSTINGS = view("doc") + TOKENS + "SELECT source, token, max(df) AS df, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM tok JOIN df USING (source, field, token) WHERE field = 'name_norm' AND source > 1 AND df <= " + str(BUDGET_OF.max_token_df) + " GROUP BY ALL"
_LISTED = f", listed AS (SELECT tok.*, df FROM tok JOIN df USING (source, field, token) WHERE source > 1 AND df <= {BUDGET_OF.max_token_df})\n"
RAREST = view("doc") + TOKENS + _LISTED + """, known AS (SELECT DISTINCT source, token, df FROM listed WHERE field = 'name_norm'),
probe AS (SELECT tok.entity_id AS s1_id, known.source, known.token FROM tok JOIN known USING (token) WHERE tok.source = 1 AND tok.field = 'name_norm' QUALIFY row_number() OVER (PARTITION BY tok.entity_id, known.source ORDER BY known.df, tok.pos) = 1)
SELECT DISTINCT s1_id, l.entity_id AS candidate_id, l.source FROM probe JOIN listed l ON l.source = probe.source AND l.token = probe.token AND l.field = 'name_norm'"""
ANY_TOKEN = view("doc") + TOKENS + _LISTED + "SELECT DISTINCT q.entity_id AS s1_id, l.entity_id AS candidate_id, l.source FROM tok q JOIN listed l ON q.token = l.token AND l.field = 'name_norm' WHERE q.source = 1 AND q.field = 'name_norm'"


def _rare(budget: Budget) -> str:
    most = min(budget.max_token_df, budget.token_bucket_cap)
    place = "{'i': CASE WHEN l.field = 'name_norm' THEN 0 ELSE 1 END, 'f': CASE WHEN q.field = 'name_norm' THEN 0 ELSE 1 END, 'd': l.df, 'p': q.pos, 'r': l.row_id}"
    return TOKENS + f""", listed AS (SELECT tok.*, df FROM tok JOIN df USING (source, field, token) WHERE source > 1 AND df <= {most}),
place AS (SELECT q.entity_id AS s1_id, l.entity_id AS candidate_id, l.source, min({place}) AS place FROM tok q JOIN listed l ON q.token = l.token WHERE q.source = 1 GROUP BY ALL),
held AS (SELECT s1_id, source, count(*) AS held FROM found GROUP BY ALL),
fresh AS (SELECT p.*, row_number() OVER (PARTITION BY p.s1_id, p.source ORDER BY place) AS r, coalesce(held, 0) AS held FROM place p LEFT JOIN held USING (s1_id, source) WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.s1_id = p.s1_id AND f.candidate_id = p.candidate_id)),
retrieved AS (SELECT s1_id, candidate_id, source, bits FROM found UNION ALL SELECT s1_id, candidate_id, source, 8 FROM fresh WHERE r <= {budget.per_s1} - held)
"""


def rare_token(name: str, budget: Budget) -> str:
    return exact_union(name, budget) + _rare(budget) + "SELECT * FROM retrieved"


DIGIT_TOKEN = view("part") + TOKENS + """, listed AS (SELECT tok.*, df FROM tok JOIN df USING (source, field, token) WHERE source > 1 AND df <= 2000),
shared AS (SELECT DISTINCT q.entity_id AS s1_id, l.entity_id AS candidate_id, l.source FROM tok q JOIN listed l ON q.token = l.token AND q.field = l.field WHERE q.source = 1)
SELECT a.entity_id AS s1_id, b.entity_id AS candidate_id, b.source FROM n a JOIN n b USING (address_dig) JOIN shared s ON s.s1_id = a.entity_id AND s.candidate_id = b.entity_id WHERE a.source = 1 AND b.source > 1 AND address_dig <> ''"""
_KEYED = """few AS (SELECT source, key FROM keyed WHERE source > 1 GROUP BY ALL HAVING count(*) <= {most})
SELECT DISTINCT q.entity_id AS s1_id, t.entity_id AS candidate_id, t.source FROM keyed q JOIN keyed t USING (key) JOIN few ON few.source = t.source AND few.key = t.key WHERE q.source = 1 AND t.source > 1"""


def windows(k: int) -> str:
    nexts = " || ' ' || ".join(["token", *[f"lead(token, {i}) OVER w" for i in range(1, k)]])
    return view("doc") + TOKENS + f", keyed AS (SELECT entity_id, source, key FROM (SELECT entity_id, source, {nexts} AS key FROM tok WHERE field = 'name_norm' WINDOW w AS (PARTITION BY entity_id ORDER BY token)) WHERE key IS NOT NULL),\n" + _KEYED.format(most=BUDGET_OF.max_token_df)


PAIR_COMBO = view("doc") + TOKENS + ", keyed AS (SELECT a.entity_id, a.source, a.token || ' ' || b.token AS key FROM tok a JOIN tok b ON a.entity_id = b.entity_id AND a.field = b.field AND a.token < b.token WHERE a.field = 'name_norm'),\n" + _KEYED.format(most=20)
COLLISIONS = view("doc") + TRUTH + """, kept AS (SELECT *, lower(business_name) AS name_key FROM n WHERE business_name <> '' QUALIFY row_number() OVER (PARTITION BY lower(business_name) ORDER BY row_id) <= 6)
SELECT a.entity_id AS s1_id, b.entity_id AS candidate_id FROM kept a JOIN kept b USING (name_key) WHERE a.source = 1 AND b.source > 1 AND a.address_norm <> b.address_norm
AND NOT EXISTS (SELECT 1 FROM truth WHERE s1_id = a.entity_id AND candidate_id = b.entity_id) ORDER BY 1, 2 LIMIT 10000"""

_DOC = BUDGET_OF
_FOUND = exact_union("doc", _DOC) + TRUTH


def recall(by: str) -> str:
    key, join, first = (", source", "USING (s1_id, source)", "source, ") if by else ("", "USING (s1_id)", "")
    return _FOUND + f""", t AS (SELECT s1_id{key}, count(DISTINCT candidate_id) AS n_true FROM truth GROUP BY ALL), c AS (SELECT s1_id{key}, count(DISTINCT candidate_id) AS n FROM found GROUP BY ALL),
h AS (SELECT t.s1_id{', t.source' if by else ''}, count(DISTINCT t.candidate_id) AS hit FROM truth t JOIN found f ON t.s1_id = f.s1_id AND t.candidate_id = f.candidate_id GROUP BY ALL),
r AS (SELECT {first}n_true, coalesce(n, 0) AS n_cand, coalesce(hit, 0) AS hit FROM t LEFT JOIN c {join} LEFT JOIN h {join})
SELECT {first}CAST(sum(n_true) AS BIGINT) AS true_pairs, CAST(sum(hit) AS BIGINT) AS recalled, round(sum(hit) / sum(n_true), 6) AS recall, round(avg(n_cand), 1) AS mean_candidates, CAST(floor(quantile_cont(n_cand, 0.5)) AS INTEGER) AS p50, CAST(floor(quantile_cont(n_cand, 0.95)) AS INTEGER) AS p95, CAST(floor(quantile_cont(n_cand, 0.99)) AS INTEGER) AS p99, count(*) AS n_s1 FROM r {'GROUP BY source' if by else ''}"""


_NAMES = ("exact_name", "exact_address", "address_digits", "rare_token", "ngram")
PROGRESSIVE = _FOUND + ", hit AS (SELECT DISTINCT t.s1_id, t.candidate_id, coalesce(bits, 0) AS bits FROM truth t LEFT JOIN found f ON t.s1_id = f.s1_id AND t.candidate_id = f.candidate_id)\n" + " UNION ALL ".join(f"SELECT '{n}' AS channel, round(avg(CASE WHEN bits & {1 << i} > 0 THEN 1 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN bits & {(2 << i) - 1} > 0 THEN 1 ELSE 0 END), 6) AS union_recall FROM hit" for i, n in enumerate(_NAMES))


def recall_with_rare() -> str:
    """Recall of the exact channels and rare tokens together."""
    return recall("").replace(_FOUND, exact_union("doc", _DOC) + _rare(_DOC) + TRUTH).replace("AS n FROM found GROUP", "AS n FROM retrieved GROUP").replace("JOIN found f", "JOIN retrieved f")


def budget_grid(budgets: tuple[int, ...]) -> str:
    one = """SELECT {b} AS per_s1, round(sum(hit) / sum(n_true), 6) AS recall, round(avg(n_cand), 4) AS mean_candidates, CAST(quantile_cont(n_cand, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(n_cand, 0.95) AS DOUBLE) AS p95, CAST(round(avg(n_cand) * 2206821) AS BIGINT) AS full_pairs, round(avg(n_cand) * 2206821 * 12 / 1073741824, 6) AS full_gb FROM (SELECT s1_id, count(DISTINCT t.candidate_id) AS n_true,
(SELECT count(*) FROM ranked f WHERE f.s1_id = t.s1_id AND r <= {b}) AS n_cand, (SELECT count(*) FROM ranked f JOIN tt USING (s1_id, candidate_id) WHERE f.s1_id = t.s1_id AND r <= {b}) AS hit FROM tt t GROUP BY s1_id)"""
    return _FOUND + f", tt AS (SELECT DISTINCT s1_id, candidate_id FROM truth), ranked AS (SELECT *, row_number() OVER (PARTITION BY source, s1_id ORDER BY {EVIDENCE} DESC, candidate_id) AS r FROM found)\n" + " UNION ALL ".join(one.format(b=b) for b in budgets)


RARITY = view("doc") + TRUTH + TOKENS + """, tt AS (SELECT DISTINCT s1_id, candidate_id, source FROM truth), nt AS (SELECT * FROM tok WHERE field = 'name_norm'),
shared AS (SELECT tt.s1_id, tt.candidate_id, min(df.df) AS rarest, count(*) AS n_shared FROM tt JOIN nt a ON a.entity_id = tt.s1_id JOIN nt b ON b.entity_id = tt.candidate_id AND b.token = a.token JOIN df ON df.source = b.source AND df.token = b.token AND df.field = 'name_norm' GROUP BY ALL),
w AS (SELECT * FROM tt LEFT JOIN shared USING (s1_id, candidate_id))
""" + " UNION ALL ".join([f"SELECT 'max_df {x}' AS measure, round(avg(CASE WHEN rarest <= {x} THEN 1 ELSE 0 END), 6) AS share FROM w" for x in (1, 5, 20, 100)] + [f"SELECT 'shares {k}', round(avg(CASE WHEN n_shared >= {k} THEN 1 ELSE 0 END), 6) FROM w" for k in (1, 2)])
EXPECTED_ROWS = view("doc") + TOKENS + """, d AS (SELECT token, count(*) AS df FROM tok WHERE source > 1 AND field = 'name_norm' GROUP BY ALL HAVING count(*) <= 1000),
own AS (SELECT entity_id, sum(df) AS r FROM tok JOIN d USING (token) WHERE source = 1 AND field = 'name_norm' GROUP BY ALL), w AS (SELECT r, coalesce(r, 0) AS x FROM n LEFT JOIN own USING (entity_id) WHERE source = 1)
SELECT round(avg(x), 4) AS mean_rows, CAST(quantile_cont(x, 0.5) AS DOUBLE) AS p50_rows, CAST(quantile_cont(x, 0.95) AS DOUBLE) AS p95_rows, round(100 * avg(CASE WHEN r IS NOT NULL THEN 1 ELSE 0 END), 4) AS pct_with_rare FROM w"""


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _jaccard(f: str) -> str:
    a, b = _words(f"{f}1"), _words(f"{f}2")
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _both(f: str) -> str:
    return f"({f}1 <> '' AND {f}2 <> '')"


def _expressions() -> dict[str, str]:
    out = {}
    for f, name in (("n", "name"), ("a", "addr")):
        out[f"{name}_exact"] = f"({f}1 = {f}2 AND {f}1 <> '')"
        out[f"{name}_token_jaccard"] = _jaccard(f)
        out[f"{name}_len_diff"] = f"abs(length({f}1) - length({f}2))"
        out[f"{name}_token_cnt_diff"] = f"abs(len({_words(f + '1')}) - len({_words(f + '2')}))"
        out[f"{name}_len_ratio"] = f"CASE WHEN {_both(f)} THEN least(length({f}1), length({f}2)) / greatest(length({f}1), length({f}2)) ELSE 0.0 END"
    out |= {"digit_exact": "(d1 = d2 AND d1 <> '')", "digit_overlap": _jaccard("d"), "digit_count_diff": f"abs(len({_words('d1')}) - len({_words('d2')}))", "contr_digit_conflict": f"({_both('d')} AND {_jaccard('d')} < 0.3)"}
    out |= {"country_match": "(c1 = c2 AND c1 <> '')", "country_both_present": _both("c"), "contr_country_conflict": f"({_both('c')} AND c1 <> c2)"}
    out |= {"miss_s1_addr": "(a1 = '')", "miss_cand_addr": "(a2 = '')", "miss_either_addr": "(a1 = '' OR a2 = '')", "miss_s1_name": "(n1 = '')", "miss_cand_name": "(n2 = '')"}
    out |= {f"prov_{n}": f"(bits & {1 << i} > 0)" for i, n in enumerate(_NAMES)} | {"prov_n_channels": "bit_count(bits)"}
    return out


_WIDE = """, wide AS (SELECT f.*, a.name_norm AS n1, b.name_norm AS n2, a.address_norm AS a1, b.address_norm AS a2, a.address_dig AS d1, b.address_dig AS d2, lower(a.country) AS c1, lower(b.country) AS c2 FROM found f JOIN n a ON a.entity_id = f.s1_id JOIN n b ON b.entity_id = f.candidate_id)
"""


def features(names: list[str], budget: Budget) -> str:
    e = _expressions()
    return exact_union("part", budget) + _WIDE + "SELECT s1_id, candidate_id, " + ", ".join(f"round(CAST(CAST({e[n]} AS FLOAT) AS DOUBLE), 6) AS {n}" for n in names) + " FROM wide"


def _score() -> str:
    e = {k: f"CAST(CAST({v} AS FLOAT) AS DOUBLE)" for k, v in _expressions().items()}
    name = f"0.4::DOUBLE * {e['name_exact']} + 0.6::DOUBLE * {e['name_token_jaccard']}"
    addr = f"0.3::DOUBLE * {e['addr_exact']} + 0.4::DOUBLE * {e['addr_token_jaccard']} + 0.2::DOUBLE * {e['digit_overlap']} + 0.1::DOUBLE * {e['digit_exact']}"
    minus = f"0.2::DOUBLE * {e['contr_digit_conflict']} + 0.2::DOUBLE * {e['contr_country_conflict']}"
    return f"round(greatest(0, least(1, 0.5::DOUBLE * ({name}) + 0.5::DOUBLE * ({addr}) - 0.3::DOUBLE * ({minus}))), 6)"


SCORED = _FOUND + _WIDE + f", scored AS (SELECT *, {_score()} AS score FROM wide), everyone AS (SELECT entity_id AS s1_id FROM n WHERE source = 1)\n"
_CARD = ", tt AS (SELECT DISTINCT s1_id, candidate_id FROM truth), card AS (SELECT s1_id, count(candidate_id) AS n_true, CASE count(candidate_id) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS stratum FROM everyone LEFT JOIN tt USING (s1_id) GROUP BY s1_id)\n"
_SPLIT = _CARD + f""", split AS (SELECT s1_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '{SAMPLE.seed}', s1_id)), s1_id) <= CASE WHEN count(*) OVER (PARTITION BY stratum) <= 1 THEN 0 ELSE least(greatest(1, floor(count(*) OVER (PARTITION BY stratum) * {SAMPLE.val_fraction}::DOUBLE)), count(*) OVER (PARTITION BY stratum) - 1) END THEN 'val' ELSE 'train' END AS part FROM card)
"""
SPLIT = SCORED + _SPLIT + "SELECT s1_id, stratum, part FROM split"
_DRAW = f"md5(concat_ws('|', '{SAMPLE.seed}', s1_id, candidate_id))"
TRAIN_PAIRS = _FOUND + _rare(_DOC) + _WIDE.replace("FROM found f", "FROM retrieved f") + ", everyone AS (SELECT entity_id AS s1_id FROM n WHERE source = 1)" + _CARD + f""", lab AS (SELECT w.*, n_true, CASE WHEN tt.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM wide w JOIN card USING (s1_id) LEFT JOIN tt USING (s1_id, candidate_id)),
pooled AS (SELECT *, sum(label) OVER (PARTITION BY s1_id) AS n_pos, CASE WHEN n_true = 0 THEN 'random' WHEN label = 1 THEN 'positive' WHEN (n1 = n2 AND n1 <> '' AND a1 <> a2) OR (a1 = a2 AND a1 <> '' AND n1 <> n2) OR bits & 3 > 0 THEN 'hard' ELSE 'random' END AS pool FROM lab),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id, pool ORDER BY {_DRAW}, candidate_id) AS r FROM pooled WHERE n_true = 0 OR n_pos > 0)
SELECT s1_id, candidate_id, label, pool FROM ranked WHERE r <= CASE WHEN pool = 'positive' THEN n_pos WHEN n_true = 0 THEN 3 WHEN pool = 'hard' THEN least(3 * n_pos, 10) ELSE 3 * n_pos END"""
VAL_PAIRS = SCORED + _SPLIT + "SELECT f.s1_id, f.candidate_id, CASE WHEN tt.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM found f JOIN split s ON s.s1_id = f.s1_id AND part = 'val' LEFT JOIN tt ON tt.s1_id = f.s1_id AND tt.candidate_id = f.candidate_id"
HARD_NEGATIVES = SCORED + f"""SELECT s1_id, candidate_id, score, 0 AS label FROM (SELECT * FROM scored s WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = s.s1_id AND t.candidate_id = s.candidate_id) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, candidate_id) <= 5) ORDER BY {_DRAW}, s1_id, candidate_id LIMIT 50000"""
_F05 = "CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"
_PER = """SELECT e.s1_id, {t} AS threshold, (SELECT count(*) FROM tt WHERE tt.s1_id = e.s1_id) AS n_true, count(p.candidate_id) AS n_pred, count(tt.candidate_id) AS tp FROM everyone e LEFT JOIN scored p ON p.s1_id = e.s1_id AND p.score >= {t} LEFT JOIN tt ON tt.s1_id = p.s1_id AND tt.candidate_id = p.candidate_id GROUP BY e.s1_id"""


def sweep(grid: list[float]) -> str:
    parts = " UNION ALL ".join(_PER.format(t=f"{t}::DOUBLE") for t in grid)
    return SCORED + f", tt AS (SELECT DISTINCT s1_id, candidate_id FROM truth) SELECT round(threshold, 4) AS threshold, round(avg({_F05}), 6) AS macro_f05 FROM ({parts}) GROUP BY threshold"


def macro(threshold: float) -> str:
    return SCORED + f""", tt AS (SELECT DISTINCT s1_id, candidate_id FROM truth), per AS ({_PER.format(t=f'{threshold}::DOUBLE')}),
s AS (SELECT avg({_F05}) AS macro, CASE WHEN sum(n_pred) > 0 THEN sum(tp) / sum(n_pred) ELSE 0 END AS p, CASE WHEN sum(n_true) > 0 THEN sum(tp) / sum(n_true) ELSE 0 END AS r, avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END END) AS z, count(*) AS n_s1, count(*) FILTER (n_true = 0) AS n_zero FROM per)
SELECT round(macro, 6) AS macro_f05, round(p, 6) AS micro_p, round(r, 6) AS micro_r, round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END, 6) AS micro_f05, round(z, 6) AS zero_match_accuracy, n_s1, n_zero FROM s"""


def lists(threshold: float) -> str:
    return SCORED + f"SELECT e.s1_id AS source1_entity_id, coalesce(string_agg(candidate_id, ',' ORDER BY candidate_id), '') AS matched_entity_ids FROM everyone e LEFT JOIN scored s ON s.s1_id = e.s1_id AND score >= {threshold} GROUP BY e.s1_id"


def _errors(threshold: float) -> str:
    return SCORED + f""", tt AS (SELECT DISTINCT s1_id, candidate_id, TRUE AS is_true FROM truth),
w AS (SELECT *, coalesce(score >= {threshold}, FALSE) AS acc, coalesce(is_true, FALSE) AS tru FROM scored FULL JOIN tt USING (s1_id, candidate_id)),
errs AS (SELECT * FROM (SELECT s1_id, candidate_id, CASE WHEN acc AND NOT tru THEN CASE WHEN n1 = n2 AND n1 <> '' THEN 'same_name_diff_addr' WHEN a1 = a2 AND a1 <> '' THEN 'same_addr_diff_name' ELSE 'high_similarity' END WHEN tru AND NOT acc THEN CASE WHEN score IS NULL THEN 'retrieval_failure' ELSE 'threshold_too_high' END END AS error FROM w) WHERE error IS NOT NULL)
"""


def errors(threshold: float) -> str:
    return _errors(threshold) + "SELECT error, count(*) AS n FROM errs GROUP BY error"


def error_examples(threshold: float) -> str:
    return _errors(threshold) + "SELECT * FROM errs QUALIFY row_number() OVER (PARTITION BY error ORDER BY s1_id, candidate_id) <= 20"


def validate(threshold: float) -> str:
    return SCORED + f"SELECT problem, CAST(n AS BIGINT) AS n FROM (VALUES ('missing', 0), ('unknown', 0), ('repeated', 0)) AS v(problem, n) UNION ALL SELECT 'not_candidate', count(*) FROM scored a WHERE score >= {threshold} AND NOT EXISTS (SELECT 1 FROM found f WHERE f.s1_id = a.s1_id AND f.candidate_id = a.candidate_id)"


_LONG = ", l AS (SELECT source, 'business_name' AS field, business_name AS value FROM e UNION ALL SELECT source, 'business_address', business_address FROM e UNION ALL SELECT source, 'country', country FROM e)\n"
PROF_COLUMNS = view("part") + _LONG + """, c AS (SELECT source, field, value, count(*) AS n FROM l GROUP BY ALL)
SELECT source, field, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN value = '' THEN n ELSE 0 END) AS BIGINT) AS missing, count(*) FILTER (value <> '') AS n_distinct, count(*) FILTER (n > 1 AND value <> '') AS n_repeated, round(100.0 * sum(CASE WHEN value = '' THEN n ELSE 0 END) / sum(n), 4) AS missing_percent FROM c GROUP BY source, field"""
PROF_HIST = view("doc") + f"SELECT source, measure, CAST(value AS INTEGER) AS value, count(*) AS n FROM (SELECT source, 'length' AS measure, length(name_norm) AS value FROM n UNION ALL SELECT source, 'tokens', len({_words('name_norm')}) FROM n) GROUP BY ALL"
PROF_QUANTILES = view("doc") + "SELECT source, " + ", ".join(f"CAST(quantile_disc(x, {q}) AS BIGINT) AS disc_{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + ", " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS linear_{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + ", round(avg(x), 6) AS mean, min(x) AS least, max(x) AS most, round(stddev_samp(x), 6) AS sd FROM (SELECT source, CAST(length(business_name) AS INTEGER) AS x FROM e) GROUP BY source"
PROF_FLOOR = view("doc") + "SELECT source, CAST(x AS INTEGER) AS q_floor FROM (SELECT source, length(business_name) AS x, row_number() OVER (PARTITION BY source ORDER BY length(business_name)) - 1 AS i, CAST(floor(0.95::DOUBLE * (count(*) OVER (PARTITION BY source) - 1)) AS BIGINT) AS want FROM e) WHERE i = want"
PROF_TOPK = view("part") + "SELECT source, business_name AS value, count(*) AS n FROM e WHERE business_name <> '' GROUP BY source, business_name QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, business_name) <= 10"
PROF_TOKENS = view("doc") + TOKENS + "SELECT token, count(*) AS n FROM tok WHERE field = 'name_norm' GROUP BY token ORDER BY n DESC, token LIMIT 30"
PROF_PATTERNS = view("part") + _LONG + r"SELECT source, field, count(*) FILTER (regexp_matches(value, '&')) AS has_ampersand, count(*) FILTER (regexp_matches(value, '(?i)\band\b')) AS has_and, count(*) FILTER (regexp_matches(value, '\p{Nd}')) AS has_digit, count(*) FILTER (regexp_matches(value, '[^\p{L}\p{M}\p{N}_\s]')) AS has_punctuation, count(*) FILTER (regexp_matches(value, '[^\x00-\x7F]')) AS has_non_ascii, count(*) AS n_rows FROM l WHERE field <> 'country' GROUP BY source, field"
PROF_JS = view("part") + """, p AS (SELECT country, count(*) / (SELECT count(*) FROM e WHERE source = 1) AS p FROM e WHERE source = 1 GROUP BY country), q AS (SELECT country, count(*) / (SELECT count(*) FROM e WHERE source > 1) AS q FROM e WHERE source > 1 GROUP BY country),
b AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (country)),
d AS (SELECT greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d FROM b) SELECT round(d, 6) AS divergence, round(sqrt(d), 6) AS distance FROM d"""
PROF_SHIFT = view("part") + "SELECT country AS value, " + ", ".join(f"count(*) FILTER (source = {s}) AS source_{s}" for s in (1, 2, 3)) + " FROM e GROUP BY country"
PROF_PREFIX = view("part") + "SELECT split_part(entity_id, '-', 1) AS prefix, count(*) AS n FROM e GROUP BY 1"
PROF_SIGNALS = view("part") + " UNION ALL ".join(
    f"SELECT '{name}' AS signal, t.source, count(DISTINCT q.entity_id) AS n_covered, count(*) AS n_pairs FROM n q JOIN n t ON {' AND '.join(f'q.{c} = t.{c}' for c in cols)} WHERE q.source = 1 AND t.source > 1 AND {' AND '.join(f'q.{c} <> {chr(39) * 2}' for c in cols)} GROUP BY t.source"
    for name, cols in {"name": ["name_norm"], "address": ["address_norm"], "country_name": ["country", "name_norm"], "digits": ["address_dig"]}.items()
)
_TRUE_WIDE = view("doc") + TRUTH + ", found AS (SELECT * FROM truth)" + _WIDE
TRUE_PAIRS = _TRUE_WIDE + "SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST({x} AS DOUBLE)), 6) AS {n}" for n, x in {"same_name": "(n1 = n2)", "same_address": "(a1 = a2)", "same_country": "(c1 = c2)", "name_jaccard": _jaccard("n"), "digit_jaccard": _jaccard("d"), "address_length_diff": "abs(length(a1) - length(a2))", "missing_address": "(a2 = '')"}.items()) + " FROM wide"
RELATIONS = _TRUE_WIDE + "SELECT CASE WHEN n1 = n2 AND a1 = a2 THEN 'name_and_address' WHEN n1 = n2 THEN 'name_only' WHEN a1 = a2 THEN 'address_only' ELSE 'neither_exact' END AS relation, count(*) AS n FROM wide GROUP BY 1"
_TRUTH_ONLY = "WITH " + TRUTH.lstrip(", ")
GT_EXPLODE = _TRUTH_ONLY + "SELECT s1_id, candidate_id, source FROM truth"
GT_INVERSE = _TRUTH_ONLY + "SELECT n_s1, count(*) AS n_targets FROM (SELECT candidate_id, count(DISTINCT s1_id) AS n_s1 FROM truth GROUP BY 1) GROUP BY 1"
GT_CARDINALITY = _TRUTH_ONLY + """, k AS (SELECT a.id, count(DISTINCT candidate_id) AS n FROM same a LEFT JOIN truth ON s1_id = a.id WHERE a.source = 1 GROUP BY 1)
SELECT count(*) FILTER (n = 0) AS n_0, count(*) FILTER (n = 1) AS n_1, count(*) FILTER (n = 2) AS n_2, count(*) FILTER (n >= 3) AS n_3_plus, round(avg(n), 6) AS mean, CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(n, 0.99) AS BIGINT) AS p99, max(n) AS most,
round(100 * avg(CASE WHEN n = 0 THEN 1 ELSE 0 END), 4) AS zero_percent, round(100 * avg(CASE WHEN n = 1 THEN 1 ELSE 0 END), 4) AS one_percent, round(100 * avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 4) AS many_percent,
CASE WHEN (SELECT max(c) FROM (SELECT count(DISTINCT s1_id) AS c FROM truth GROUP BY candidate_id)) > 1 THEN 'many-to-many' WHEN max(n) > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS mapping FROM k"""
GT_COMPONENTS = _TRUTH_ONLY + ", node AS (SELECT s1_id AS id FROM truth UNION SELECT candidate_id FROM truth) SELECT id AS node, min(id) OVER (PARTITION BY h) AS component FROM node JOIN same USING (id)"
GT_COMPONENT_SIZES = _TRUTH_ONLY + ", node AS (SELECT s1_id AS id FROM truth UNION SELECT candidate_id FROM truth) SELECT size, count(*) AS n FROM (SELECT h, count(*) AS size FROM node JOIN same USING (id) GROUP BY h) GROUP BY size"
RESERVOIR = view("part") + f"SELECT entity_id, business_name FROM e ORDER BY md5(concat_ws('|', '{SAMPLE.seed}', entity_id)), entity_id LIMIT 100"
PAIR_SUMMARY = _TRUE_WIDE + f", m AS (SELECT source, c1 AS country, {_jaccard('n')} AS x, abs(length(a1) - length(a2)) AS y FROM wide) SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(country) = 0 THEN 'country' ELSE 'all' END AS level, coalesce(CAST(source AS VARCHAR), country, '') AS grp, " + ", ".join([f"round(quantile_cont(x, {q}), 6) AS jaccard_{int(q * 100)}" for q in (0.1, 0.5, 0.9)] + [f"round(quantile_cont(y, {q}), 6) AS length_diff_{int(q * 100)}" for q in (0.5, 0.9, 0.99)]) + ", round(avg(x), 6) AS mean_jaccard, count(*) AS n FROM m GROUP BY GROUPING SETS ((source), (country), ())"
TOKEN_DF_RECORDS = view("doc") + ", spread AS (SELECT DISTINCT source, entity_id, unnest(string_split(name_norm || ' ' || address_norm, ' ')) AS token FROM n) SELECT source, token, count(*) AS df FROM spread WHERE length(token) >= 3 GROUP BY ALL"
REPEATED_ROWS = view("part") + "SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM (SELECT source, count(*) AS n FROM e GROUP BY source, business_name, business_address, country) GROUP BY source"
SAMPLE_COLLISIONS = view("doc") + """, few AS (SELECT source, entity_id, name_norm FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY row_id) <= 100)
SELECT a.entity_id AS left_id, b.entity_id AS right_id, a.name_norm AS name FROM few a JOIN few b USING (name_norm) WHERE a.source < b.source AND name_norm <> '' ORDER BY 1, 2 LIMIT 1000"""
TOKEN_SIGNALS = view("doc") + TOKENS + _LISTED + """, p AS (SELECT DISTINCT q.field, q.entity_id AS s1_id, l.entity_id AS candidate_id, l.source FROM tok q JOIN listed l ON q.token = l.token AND q.field = l.field WHERE q.source = 1)
SELECT CASE field WHEN 'name_norm' THEN 'name_tokens' ELSE 'address_tokens' END AS signal, source, count(DISTINCT s1_id) AS n_covered, count(*) AS n_pairs FROM p GROUP BY ALL"""
#: The normalised first line, checked where it is ASCII: there the native and the script-aware form are the same.
NORM_FORMS_ASCII = view("doc") + r"SELECT entity_id, name_norm, address_norm FROM n WHERE regexp_full_match(business_name, '[\x00-\x7F]*') AND regexp_full_match(business_address, '[\x00-\x7F]*')"
