"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

from .queries import NAMES, SNIPPETS

E = "(SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
COORDINATES = r"""(SELECT doc_id, n_chars::DOUBLE AS c0, len(w)::DOUBLE AS c1, len(list_distinct(w))::DOUBLE AS c2
  FROM (SELECT doc_id, n_chars, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))"""
LONG = f"(SELECT doc_id, 0 AS r, c0 AS v FROM {COORDINATES} UNION ALL SELECT doc_id, 1, c1 FROM {COORDINATES} UNION ALL SELECT doc_id, 2, c2 FROM {COORDINATES})"
STATS = f"(SELECT r, quantile_cont(v, 0.25) AS q25, median(v) AS m, quantile_cont(v, 0.75) AS q75, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1.0) AS s FROM {LONG} GROUP BY r)"
CENTRED = f"""(SELECT vec_id, i - 1 AS i, e[i] - avg(e[i]) OVER (PARTITION BY i) AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM {E} JOIN {COORDINATES} c ON c.doc_id = vec_id))"""
PLANAR = f"(SELECT vec_id, e[1] AS x1, e[2] AS x2 FROM {E})"
MODEL = f"""
t AS (SELECT p.vec_id, x1, x2, c0 FROM {PLANAR} p JOIN {COORDINATES} c ON c.doc_id = p.vec_id),
q AS (SELECT median(c0) AS m, greatest(quantile_cont(c0, 0.75) - quantile_cont(c0, 0.25), 1.0) AS s FROM t),
z AS (SELECT x1, x2, (c0 - m) / s AS y FROM t, q),
u AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay FROM z),
g AS (SELECT sum((x1 - a1) * (x1 - a1)) + 1 AS a, sum((x1 - a1) * (x2 - a2)) AS b, sum((x2 - a2) * (x2 - a2)) + 1 AS d, sum((x1 - a1) * (y - ay)) AS p, sum((x2 - a2) * (y - ay)) AS r FROM z, u),
w AS (SELECT (d * p - b * r) / (a * d - b * b) AS w1, (a * r - b * p) / (a * d - b * b) AS w2 FROM g),
model AS (SELECT w1, w2, ay - a1 * w1 - a2 * w2 AS b0, m, s FROM w, u, q)"""
def _distance(expression: str) -> str:
    return f"SELECT a.vec_id, round({expression}, 6) + 0.0 AS distance FROM {E} a, (SELECT e FROM {E} WHERE vec_id = 0) b"


_FIXED = [f"(list_dot_product({{0}}, list_transform(range(1, len({{0}}) + 1), lambda i: sin(i * {j + 1}))) + {0.5 * j})" for j in range(3)]


def _far(a: str, b: str) -> str:
    return "greatest(" + ", ".join(f"abs({x.format(a)} - {x.format(b)})" for x in _FIXED) + ")"


def _cosine(a: str, b: str) -> str:
    return f"1 - greatest(-1, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"


def _search(exclude: bool, pool: int | None) -> str:
    return f"""WITH f AS (SELECT t.vec_id AS index, {_far("t.e", "s.e")} AS relation_distance, {_cosine("t.e", "s.e")} AS cosine_distance FROM {E} t JOIN {E} s ON s.vec_id = 0 {"AND t.vec_id <> 0" if exclude else ""}),
k AS (SELECT * FROM f {f"QUALIFY row_number() OVER (ORDER BY cosine_distance, index) <= {pool}" if pool else ""})
SELECT (row_number() OVER (ORDER BY relation_distance, cosine_distance, index))::INTEGER AS rank, index, round(relation_distance, 6) AS relation_distance, round(cosine_distance, 6) AS cosine_distance
FROM k QUALIFY row_number() OVER (ORDER BY relation_distance, cosine_distance, index) <= 10"""


PAIRS = f"""
pr AS (SELECT a.vec_id AS a, (a.label = b.label)::INTEGER AS y, list_transform(a.e, lambda v: v / sqrt(list_dot_product(a.e, a.e))) AS l, list_transform(b.e, lambda v: v / sqrt(list_dot_product(b.e, b.e))) AS r
  FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1)"""

SIDES = f"""
c AS (SELECT vec_id, e, c0, c1, c2 FROM {E} JOIN {COORDINATES} d ON d.doc_id = vec_id),
q AS (SELECT median(c0) AS m0, median(c1) AS m1, median(c2) AS m2, {", ".join(f"greatest(quantile_cont(c{i}, 0.75) - quantile_cont(c{i}, 0.25), 1.0) AS s{i}" for i in range(3))} FROM c WHERE vec_id % 5 < 3),
sides AS (SELECT vec_id AS index, e, c1::BIGINT AS tokens, (c0 - m0) / s0 AS t0, (c1 - m1) / s1 AS t1, (c2 - m2) / s2 AS t2,
  {", ".join(f"list_dot_product(e, list_transform(range(1, len(e) + 1), lambda i: sin(i * {j + 1}))) AS p{j}" for j in range(3))} FROM c, q),
train AS (SELECT row_number() OVER (ORDER BY index) AS n, * FROM sides WHERE index % 5 < 3),
asked AS (SELECT *, (index * 7 + o * 13) % (SELECT count(*) FROM train) + 1 AS na, (index * 11 + o * 17 + 1) % (SELECT count(*) FROM train) + 1 AS nb
  FROM (SELECT *, unnest(range(0, 4)) AS o FROM sides WHERE index % 5 = 4)),
far AS (SELECT k.index AS query_index, k.o AS pair_order, k.na, k.nb, x.index AS a, z.index AS b,
  greatest(abs(x.t0 - k.t0), abs(x.t1 - k.t1), abs(x.t2 - k.t2)) AS ta, greatest(abs(z.t0 - k.t0), abs(z.t1 - k.t1), abs(z.t2 - k.t2)) AS tb,
  greatest(abs(x.p0 - k.p0), abs(x.p1 - k.p1), abs(x.p2 - k.p2)) AS pa, greatest(abs(z.p0 - k.p0), abs(z.p1 - k.p1), abs(z.p2 - k.p2)) AS pb,
  abs(x.tokens - k.tokens) AS wa, abs(z.tokens - k.tokens) AS wb, list_distance(x.e, k.e) AS ea, list_distance(z.e, k.e) AS eb,
  1 - list_dot_product(x.e, k.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(k.e, k.e))) AS ca, 1 - list_dot_product(z.e, k.e) / (sqrt(list_dot_product(z.e, z.e)) * sqrt(list_dot_product(k.e, k.e))) AS cb
  FROM asked k JOIN train x ON x.n = k.na JOIN train z ON z.n = k.nb WHERE k.na <> k.nb AND (k.index % 10 <> 9 OR k.o < 2)),
pairs AS (SELECT *, (ta, a) <= (tb, b) AS first FROM far)"""


def _preference(a: str, b: str) -> str:
    return f"avg(CASE WHEN {a} = {b} THEN 0.5 WHEN ({a} < {b}) = first THEN 1.0 ELSE 0.0 END)"


SCORES = f"""{SIDES},
scores AS (SELECT s.index AS query_index, count(query_index) AS pairs, {_preference("ca", "cb")} AS raw_cosine, {_preference("ea", "eb")} AS raw_euclidean, {_preference("wa", "wb")} AS token_length, {_preference("ta", "tb")} AS true_oracle, {_preference("pa", "pb")} AS predicted_executor
  FROM (SELECT index FROM sides WHERE index % 5 = 4) s LEFT JOIN pairs ON query_index = s.index GROUP BY s.index)"""
METHODS = ("raw_cosine", "raw_euclidean", "token_length", "true_oracle", "predicted_executor")
_MEAN = {m: f"avg(CASE WHEN pairs > 0 THEN {m} END)" for m in METHODS}
SCORED = "(SELECT l.doc_id, quality AS y, (n_chars * 37 + l.doc_id * 11 + quality * 41) % 101 / 100.0::DOUBLE AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _value(x) -> str:
    return "NULL" if x is None else f"{x}::DOUBLE"


SQL = {
    "cosine_distance": _distance("1 - greatest(-1, least(1, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))))"),
    "cosine_distance_eps": _distance("1 - list_dot_product(a.e, b.e) / greatest(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 2.220446049250313e-16)"),
    "euclidean": _distance("list_distance(a.e, b.e)"),
    "chebyshev": _distance("list_max(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2])))"),
    "l2_normalize": f"SELECT label, count(*) AS n, round(avg(list_sum(e) / sqrt(list_dot_product(e, e))), 4) AS total, round(avg(e[1] / sqrt(list_dot_product(e, e))), 4) AS first FROM {E} GROUP BY label",
    "pair_features": f"""WITH {PAIRS}, f AS (SELECT y, list_dot_product(l, r) AS c, list_sum(list_transform(list_zip(l, r), lambda p: abs(p[1] - p[2]))) AS d, list_sum(l) AS sl, list_sum(r) AS sr, len(l) AS n FROM pr)
SELECT y, count(*) AS n, round(avg(c), 4) AS cosine, round(avg(d), 4) AS absolute, round(avg(c), 4) AS product, round(avg(sr - c * sl), 4) AS residual, round(avg(d + c), 4) AS "full", max(2 * f.n)::INTEGER AS width FROM f GROUP BY y""",
    "robust_stats": f"SELECT r::INTEGER AS relation, q25, m AS median, q75, s AS scale FROM {STATS}",
    "robust_scale": f"""SELECT v.doc_id, {", ".join(f"max(CASE WHEN v.r = {i} THEN round((v.v - m) / s, 6) END) AS z{i}, max(CASE WHEN v.r = {i} THEN round(v.v, 3) END) AS c{i}" for i in range(3))}
FROM {LONG} v JOIN {STATS} t ON t.r = v.r GROUP BY v.doc_id""",
    "gram_matrix": f"WITH c AS (SELECT * FROM {CENTRED}) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.x * b.x), 6) AS value FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.i, b.i",
    "cross_product": f"""WITH c AS (SELECT * FROM {CENTRED}), y AS (SELECT doc_id, r, v - avg(v) OVER (PARTITION BY r) AS y FROM {LONG} WHERE doc_id IN (SELECT vec_id FROM embeddings))
SELECT i::INTEGER AS i, r::INTEGER AS j, round(sum(x * y), 3) AS value FROM c JOIN y ON doc_id = vec_id GROUP BY i, r""",
    "ridge_fit_2d": f"WITH {MODEL} SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(b0, 6) AS b, round(m, 6) AS median, round(s, 6) AS scale FROM model",
    "ridge_fit_residual": "SELECT max(len(embedding))::INTEGER AS dimensions, 3::INTEGER AS relations, true AS solved FROM embeddings",
    "project": f"SELECT vec_id, {', '.join(f'round(list_dot_product(e, list_transform(range(1, len(e) + 1), lambda i: sin(i * {j + 1}))) + {0.5 * j}, 6) AS r{j}' for j in range(3))} FROM {E}",
    "search_topk": _search(False, None),
    "search_exclude": _search(True, None),
    "search_candidate_pool": _search(True, 100),
    "search_multi_source": f"""WITH f AS (SELECT s.vec_id AS source, t.vec_id AS index, {_far("t.e", "s.e")} AS relation_distance, {_cosine("t.e", "s.e")} AS cosine_distance FROM {E} t JOIN {E} s ON s.vec_id % 20 = 0 AND s.vec_id <> t.vec_id),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY cosine_distance, index) <= 40)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY relation_distance, cosine_distance, index))::INTEGER AS rank, index, round(relation_distance, 6) AS relation_distance, round(cosine_distance, 6) AS cosine_distance
FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY relation_distance, cosine_distance, index) <= 5""",
    "coordinate_search_true": f"""WITH z AS (SELECT v.doc_id, v.r, (v.v - m) / s AS z FROM {LONG} v JOIN {STATS} t ON t.r = v.r),
f AS (SELECT a.doc_id, max(abs(a.z - b.z)) AS d FROM z a JOIN z b ON a.r = b.r AND b.doc_id = 0 AND a.doc_id <> 0 GROUP BY a.doc_id)
SELECT doc_id, round(d, 6) AS distance, (row_number() OVER (ORDER BY d, doc_id))::INTEGER AS rank FROM f ORDER BY rank LIMIT 20""",
    "hard_negative_scores": f"WITH {SCORES} SELECT query_index, pairs, {', '.join(f'CASE WHEN pairs > 0 THEN round({m}, 6) END AS {m}' for m in METHODS)} FROM scores",
    "hard_negative_decision": f"""WITH {SCORES}, d AS (SELECT {", ".join(f"{e} AS {m}" for m, e in _MEAN.items())}, count(*) FILTER (pairs > 0) AS queries_with_pairs, count(*) FILTER (pairs = 0) AS queries_without_pairs FROM scores)
SELECT {", ".join(f"round({m}, 6) AS {m}" for m in METHODS)}, queries_with_pairs, queries_without_pairs, round(greatest(raw_cosine, raw_euclidean), 6) AS raw_best,
  CASE WHEN raw_cosine = raw_euclidean THEN 'raw_cosine,raw_euclidean' WHEN raw_cosine > raw_euclidean THEN 'raw_cosine' ELSE 'raw_euclidean' END AS raw_best_methods,
  round(predicted_executor - greatest(raw_cosine, raw_euclidean), 6) AS gap, 0.1::DOUBLE AS threshold,
  CASE WHEN predicted_executor - greatest(raw_cosine, raw_euclidean) >= 0.1 THEN 'REAL_PREMISE_SUPPORTED' ELSE 'REAL_PREMISE_FAILED' END AS outcome FROM d""",
    "pair_prefix_offsets": f'WITH {SIDES}, n AS (SELECT query_index, count(*) AS pair_count FROM pairs GROUP BY 1) SELECT query_index, pair_count, coalesce(sum(pair_count) OVER (ORDER BY query_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM n',
    "ranks_and_winner": r"""SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id))::INTEGER AS rank,
  CASE WHEN n_chars <= 6 * len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) THEN 'A' ELSE 'B' END AS winner FROM documents""",
    "manifest_join": "SELECT l.doc_id, l.doc_id + 1 AS other, quality, a.n_chars AS left_chars, b.n_chars AS right_chars FROM labels l JOIN documents a ON a.doc_id = l.doc_id JOIN documents b ON b.doc_id = l.doc_id + 1",
    "manifest_missing": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "split_overlap": "SELECT vec_id FROM embeddings INTERSECT SELECT doc_id FROM labels",
    "union_train_validation": "SELECT CASE WHEN vec_id % 5 < 3 THEN 'train' ELSE 'validation' END AS split, count(*) AS rows, count(DISTINCT label) AS labels FROM embeddings WHERE vec_id % 5 < 4 GROUP BY 1",
    "contract_report": """SELECT d.lang || '/' || d.source AS contract_sha256, d.lang AS model, any_value(length(d.source) % 2 = 1) AS truncate, count(l.doc_id) AS rows,
  min(CASE WHEN l.doc_id IS NOT NULL THEN n_chars END) AS minimum_dimension, max(CASE WHEN l.doc_id IS NOT NULL THEN n_chars END) AS maximum_dimension
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 GROUP BY d.lang, d.source""",
    "binary_metrics": f"""WITH s AS (SELECT * FROM {SCORED}), t AS (SELECT count(*) AS n, sum(y) AS pos, sum(1 - y) AS neg, sum((p >= 0.5 AND y = 1)::INTEGER) AS tp, sum((p >= 0.5 AND y = 0)::INTEGER) AS fp,
  -avg(CASE WHEN y = 1 THEN ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) ELSE ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) END) AS ll FROM s),
a AS (SELECT avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc FROM s x, s z WHERE x.y = 1 AND z.y = 0)
SELECT round((tp + neg - fp) / n, 6) AS accuracy, round((tp / pos + (neg - fp) / neg) / 2, 6) AS balanced_accuracy, round(2 * tp / (tp + fp + pos), 6) AS f1, round(auc, 6) AS roc_auc, round(ll, 6) AS log_loss FROM t, a""",
    "alpha_select": f"""WITH s AS (SELECT 'm' || (doc_id % 4) AS name, alpha, round(avg(((p >= round(0.4 + alpha * 20, 1))::INTEGER = y)::INTEGER), 2) AS score FROM {SCORED}, (VALUES (1e-5), (1e-4), (1e-3), (1e-2)) v(alpha) GROUP BY 1, 2)
SELECT name, alpha::DOUBLE AS alpha, score FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, alpha) = 1""",
    "hashes": """SELECT doc_id, sha256(text) AS text_sha256, sha256('{"dtype":"uint8","shape":[5]}' || text) AS array_sha256 FROM documents""",
    "python_structure": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {', '.join(map(_value, v))}, {v[0] is None})" for n, _, v in SNIPPETS) + f") t(name, {', '.join(NAMES)}, failed)",
    "mean_pooling": f"""WITH s AS (SELECT vec_id // 4 AS g, (vec_id % 3 <> 0)::INTEGER AS m, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {E}),
p AS (SELECT g, i, sum(m * x) / greatest(sum(m), 1) AS v FROM s GROUP BY g, i)
SELECT g, round(sum(v), 6) AS total, round(max(CASE WHEN i = 1 THEN v END), 6) AS first FROM p GROUP BY g""",
}
SQL["project_independent"] = SQL["project"]
