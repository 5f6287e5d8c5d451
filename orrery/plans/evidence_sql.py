"""DuckDB SQL for the rows of the queries over stored files."""

from __future__ import annotations

from .oracle import E, METHODS, SIDES, _cosine, _far, _preference
from .oracle import SQL as CORE

CONTRACT = "d.lang || '/' || d.source"
#: The pairs of the evidence: always two different train rows.
APART = SIDES.replace(
    "(index * 11 + o * 17 + 1) % (SELECT count(*) FROM train) + 1 AS nb",
    "((index * 7 + o * 13) % (SELECT count(*) FROM train) + 1 + (index * 11 + o * 17) % ((SELECT count(*) FROM train) - 1)) % (SELECT count(*) FROM train) + 1 AS nb",
)
_SPLIT = "CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'validation' ELSE 'test' END"
_LABELS = "(SELECT label, count(*) AS n, min(vec_id) AS first, list(vec_id ORDER BY vec_id)[1:3] AS ids, any_value(len(embedding)) AS d FROM embeddings GROUP BY label)"
_BROKEN = "CASE WHEN label % 2 = 1 THEN 'broken.npz' ELSE 'broken.npy' END"
_FILES = f"""(SELECT label, n, d, ids, 'matrix.npy' AS file FROM {_LABELS} UNION ALL SELECT label, n, d, ids, 'snapshot.npz' FROM {_LABELS} UNION ALL SELECT label, n, d, ids, 'plain.npz' FROM {_LABELS} UNION ALL SELECT label, n, d, ids, {_BROKEN} FROM {_LABELS})"""
_FIT = "t AS (SELECT vec_id, e[1] AS x1, e[2] AS x2, c0, c1, c2 FROM c WHERE vec_id % 5 < 3)"


def _ridge(i: int) -> str:
    return f"""z{i} AS (SELECT x1, x2, (c{i} - m{i}) / s{i} AS y FROM t, q), u{i} AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay FROM z{i}),
g{i} AS (SELECT sum((x1 - a1) * (x1 - a1)) + 1 AS a, sum((x1 - a1) * (x2 - a2)) AS b, sum((x2 - a2) * (x2 - a2)) + 1 AS d, sum((x1 - a1) * (y - ay)) AS p, sum((x2 - a2) * (y - ay)) AS r FROM z{i}, u{i}),
w{i} AS (SELECT (d * p - b * r) / (a * d - b * b) AS v1, (a * r - b * p) / (a * d - b * b) AS v2, ay, a1, a2 FROM g{i}, u{i})"""


_LOOK = f"""(SELECT vec_id AS ordinal, 'row-' || vec_id AS stable_key, CASE WHEN vec_id % 17 = 6 OR d.doc_id IS NULL THEN 'missing' WHEN vec_id % 11 = 3 THEN 'shape or dtype'
  WHEN vec_id % 7 = 1 AND e.e[1] <> e.e[len(e.e)] THEN 'payload hash' WHEN vec_id % 13 = 5 THEN 'array hash' END AS fault, round(list_sum(e.e), 6) + 0.0 AS total FROM {E} e LEFT JOIN documents d ON d.doc_id = vec_id)"""

#: What ``refusals`` tries, each of which must be refused.
REFUSED = (
    "projection: scale of zero",
    "projection: infinite coefficient",
    "projection: names repeat",
    "projection: dimensions differ",
    "projection: negative alpha",
    "fit: one row",
    "fit: negative alpha",
    "fit: null coordinate",
    "fit: too few names",
    "search: k of zero",
    "search: pool below k",
    "search: unknown row excluded",
    "search: source of zeros",
    "search: other dimensions",
    "manifest: cut file",
    "manifest: cut metadata",
    "evidence: cut selection",
    "evidence: cut predictions",
    "evidence: cut pairs",
    "evidence: no table",
)

SQL = {
    "refusals": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in REFUSED) + ') t("case", refused)',
    "sqlite_tables": """SELECT place::INTEGER AS place, name, rows FROM (SELECT 0 AS place, 'embedding_contracts' AS name, count(DISTINCT d.lang || '/' || d.source) AS rows FROM documents d
  UNION ALL SELECT 1, 'embeddings', count(*) FROM embeddings JOIN documents ON doc_id = vec_id UNION ALL SELECT 2, 'embeddings_v2', count(*) FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 17 <> 6)""",
    "sqlite_vectors": f"SELECT 't' || vec_id AS text_sha256, {CONTRACT} AS contract_sha256, len(e)::BIGINT AS dimension, round(list_sum(e), 6) AS total, round(e[1], 6) AS first FROM {E} JOIN documents d ON doc_id = vec_id",
    "cache_contracts": f"""WITH k AS (SELECT {CONTRACT} AS contract_sha256, substr({CONTRACT}, 1, 2) AS model, length({CONTRACT}) % 2 = 1 AS truncate, count(vec_id) AS rows, min(len(embedding))::BIGINT AS minimum_dimension, max(len(embedding))::BIGINT AS maximum_dimension
  FROM documents d LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2, 3)
SELECT row_number() OVER (ORDER BY model, contract_sha256) - 1 AS place, *, (sum(rows) OVER ())::BIGINT AS embedding_rows, count(*) OVER () AS contract_count FROM k""",
    "cache_lookup": f"SELECT ordinal, stable_key, fault, CASE WHEN fault IS NULL THEN total END AS total FROM {_LOOK}",
    "array_inventory": f"""SELECT 'label-' || label AS folder, file, CASE WHEN file = 'matrix.npy' THEN 'npy' WHEN file = 'snapshot.npz' THEN 'benchmark_embedding_snapshot' WHEN file = 'plain.npz' THEN 'generic_npz' END AS classification,
  CASE WHEN file = 'matrix.npy' THEN 1 WHEN file = 'snapshot.npz' THEN 4 WHEN file = 'plain.npz' THEN 3 END::INTEGER AS arrays, CASE WHEN file IN ('matrix.npy', 'snapshot.npz') THEN '[' || n || ',' || d || ']' END AS shape,
  CASE WHEN file IN ('matrix.npy', 'snapshot.npz') THEN 'float32' END AS dtype, CASE WHEN file = 'snapshot.npz' THEN '"model-' || label || '"' END AS model, CASE WHEN file = 'plain.npz' THEN n::VARCHAR END AS rows,
  CASE WHEN file = 'plain.npz' THEN ids::VARCHAR END AS ids, CASE WHEN file = 'plain.npz' THEN 'object_dtype_requires_pickle' END AS skipped, file LIKE 'broken%' AS failed FROM {_FILES}""",
    "array_errors": f"SELECT split_part(file, '.', 2) AS kind, count(*) AS files, count(*) FILTER (file LIKE 'broken%') AS errors FROM {_FILES} GROUP BY 1",
    "inventory": f"""SELECT count(*) FILTER (file LIKE '%.npz') AS npz, count(*) FILTER (file = 'broken.npz') AS npz_errors, count(*) FILTER (file LIKE '%.npy') AS npy, count(*) FILTER (file = 'broken.npy') AS npy_errors, count(*) FILTER (file = 'snapshot.npz') AS snapshots, true AS ordered,
  (SELECT count(*) FROM embeddings JOIN documents ON doc_id = vec_id) AS embedding_rows, (SELECT count(DISTINCT lang || '/' || source) FROM documents) AS contracts FROM {_FILES}""",
    "json_lines": "SELECT doc_id, lang, n_chars, sha256(text) AS text_sha256 FROM documents",
    "json_report": "SELECT row_number() OVER (ORDER BY source) - 1 AS place, source, count(*) AS rows, (sum(count(*)) OVER ())::BIGINT AS total, true AS whole FROM documents GROUP BY source",
    "file_hashes": "SELECT lang || '-' || source || '.txt' AS file, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY lang, source",
    "text_hash_match": """SELECT doc_id, doc_id % 3 <> 1 AND (doc_id % 3 <> 0 OR text NOT LIKE '%' || chr(13) || '%') AS matches, CASE WHEN doc_id % 3 = 0 THEN text NOT LIKE '%' || chr(10) || '%' ELSE doc_id % 3 = 2 END AS equal
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "vector_hashes": "SELECT vec_id, true AS agrees, (4 * len(embedding))::INTEGER AS bytes FROM embeddings",
    "projection_files": CORE["project"].replace(" FROM (SELECT vec_id", ", true AS equal FROM (SELECT vec_id", 1),
    "stream_projection": CORE["project"],
    "pair_manifests": f"""WITH o AS (SELECT vec_id, e, label, lead(vec_id) OVER (ORDER BY vec_id) AS next FROM {E})
SELECT 'e' || a.vec_id AS example_id, {_SPLIT.replace("vec_id", "a.vec_id")} AS split, (a.label = b.label)::INTEGER AS label, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 4) AS cosine, (SELECT count(*) FROM embeddings) AS texts
FROM o a JOIN o b ON b.vec_id = a.next""",
    "pair_scores": f"""WITH v AS (SELECT a.vec_id AS a, (a.label = b.label)::INTEGER AS y, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1),
m AS (SELECT avg(c) AS m, stddev_pop(c) AS s FROM v WHERE a % 5 < 4), s AS (SELECT y, 1 / (1 + exp(-(0.7 * (c - m) / s - 0.2))) AS p FROM v, m WHERE a % 5 = 4),
t AS (SELECT count(*) AS n, sum(y) AS pos, sum(1 - y) AS neg, sum((p >= 0.5 AND y = 1)::INTEGER) AS tp, sum((p >= 0.5 AND y = 0)::INTEGER) AS fp, -avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM s),
a AS (SELECT avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc FROM s x, s z WHERE x.y = 1 AND z.y = 0)
SELECT round((tp + neg - fp) / n, 4) AS accuracy, round((tp / pos + (neg - fp) / neg) / 2, 4) AS balanced_accuracy, round(2 * tp / (tp + fp + pos), 4) AS f1, round(auc, 4) AS roc_auc, round(ll, 4) AS log_loss FROM t, a""",
    "selection_rows": f"""WITH {SIDES} SELECT {_SPLIT.replace("vec_id", "index")} AS split, row_number() OVER (PARTITION BY {_SPLIT.replace("vec_id", "index")} ORDER BY index) - 1 AS ordinal, 'row-' || index AS stable_key, tokens, round(t0, 6) AS z0, round(t1, 6) AS z1, round(t2, 6) AS z2 FROM sides""",
    "stored_embeddings": f"""WITH {SIDES} SELECT {_SPLIT.replace("vec_id", "index")} AS split, row_number() OVER (PARTITION BY {_SPLIT.replace("vec_id", "index")} ORDER BY index) - 1 AS ordinal, count(*) OVER (PARTITION BY {_SPLIT.replace("vec_id", "index")}) AS rows, round(list_sum(e), 6) AS total FROM sides""",
    "stored_pairs": f"""WITH {APART}, test AS (SELECT index, row_number() OVER (ORDER BY index) - 1 AS place FROM sides WHERE index % 5 = 4)
SELECT place AS query_index, pair_order, CASE WHEN first THEN na ELSE nb END - 1 AS closer_index, CASE WHEN first THEN nb ELSE na END - 1 AS farther_index, count(*) OVER (PARTITION BY place) AS pair_count FROM pairs JOIN test ON index = query_index""",
    "replayed_decision": f"""WITH {APART},
scores AS (SELECT s.index AS query_index, count(query_index) AS pairs, {_preference("ca", "cb")} AS raw_cosine, {_preference("ea", "eb")} AS raw_euclidean, {_preference("wa", "wb")} AS token_length, {_preference("ta", "tb")} AS true_oracle, {_preference("pa", "pb")} AS predicted_executor
  FROM (SELECT index FROM sides WHERE index % 5 = 4) s LEFT JOIN pairs ON query_index = s.index GROUP BY s.index)
SELECT {", ".join(f"round(avg(CASE WHEN pairs > 0 THEN {m} END), 6) AS {m}" for m in METHODS)}, count(*) FILTER (pairs > 0) AS queries_with_pairs, count(*) FILTER (pairs = 0) AS queries_without_pairs, sum(pairs)::BIGINT AS pairs,
  CASE WHEN avg(predicted_executor) - greatest(avg(raw_cosine), avg(raw_euclidean)) >= 0.1 THEN 'REAL_PREMISE_SUPPORTED' ELSE 'REAL_PREMISE_FAILED' END AS outcome, true AS published FROM scores""",
    "exported_projection": f"""WITH {SIDES.split("sides AS")[0].rstrip().rstrip(",")}, {_FIT}, {_ridge(0)}, {_ridge(1)}, {_ridge(2)}
SELECT c.vec_id, {", ".join(f"round((e[1] - w{i}.a1) * w{i}.v1 + (e[2] - w{i}.a2) * w{i}.v2 + w{i}.ay, 6) AS r{i}" for i in range(3))}, true AS verified FROM c, w0, w1, w2 WHERE c.vec_id % 5 = 4""",
    "singular_fit": f"""WITH t AS (SELECT e[1] AS x, n_chars::DOUBLE AS y FROM {E} JOIN documents ON doc_id = vec_id), q AS (SELECT median(y) AS m, greatest(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 1.0) AS s FROM t),
z AS (SELECT x, (y - m) / s AS y FROM t, q), u AS (SELECT covar_pop(x, y) / var_pop(x) AS w, avg(y) AS ay, avg(x) AS ax FROM z) SELECT round(w / 2, 4) AS w1, round(w / 2, 4) AS w2, round(ay - ax * w, 4) AS b FROM u""",
    "compared_relations": f"""WITH k(vec_id, name, m1, m2, m3) AS (VALUES (0, 'Query', 3, 1, 2), (1, 'Candidate A', 3, 1, 2), (2, 'Candidate B', 1, 0, 1)), r AS (SELECT k.*, e FROM k JOIN {E} e ON e.vec_id = k.vec_id),
d AS (SELECT a.name, {_cosine("a.e", "b.e")} AS cosine, {_far("a.e", "b.e")} AS predicted, greatest(abs(a.m1 - b.m1), abs(a.m2 - b.m2), abs(a.m3 - b.m3))::DOUBLE AS measured FROM r a JOIN r b ON b.vec_id = 0 AND a.vec_id > 0)
SELECT name, {", ".join(f"(row_number() OVER (ORDER BY {m}, name))::INTEGER AS {m}_rank, round({m}, 6) AS {m}, CASE WHEN first_value({m}) OVER (ORDER BY name) <= last_value({m}) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 'A' ELSE 'B' END AS nearest_by_{m}" for m in ("cosine", "predicted", "measured"))} FROM d""",
    "code_structure_rows": "SELECT doc_id, (1 + n_chars % 4)::DOUBLE AS cyclomatic_complexity, (n_chars % 4)::DOUBLE AS max_control_depth, (doc_id % 5)::DOUBLE AS distinct_call_sites FROM documents",
}
