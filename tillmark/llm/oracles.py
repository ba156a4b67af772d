"""DuckDB SQL for the queries whose results SQL can express: the Merkle manifest, vector codes and MinHash near-duplicates."""

from __future__ import annotations

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of the decimal id, byte by byte and bit by bit (a step of -1 shifts by one bit).
_CRC = """list_reduce(flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(4294967295 AS BIGINT))"""


def _tree(name: str, start: str) -> str:
    """CTEs ``name`` (all nodes) and ``name_runs`` (the digests of each run of three) over leaves (tree, place, digest, n)."""
    return f"""{name}(tree, level, place, digest, n) AS (SELECT tree, 0, place, digest, n FROM {start} UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, place // 3, n),
{name}_runs AS MATERIALIZED (SELECT tree, level, place // 3 AS run, list(digest ORDER BY place) AS all_ FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _fold(name: str, start: str, runs: str) -> str:
    """CTE ``name``: from rows (k, tree, place, digest) up to the root, with the siblings so far; the last level of each k counts."""
    side = "array_to_string({}, '')"
    left, right = side.format("all_[1:place % 3]"), side.format("all_[place % 3 + 2:]")
    return f"""{name}(k, tree, level, place, digest, proof) AS (SELECT k, tree, 0, place, digest, proof FROM {start} UNION ALL
  SELECT k, f.tree, f.level + 1, place // 3, sha256({left} || digest || {right}), proof || {left} || {right} FROM {name} f JOIN {runs} r ON r.tree = f.tree AND r.level = f.level AND r.run = place // 3)"""


OP11 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf("text")} AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim FROM documents),
p AS MATERIALIZED (SELECT k, doc_id, tree, leaf, claim, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree("own", "p")},
subs AS MATERIALIZED (SELECT tree AS place, 0 AS tree, digest, count(*) OVER () AS n FROM own WHERE n = 1),
{_tree("top", "subs")},
start AS (SELECT k, tree, place, claim AS digest, '' AS proof FROM p),
{_fold("up", "start", "own_runs")},
half AS (SELECT k, arg_max(tree, level) AS place, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM up GROUP BY k),
again AS (SELECT k, 0 AS tree, place, digest, proof FROM half),
{_fold("upper", "again", "top_runs")},
done AS (SELECT k, arg_max(digest, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM upper GROUP BY k)
SELECT doc_id, leaf, subs.digest AS subroot, r.digest AS root, proof_sha256, folded_root, folded_root = r.digest AS verified
FROM p JOIN done USING (k) JOIN subs ON subs.place = p.tree, (SELECT digest FROM top WHERE n = 1) r"""


def _op12(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    apart = "list_sum(list_transform(list_zip(pt.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = lambda n: f"a{n} AS MATERIALIZED (SELECT r, p, min((d, e)) AS best FROM (SELECT pt.r, pt.p, b.e, {apart} AS d FROM pt JOIN b{n} b USING (p)) GROUP BY r, p)"
    steps = [f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM pt WHERE r <= {entries})", nearest(0)]
    for n in range(rounds):
        steps.append(f"""m{n} AS (SELECT p, e, list(f ORDER BY i) AS x FROM (SELECT p, best[2] AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS f FROM a{n} JOIN pt USING (r, p), UNNEST(range(1, len(x) + 1)) t(i) GROUP BY ALL) GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (p, e))""")
        steps.append(nearest(n + 1))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pt AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM k, range(0, {parts}) t(p)),
{", ".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN o USING (r)"""


OP12 = _op12()

OP13 = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT k, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) END AS shingles FROM w),
u AS MATERIALIZED (SELECT k, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
e AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM u a JOIN u b USING (shingle) WHERE a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c(k, root) AS (SELECT k, k FROM s UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.k),
m AS (SELECT c.k, min(s.doc_id) AS component_id FROM c JOIN s ON s.k = c.root GROUP BY c.k)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN m USING (k)"""
