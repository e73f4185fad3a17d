"""DuckDB SQL that takes more than a few lines to state."""

from __future__ import annotations


def clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """Plain k-means, every distance worked out in every round; centroids are rows (j, d, c)."""
    steps = [f"""
        kept AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
        c0 AS MATERIALIZED (
            SELECT j, unnest(v) AS c, generate_subscripts(v, 1) AS d
            FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS j FROM kept)
            WHERE j < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} AS MATERIALIZED (
            SELECT r, arg_min(j, (dist, j)) AS j, min(dist) AS dist
            FROM (SELECT r, j, sum((x - c) * (x - c)) AS dist FROM parts JOIN c{n} USING (d) GROUP BY r, j) GROUP BY r)""")
        if n < rounds:
            # (s % n + n) % n is the remainder that goes with the floor
            steps.append(f"""
        c{n + 1} AS MATERIALIZED (
            SELECT c{n}.j, c{n}.d, coalesce((s - (s % m + m) % m) // m, c) AS c
            FROM c{n} LEFT JOIN (SELECT j, d, sum(x) AS s, count(*) AS m FROM parts JOIN a{n} USING (r) GROUP BY j, d) USING (j, d))""")
    return f"""
        WITH {",".join(steps)},
        marks AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
        SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
               CAST(sum(dist) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} AS a JOIN kept USING (r) JOIN marks ON marks.j = a.j"""


def collocations_sql(least: int = 100, top: int = 2000, percent: int = 100, longest: int = 5) -> str:
    """Every n-gram spelt out and grouped; the lists of words are the keys."""
    grams = " UNION ALL ".join(
        f"SELECT lang, w[i:i + {m - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM pieces WHERE len(w) >= {m})" for m in range(1, longest + 1)
    )
    inside = " UNION ALL ".join(f"SELECT lang, p[s:s + {m - 1}] AS p, a FROM (SELECT lang, p, a, unnest(range(1, len(p) - {m - 2})) AS s FROM candidates WHERE len(p) > {m})" for m in range(2, longest))
    return f"""
        WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS MATERIALIZED (
            SELECT lang, string_split_regex(trim(piece, chr(32) || chr(9)), '[\\x20\\x09]+') AS w
            FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered)
            WHERE trim(piece, chr(32) || chr(9)) <> ''),
        f AS MATERIALIZED (SELECT lang, p, count(*) AS n FROM ({grams}) GROUP BY lang, p HAVING count(*) >= {least} OR len(p) = 1),
        totals AS (SELECT lang, sum(n) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
        candidates AS (SELECT lang, p, n AS a FROM f WHERE len(p) > 1),
        longer AS (SELECT lang, p, max(a) AS b FROM ({inside}) GROUP BY lang, p),
        cuts AS (
            SELECT c.lang, c.p, c.a, k, x.n AS l, y.n AS r, t.n,
                   CAST(1000 AS HUGEINT) * CAST(c.a AS HUGEINT) * CAST(t.n AS HUGEINT) // (CAST(x.n AS HUGEINT) * CAST(y.n AS HUGEINT)) AS score
            FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates) AS c
            JOIN totals AS t USING (lang)
            JOIN f AS x ON x.lang = c.lang AND x.p = c.p[1:k]
            JOIN f AS y ON y.lang = c.lang AND y.p = c.p[k + 1:]
            LEFT JOIN longer AS o ON o.lang = c.lang AND o.p = c.p
            WHERE o.b IS NULL OR 100 * o.b < {percent} * c.a),
        best AS (SELECT lang, p, a, n, arg_min({{'l': l, 'r': r, 'score': score}}, (score, k)) AS b FROM cuts GROUP BY lang, p, a, n),
        ranked AS (
            SELECT lang, array_to_string(p, ' ') AS phrase, a, b.l AS l, b.r AS r, n, b.score AS score,
                   row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, array_to_string(p, ' ')) AS rank
            FROM best)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}"""
