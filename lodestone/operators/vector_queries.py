"""Registered vector queries, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import vectors as x
from lodestone.plans.views import Views


def _seeded(f, *a, **k):
    def run(spark, sf_dir):
        v = Views(spark, sf_dir)
        return f(v, x.seed_vectors(v.table("embeddings"), "vec_id = 0")[0], *a, **k)

    return run


QUERIES = {
    "vector_search": _seeded(x.vector_search),
    "vector_search_facet": _seeded(x.vector_search, facet=3),
    "related_objects": lambda s, d: x.related(Views(s, d), 0),
    "contact_vector_search": _seeded(x.contact_search),
    "similar_contacts": _seeded(x.contact_search, exclude=0),
    "mean_pool_centroids": lambda s, d: x.centroids(Views(s, d)),
    "coarse_then_fine": _seeded(x.coarse_then_fine),
    "nearest_name": lambda s, d: x.nearest_in_facet(Views(s, d)),
    "residual_basis": lambda s, d: x.residuals(Views(s, d)),
}

_E = "e AS (SELECT vec_id, vec_id // 5 AS object, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 0)"
_BEST = "SELECT object, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY distance, vec_id) AS rk FROM (SELECT object, vec_id, round(1 - list_cosine_similarity(v, qv), 6) AS distance FROM e, q{})) WHERE rk = 1 ORDER BY distance, object LIMIT 10"
SQL = {
    "vector_search": f"WITH {_E} " + _BEST.format(""),
    "vector_search_facet": f"WITH {_E} " + _BEST.format(" WHERE label = 3"),
    "related_objects": f"WITH {_E} SELECT a.object, min(round(1 - list_cosine_similarity(a.v, b.v), 6)) AS distance FROM e a, e b WHERE b.object = 0 AND a.object <> 0 GROUP BY a.object ORDER BY distance, a.object LIMIT 10",
    "contact_vector_search": f"WITH {_E} SELECT vec_id, c_name AS display_name, distance FROM (SELECT vec_id, round(1 - list_cosine_similarity(v, qv), 6) AS distance FROM e, q ORDER BY 2, 1 LIMIT 20) LEFT JOIN customer ON c_custkey = vec_id",
    "similar_contacts": f"WITH {_E} SELECT vec_id, c_name AS display_name, distance FROM (SELECT vec_id, round(1 - list_cosine_similarity(v, qv), 6) AS distance FROM e, q WHERE vec_id <> 0 ORDER BY 2, 1 LIMIT 20) LEFT JOIN customer ON c_custkey = vec_id",
    "mean_pool_centroids": f"""WITH {_E}, u AS (SELECT label, unnest(v) / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS x, unnest(range(len(v))) AS dim FROM e),
m AS (SELECT label, dim, count(*) AS n, avg(x) AS mean FROM u GROUP BY ALL), s AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM m GROUP BY label)
SELECT label AS facet, n, CAST(dim AS INTEGER) AS dim, round(mean / size, 6) AS value FROM m JOIN s USING (label)""",
    "coarse_then_fine": f"WITH {_E}, c AS (SELECT vec_id FROM e, q ORDER BY round(1 - list_cosine_similarity(v[1:16], qv[1:16]), 6), vec_id LIMIT 80) SELECT vec_id, round(1 - list_cosine_similarity(v, qv), 6) AS distance FROM e JOIN c USING (vec_id), q ORDER BY 2, 1 LIMIT 10",
    "nearest_name": f"WITH {_E} SELECT query, nearest, cosine FROM (SELECT a.vec_id AS query, b.vec_id AS nearest, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS rk FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rk = 1",
}
