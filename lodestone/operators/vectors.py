"""Exact vector search. Distances are matrix products over Arrow batches; top-k and best-of-group stay in the planner."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.common import best_per_key, norm_limit
from lodestone.plans.views import Views


#: Ids that a block of a facet's rows spans, and the parts that a facet's rows are dealt to.
BLOCK, PARTS = 4096, 16


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A (rows, dims) matrix of a list column; rows of another length, null or with NaN are all NaN."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), dims), np.nan)
    good = (lengths == dims) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False)
    first = column.offsets.to_numpy()[:-1][good]
    if len(first):
        out[good] = flat[first[:, None] + np.arange(dims)]
    return out


def vectors(v: Views, chunks: int = 5) -> DataFrame:
    """vec_id, object, embedding, facet: `chunks` vectors in a row are one object's."""
    return v.table("embeddings").select("vec_id", F.expr(f"vec_id div {chunks}").alias("object"), "embedding", F.col("label").alias("facet"))


def distances(df: DataFrame, query: Sequence[Sequence[float]], keep: Sequence[str]) -> DataFrame:
    """The kept columns and the least cosine distance to any of the query vectors, without rows that have no valid vector."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    names = list(keep)

    def measure(batches):
        for b in batches:
            m = matrix(b.column(len(names)), q.shape[1])
            with np.errstate(all="ignore"):
                d = (1 - (m @ q.T) / np.linalg.norm(m, axis=1)[:, None]).min(axis=1)
            ok = pa.array(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(d)], names=[*names, "distance"]).filter(ok)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, "embedding").mapInArrow(measure, f"{schema}, distance double").withColumn("distance", F.round("distance", 6))


def seed_vectors(df: DataFrame, condition: str) -> list[list[float]]:
    """The vectors of one object; bounded by its chunks."""
    return [r[0] for r in df.where(condition).orderBy("vec_id").select("embedding").collect()]


def vector_search(v: Views, query: Sequence[float], facet: int | None = None, limit: int = 10) -> DataFrame:
    """Best chunk of each object, then the nearest objects."""
    base = vectors(v) if facet is None else vectors(v).where(F.col("facet") == facet)
    best = best_per_key(distances(base, [query], ["object", "vec_id"]), ["object"], [F.asc("distance"), F.asc("vec_id")])
    return best.orderBy("distance", "object").limit(norm_limit(limit)).select("object", "vec_id", "distance")


def related(v: Views, seed: int, limit: int = 10) -> DataFrame:
    """Objects nearest to any chunk of the seed object, the seed left out."""
    base = vectors(v)
    query = seed_vectors(base, f"object = {seed}")
    near = distances(base.where(F.col("object") != seed), query, ["object"]).groupBy("object").agg(F.min("distance").alias("distance"))
    return near.orderBy("distance", "object").limit(norm_limit(limit))


def contact_search(v: Views, query: Sequence[float], dims: int = 64, exclude: int | None = None, limit: int = 20) -> DataFrame:
    """Contacts (vec_id as the contact's number) by distance, with their names where they have one."""
    if len(query) != dims:
        raise ValueError(f"the query vector has {len(query)} dimensions, not {dims}")
    base = v.table("embeddings") if exclude is None else v.table("embeddings").where(F.col("vec_id") != exclude)
    top = distances(base, [query], ["vec_id"]).orderBy("distance", "vec_id").limit(norm_limit(limit))
    names = v.table("customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_name").alias("display_name"))
    return top.join(names, "vec_id", "left").select("vec_id", "display_name", "distance")


def centroids(v: Views) -> DataFrame:
    """facet, n, dim, value: the mean of the unit vectors of each facet, again of unit length."""
    unit = v.table("embeddings").select(F.col("label").alias("facet"), F.col("embedding"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"))
    long = unit.select("facet", "norm", F.posexplode("embedding").alias("dim", "x")).groupBy("facet", "dim").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double") / F.col("norm")).alias("mean"))
    size = long.groupBy("facet").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("size"))
    return long.join(size, "facet").select("facet", "n", "dim", F.round(F.col("mean") / F.col("size"), 6).alias("value"))


def coarse_then_fine(v: Views, query: Sequence[float], dims: int = 16, beam: int = 64, limit: int = 10) -> DataFrame:
    """The `beam` nearest by the first dimensions, ranked again by all."""
    cut = v.table("embeddings").select("vec_id", F.slice("embedding", 1, dims).alias("embedding"))
    coarse = distances(cut, [list(query)[:dims]], ["vec_id"]).orderBy("distance", "vec_id").limit(max(beam, 8 * limit)).select("vec_id")
    fine = v.table("embeddings").join(F.broadcast(coarse), "vec_id", "left_semi")  # the beam
    return distances(fine, [query], ["vec_id"]).orderBy("distance", "vec_id").limit(limit)


def nearest_in_facet(v: Views, modulo: int = 50) -> DataFrame:
    """For the stated query set (ids divisible by modulo): the highest cosine to another vector of the same facet.

    Blocks of a facet's rows meet blocks of its queries, whose cosines are one matrix product. Rows are dealt to PARTS of a facet and
    queries go to each part, so all pairs of a facet never exist at once, in no task.
    """
    rows = v.table("embeddings").where("label is not null and embedding is not null").select("vec_id", "label", "embedding")
    packed = lambda df, size, *keys: df.groupBy("label", F.expr(f"vec_id div {size}").alias("block"), *keys).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("held")).select("label", "block", *keys, F.col("held.vec_id").alias("ids"), F.col("held.embedding").alias("vecs"))
    left = packed(rows, BLOCK).withColumn("part", F.pmod("block", F.lit(PARTS)).cast("int"))
    right = packed(rows.where(F.col("vec_id") % modulo == 0), BLOCK * modulo // 4).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = left.select("label", "part", "ids", "vecs").join(right.select("label", "part", F.col("ids").alias("queries"), F.col("vecs").alias("asked")), ["label", "part"])

    def unit(vecs):
        x = vecs.values
        m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        return m, np.linalg.norm(m, axis=1)

    def measure(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                ids, queries = b.column(0)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()
                (x, nx), (q, nq) = unit(b.column(1)[i]), unit(b.column(3)[i])
                with np.errstate(all="ignore"):
                    cos = np.round((q @ x.T) / (nq[:, None] * nx), 6)
                cos[(queries[:, None] == ids) | np.isnan(cos)] = -2
                best = cos.argmax(1)  # ids ascend: the first of equal cosines is the smallest
                found = cos[np.arange(len(queries)), best]
                ok = found > -2
                out.append((queries[ok], found[ok], -ids[best[ok]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "cosine", "neg"])

    pairs = met.select("ids", "vecs", "queries", "asked").mapInArrow(measure, "query bigint, cosine double, neg bigint")
    best = pairs.groupBy("query").agg(F.max(F.struct("cosine", "neg")).alias("b"))
    return best.select("query", (-F.col("b.neg")).alias("nearest"), F.col("b.cosine").alias("cosine"))


def residual_basis(sample: np.ndarray, directions: int = 20, least: int = 512, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions of a bounded sample, by power iteration with deflation; no directions under `least` rows."""
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    if len(sample) < least:
        return mean, np.zeros((0, sample.shape[1]))
    x, found = sample - mean, []
    rng = np.random.default_rng(1)
    for _ in range(min(directions, x.shape[1])):
        u = rng.standard_normal(x.shape[1])
        for _ in range(steps):
            u = x.T @ (x @ u)
            size = np.linalg.norm(u)
            if size < 1e-12:
                return mean, np.array(found).reshape(-1, sample.shape[1])
            u /= size
        found.append(u)
        x = x - np.outer(x @ u, u)
    return mean, np.array(found)


def residuals(v: Views, directions: int = 20, most: int = 4096) -> DataFrame:
    """vec_id and the length that is left of each unit vector without the mean and the leading directions of a bounded sample."""
    base = v.table("embeddings").select("vec_id", "embedding")
    rows = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()  # the documented sample bound
    unit = lambda m: m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))
    dims = len(rows[0].embedding) if rows else 1
    mean, basis = residual_basis(unit(np.array([r.embedding for r in rows], np.float64).reshape(-1, dims)), directions)

    def left(batches):
        for b in batches:
            x = unit(matrix(b.column(1), dims)) - mean
            x = x - (x @ basis.T) @ basis
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.linalg.norm(x, axis=1), 6))], names=["vec_id", "residual"])

    return base.mapInArrow(left, "vec_id bigint, residual double")
