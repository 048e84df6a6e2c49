"""Clustering and trees: distributed where the method allows, built on MLlib where Spark has the algorithm."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.plans.mle import batch_sums, project
from gramforge.util import checkpoint, col


@dataclass
class KMeans:
    centres: np.ndarray
    inertia: float
    names: list[str]

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        return df.withColumn(out, nearest_centre([col(c) for c in self.names], self.centres)["k"])


def nearest_centre(x, centres: np.ndarray):
    """Struct (distance squared d, index k) of the nearest centre; ties go to the lower index."""
    c = []
    for i, m in enumerate(centres):
        d = F.lit(0.0)
        for e, v in zip(x, m, strict=True):
            d = d + (e - float(v)) * (e - float(v))
        c.append(F.struct(d.alias("d"), F.lit(i).alias("k")))
    return F.least(*c) if len(c) > 1 else c[0]


def kmeans(df: DataFrame, names: Sequence[str], k: int, *, seed: int = 0, restarts: int = 10, max_iter: int = 300, sample: int = 20_000) -> KMeans:
    """Lloyd's iterations with sums per Arrow batch, all restarts in one job each; starts by k-means++ on a bounded sample of rows of least hash."""
    z = project(df, [col(c) for c in names])
    n = z.count()
    if n < k:
        raise InvalidOperation("fewer rows than clusters")
    p = len(names)
    pick = np.array(z.orderBy(F.xxhash64(*z.columns, F.lit(seed)), *z.columns).limit(sample).collect(), float).reshape(-1, p)
    starts = []
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        c = [pick[rng.integers(len(pick))]]
        while len(c) < k:
            d = np.min([((pick - m) ** 2).sum(axis=1) for m in c], axis=0)
            c.append(pick[rng.choice(len(pick), p=d / d.sum())] if d.sum() > 0 else pick[rng.integers(len(pick))])
        starts.append(np.array(c))
    width = 1 + k + k * p
    inertia, open_ = [math.inf] * restarts, list(range(restarts))
    for _ in range(max_iter):
        now = [starts[r] for r in open_]

        def add(m: np.ndarray, now=now) -> np.ndarray:
            out = []
            for centres in now:
                d = np.column_stack([((m - c) ** 2).sum(axis=1) for c in centres])
                hit = np.eye(k)[d.argmin(axis=1)]
                out += [[d.min(axis=1).sum()], hit.sum(axis=0), (hit.T @ m).ravel()]
            return np.concatenate(out)

        sums = batch_sums(z, width * len(now), add).reshape(-1, width)
        done = []
        for r, v in zip(open_, sums, strict=True):
            size = v[1 : k + 1]
            starts[r] = np.where(size[:, None] > 0, v[k + 1 :].reshape(k, p) / np.maximum(size, 1)[:, None], starts[r])
            if v[0] >= inertia[r] - 1e-10 * abs(inertia[r]):
                done.append(r)
            inertia[r] = float(v[0])
        open_ = [r for r in open_ if r not in done]
        if not open_:
            break
    best = int(np.argmin(inertia))
    return KMeans(starts[best], inertia[best], list(names))


def gaussian_mixture(df: DataFrame, names: Sequence[str], k: int, *, seed: int = 0, max_iter: int = 100, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """EM with full covariances: responsibilities per Arrow batch, only weighted moments are shuffled."""
    km = kmeans(df, names, k, seed=seed, restarts=1)
    z = project(df, [col(c) for c in names])
    p = len(names)
    mu, pi = km.centres.copy(), np.full(k, 1 / k)
    cov = np.array([np.diag(np.maximum(batch_sums(z, 2 * p + 1, lambda m: np.concatenate([m.sum(0), (m * m).sum(0), [len(m)]]))[p : 2 * p] / z.count() - mu.mean(0) ** 2, 1e-3)) for _ in range(k)])
    old = -math.inf
    for _ in range(max_iter):
        chol = [np.linalg.cholesky(c + 1e-9 * np.eye(p)) for c in cov]

        def add(m: np.ndarray, mu=mu, pi=pi, chol=chol) -> np.ndarray:
            lp = np.column_stack([np.log(pi[j]) - 0.5 * (np.linalg.solve(chol[j], (m - mu[j]).T) ** 2).sum(0) - np.log(np.diag(chol[j])).sum() - 0.5 * p * math.log(2 * math.pi) for j in range(k)])
            top = lp.max(axis=1, keepdims=True)
            ll = top[:, 0] + np.log(np.exp(lp - top).sum(axis=1))
            r = np.exp(lp - ll[:, None])
            return np.concatenate([[ll.sum(), len(m)], r.sum(0), (r.T @ m).ravel(), np.array([(m * r[:, [j]]).T @ m for j in range(k)]).ravel()])

        v = batch_sums(z, 2 + k + k * p + k * p * p, add)
        nk = np.maximum(v[2 : 2 + k], 1e-10)
        mu = v[2 + k : 2 + k + k * p].reshape(k, p) / nk[:, None]
        cov = v[2 + k + k * p :].reshape(k, p, p) / nk[:, None, None] - np.einsum("ki,kj->kij", mu, mu) + 1e-9 * np.eye(p)
        pi = nk / v[1]
        if abs(v[0] - old) <= tol * abs(v[0]):
            break
        old = v[0]
    return {"weights": pi, "means": mu, "covariances": cov, "log_likelihood": np.array(v[0])}


def dbscan(df: DataFrame, key: str, names: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """Density clusters: points meet only points of neighbouring grid cells of width eps; core points are joined by
    label propagation with pointer jumping. Columns: key, `cluster` (least core key; NULL for noise).

    Points of one cell narrower than eps / sqrt(p) are all within eps of each other: a full fine cell makes its points core and
    one star per cell replaces its pairs, so dense spots do not square. Neighbouring cells are found among occupied ones: these meet
    on squares of width eps of the (up to) three columns of largest range and are kept if no other column separates them, so the
    number of columns does not multiply cells. Where eps is near the range of the columns, all pairs of cells are compared.
    """
    p = len(names)
    fine = eps / math.sqrt(p) * 0.999999
    src = df.select(col(key).alias("id"), F.array(*[col(c).cast("double") for c in names]).alias("x"))
    pts = checkpoint(src.withColumn("g", F.transform("x", lambda e: F.floor(e / fine))).withColumn("cell", F.concat_ws(",", F.transform("g", lambda e: e.cast("string")))))
    # A cell's middle and how far its points can be from it; a single point is its own middle.
    single = F.col("m") == 1
    sizes = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("star"), F.first("g").alias("g"), F.first("x").alias("x"))
    sizes = sizes.select("cell", "m", "star", "g", F.when(single, F.col("x")).otherwise(F.transform("g", lambda e: (e + 0.5) * fine)).alias("c"), F.when(single, 0.0).otherwise(eps / 2).alias("w"))
    sizes = checkpoint(sizes)
    spread = sizes.agg(*[(F.max(F.col("g")[i]) - F.min(F.col("g")[i])).alias(f"s{i}") for i in range(p)]).first()
    wide = sorted(range(p), key=lambda i: -(spread[i] or 0))[:3]
    # Points within eps are at most r fine cells apart in every column.
    r = math.ceil(eps / fine)
    square = [F.floor(F.col("g")[i] / r) for i in wide]
    left = sizes.select("cell", "g", "c", "w", *[e.alias(f"o{i}") for i, e in enumerate(square)], F.pmod(F.xxhash64("cell"), F.lit(16)).alias("part"))
    right = sizes.select(F.col("cell").alias("b"), F.col("g").alias("h"), F.col("c").alias("d"), F.col("w").alias("v"), *[e.alias(f"o{i}") for i, e in enumerate(square)], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("part"))
    for i in range(len(wide)):
        left = left.withColumn(f"o{i}", F.explode(F.sequence(F.col(f"o{i}") - 1, F.col(f"o{i}") + 1)))
    # Two lower bounds of the distance of two cells' points: from the middles, and the gap between the cells.
    middle = F.aggregate(F.zip_with("c", "d", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda u, v: u + v)
    gap = F.aggregate(F.zip_with("g", "h", lambda u, v: F.pow(F.greatest(F.abs(u - v) - 1, F.lit(0)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda u, v: u + v)
    on, tasks = [*[f"o{i}" for i in range(len(wide))], "part"], 4 * df.sparkSession.sparkContext.defaultParallelism
    near = left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).where(F.col("cell") < F.col("b"))
    near = checkpoint(near.where((middle <= F.pow(eps + F.col("w") + F.col("v"), F.lit(2.0)) * (1 + 1e-9)) & (gap * (fine * fine) <= eps * eps * (1 + 1e-9))).select(F.col("cell").alias("a"), "b"))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    dist2 = F.aggregate(F.zip_with("l.x", "r.x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda u, v: u + v)
    full = sizes.where(F.col("m") >= min_points).select("cell")
    sparse = pts.join(full, "cell", "left_anti")
    counts = sparse.alias("l").join(near.alias("n"), F.col("l.cell") == F.col("n.a")).join(pts.alias("r"), F.col("n.b") == F.col("r.cell")).where(dist2 <= eps * eps).groupBy(F.col("l.id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    core = pts.join(sizes.select("cell", "m"), "cell").join(counts, "id", "left").where(F.col("m") + F.coalesce("k", F.lit(0)) >= min_points).drop("m", "k")
    core = checkpoint(core)
    stars = core.groupBy("cell").agg(F.min("id").alias("star"))
    inside = core.join(stars, "cell").select(F.col("id").alias("a"), F.col("star").alias("b"))
    across = core.alias("l").join(near.alias("n"), F.col("l.cell") == F.col("n.a")).join(core.alias("r"), F.col("n.b") == F.col("r.cell")).where((F.col("l.cell") < F.col("r.cell")) & (dist2 <= eps * eps))
    # One edge per pair of cells is enough, as a cell's core points are connected among themselves.
    across = across.groupBy("l.cell", "r.cell").agg(F.min(F.struct(F.col("l.id").alias("a"), F.col("r.id").alias("b"))).alias("e")).select("e.a", "e.b")
    label = connected_components(core.select("id"), inside.unionByName(across))
    rest = pts.join(core.select("id"), "id", "left_anti")
    border = rest.alias("l").join(near.select("a", "b").unionByName(sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))).alias("n"), F.col("l.cell") == F.col("n.a")).join(core.alias("r"), F.col("n.b") == F.col("r.cell")).where(dist2 <= eps * eps)
    border = border.select(F.col("l.id").alias("id"), F.col("r.id").alias("c")).join(label.withColumnRenamed("id", "c"), "c").groupBy("id").agg(F.min("component").alias("component"))
    both = label.unionByName(border)
    return pts.select("id").join(both, "id", "left").select(F.col("id").alias(key), F.col("component").alias("cluster"))


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component = least id): alternating large-star and small-star steps; logarithmically many rounds, no node list is collected."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = checkpoint(small)
        if small.exceptAll(e).limit(1).count() == 0 and e.exceptAll(small).limit(1).count() == 0:
            break
        e = small
    root = e.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(root, F.col("id") == F.col("a"), "left").select("id", F.coalesce("component", F.col("id")).alias("component"))


@dataclass
class Trees:
    model: object
    names: list[str]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        z = VectorAssembler(inputCols=self.names, outputCol="__f").transform(df)
        return self.model.setPredictionCol(out).transform(z).drop("__f")


def _assembled(df: DataFrame, y: str, names: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="__f").transform(df.select(col(y).cast("double").alias("__y"), *[col(c).cast("double").alias(c) for c in names]))


def random_forest(df: DataFrame, y: str, names: Sequence[str], *, trees: int = 100, depth: int = 8, seed: int = 0) -> Trees:
    from pyspark.ml.regression import RandomForestRegressor

    m = RandomForestRegressor(featuresCol="__f", labelCol="__y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return Trees(m.fit(_assembled(df, y, names)), list(names))


def gradient_boosting(df: DataFrame, y: str, names: Sequence[str], *, rounds: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 0) -> Trees:
    from pyspark.ml.regression import GBTRegressor

    m = GBTRegressor(featuresCol="__f", labelCol="__y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return Trees(m.fit(_assembled(df, y, names)), list(names))


def hierarchical(x: np.ndarray, k: int, linkage: str = "average", max_points: int = 3000) -> np.ndarray:
    """Agglomerative labels for a bounded set of points (for example k-means centres of a large table)."""
    n = len(x)
    if n > max_points:
        raise InvalidOperation(f"over {max_points} points; cluster their k-means centres instead")
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    if linkage == "ward":
        d = d * d
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        a, b, di, dj, dij = size[i], size[j], d[i].copy(), d[j].copy(), d[i, j]
        if linkage == "single":
            new = np.minimum(di, dj)
        elif linkage == "complete":
            new = np.where(np.isinf(di) | np.isinf(dj), np.inf, np.maximum(di, dj))
        elif linkage == "average":
            new = (a * di + b * dj) / (a + b)
        else:
            new = ((a + size) * di + (b + size) * dj - size * dij) / (a + b + size)
        new[~live] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        live[j] = False
        size[i] += b
        label[label == label[j]] = label[i] if label[i] != label[j] else label[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def gaussian_process(x: np.ndarray, y: np.ndarray, at: np.ndarray, length: float = 1.0, signal: float = 1.0, noise: float = 0.1, max_points: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Exact regression with a squared exponential kernel on a bounded set of points: (mean, variance)."""
    if len(x) > max_points:
        raise InvalidOperation(f"over {max_points} points")
    k = lambda a, b: signal * np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(-1) / length**2)
    c = np.linalg.cholesky(k(x, x) + noise * np.eye(len(x)))
    s = np.linalg.solve(c, k(x, at))
    return s.T @ np.linalg.solve(c, y), signal - (s * s).sum(0)


def spectral_clustering(edges: DataFrame, k: int, *, max_iter: int = 20) -> DataFrame:
    """Clusters of a weighted graph (src, dst, weight; long ids) by power iteration; columns id, cluster."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight").assignClusters(edges)


def mlp(df: DataFrame, y: str, names: Sequence[str], *, hidden: int = 8, epochs: int = 100, rate: float = 0.05, seed: int = 0) -> dict[str, object]:
    """One sigmoid hidden layer for regression by full-batch Adam: every epoch adds the gradient over Arrow batches.

    Inputs and response are standardised; `predict` maps a raw matrix to predictions.
    """
    z = project(df, [*[col(c) for c in names], col(y)])
    p = len(names)
    v = batch_sums(z, 2 * (p + 1) + 1, lambda m: np.concatenate([m.sum(0), (m * m).sum(0), [len(m)]]))
    n = v[-1]
    mean = v[: p + 1] / n
    sd = np.sqrt(np.maximum(v[p + 1 : -1] / n - mean**2, 1e-12))
    rng = np.random.default_rng(seed)
    w = np.concatenate([rng.normal(0, 1 / math.sqrt(p + 1), (p + 1) * hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden + 1)])

    def parts(w: np.ndarray):
        return w[: (p + 1) * hidden].reshape(p + 1, hidden), w[(p + 1) * hidden :]

    def forward(w: np.ndarray, x: np.ndarray):
        a, b = parts(w)
        h = 1 / (1 + np.exp(-np.clip(x @ a[:-1] + a[-1], -30, 30)))
        return h, h @ b[:-1] + b[-1]

    def add(m: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = (m - mean) / sd
        h, f = forward(w, s[:, :p])
        e = f - s[:, p]
        d = e[:, None] * parts(w)[1][:-1] * h * (1 - h)
        return np.concatenate([(s[:, :p].T @ d).ravel(), d.sum(0), h.T @ e, [e.sum(), (e * e).sum()]])

    m1, m2, loss = np.zeros_like(w), np.zeros_like(w), math.nan
    for t in range(1, epochs + 1):
        g = batch_sums(z, len(w) + 1, lambda m, w=w: add(m, w)) / n
        loss, g = float(g[-1]), g[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return {"loss": loss, "predict": lambda x: forward(w, (np.asarray(x, float) - mean[:p]) / sd[:p])[1] * sd[p] + mean[p]}


def tsne(x: np.ndarray, *, dims: int = 2, perplexity: float = 30.0, iters: int = 500, seed: int = 0, max_points: int = 3000) -> np.ndarray:
    """Exact t-SNE of a bounded set of points."""
    n = len(x)
    if n > max_points:
        raise InvalidOperation(f"over {max_points} points")
    d = np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)
    p = np.zeros((n, n))
    goal = math.log(min(perplexity, (n - 1) / 3))
    for i in range(n):
        lo, hi, b = 0.0, math.inf, 1.0
        di = np.delete(d[i], i)
        for _ in range(60):
            w = np.exp(-(di - di.min()) * b)
            s = w.sum()
            h = math.log(s) + b * ((di - di.min()) * w).sum() / s
            if abs(h - goal) < 1e-5:
                break
            lo, hi = (b, hi) if h > goal else (lo, b)
            b = b * 2 if hi == math.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = w / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, v = rng.normal(0, 1e-4, (n, dims)), np.zeros((n, dims))
    for t in range(iters):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        w = (p * (12 if t < 100 else 1) - q / q.sum()) * q
        g = 4 * (np.diag(w.sum(1)) - w) @ y
        v = (0.5 if t < 100 else 0.8) * v - 100.0 * g
        y = y + v
        y -= y.mean(0)
    return y
