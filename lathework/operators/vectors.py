"""Exact top-k vector search of a query set against all rows, in blocks.

Queries and rows are dealt into blocks; each pair of blocks is scored at once by
a matrix product in its own task and gives at most k hits per query, so nothing
but hits is shuffled afterwards. No index is needed for exact results; an
inverted-file index for large corpora is :func:`ivf_search`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.text import finite

METRICS = ("ip", "cosine", "l2")
#: How many queries and rows are scored at a time, and of how many rows at once only the best rough score is looked at first.
PART, PIECE, SEGMENT = 256, 8192, 32
#: Pairs of a part that are kept before they are cut to k a query.
MOST_PAIRS = 4_000_000
#: Cosines of vectors of at most so many members are searched by boxes of at most so many rows, if there are more than two boxes, and so many neighbouring queries at a time; in more dimensions boxes bound next to nothing.
BOXED, BOX, NEIGHBOURS = 8, 256, 64


def valid_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite members."""
    return df.where((F.size(vector) == dim) & F.forall(vector, lambda x: finite(x.cast("double"))))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Similarities, larger is nearer: inner product, cosine or minus the distance."""
    dot = q @ x.T
    if metric == "ip":
        return dot
    qn, xn = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(dot / np.sqrt(qn * xn))
    return -np.sqrt(np.maximum(qn + xn - 2 * dot, 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _rough(v: np.ndarray, metric: str) -> np.ndarray | None:
    """Vectors in single precision, for cosines of length 1; None where that is not safe."""
    n = (v * v).sum(1)
    if metric not in ("ip", "cosine") or not (np.isfinite(n) & ((n == 0) | (n > 1e-30) & (n < 1e30))).all():
        return None
    return (np.divide(v, np.sqrt(n)[:, None], out=np.zeros_like(v), where=n[:, None] > 0) if metric == "cosine" else v).astype(np.float32)


def _pair_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """As :func:`_scores`, of each query with the row in its place."""
    dot = (q * x).sum(1)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            dot = np.nan_to_num(dot / np.sqrt((q * q).sum(1) * (x * x).sum(1)))
    return np.round(dot, 6)


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, first place of each box and the end, least and greatest members in each box): rows halved along their widest dimension down to :data:`BOX` rows."""
    order, cuts, lows, highs, open_ = np.arange(len(x)), [], [], [], [(0, len(x))]
    while open_:
        a, b = open_.pop()
        part = x[order[a:b]]
        low, high = part.min(0), part.max(0)
        if b - a <= BOX:
            cuts.append(a)
            lows.append(low)
            highs.append(high)
            continue
        m = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, (high - low).argmax()], m)]
        open_ += [(a + m, b), (a, a + m)]  # the left half is next, so boxes come in their order
    return order, np.array([*cuts, len(x)]), np.array(lows, dtype=np.float64), np.array(highs, dtype=np.float64)


def _cut(q: np.ndarray, x: np.ndarray, pairs: list, metric: str, k: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of the kept (query, row) per query with their scores, ties by row."""
    at, row = (np.concatenate(c) for c in zip(*pairs))
    if own is not None:
        other = (row < own[0][at]) | (row >= own[1][at])
        at, row = at[other], row[other]
    score = _pair_scores(q[at], x[row], metric)
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], row[first], score[first]


def _margin(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray | float:
    """How far a rough score may be below the k-th best one at most, for a row to be among the best: rounding to 6 places, twice the rough error."""
    reach = 1.0 if metric == "cosine" else np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)).max(initial=0)
    return 2e-6 + (q.shape[1] + 8) * 1.2e-7 * reach


def _nearest_boxed(q: np.ndarray, x: np.ndarray, rough: tuple[np.ndarray, np.ndarray], k: int, own: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_nearest` for cosines in few dimensions, with the same result: only boxes whose best possible score reaches the k-th best row known are scored.

    Of neighbouring queries, the rows of the nearest boxes give the lower bound for the k-th best. What a box holds is bounded by
    the distance to it: 2 qx = q² + x² - (q - x)².
    """
    qs, xs = rough
    margin = _margin(q, x, "cosine")
    order, cuts, low, high = _boxes(xs)
    sizes, qd = np.diff(cuts), qs.astype(np.float64)
    length = np.maximum.reduceat((xs[order].astype(np.float64) ** 2).sum(1), cuts[:-1])
    home = np.concatenate([(qs[c : c + PIECE // 8] @ ((low + high) / 2).T.astype(np.float32)).argmax(1) for c in range(0, len(q), PIECE // 8)])
    nearby = np.argsort(home, kind="stable")
    more = k if own is None else k + int((own[1] - own[0]).max(initial=0))  # own rows may be among the best
    rows_of = lambda boxes: np.concatenate([order[cuts[b] : cuts[b + 1]] for b in boxes])
    found = []
    for start in range(0, len(q), NEIGHBOURS):
        at = nearby[start : start + NEIGHBOURS]
        away = sum((v[:, None] - np.clip(v[:, None], a, b)) ** 2 for v, a, b in zip(qd[at].T, low.T, high.T))
        most = ((qd[at] ** 2).sum(1)[:, None] + length - away) / 2
        seeds = np.unique(home[at])
        if (have := sizes[seeds].sum()) < 2 * more:
            near = np.argsort(-most.mean(0), kind="stable")
            seeds = np.union1d(seeds, near[: np.searchsorted(np.cumsum(sizes[near]), 2 * more - have) + len(seeds) + 1])
        s = qs[at] @ xs[rows_of(seeds)].T
        bound = np.partition(s, s.shape[1] - more, axis=1)[:, s.shape[1] - more] if s.shape[1] >= more else np.full(len(at), -np.inf, dtype=np.float32)
        least = (bound - margin).astype(np.float32)
        rows, kept, size = rows_of(np.flatnonzero((most >= least[:, None]).any(0))), [], 0
        for c in range(0, len(rows), PIECE):
            i, j = np.nonzero(qs[at] @ xs[rows[c : c + PIECE]].T >= least[:, None])
            kept.append((at[i], rows[c + j]))
            size += len(i)
            if size > MOST_PAIRS:
                kept = [_cut(q, x, kept, "cosine", k, own)[:2]]
                size = len(kept[0][0])
        found.append(_cut(q, x, kept, "cosine", k, own))
    return tuple(np.concatenate(c) for c in zip(*found))


def _nearest(q: np.ndarray, x: np.ndarray, rough: tuple[np.ndarray, np.ndarray], metric: str, k: int, own: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows of each query, best first, ties by row; ``own``: first and end of the rows that don't count for a query.

    All pairs get a rough score in single precision. The k-th best of the segments' best is a lower bound for the k-th best
    row; what is not within the error of that bound can't be among k best, all else is scored in double precision.
    """
    (qs, xs), n, kept, size = rough, len(x), [], 0
    margin = _margin(q, x, metric)
    best = np.full((len(q), k), -np.inf, dtype=np.float32)

    for c in range(0, n, PIECE):
        s = qs @ xs[c : c + PIECE].T
        if own is not None:
            for j in np.flatnonzero((own[0] < min(c + PIECE, n)) & (own[1] > c) & (own[0] < own[1])):
                s[j, max(own[0][j] - c, 0) : max(own[1][j] - c, 0)] = -np.inf
        if rest := -s.shape[1] % SEGMENT:
            s = np.pad(s, ((0, 0), (0, rest)), constant_values=-np.inf)
        s = s.reshape(len(q), -1, SEGMENT)
        tops = s.max(2)
        best = np.partition(np.concatenate([best, tops], 1), tops.shape[1], axis=1)[:, tops.shape[1] :]
        least = (best.min(1) - margin).astype(np.float32)
        at, seg = np.nonzero((tops >= least[:, None]) & (tops > -np.inf))
        inner = s[at, seg]
        a, b = np.nonzero((inner >= least[at][:, None]) & (inner > -np.inf))
        kept.append((at[a], c + seg[a] * SEGMENT + b))
        size += len(a)
        if size > MOST_PAIRS:
            kept = [_cut(q, x, kept, metric, k)[:2]]
            size = len(kept[0][0])
    return _cut(q, x, kept, metric, k)


def _scorer(types: tuple[str, str], metric: str, k: int | None, *, groups: bool, exclude_self: bool, above: float | None = None, up_to: float | None = None):
    """A function on one block of queries and one of rows that gives at most ``k`` hits per query, and its schema."""

    def nothing(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query_id": left["query_id"][:0], "row_id": right["row_id"][:0], "score": np.empty(0)}, index=range(0))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame | None:
        """By rough scores first, where that is safe."""
        q, x = _matrix(left["vector"]), _matrix(right["vector"])
        qs, xs = _rough(q, metric), _rough(x, metric)
        if qs is None or xs is None:
            return None
        asked, ids, found = left["query_id"].to_numpy(), right["row_id"].to_numpy(), []
        own = (np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")) if exclude_self else None
        if metric == "cosine" and 0 < x.shape[1] <= BOXED and len(x) > 2 * BOX:
            at, row, s = _nearest_boxed(q, x, (qs, xs), k, own)
            return pd.DataFrame({"query_id": asked[at], "row_id": ids[row], "score": s})
        for start in range(0, len(left), PART):
            part = slice(start, start + PART)
            at, row, s = _nearest(q[part], x, (qs[part], xs), metric, k, own and (own[0][part], own[1][part]))
            found.append(pd.DataFrame({"query_id": asked[part][at], "row_id": ids[row], "score": s}))
        return pd.concat(found, ignore_index=True)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return nothing(left, right)
        right = right.sort_values("row_id", ignore_index=True)
        ids, found = right["row_id"].to_numpy(), []
        x = _matrix(right["vector"])
        if k is not None and above is None and up_to is None:
            rows_of = right.groupby("grp", sort=False).indices if groups else {}
            parts = [nearest(l, right.iloc[rows_of[g]]) for g, l in left.groupby("grp", sort=False) if g in rows_of] if groups else [nearest(left, right)]
            if all(x is not None for x in parts):
                return pd.concat(parts, ignore_index=True) if parts else nothing(left, right)
        for start in range(0, len(left), PART):
            part = left.iloc[start : start + PART]
            s = np.round(_scores(_matrix(part["vector"]), x, metric), 6)
            if groups:
                s = np.where(part["grp"].to_numpy(dtype=object)[:, None] == right["grp"].to_numpy(dtype=object)[None, :], s, -np.inf)
            if exclude_self:
                s = np.where(part["query_id"].to_numpy()[:, None] == ids[None, :], -np.inf, s)
            if above is not None:
                s = np.where(s > above, s, -np.inf)
            if up_to is not None:
                s = np.where(s <= up_to, s, -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            taken = np.take_along_axis(s, order, axis=1)
            at, column = np.nonzero(np.isfinite(taken))
            found.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[at], "row_id": ids[order[at, column]], "score": taken[at, column]}))
        return pd.concat(found, ignore_index=True)

    return score, f"query_id {types[0]}, row_id {types[1]}, score double"


def _blocks(queries: DataFrame, rows: DataFrame, cell: str, block_rows: int, block_queries: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``cell, qb, rb``: within a cell each block of queries meets each block of rows; a cell with many rows is cut into many blocks."""
    n_q = queries.groupBy(cell).agg(F.count("*").alias("nq"))
    n_r = rows.groupBy(cell).agg(F.count("*").alias("nr"))
    sizes = n_q.join(n_r, cell).select(  # one row per cell, of which there is a bounded number
        cell, F.ceil(F.col("nq") / block_queries).cast("int").alias("nqb"), F.greatest(F.ceil(F.col("nr") / block_rows), F.lit(least)).cast("int").alias("nrb")
    )
    q = queries.join(F.broadcast(sizes), cell).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nqb")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nrb") - 1)))
    r = rows.join(F.broadcast(sizes), cell).withColumn("rb", F.pmod(F.xxhash64("row_id"), F.col("nrb")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)))
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns if c not in ("nqb", "nrb")))  # noqa: E731  both sides may come from one table
    return fresh(q), fresh(r)


def block_search(
    queries: DataFrame, rows: DataFrame, *, k: int | None, metric: str = "ip", block_rows: int = 50_000, block_queries: int = 2_000, same_group: bool = False, exclude_self: bool = False, above: float | None = None, up_to: float | None = None, cells: int = 64
) -> DataFrame:
    """The ``k`` nearest rows of each query, all of them if ``k`` is None: ``query_id, row_id, score, rank``; ties go to the smaller row id.

    ``queries``: query_id, vector[, grp]; ``rows``: row_id, vector[, grp]. With ``same_group`` a query
    whose grp is not null meets rows of that grp only (a null grp of a row matches none): groups are dealt into
    ``cells``, and only what shares a cell meets; queries without a grp meet all rows. Filter and bounds above < score <= up_to come
    before any ranking. Empty inputs give no rows; l2 scores are minus the distance.
    """
    if metric not in METRICS or k is not None and not 1 <= k <= 16384:
        raise ValueError("metric or k out of range")
    score_of = {"exclude_self": exclude_self, "above": above, "up_to": up_to}
    types = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["row_id"]
    least = min(16, queries.sparkSession.sparkContext.defaultParallelism)

    def hits(q: DataFrame, r: DataFrame, grouped: bool) -> DataFrame:
        cell = F.pmod(F.xxhash64("grp"), F.lit(cells)).cast("int") if grouped else F.lit(0)
        keep = ["vector", *(["grp"] if grouped else []), cell.alias("cell")]
        left, right = _blocks(q.select("query_id", *keep), r.select("row_id", *keep), "cell", block_rows, block_queries, 1 if grouped else least)
        score, schema = _scorer(types, metric, k, groups=grouped, **score_of)
        return left.groupBy("cell", "qb", "rb").cogroup(right.groupBy("cell", "qb", "rb")).applyInPandas(score, schema)

    if not same_group:
        return top_k(hits(queries, rows, False), k)
    return top_k(hits(queries.where("grp is not null"), rows.where("grp is not null"), True).unionByName(hits(queries.where("grp is null"), rows, False)), k)


def top_k(hits: DataFrame, k: int | None) -> DataFrame:
    """The ``k`` best hits per query, all of them if ``k`` is None, with ``rank``; ties go to the smaller row id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def sparse_search(queries: DataFrame, rows: DataFrame, *, k: int, same_group: bool = False) -> DataFrame:
    """Sparse inner-product search by an equi-join on dimensions: ``query_id, row_id, score, rank``. Vectors are map<bigint,float>; rows that share no dimension are no hits."""
    group = ["grp"] if same_group else []
    q = queries.select("query_id", *(F.col(g).alias("q_grp") for g in group), F.explode("sparse").alias("dim", "qw"))
    r = rows.select("row_id", *group, F.explode("sparse").alias("dim", "rw"))
    hits = q.join(r, "dim")
    if same_group:
        hits = hits.where(F.col("q_grp").isNull() | (F.col("q_grp") == F.col("grp")))
    scored = hits.groupBy("query_id", "row_id").agg(F.round(F.sum(F.col("qw").cast("double") * F.col("rw").cast("double")), 6).alias("score"))
    return top_k(scored, k)


def in_range(hits: DataFrame, above: float, up_to: float) -> DataFrame:
    """Hits with above < score <= up_to."""
    return hits.where((F.col("score") > above) & (F.col("score") <= up_to))


def squashed(c: Column) -> Column:
    """A score mapped to (0, 1) by the arc tangent."""
    return F.atan(c) / F.lit(np.pi) + 0.5


def weighted_fusion(dense: DataFrame, sparse: DataFrame, *, k: int, weights: tuple[float, float] = (0.8, 0.3), normalise: str = "none") -> DataFrame:
    """Two routes' hits merged by weighted sum; a route without the hit adds nothing."""
    s = (lambda c: F.coalesce(squashed(c), F.lit(0.0))) if normalise == "arctan" else (lambda c: F.coalesce(c, F.lit(0.0)))
    d = dense.select("query_id", "row_id", F.col("score").alias("d"))
    p = sparse.select("query_id", "row_id", F.col("score").alias("p"))
    both = d.join(p, ["query_id", "row_id"], "full_outer")
    return top_k(both.select("query_id", "row_id", F.round(weights[0] * s(F.col("d")) + weights[1] * s(F.col("p")), 6).alias("score")), k)


def reciprocal_rank_fusion(*routes: DataFrame, k: int, constant: int = 100) -> DataFrame:
    """Routes' hits merged by the sum of 1 / (constant + rank)."""
    both = routes[0].select("query_id", "row_id", "rank")
    for r in routes[1:]:
        both = both.unionByName(r.select("query_id", "row_id", "rank"))
    return top_k(both.groupBy("query_id", "row_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score")), k)


def ivf_search(queries: DataFrame, rows: DataFrame, *, k: int, lists: int | None = None, probes: int | None = None, sample: int = 10_000, metric: str = "ip", block_rows: int = 50_000) -> DataFrame:
    """Approximate search through an inverted-file index: ``query_id, row_id, score, rank``.

    Centroids are fitted by k-means on a bounded sample (``sample`` rows, the smallest hashes); ``lists`` is by default
    the square root of the number of rows, at most a fourth of the sample. Every row is assigned to its nearest centroid, and
    a query meets the rows of its ``probes`` nearest lists only, by default six in ten: on vectors without
    structure, as those of the test tables, half of the lists hold nine in ten of the nearest rows. Large lists are cut into blocks of
    about ``block_rows``.
    """
    spark = rows.sparkSession
    types = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["row_id"]
    score, schema = _scorer(types, metric, k, groups=False, exclude_self=False)
    taken = rows.select("row_id", "vector").orderBy(F.xxhash64("row_id")).limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    n_taken = taken.count()
    if not n_taken:
        return top_k(spark.createDataFrame([], schema), k)
    lists = lists or max(1, int(rows.count() ** 0.5))
    lists = max(1, min(lists, n_taken // 4 or 1))
    probes = min(lists, probes or -(-lists * 6 // 10))
    centres = np.array(KMeans(k=lists, seed=1, maxIter=10).fit(taken).clusterCenters()) if lists > 1 else np.zeros((1, len(taken.first().features)))
    shared = spark.sparkContext.broadcast(centres)  # lists x dimensions, at most a fourth of the sample

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series, n: pd.Series) -> pd.Series:
        d = ((_matrix(vectors)[:, None, :] - shared.value[None]) ** 2).sum(2)
        order = d.argsort(1, kind="stable")
        return pd.Series([o[:m].tolist() for o, m in zip(order, n)])

    q = queries.select("query_id", "vector", F.explode(nearest("vector", F.lit(probes))).alias("cell"))
    r = rows.select("row_id", "vector", F.get(nearest("vector", F.lit(1)), F.lit(0)).alias("cell"))
    left, right = _blocks(q, r, "cell", block_rows, block_rows, 1)
    return top_k(left.groupBy("cell", "qb", "rb").cogroup(right.groupBy("cell", "qb", "rb")).applyInPandas(score, schema), k)
