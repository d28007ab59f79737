"""Clustering evidence: fits, internal indices, agreement, bootstrap stability, consensus, verdict."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.compare import minmax
from tidemark.operators.ordered import exact_quantiles, with_single_row

L = F.lit
TINY_SHARE = 0.10


def robust_scale(rows: DataFrame, space: list[str]) -> DataFrame:
    """Median / IQR scaling of complete rows into s_ columns."""
    full = rows.dropna(subset=space)
    long = full.select(F.inline(F.array(*[F.struct(L(m).alias("m"), F.col(m).alias("x")) for m in space])))
    q = exact_quantiles(long, ["m"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    stats = q.agg(*[F.max(F.when(F.col("m") == m, F.col(k))).alias(f"_{m}_{k}") for m in space for k in ("q1", "q2", "q3")])
    df = with_single_row(full, stats)
    scale = lambda m: F.when(F.col(f"_{m}_q3") == F.col(f"_{m}_q1"), L(1.0)).otherwise(F.col(f"_{m}_q3") - F.col(f"_{m}_q1"))
    return df.withColumns({f"s_{m}": (F.col(m) - F.col(f"_{m}_q2")) / scale(m) for m in space}).drop(*[f"_{m}_{k}" for m in space for k in ("q1", "q2", "q3")])


def va_quadrant(rows: DataFrame) -> DataFrame:
    """High / low valence and arousal by the table medians; missing values count as the median."""
    long = rows.select(F.inline(F.array(*[F.struct(L(m).alias("m"), F.col(m).alias("x")) for m in ("valence", "arousal")])))
    q = exact_quantiles(long, ["m"], "x", {"q": 0.5}).agg(*[F.max(F.when(F.col("m") == m, F.col("q"))).alias(f"_{m}") for m in ("valence", "arousal")])
    df = with_single_row(rows, q)
    side = lambda m: F.when(F.coalesce(F.col(m), F.col(f"_{m}")) >= F.col(f"_{m}"), "high").otherwise("low")
    return df.withColumn("va_quadrant", F.concat(side("valence"), L("_valence_"), side("arousal"), L("_arousal"))).drop("_valence", "_arousal")


def internal_indices(rows: DataFrame, space: list[str], cluster: str, keys: list[str]) -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz and squared-distance silhouette from cluster sums.

    The silhouette uses squared Euclidean distances, whose cluster means follow from sums, so no
    pairs of rows are formed. (Plain distances would need every pair.)
    """
    sq = reduce(lambda a, b: a + b, [F.col(s) * F.col(s) for s in space])
    per = rows.groupBy(*keys, cluster).agg(F.count(L(1)).alias("n"), F.avg(sq).alias("m2"), *[F.avg(s).alias(f"c_{s}") for s in space])
    cents = F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("k"), "n", "m2", F.array(*[f"c_{s}" for s in space]).alias("c"))))
    packed = per.groupBy(*keys).agg(cents.alias("cl"), F.sum("n").alias("total"), *[(F.sum(F.col("n") * F.col(f"c_{s}")) / F.sum("n")).alias(f"g_{s}") for s in space])
    x = F.array(*space)
    gap2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), L(0.0), lambda acc, v: acc + v)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), L(0.0), lambda acc, v: acc + v)
    df = rows.join(packed, keys) if keys else with_single_row(rows, packed)
    df = df.withColumn("_x2", sq).withColumn("_own", F.filter("cl", lambda k: k["k"] == F.col(cluster))[0])
    mean_to = lambda k: F.col("_x2") + k["m2"] - L(2.0) * dot(x, k["c"])
    own = F.col("_own")
    df = df.withColumns({
        "_a": F.when(own["n"] > 1, mean_to(own) * own["n"] / (own["n"] - L(1))),
        "_b": F.array_min(F.transform(F.filter("cl", lambda k: k["k"] != F.col(cluster)), mean_to)),
        "_d": gap2(x, own["c"]),
    })
    sil = F.when(F.col("_a").isNull(), L(0.0)).otherwise(F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), L(0.0)))
    rowwise = df.groupBy(*keys, cluster).agg(F.sum(sil).alias("sil"), F.sum("_d").alias("within"), F.avg(F.sqrt("_d")).alias("scatter"), F.count(L(1)).alias("n"),
                                             F.first("_own").alias("own"))
    grand = packed.select(*keys, "total", F.array(*[f"g_{s}" for s in space]).alias("g"))
    w = rowwise.join(grand, keys) if keys else with_single_row(rowwise, grand)
    w = w.withColumn("between", F.col("n") * gap2(F.col("own.c"), F.col("g")))
    pack = F.collect_list(F.struct("scatter", F.col("own.c").alias("c"), F.col(cluster).alias("k")))
    out = w.groupBy(*keys).agg(F.sum("sil").alias("sil"), F.sum("within").alias("within"), F.sum("between").alias("between"), F.max("total").alias("total"),
                               F.count(L(1)).alias("k"), pack.alias("p"))
    worst = F.transform("p", lambda i: F.array_max(F.transform(F.filter("p", lambda j: j["k"] != i["k"]), lambda j: F.try_divide(i["scatter"] + j["scatter"], F.sqrt(gap2(i["c"], j["c"]))))))
    return out.select(
        *keys, "k", F.col("total").alias("n_samples"), (F.col("sil") / F.col("total")).alias("silhouette_squared"),
        (F.aggregate(worst, L(0.0), lambda a, v: a + v) / F.col("k")).alias("davies_bouldin_index"),
        F.try_divide(F.col("between") / (F.col("k") - L(1)), F.col("within") / (F.col("total") - F.col("k"))).alias("calinski_harabasz_score"))


def agreement(rows: DataFrame, truth: str, cluster: str, keys: list[str]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information from the contingency counts."""
    cells = rows.groupBy(*keys, truth, cluster).agg(F.count(L(1)).alias("n"))
    pairs = lambda c: c * (c - L(1)) / L(2.0)
    plogp = lambda c: F.sum(c * F.ln(c))
    a = cells.groupBy(*keys, truth).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("pa"), plogp(F.col("n")).alias("la"), F.count(L(1)).alias("ka"), F.sum("n").alias("total"))
    b = cells.groupBy(*keys, cluster).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("pb"), plogp(F.col("n")).alias("lb"))
    c = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("pc"), plogp(F.col("n")).alias("lc"))
    df = a.join(b, keys).join(c, keys)
    n = F.col("total").cast("double")
    expected = F.col("pa") * F.col("pb") / (n * (n - 1) / L(2.0))
    ari = F.coalesce(F.try_divide(F.col("pc") - expected, L(0.5) * (F.col("pa") + F.col("pb")) - expected), L(1.0))
    ha, hb = F.ln(n) - F.col("la") / n, F.ln(n) - F.col("lb") / n
    mutual = F.ln(n) + (F.col("lc") - F.col("la") - F.col("lb")) / n
    nmi = F.coalesce(F.try_divide(mutual, L(0.5) * (ha + hb)), L(1.0))
    return df.select(*keys, F.when(F.col("ka") >= 2, ari).alias("ari"), F.when(F.col("ka") >= 2, nmi).alias("nmi"))


def cluster_shares(rows: DataFrame, cluster: str, keys: list[str]) -> DataFrame:
    """Smallest share, tiny flag and coefficient of variation of the cluster shares."""
    per = rows.groupBy(*keys, cluster).agg(F.count(L(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.count(L(1)).alias("clusters"), (F.min("n") / F.sum("n")).alias("smallest_share"),
        (F.min("n") / F.sum("n") < TINY_SHARE).alias("tiny_cluster"), (F.stddev_pop("n") / F.avg("n")).alias("size_cv"))


# --- fits ---------------------------------------------------------------------------------------

def vectors(scaled: DataFrame, space: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"s_{m}" for m in space], outputCol="features").transform(scaled)


def fit(data: DataFrame, algorithm: str, k: int, seed: int = 42, restarts: int | None = None):
    """Best of several restarts: lowest cost for k-means, highest likelihood for the mixture."""
    best = None
    for i in range(restarts or (20 if algorithm == "kmeans" else 4)):
        if algorithm == "kmeans":
            model = KMeans(k=k, seed=seed + i).fit(data)
            merit = -model.summary.trainingCost
        else:
            model = GaussianMixture(k=k, seed=seed + i).fit(data)
            merit = model.summary.logLikelihood
        if best is None or merit > best[1]:
            best = (model, merit)
    return best


def centers(model) -> list[list[float]]:
    """Cluster centres: k small vectors held by the fitted model."""
    if hasattr(model, "clusterCenters"):
        return [list(map(float, c)) for c in model.clusterCenters()]
    return [list(map(float, g.mean)) for g in model.gaussians]


def information_criteria(log_likelihood: float, k: int, dims: int, n: int) -> tuple[float, float]:
    """AIC and BIC of a full-covariance mixture."""
    import math

    free = k - 1 + k * dims + k * dims * (dims + 1) // 2
    return 2 * free - 2 * log_likelihood, free * math.log(n) - 2 * log_likelihood


def centroid_drift(first: list[list[float]], second: list[list[float]]) -> float:
    """Mean distance of matched centres over the best of the k! matchings (k <= 5)."""
    dist = [[sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 for b in second] for a in first]
    return min(sum(dist[i][j] for i, j in enumerate(p)) for p in permutations(range(len(first)))) / len(first)


def bootstrap_sample(data: DataFrame, group: str, iteration: int, seed: int = 42) -> DataFrame:
    """Groups drawn with replacement: each group enters a Poisson(1) number of times by a hash of
    (group, iteration), so no list of groups is gathered and a retry draws the same sample."""
    u = (F.abs(F.xxhash64(F.col(group), L(iteration), L(seed))) % L(1_000_000)) / L(1_000_000.0)
    cuts = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)
    times = reduce(lambda acc, c: acc + (u >= c).cast("int"), cuts, L(0))
    return data.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(L(1), times)).otherwise(F.array().cast("array<int>")))).drop("_copy")


def candidates(rows: DataFrame, space: list[str], *, ks=(2, 3, 4, 5), iterations: int = 24, restarts: int | None = None,
               group: str = "source_record_id", algorithms=("kmeans", "gmm"), seed: int = 42) -> DataFrame:
    """One row per algorithm and k with internal, agreement and bootstrap metrics.

    The fits loop on the driver over a staged vector table; all passes over rows run on Spark.
    """
    spark = rows.sparkSession
    scaled = va_quadrant(robust_scale(rows, space)).withColumn("_row", F.monotonically_increasing_id())
    data = vectors(scaled, space).persist()
    n = data.count()
    records = []
    if n < max(40, 10 * min(ks)):
        data.unpersist()
        return spark.createDataFrame([], _CANDIDATE_SCHEMA)
    scaled_names = [f"s_{m}" for m in space]
    for algorithm in algorithms:
        for k in ks:
            model, merit = fit(data, algorithm, k, seed, restarts)
            assigned = model.transform(data).withColumn("_one", L(0))
            internal = internal_indices(assigned, scaled_names, "prediction", ["_one"]).first()
            if internal is None or internal["k"] < 2:
                continue
            by_label = agreement(assigned, "label", "prediction", ["_one"]).first()
            by_va = agreement(assigned, "va_quadrant", "prediction", ["_one"]).first()
            shares = cluster_shares(assigned, "prediction", ["_one"]).first()
            boots = []
            for it in range(iterations):
                other, _ = fit(bootstrap_sample(data, group, it, seed), algorithm, k, seed + it, 1)
                both = other.transform(assigned.withColumnRenamed("prediction", "reference").drop("probability")).withColumn("_one", L(0))
                ari = agreement(both, "reference", "prediction", ["_one"]).first()["ari"]
                share = cluster_shares(both, "prediction", ["_one"]).first()
                boots.append((ari, centroid_drift(centers(model), centers(other)), float(share["clusters"] < k or share["tiny_cluster"]), share["size_cv"]))
            mean = lambda i: sum(b[i] for b in boots) / len(boots) if boots else None
            aic, bic = information_criteria(merit, k, len(space), n) if algorithm == "gmm" else (None, None)
            records.append((algorithm, k, n, internal["silhouette_squared"], internal["davies_bouldin_index"], internal["calinski_harabasz_score"],
                            by_label["ari"], by_label["nmi"], by_va["ari"], by_va["nmi"], mean(0), mean(1), mean(2), mean(3), shares["size_cv"], aic, bic))
    data.unpersist()
    return spark.createDataFrame(records, _CANDIDATE_SCHEMA)


_CANDIDATE_SCHEMA = (
    "algorithm string, k int, n_samples long, silhouette_score double, davies_bouldin_index double, calinski_harabasz_score double, label_ari double, label_nmi double, "
    "va_ari double, va_nmi double, bootstrap_mean_ari double, centroid_drift_mean double, tiny_cluster_rate double, mean_cluster_size_cv double, "
    "full_sample_cluster_size_cv double, aic double, bic double"
)


def principal_components(scaled: DataFrame, space: list[str], k: int = 2) -> DataFrame:
    """First principal components of the scaled space."""
    data = vectors(scaled, space)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(data)
    out = model.transform(data).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({f"pc{i + 1}": F.col("_pc")[i] for i in range(k)}).drop("_pc", "features")


# --- candidate scores, consensus, verdict ---------------------------------------------------------

def score_candidates(table: DataFrame, groups: list[str]) -> DataFrame:
    """Internal and alignment score, stable flag and best candidate per algorithm.

    Missing metrics count as 0 after scaling, so a missing inverse metric counts as best.
    """
    w = Window.partitionBy(*groups, "algorithm")
    m = lambda c: minmax(F.col(c), w, missing=0.0)
    inverse = lambda c: L(1.0) - m(c)
    df = table.withColumns({
        "internal_score": L(0.30) * m("silhouette_score") + L(0.20) * inverse("davies_bouldin_index") + L(0.20) * m("calinski_harabasz_score")
        + L(0.20) * m("bootstrap_mean_ari") + L(0.10) * inverse("tiny_cluster_rate"),
        "alignment_score": L(0.35) * m("label_ari") + L(0.35) * m("label_nmi") + L(0.15) * m("va_ari") + L(0.15) * m("va_nmi"),
        "stable_support": (F.coalesce("bootstrap_mean_ari", L(-1.0)) >= 0.55) & (F.coalesce("tiny_cluster_rate", L(1.0)) <= 0.35)
        & (F.coalesce("silhouette_score", L(-1.0)) > 0),
    })
    order = w.orderBy(F.desc("stable_support"), F.desc("internal_score"), F.desc("alignment_score"), "k")
    return df.withColumn("best_for_algorithm", F.row_number().over(order) == 1)


def consensus(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Supported k over the stable candidates (all when none is stable), with its strength."""
    w = Window.partitionBy(*groups)
    src = scored.withColumn("_any", F.max(F.col("stable_support").cast("int")).over(w)).where((F.col("_any") == 0) | F.col("stable_support"))
    by_k = src.groupBy(*groups, "k").agg(
        F.sum(F.col("stable_support").cast("int")).alias("stable_algorithm_count"), F.avg("internal_score").alias("mean_internal_score"),
        F.avg("alignment_score").alias("mean_alignment_score"), F.avg("bootstrap_mean_ari").alias("consensus_mean_bootstrap_ari"),
        F.avg("label_ari").alias("label_alignment_ari"), F.avg("label_nmi").alias("label_alignment_nmi"), F.avg("va_ari").alias("va_alignment_ari"), F.avg("va_nmi").alias("va_alignment_nmi"))
    order = w.orderBy(F.desc("stable_algorithm_count"), F.desc("mean_internal_score"), F.desc("mean_alignment_score"), "k")
    top = by_k.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn").withColumnRenamed("k", "consensus_supported_k")
    count, ari = F.col("stable_algorithm_count"), F.col("consensus_mean_bootstrap_ari")
    strength = F.when((count >= 2) & (ari >= 0.70), "strong").when((count >= 1) & (ari >= 0.55), "moderate").otherwise("weak")
    best = scored.where("best_for_algorithm").groupBy(*groups).agg(
        F.max(F.when(F.col("algorithm") == "kmeans", F.col("k"))).alias("best_k_kmeans"), F.max(F.when(F.col("algorithm") == "gmm", F.col("k"))).alias("best_k_gmm"))
    return top.withColumn("consensus_support_strength", strength).join(best, groups, "left")


def verdict(table: DataFrame) -> DataFrame:
    """Confident and likely state counts with the verdict text."""
    size, k = F.coalesce("label_set_size", L(0)), F.coalesce("consensus_supported_k", L(0))
    strength, ari = F.coalesce("consensus_support_strength", L("weak")), F.col("consensus_mean_bootstrap_ari")
    aligned = (F.coalesce("label_alignment_ari", L(0.0)) >= 0.10) | (F.coalesce("label_alignment_nmi", L(0.0)) >= 0.10)
    df = table.withColumns({
        "_two": (size >= 2) | ((k >= 2) & aligned),
        "_four": (k >= 4) & (size >= 4) & (strength == "strong") & (F.coalesce(ari, L(0.0)) >= 0.70),
        "_three": (k >= 3) & (size >= 3) & strength.isin("strong", "moderate"),
        "_hint": (size >= 3) | (k >= 3),
    })
    two, three, four = F.col("_two"), F.col("_three"), F.col("_four")
    base_likely = F.when(two | (k >= 2), 2).otherwise(1)
    likely = F.when(four, k).when(three, 3).otherwise(base_likely)
    return df.withColumns({
        "confident_state_count": F.when(four, k).when(two, 2).otherwise(1).cast("int"),
        "likely_state_count": likely.cast("int"),
        "no_evidence_for_above": F.when(four, k + 1).when(three, 4).when(base_likely >= 2, 3).otherwise(2).cast("int"),
        "capacity_verdict": F.when(four, F.concat(L("evidence for "), k.cast("string"), L(" states"))).when(three, "likely 3 states")
        .when(two & F.col("_hint"), "confidently 2 states, limited evidence for 3rd mode").when(two, "confidently 2 states")
        .when(base_likely >= 2, "tentative evidence for 2 states").otherwise("weak evidence even for 2 states"),
    }).drop("_two", "_three", "_four", "_hint")


def dynamic_notes(capacity: DataFrame) -> DataFrame:
    """Compares the likely counts of dynamic rows with their static counterpart."""
    keys = ["dataset", "mode", "version"]
    static = capacity.where("regime = 'static'").select(*keys, F.col("likely_state_count").alias("_static"))
    df = capacity.join(static, keys, "left")
    note: Column = (
        F.when(F.col("likely_state_count") < F.col("_static"), "dynamics smooths the states").when(F.col("likely_state_count") > F.col("_static"), "dynamics adds a supported state")
        .when(F.col("_static").isNotNull(), "dynamics keeps the number of states")
    )
    return df.withColumn("dynamic_vs_static_note", F.when(F.col("regime") == "dynamic", note)).drop("_static")


