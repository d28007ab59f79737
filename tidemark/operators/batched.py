"""Clusterings of many groups, sizes, restarts and bootstrap draws at once.

A pass over the rows moves every candidate one step: a task adds up what each candidate needs of its rows (Lloyd: counts
and sums; EM: responsibilities and second moments), the sums are added by candidate, and a few numbers a candidate
reach the driver. The number of passes is bounded by ``PASSES`` and does not depend on the number of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clusters import agreement, centroid_drift, cluster_shares, information_criteria, internal_indices
from tidemark.operators.ordered import exact_quantiles, null_safe_join, with_position

PASSES, RIDGE = 40, 1e-6
#: A candidate rests when its centres move less than the first in a step, or its mean log likelihood gains less than the second.
REST = (1e-4, 1e-3)
#: Rows of a group from which first centres are drawn (those of least hash); the fits themselves use all rows.
SEEDING = 512
#: Rows of a file that the passes read, and of a block in it: the scores of a stack for a block stay in a core's cache.
PART_ROWS, BLOCK_ROWS, STACK_CLUSTERS = 65_536, 2_048, 32


@dataclass(frozen=True)
class Model:
    """A candidate: its group, algorithm and size, its draw (0: the rows as they are), and its parameters."""

    group: int
    algorithm: str
    k: int
    draw: int
    unit: str
    means: np.ndarray
    covs: np.ndarray | None = None
    shares: np.ndarray | None = None
    merit: float = -math.inf

    def weights(self) -> np.ndarray:
        """Term by cluster: with ``terms`` of a row they give minus the squared distance, or log density times share."""
        d = self.means.shape[1]
        out = np.empty((1 + d + d * d, self.k))
        for c, mean in enumerate(self.means):
            if self.algorithm == "kmeans":
                inverse, base = 2 * np.eye(d), 0.0
            else:
                inverse = np.linalg.inv(self.covs[c])
                base = math.log(max(self.shares[c], 1e-300)) - 0.5 * np.linalg.slogdet(self.covs[c])[1] - 0.5 * d * math.log(2 * math.pi)
            out[:, c] = np.concatenate([[base - 0.5 * mean @ inverse @ mean], inverse @ mean, -0.5 * inverse.ravel()])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return terms(x) @ self.weights()

    def sums(self, z: np.ndarray, w: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        """What a step needs of rows with terms ``z``: the merit, and per cluster weight, sums, and (mixture) second moments."""
        s = z @ self.weights() if s is None else s
        if self.algorithm == "kmeans":
            part = np.zeros_like(s)
            part[np.arange(len(s)), s.argmax(1)] = w
            return np.concatenate([[s.max(1) @ w], (part.T @ z[:, : 1 + self.means.shape[1]]).ravel()])
        top = s.max(1)
        part = np.exp(s - top[:, None])
        each = part.sum(1)
        return np.concatenate([[(top + np.log(each)) @ w], ((part * (w / each)[:, None]).T @ z).ravel()])

    def step(self, sums: np.ndarray) -> tuple[Model, bool]:
        """The candidate after a step, and whether it still moves. An empty cluster keeps its centre."""
        k, d = self.means.shape
        merit, table = float(sums[0]), sums[1:].reshape(k, -1)
        n = table[:, 0]
        held = np.maximum(n, 1e-12)[:, None]
        means = np.where(n[:, None] > 1e-9, table[:, 1 : 1 + d] / held, self.means)
        if self.algorithm == "kmeans":
            return replace(self, means=means, merit=merit), float(((means - self.means) ** 2).sum()) > REST[0] ** 2
        second = table[:, 1 + d :].reshape(k, d, d) / held[:, :, None]
        covs = second - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
        covs = np.where((n > 1e-9)[:, None, None], (covs + covs.transpose(0, 2, 1)) / 2, self.covs)
        covs = np.array([c if np.linalg.eigvalsh(c)[0] > 0 else c + (RIDGE - np.linalg.eigvalsh(c)[0]) * np.eye(d) for c in covs])
        return replace(self, means=means, covs=covs, shares=n / n.sum(), merit=merit), abs(merit - self.merit) > REST[1] * max(n.sum(), 1.0)


@dataclass(frozen=True)
class Sizes:
    """Rows and records of a group."""

    row_n: int
    record_n: int


def terms(x: np.ndarray) -> np.ndarray:
    """One, the values, and their products two by two: all candidates' scores are one product with these."""
    return np.hstack([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])


def draw_counts(places: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    """How often each of ``places`` (ascending, of 0..n-1) comes up when n are drawn with replacement; all n places sum to n.

    The draws are divided between the halves of a range by a binomial number that depends on the range, the draw and the
    seed only, down to the single place, so every task gets the same counts without a list of all places.
    """
    out = np.zeros(len(places), np.int64)
    todo = [(0, n, n, 0, len(places))]
    while todo:
        low, high, count, first, last = todo.pop()
        if count == 0 or first == last:
            continue
        if high - low == 1:
            out[first:last] = count
            continue
        middle = (low + high) // 2
        left = int(np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, draw, low, high]))).binomial(count, (middle - low) / (high - low)))
        cut = first + int(np.searchsorted(places[first:last], middle))
        todo += [(low, middle, left, first, cut), (middle, high, count - left, cut, last)]
    return out


def drawn(places: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """``places`` (group, <unit>_place, <unit>_n and others) with <unit>_drawn: how often each comes up in draws 1 to ``draws``.

    Counted once, as every step of every candidate reads them.
    """
    place, n = places.columns.index(f"{unit}_place"), places.columns.index(f"{unit}_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = np.asarray(batch.column("group")), np.asarray(batch.column(place))
            counts = np.zeros((batch.num_rows, draws), np.int32)
            for group in np.unique(own):
                rows = np.flatnonzero(own == group)
                total = int(np.asarray(batch.column(n))[rows[0]])
                some, inverse = np.unique(at[rows], return_inverse=True)
                for draw in range(draws):
                    counts[rows, draw] = draw_counts(some, total, draw + 1, seed)[inverse]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * draws, pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, f"{unit}_drawn"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields)
    return places.mapInArrow(run, f"{fields}, {unit}_drawn array<int>")


def packed(places: DataFrame, unit: str) -> DataFrame:
    """``places`` with <unit>_drawn as one byte a draw. A count above 255 (less than one in 10^500 draws) is an error."""
    at = places.columns.index(f"{unit}_drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            counts = np.asarray(lists.flatten().cast(pa.uint8())).reshape(batch.num_rows, -1)
            columns = list(batch.columns)
            columns[at] = pa.array([c.tobytes() for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return places.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if f.name == f'{unit}_drawn' else f.dataType.simpleString()}" for f in places.schema.fields))


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (group, x, record_drawn, row_drawn) of a group as blocks: x row by row, and the counts draw by draw (none: empty)."""

    def block(group: int, x: np.ndarray, *drawn: list[bytes]) -> tuple:
        return group, x.tobytes(), *[np.frombuffer(b"".join(d), np.uint8).reshape(len(x), -1).T.tobytes() for d in drawn]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def full(least: int) -> pa.RecordBatch:
            out = []
            for group, parts in held.items():
                if parts and (n := sum(len(p[0]) for p in parts)) >= least:
                    x, record, row = np.concatenate([p[0] for p in parts]), *([v for p in parts for v in p[i]] for i in (1, 2))
                    cut = n if least == 1 else n - n % BLOCK_ROWS
                    out += [block(group, *(v[i : min(i + BLOCK_ROWS, cut)] for v in (x, record, row))) for i in range(0, cut, BLOCK_ROWS)]
                    held[group] = [(x[cut:], record[cut:], row[cut:])] if cut < n else []
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 3))], ["group", "x", "record_drawn", "row_drawn"])

        for batch in batches:
            own = np.asarray(batch.column("group"))
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, dims)
            for group in np.unique(own):
                at = own == group
                held.setdefault(int(group), []).append((x[at], *[batch.column(n).filter(pa.array(at)).to_pylist() for n in ("record_drawn", "row_drawn")]))
            yield full(BLOCK_ROWS)
        yield full(1)

    return rows.select("group", "x", "record_drawn", "row_drawn").mapInArrow(run, "group int, x binary, record_drawn binary, row_drawn binary")


#: Log of a share that is nothing beside one; far lower ones take the exponential four times as long.
LEAST = -200.0


def short_terms(x: np.ndarray) -> np.ndarray:
    """``terms`` with each product of two values once."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


class Stack:
    """Candidates of one algorithm whose rows weigh alike, so that one product scores all their clusters: a line a cluster.

    k-means does without the products, which add the same to all clusters of a row.
    """

    def __init__(self, models: list[Model]):
        self.models, self.kmeans, self.d = models, models[0].algorithm == "kmeans", models[0].means.shape[1]
        d, tables = self.d, [m.weights().T for m in models]
        i, j = np.triu_indices(d)
        twice = np.where(i == j, 0.5, 1.0)
        short = [t[:, : 1 + d] if self.kmeans else np.hstack([t[:, : 1 + d], (t[:, 1 + d + i * d + j] + t[:, 1 + d + j * d + i]) * twice]) for t in tables]
        self.table, ends = np.vstack(short), np.cumsum([m.k for m in models])
        self.spans = [slice(e - m.k, e) for m, e in zip(models, ends)]
        sizes = [m.k for m in models]
        self.runs = [(k, [c for c in range(len(sizes)) if sizes[c] == k]) for k in dict.fromkeys(sizes)]  # neighbours of one size, worked on together

    def scores(self, z: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores, a line a cluster, and views of them as (candidate, cluster, row)."""
        s = self.table @ z[:, : self.table.shape[1]].T
        return s, [s[self.spans[at[0]].start : self.spans[at[-1]].stop].reshape(len(at), k, -1) for k, at in self.runs]

    def nearest(self, z: np.ndarray, top: list[np.ndarray] | None = None) -> np.ndarray:
        """One where a cluster is the best of its candidate for a row (the first of equal ones), else zero; ``top`` takes the best scores."""
        s, views = self.scores(z)
        for own in views:
            best = own.max(1)
            hit = own == best[:, None]
            if np.count_nonzero(hit) != best.size:
                hit &= np.cumsum(hit, 1) == 1
            own[:] = hit
            if top is not None:
                top.append(best)
        return s

    def sums(self, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The merits of the candidates, then per cluster the sums over rows with ``short_terms`` z (k-means: less the products)."""
        if self.kmeans:
            few, top = z[:, : 1 + self.d], []
            s = self.nearest(z, top)
            merits = np.concatenate([t @ w for t in top]) - (few[:, 1:] ** 2).sum(1) @ w
            return np.concatenate([merits, (s @ (few * w[:, None])).ravel()])
        (s, views), merits = self.scores(z), []
        tops = [own.max(1) for own in views]
        for own, top in zip(views, tops):
            own -= top[:, None]
        np.exp(np.maximum(s, LEAST, out=s), out=s)
        for own, top in zip(views, tops):
            each = own.sum(1)
            merits.append((top + np.log(each)) @ w)
            own *= (w / each)[:, None]
        return np.concatenate([*merits, (s @ z).ravel()])

    def stepped(self, sums: np.ndarray) -> Iterator[tuple[Model, bool]]:
        """``Model.step`` of each candidate."""
        d, merits = self.d, sums[: len(self.models)]
        table = sums[len(self.models) :].reshape(len(self.table), -1)
        if not self.kmeans:
            i, j = np.triu_indices(d)
            products = np.empty((len(table), d, d))
            products[:, i, j] = products[:, j, i] = table[:, 1 + d :]
            table = np.hstack([table[:, : 1 + d], products.reshape(len(table), -1)])
        for m, span, merit in zip(self.models, self.spans, merits):
            yield m.step(np.concatenate([[merit], table[span].ravel()]))


def _stacked(models: dict[int, Model], by) -> list[tuple[list[int], Stack]]:
    """Candidates with equal ``by`` in stacks of about ``STACK_CLUSTERS`` clusters, with their numbers."""
    out: list[tuple[list[int], Stack]] = []
    for key in dict.fromkeys(map(by, models.values())):
        some: list[int] = []
        for i in sorted((i for i, m in models.items() if by(m) == key), key=lambda i: models[i].k):
            if some and sum(models[n].k for n in some) + models[i].k > STACK_CLUSTERS:
                out.append((some, Stack([models[n] for n in some])))
                some = []
            some.append(i)
        out.append((some, Stack([models[n] for n in some])))
    return out


def _summed(rows: DataFrame, groups: set[int], dims: int, work) -> dict[int, np.ndarray]:
    """Sums by number of ``work(group, z, drawn)``, which yields (number, array): added in the task, then by number.

    ``z`` are the terms of a block, ``drawn`` its counts (draw by row) by unit.
    """
    units = [n for n in ("record_drawn", "row_drawn") if n in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, x, *counts in zip(*[batch.column(n) for n in ("group", "x", *units)]):
                z = short_terms(np.frombuffer(x.as_buffer()).reshape(-1, dims))
                drawn = {n.removesuffix("_drawn"): np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, len(z)) for n, c in zip(units, counts)}
                for number, sums in work(group.as_py(), z, drawn):
                    total[number] = total[number] + sums if number in total else sums
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([s.tobytes() for s in total.values()], pa.binary())], ["number", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b.as_buffer()) for b in table.column("sums")], axis=0)
        return pa.table({"number": table.column("number")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    each = rows.where(F.col("group").isin(*groups)).mapInArrow(run, "number long, sums binary")
    return {r.number: np.frombuffer(r.sums) for r in each.groupBy("number").applyInArrow(add, "number long, sums binary").collect()}


def fit_all(rows: DataFrame, models: list[Model]) -> list[Model]:
    """All candidates moved until they rest or ``PASSES`` passes are done; a resting one costs nothing more. ``rows``: ``blocks``."""
    models, moving = list(models), set(range(len(models)))
    rows = rows if any(m.draw for m in models) else rows.select("group", "x")
    for _ in range(PASSES):
        if not moving:
            break
        stacks = _stacked({i: models[i] for i in sorted(moving)}, lambda m: (m.group, m.unit if m.draw else "", m.draw, m.algorithm))
        work_list: dict[int, dict[tuple, list[tuple[int, Stack]]]] = {}
        for number, (_, stack) in enumerate(stacks):
            m = stack.models[0]
            work_list.setdefault(m.group, {}).setdefault((m.unit, m.draw), []).append((number, stack))

        def work(group, z, drawn, work_list=work_list):
            for (unit, draw), some in work_list[group].items():
                own, w = z, np.ones(len(z))
                if draw:
                    counts = drawn[unit][draw - 1]
                    at = np.flatnonzero(counts)  # rows that are not drawn add nothing
                    own, w = z[at], counts[at].astype(float)
                for number, stack in some:
                    yield number, stack.sums(own, w)

        sums = _summed(rows, set(work_list), models[0].means.shape[1], work)
        for number, (places, stack) in enumerate(stacks):
            for i, (model, more) in zip(places, stack.stepped(sums[number])):
                models[i] = model
                if not more:
                    moving.discard(i)
    return models


def first_model(sample: np.ndarray, group: int, algorithm: str, k: int, draw: int, unit: str, seed: int) -> Model:
    """First parameters from a sample: centres far from one another (k-means++), for a mixture with a few Lloyd steps."""
    rng = np.random.default_rng([seed, group, k, draw])
    centres = [sample[rng.integers(len(sample))]]
    while len(centres) < k:
        far = np.min([((sample - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    model = Model(group, "kmeans", k, draw, unit, np.array(centres))
    if algorithm == "kmeans":
        return model
    for _ in range(5):
        model, _ = model.step(model.sums(terms(sample), np.ones(len(sample))))
    own = model.scores(sample).argmax(1)
    spread = np.cov(sample.T).reshape(sample.shape[1], -1) + RIDGE * np.eye(sample.shape[1])
    covs = [np.cov(sample[own == c].T) + RIDGE * np.eye(sample.shape[1]) if (own == c).sum() > sample.shape[1] else spread for c in range(k)]
    return replace(model, algorithm="gmm", covs=np.array(covs), shares=(np.bincount(own, minlength=k) + 1.0) / (len(own) + k), merit=-math.inf)


def robust_scale(rows: DataFrame, space: list[str], keys: list[str]) -> DataFrame:
    """Median / IQR scaling of the complete rows of each group into s_ columns."""
    full = rows.dropna(subset=space)
    long = full.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in space])))
    q = exact_quantiles(long, [*keys, "m"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    stats = q.groupBy(*keys).agg(*[F.max(F.when(F.col("m") == m, F.col(k))).alias(f"_{m}_{k}") for m in space for k in ("q1", "q2", "q3")])
    width = {m: F.when(F.col(f"_{m}_q3") == F.col(f"_{m}_q1"), F.lit(1.0)).otherwise(F.col(f"_{m}_q3") - F.col(f"_{m}_q1")) for m in space}
    df = null_safe_join(full, stats, keys)
    return df.withColumns({f"s_{m}": (F.col(m) - F.col(f"_{m}_q2")) / width[m] for m in space}).drop(*[f"_{m}_{k}" for m in space for k in ("q1", "q2", "q3")])


def placed(scaled: DataFrame, space: list[str], keys: list[str], record: str, staging, *, ks, draws: int, seed: int) -> tuple[DataFrame, dict[int, tuple], dict[int, Sizes]]:
    """Rows with group (a number), x, a number of their own and the draws of their record; the groups' keys and sizes by number.

    Draws of single rows are there for groups of so few records that some k draws rows, and empty elsewhere.
    """
    spark = scaled.sparkSession
    x = F.array(*[F.col(f"s_{m}").cast("double") for m in space]).alias("x")
    rows = staging(scaled.select(*keys, F.col(record).alias("record"), "label", "va_quadrant", x).withColumn("_row", F.monotonically_increasing_id()), "cluster-rows")
    found = rows.groupBy(*keys).count().orderBy(*keys).collect()  # one row a group
    names, row_n = {i: tuple(r)[:-1] for i, r in enumerate(found)}, {i: r["count"] for i, r in enumerate(found)}
    numbers = spark.createDataFrame([(i, row_n[i], *n) for i, n in names.items()], f"group int, row_n long, {', '.join(f'{k} string' for k in keys)}")
    rows = null_safe_join(rows, F.broadcast(numbers), keys).select("group", "row_n", "record", "label", "va_quadrant", "x", "_row")
    bucket = F.shiftright(F.xxhash64("record"), 44)
    records = with_position(rows.select("group", "record").distinct().withColumn("_h", F.xxhash64("record")), ["group"], ["_h", "record"], bucket, "record_place").drop("_h")
    records = staging(records, "cluster-records")
    record_n = {r.group: r.n for r in records.groupBy("group").agg((F.max("record_place") + 1).alias("n")).collect()}  # one row a group
    counts = spark.createDataFrame(list(record_n.items()), "group int, record_n long")
    cores = spark.sparkContext.defaultParallelism
    records = records.join(F.broadcast(counts), "group").repartitionByRange(cores, "group", "record_place").sortWithinPartitions("group", "record_place")
    records = staging(packed(drawn(records, "record", draws, seed).select("group", "record", "record_drawn"), "record"), "cluster-draws")
    parts = max(cores, sum(row_n.values()) // PART_ROWS + 1)  # every pass reads these files, so they are of one size
    few = [g for g, n in record_n.items() if n < max(2 * max(ks), 8)]
    small = F.col("group").isin(*few) if few else F.lit(False)
    out = null_safe_join(rows.where(~small).withColumn("row_drawn", F.lit(b"")), records, ["group", "record"]).drop("record").repartition(parts)
    if few:
        own = with_position(null_safe_join(rows.where(small), records, ["group", "record"]).drop("record"), ["group"], ["_row"], F.shiftright("_row", 16), "row_place")
        own = own.repartitionByRange(parts, "group", "row_place").sortWithinPartitions("group", "row_place")
        out = out.unionByName(packed(drawn(own, "row", draws, seed), "row").drop("row_place"))
    return staging(out.drop("row_n"), "cluster-places"), names, {g: Sizes(row_n[g], record_n[g]) for g in names}


def candidates(scaled: DataFrame, space: list[str], keys: list[str], staging, *, ks=(2, 3, 4, 5), iterations: int = 24, restarts=(("kmeans", 20), ("gmm", 4)),
               record: str = "source_record_id", seed: int = 42) -> DataFrame:
    """One row per group of ``keys``, algorithm and k, with internal, agreement and bootstrap metrics.

    ``scaled`` has s_ columns without nulls, label, va_quadrant and ``record``. A draw takes as many records as there are,
    with replacement, exactly; where a group has fewer than max(2 k, 8) records, rows are drawn. Groups of fewer than
    max(40, 10 k) rows are not clustered at that k. ``staging`` writes a table that several passes read.
    """
    rows, names, sizes = placed(scaled, space, keys, record, staging, ks=ks, draws=iterations, seed=seed)
    dealt = staging(blocks(rows, len(space)), "cluster-blocks")
    first = Window.partitionBy("group").orderBy(F.xxhash64("_row"), "_row")
    sampled = rows.withColumn("_no", F.row_number().over(first)).where(F.col("_no") <= SEEDING).select("group", "x").collect()
    samples = {g: np.array([r.x for r in sampled if r.group == g], float) for g in names}
    tasks = [(g, a, k, n) for g in names for a, n in restarts for k in ks if sizes[g].row_n >= max(40, 10 * k)]
    fitted = fit_all(dealt, [first_model(samples[g], g, a, k, 0, "row", seed + i) for g, a, k, n in tasks for i in range(n)])
    best: dict[tuple, Model] = {}
    for m in fitted:
        key = (m.group, m.algorithm, m.k)
        if key not in best or m.merit > best[key].merit:
            best[key] = m
    starts = []
    for (g, a, k), m in best.items():
        unit = "record" if sizes[g].record_n >= max(2 * k, 8) else "row"
        for draw in range(1, iterations + 1):
            starts += [replace(m, draw=draw, unit=unit, merit=-math.inf), first_model(samples[g], g, a, k, draw, unit, seed + draw)]
    drawn: dict[tuple, Model] = {}
    for m in fit_all(dealt, starts):
        key = (m.group, m.algorithm, m.k, m.draw)
        if key not in drawn or m.merit > drawn[key].merit:
            drawn[key] = m
    boots = _bootstrap(dealt, best, drawn)
    return _metrics(rows, space, keys, names, sizes, best, boots)


def _bootstrap(rows: DataFrame, best: dict, drawn: dict) -> dict[tuple, list[tuple]]:
    """Per group, algorithm and k the (ari, drift, tiny, size_cv) of each draw's model over all rows, against the best one."""
    order = list(drawn)
    stacks = _stacked({i: drawn[key] for i, key in enumerate(order)}, lambda m: (m.group, m.algorithm, m.k))
    references = [Stack([best[m.group, m.algorithm, m.k]]) for m in (stack.models[0] for _, stack in stacks)]

    def work(group, z, counts):
        for number, ((_, stack), reference) in enumerate(zip(stacks, references)):
            if stack.models[0].group == group:
                yield number, (stack.nearest(z) @ reference.nearest(z).T).ravel()

    out: dict[tuple, list[tuple]] = {}
    tables: dict[tuple, np.ndarray] = {}
    if drawn:
        sums = _summed(rows.select("group", "x"), {key[0] for key in drawn}, stacks[0][1].d, work)
        for number, (places, stack) in enumerate(stacks):
            for i, span in zip(places, stack.spans):
                tables[order[i]] = sums[number].reshape(len(stack.table), -1)[span].T  # cluster of the best model by cluster of the draw's
    for key, m in drawn.items():
        table = tables[key]
        found = table.sum(0)
        if (found > 0).sum() >= 2:
            share = found[found > 0] / found.sum()
            out.setdefault(key[:3], []).append((rand_index(table), centroid_drift(best[key[:3]].means.tolist(), m.means.tolist()), float(len(share) < m.k or share.min() < 0.10), float(np.std(share) / np.mean(share))))
    return out


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    pairs = lambda c: float((c * (c - 1) / 2).sum())
    a, b, n = pairs(table.sum(1)), pairs(table.sum(0)), float(table.sum())
    expected = a * b / (n * (n - 1) / 2)
    return 1.0 if (a + b) / 2 == expected else (pairs(table) - expected) / ((a + b) / 2 - expected)


def _metrics(rows: DataFrame, space: list[str], keys: list[str], names: dict, sizes: dict, best: dict, boots: dict) -> DataFrame:
    kinds = "group int, algorithm string, k int, n_samples long, bootstrap_mean_ari double, centroid_drift_mean double, tiny_cluster_rate double, mean_cluster_size_cv double, effective_bootstrap_runs int, aic double, bic double"
    table = []
    for (g, a, k), m in best.items():
        runs = boots.get((g, a, k), [])
        mean = [float(np.mean(c)) for c in zip(*runs)] if runs else [None] * 4
        criteria = information_criteria(m.merit, k, len(space), sizes[g].row_n) if a == "gmm" else (None, None)
        table.append((g, a, k, sizes[g].row_n, *mean, len(runs), *criteria))
    spark = rows.sparkSession

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("group"))
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else None
            for (g, a, k), m in best.items():
                at = np.flatnonzero(own == g)
                if len(at):
                    part = batch.take(pa.array(at))
                    found = pa.array(m.scores(x[at]).argmax(1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("group"), pa.array([a] * len(at)), pa.array([k] * len(at), pa.int32()), found, part.column("label"), part.column("va_quadrant"), part.column("x")], ["group", "algorithm", "k", "cluster", "label", "va_quadrant", "x"])

    by = ["group", "algorithm", "k"]
    assigned = rows.select("group", "label", "va_quadrant", "x").mapInArrow(assign, "group int, algorithm string, k int, cluster int, label string, va_quadrant string, x array<double>")
    assigned = assigned.select(*by, "cluster", "label", "va_quadrant", *[F.col("x")[i].alias(f"s_{m}") for i, m in enumerate(space)])
    inner = internal_indices(assigned.withColumnRenamed("k", "size"), [f"s_{m}" for m in space], "cluster", ["group", "algorithm", "size"])
    inner = inner.select("group", "algorithm", F.col("size").alias("k"), F.col("silhouette_squared").alias("silhouette_score"), "davies_bouldin_index", "calinski_harabasz_score")
    out = spark.createDataFrame(table, kinds).join(inner, by, "left")
    for truth, name in (("label", "label"), ("va_quadrant", "va")):
        out = out.join(agreement(assigned, truth, "cluster", by).withColumnsRenamed({"ari": f"{name}_ari", "nmi": f"{name}_nmi"}), by, "left")
    out = out.join(cluster_shares(assigned, "cluster", by).select(*by, F.col("size_cv").alias("full_sample_cluster_size_cv")), by, "left")
    numbers = spark.createDataFrame([(i, *n) for i, n in names.items()], f"group int, {', '.join(f'{k} string' for k in keys)}")
    return out.join(F.broadcast(numbers), "group").drop("group")
