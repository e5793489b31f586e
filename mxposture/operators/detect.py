"""Detectors over endpoint windows: robust baseline, isolation forest, advisories."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.constants import (
    ADVISORY_CODE,
    ADVISORY_DEFAULT,
    FOREST_MIN_TRAIN,
    FOREST_QUANTILE,
    FOREST_REFIT_DAYS,
    FOREST_SAMPLE,
    FOREST_TREES,
    LOCKED_SEED,
    MIN_HISTORY,
    MIN_SUPPORT,
    RARITY_FEATURES,
    RATE_FEATURES,
    ROBUST_FEATURES,
    Z_THRESHOLD,
)
from mxposture.functions.states import lookup
from mxposture.functions.text import joined_digest
from mxposture.operators import windows as W
from mxposture.operators.history import with_past
from mxposture.operators.scale import cumulative_share, exact_quantiles, global_position, join_few
from mxposture.session import checkpointed, settled

VERSION_BUCKETS = ["TLSv10", "TLSv12", "TLSv13", "other"]


class Scorer(Protocol):
    """A detector: windows in, one score row per window out."""

    name: str
    digest: str

    def score(self, windows: DataFrame) -> DataFrame: ...


def digest_of(name: str, params: dict) -> str:
    text = json.dumps({"name": name, "params": params}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def score_with_all(windows: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """Scores of several detectors, one below the other."""
    out = None
    for scorer in scorers:
        scored = scorer.score(windows)
        out = scored if out is None else out.unionByName(scored)
    return out


SCORE_COLUMNS = [
    "endpoint_id",
    "day_index",
    "detector",
    "score",
    "threshold",
    "above_threshold",
    "suppressed",
    "skip_reason",
    "percentile",
    "contributions",
    "reason",
    "model_digest",
]


def prepare(
    windows: DataFrame,
    features: list[str],
    min_support: int,
    min_history: int,
    rates: list[str] | None = None,
) -> DataFrame:
    """Windows with history, robust scores, rarities and skip reason."""
    cols = list(dict.fromkeys([*(rates or []), *features]))
    out = with_past(windows, cols, RARITY_FEATURES)
    out = W.with_robust_scores(out, features)
    out = W.with_rarity(out)
    return out.withColumn("skip_reason", W.skip_reason(min_support, min_history))


def _finish(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """Percentile among the eligible windows of the day, and the fixed output columns."""
    live = F.col("skip_reason").isNull() & ~F.col("suppressed")
    rows = checkpointed(rows)
    ranked = cumulative_share(
        rows.where(live).select("day_index", "score"),
        ["day_index"],
        "score",
        F.floor(F.col("score") * F.lit(64.0)).cast("bigint"),
        "percentile",
    )
    out = rows.join(ranked, ["day_index", "score"], "left")
    out = out.withColumn("percentile", F.when(live, F.col("percentile")))
    return out.withColumns({"detector": F.lit(name), "model_digest": F.lit(digest)}).select(
        *SCORE_COLUMNS
    )


_EMPTY_PARTS = "array<struct<rank:double,feature:string,evidence_field:string,value_num:double,value_str:string,reference_num:double,reference_str:string>>"
_MAINTENANCE = "announced work, not scored [evidence: session.explicit_upgrade.state]"


def _outcome(rows: DataFrame, threshold: Column, reason: Column) -> DataFrame:
    """Apply the exits: maintenance first, then the skip reason."""
    still = F.coalesce(F.col("in_maintenance"), F.lit(False))
    skipped = F.col("skip_reason").isNotNull()
    out = rows.withColumns(
        {
            "suppressed": still,
            "skip_reason": F.when(~still, F.col("skip_reason")),
            "score": F.when(still | skipped, F.lit(0.0)).otherwise(F.col("raw_score")),
            "threshold": threshold,
            "reason": F.when(still, F.lit(_MAINTENANCE))
            .when(skipped, F.concat(F.col("skip_reason"), F.lit(" [evidence: session.uid]")))
            .otherwise(reason),
            "contributions": F.when(
                still | skipped, F.array().cast(_EMPTY_PARTS)
            ).otherwise(F.col("contributions")),
        }
    )
    fired = ~F.col("suppressed") & F.col("skip_reason").isNull() & (F.col("score") >= F.col("threshold"))
    return out.withColumn("above_threshold", fired)


class Baseline:
    """Robust per-endpoint statistics plus peer rarity; everything stays in Columns."""

    name = "baseline"

    def __init__(
        self,
        features: list[str] | None = None,
        min_support: int = MIN_SUPPORT,
        min_history: int = MIN_HISTORY,
        threshold: float = Z_THRESHOLD,
    ) -> None:
        self.features = features or ROBUST_FEATURES
        self.min_support, self.min_history, self.threshold = min_support, min_history, threshold
        self.digest = digest_of(
            self.name,
            {
                "features": self.features,
                "min_support": min_support,
                "min_history": min_history,
                "threshold": threshold,
            },
        )

    def score(self, windows: DataFrame) -> DataFrame:
        rows = prepare(windows, self.features, self.min_support, self.min_history)
        parts = [
            W.numeric_part(n, F.col(f"score_{n}"), F.col(f"med_{n}")) for n in self.features
        ] + [W.rarity_part(n) for n in RARITY_FEATURES]
        rows = rows.withColumn("contributions", W.top_parts(parts))
        best = F.greatest(
            *[F.col(f"score_{n}") for n in self.features],
            *[F.col(f"rarity_{n}") for n in RARITY_FEATURES],
        )
        rows = rows.withColumn("raw_score", best)
        rows = _outcome(rows, F.lit(self.threshold), W.reason_text(F.col("contributions")))
        return _finish(rows, self.name, self.digest)


# --- isolation forest -----------------------------------------------------------------------------


def feature_vector(rates: list[str], features: list[str]) -> Column:
    """Rates, absolute z-scores, rarity and first-seen flags, version one-hots."""
    version = F.when(
        F.col("dominant_tls_version").isin(VERSION_BUCKETS[:3]), F.col("dominant_tls_version")
    ).otherwise("other")
    own_first = (F.col("history_count") > 0) & (F.col("seen_issuer_id") == 0)
    values = [F.col(n) for n in rates]
    values += [F.abs(F.col(f"z_{n}")) for n in features]
    for n in RARITY_FEATURES:
        values += [F.col(f"rarity_{n}"), F.col(f"first_{n}").cast("double")]
    values.append(own_first.cast("double"))
    values += [(version == b).cast("double") for b in VERSION_BUCKETS]
    return F.array(*[v.cast("double") for v in values])


def fit_days(counts: list[tuple[int, int]], days: list[int], min_train: int, every: int) -> dict[int, int]:
    """day -> day of the model used. ``counts`` are trainable rows per day.

    A model is fitted on the first day with enough earlier rows, then again once ``every`` days
    have passed.
    """
    used: dict[int, int] = {}
    last = None
    for day in sorted(days):
        if last is not None and day - last < every:
            used[day] = last
            continue
        if sum(n for d, n in counts if d < day) >= min_train:
            last = day
            used[day] = day
    return used


def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(data: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random isolation tree as flat node lists; a leaf has child -1."""
    limit = max(1, math.ceil(math.log2(max(2, len(data)))))
    nodes: dict[str, list] = {"feature": [], "cut": [], "low": [], "high": [], "size": []}
    todo = [(np.arange(len(data)), 0, -1, "low")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes["size"])
        for key, value in (("feature", -1), ("cut", 0.0), ("low", -1), ("high", -1), ("size", len(rows))):
            nodes[key].append(value)
        if parent >= 0:
            nodes[side][parent] = me
        part = data[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else np.array([])
        if depth >= limit or len(rows) <= 1 or len(spread) == 0:
            continue
        f = int(rng.choice(spread))
        lo, hi = float(part[:, f].min()), float(part[:, f].max())
        cut = float(rng.uniform(lo, hi))
        below = part[:, f] <= cut
        nodes["feature"][me], nodes["cut"][me] = f, cut
        todo.append((rows[~below], depth + 1, me, "high"))
        todo.append((rows[below], depth + 1, me, "low"))
    return nodes


_TREE_SCHEMA = (
    "fit_day bigint, tree int, sample int, feature array<int>, cut array<double>, low array<int>, "
    "high array<int>, size array<int>"
)


def _tree_builder(seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw")
        data = np.array(pdf["scaled"].tolist(), dtype=float)
        fit, tree = int(pdf["fit_day"].iloc[0]), int(pdf["tree"].iloc[0])
        nodes = _grow(data, np.random.default_rng([seed, fit, tree]))
        return pd.DataFrame([{"fit_day": fit, "tree": tree, "sample": len(data), **nodes}])

    return build


def _path_scores(trees: list[dict], data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data))
    norm = 0.0
    for t in trees:
        node = np.zeros(len(data), dtype=int)
        depth = np.zeros(len(data))
        while True:
            f = t["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            go_low = data[rows, f[rows]] <= t["cut"][node[rows]]
            node[rows] = np.where(go_low, t["low"][node[rows]], t["high"][node[rows]])
            depth[rows] += 1
        total += depth + _average_path(t["size"][node])
        norm += float(_average_path([t["sample"]])[0])
    return np.power(2.0, -total / norm) if norm > 0 else np.full(len(data), 0.5)


class Forest:
    """Isolation forest over endpoint windows, trained on the past only and refitted by week.

    Sampling, scaling and thresholds are Spark aggregates; a tree is built from at most
    ``sample`` rows in one group, and scoring streams the windows past a bounded set of trees.
    """

    name = "isolation_forest"
    # Models scored in one pass: 16 fits of 80 trees stay below 20 MB per broadcast.
    FITS_PER_PASS = 16

    def __init__(
        self,
        rates: list[str] | None = None,
        features: list[str] | None = None,
        min_support: int = MIN_SUPPORT,
        min_history: int = MIN_HISTORY,
        trees: int = FOREST_TREES,
        sample: int = FOREST_SAMPLE,
        quantile: float = FOREST_QUANTILE,
        min_train: int = FOREST_MIN_TRAIN,
        every: int = FOREST_REFIT_DAYS,
        seed: int = LOCKED_SEED,
    ) -> None:
        self.rates, self.features = rates or RATE_FEATURES, features or ROBUST_FEATURES
        self.min_support, self.min_history = min_support, min_history
        self.trees, self.sample, self.quantile = trees, sample, quantile
        self.min_train, self.every, self.seed = min_train, every, seed
        params = {k: v for k, v in vars(self).items()}
        self.digest = digest_of(self.name, params)

    def vectors(self, windows: DataFrame) -> DataFrame:
        rows = prepare(windows, self.features, self.min_support, self.min_history, self.rates)
        return rows.withColumn("vector", feature_vector(self.rates, self.features)).withColumn(
            "trainable", ~F.coalesce("in_maintenance", F.lit(False)) & F.col("skip_reason").isNull()
        )

    def schedule(self, rows: DataFrame) -> dict[int, int]:
        """Reads one row per distinct day."""
        per_day = rows.groupBy("day_index").agg(F.count_if("trainable").alias("n")).collect()
        counts = [(r["day_index"], r["n"]) for r in per_day]
        return fit_days(counts, [d for d, _ in counts], self.min_train, self.every)

    def _training(self, rows: DataFrame, fits: list[int]) -> DataFrame:
        wanted = F.filter(F.array(*[F.lit(f).cast("bigint") for f in fits]), lambda f: f > F.col("day_index"))
        return rows.where("trainable").select(
            "endpoint_id", "day_index", "vector", F.explode(wanted).alias("fit_day")
        )

    def _scales(self, training: DataFrame) -> DataFrame:
        """Median and deviation of every feature for every fit, as two arrays per fit."""
        long = training.select("fit_day", F.posexplode("vector").alias("f", "value"))
        key = ["fit_day", "f"]
        med = settled(exact_quantiles(long, key, "value", {"med": 0.5}))
        away = join_few(long, med, key).withColumn("away", F.abs(F.col("value") - F.col("med")))
        mad = exact_quantiles(away, key, "away", {"mad": 0.5})
        both = med.join(mad, key)
        packed = F.array_sort(F.collect_list(F.struct("f", "med", "mad")))
        return both.groupBy("fit_day").agg(packed.alias("p")).select(
            "fit_day",
            F.transform("p", lambda x: x["med"]).alias("med"),
            F.transform("p", lambda x: F.greatest(x["mad"], F.lit(1e-6))).alias("mad"),
        )

    @staticmethod
    def _scaled(rows: DataFrame, scales: DataFrame) -> DataFrame:
        value = F.transform(
            F.arrays_zip("vector", "med", "mad"), lambda x: (x["vector"] - x["med"]) / x["mad"]
        )
        return join_few(rows, scales, ["fit_day"]).withColumn("scaled", value).drop("med", "mad")

    def _grow_trees(self, scaled: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """At most ``sample`` rows per tree by hash order.

        A row is offered to a tree only when its hash is below a bound that leaves a little more
        than the sample size, so the shuffle carries the samples and not 80 copies of the table.
        """
        room = self.sample + 12 * math.sqrt(self.sample)
        share = F.lit(1.0)
        for fit, n in sizes.items():
            share = F.when(F.col("fit_day") == fit, min(1.0, room / max(n, 1))).otherwise(share)
        scaled = scaled.withColumn("_share", share)

        def draw(tree: Column) -> Column:
            h = F.xxhash64("endpoint_id", "day_index", "fit_day", tree, F.lit(self.seed))
            return (F.shiftrightunsigned(h, 11)).cast("double") / F.lit(float(1 << 53))

        offered = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.lit(self.trees - 1)),
                lambda t: F.struct(t.alias("tree"), draw(t).alias("draw")),
            ),
            lambda d: d["draw"] < F.col("_share"),
        )
        rows = scaled.select("fit_day", "scaled", F.explode(offered).alias("d")).select(
            "fit_day", "scaled", "d.*"
        )
        order = Window.partitionBy("fit_day", "tree").orderBy("draw")
        picked = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= self.sample)
        return picked.drop("_n").groupBy("fit_day", "tree").applyInPandas(
            _tree_builder(self.seed), _TREE_SCHEMA
        )

    def _score_pairs(self, pairs: DataFrame, models: DataFrame, fits: list[int]) -> DataFrame:
        """``raw_score`` of (window, fit) pairs; models of a few fits are shipped at a time."""
        spark = pairs.sparkSession
        out = None
        schema = "endpoint_id string, day_index bigint, fit_day bigint, raw_score double"
        for start in range(0, len(fits), self.FITS_PER_PASS):
            batch = fits[start : start + self.FITS_PER_PASS]
            by_fit: dict[int, list] = {}
            # At most FITS_PER_PASS x trees rows of at most 2 x sample nodes each.
            for r in models.where(F.col("fit_day").isin(batch)).collect():
                by_fit.setdefault(r["fit_day"], []).append(
                    {
                        "sample": r["sample"],
                        "feature": np.array(r["feature"], dtype=int),
                        "cut": np.array(r["cut"], dtype=float),
                        "low": np.array(r["low"], dtype=int),
                        "high": np.array(r["high"], dtype=int),
                        "size": np.array(r["size"], dtype=float),
                    }
                )
            shipped = spark.sparkContext.broadcast(by_fit)

            def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    parts = []
                    for fit, group in pdf.groupby("fit_day", sort=False):
                        data = np.array(group["scaled"].tolist(), dtype=float)
                        scored = group[["endpoint_id", "day_index", "fit_day"]].copy()
                        scored["raw_score"] = _path_scores(shipped.value[int(fit)], data)
                        parts.append(scored)
                    if parts:
                        yield pd.concat(parts)

            part = (
                pairs.where(F.col("fit_day").isin(batch))
                .select("endpoint_id", "day_index", "fit_day", "scaled")
                .mapInPandas(run, schema)
            )
            out = part if out is None else out.unionByName(part)
        return out

    def score(self, windows: DataFrame) -> DataFrame:
        rows = settled(self.vectors(windows))
        used = self.schedule(rows)
        fits = sorted(set(used.values()))
        parts = [
            W.numeric_part(n, F.abs(F.col(n) - F.col(f"med_{n}")), F.col(f"med_{n}"))
            for n in self.rates
        ] + [W.rarity_part(n) for n in RARITY_FEATURES]
        rows = rows.withColumn("contributions", W.top_parts(parts))
        keep = ["endpoint_id", "day_index"]
        if not fits:
            scored = rows.withColumns(
                {"raw_score": F.lit(None).cast("double"), "_threshold": F.lit(Z_THRESHOLD)}
            )
        else:
            model_day = lookup(F.col("day_index").cast("int"), used).cast("bigint")
            rows = rows.withColumn("fit_day", model_day)
            training = self._training(rows, fits)
            scales = settled(self._scales(training))
            sizes = {r["fit_day"]: r["n"] for r in training.groupBy("fit_day").agg(F.count(F.lit(1)).alias("n")).collect()}
            scaled = self._scaled(training, scales)
            models = settled(self._grow_trees(scaled, sizes))
            trained = settled(self._score_pairs(scaled, models, fits))
            bars = exact_quantiles(
                trained, ["fit_day"], "raw_score", {"_threshold": self.quantile}
            )
            live = rows.where(F.col("fit_day").isNotNull() & F.col("trainable"))
            now = self._score_pairs(
                self._scaled(live.select(*keep, "vector", "fit_day"), scales), models, fits
            )
            scored = rows.join(now.join(bars, "fit_day").drop("fit_day"), keep, "left")
        scored = scored.withColumn(
            "skip_reason",
            F.coalesce(
                "skip_reason", F.when(F.col("raw_score").isNull(), F.lit("insufficient_history"))
            ),
        )
        bar = F.when(
            F.col("skip_reason").isNull() & ~F.coalesce("in_maintenance", F.lit(False)), F.col("_threshold")
        ).otherwise(F.lit(Z_THRESHOLD))
        text = W.reason_text(F.col("contributions"), "Isolation Forest multivariate isolation;")
        return _finish(_outcome(scored, bar, text), self.name, self.digest)


# --- advisories -----------------------------------------------------------------------------------


def advisory_code(detector: Column, contributions: Column) -> Column:
    first = F.get(contributions, 0)["feature"]
    many = (detector == "isolation_forest") & (F.size(contributions) > 1)
    return F.when(many | first.isNull(), F.lit(ADVISORY_DEFAULT)).otherwise(
        F.coalesce(lookup(first, ADVISORY_CODE), F.lit(ADVISORY_DEFAULT))
    )


def anomalies(scores: DataFrame) -> DataFrame:
    """Strongest alert of each endpoint and detector (earlier day on a tie)."""
    alerts = scores.where(
        F.col("above_threshold") & ~F.col("suppressed") & F.col("skip_reason").isNull()
    )
    best = F.min(
        F.struct((-F.col("score")).alias("rank"), "day_index", *[c for c in SCORE_COLUMNS if c not in ("endpoint_id", "day_index", "detector", "score", "contributions")], "score", "contributions")
    )
    rows = alerts.groupBy("endpoint_id", "detector").agg(best.alias("b")).select(
        "endpoint_id", "detector", "b.*"
    )
    digest = joined_digest(
        F.col("endpoint_id"), F.col("day_index"), F.col("detector"), F.col("model_digest"), F.col("reason")
    )
    return rows.drop("rank").withColumns(
        {"anomaly_id": digest, "code": advisory_code(F.col("detector"), F.col("contributions"))}
    )


def advisory_items(
    anomalies_: DataFrame, history_count: int, limit: int | None = None, baseline_min: int = MIN_HISTORY,
    forest_min: int = FOREST_MIN_TRAIN,
) -> DataFrame:
    """Advisory section: a note when history is short, else the leading anomalies, else a note."""
    spark = anomalies_.sparkSession
    schema = "position int, code string, reason string"
    order = [F.col("score").desc(), "endpoint_id", "day_index"]
    if limit is None:
        items = global_position(anomalies_, order).withColumn("position", F.col("position").cast("int"))
    else:
        top = anomalies_.orderBy(*order).limit(limit)
        items = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    items = items.select("position", "code", "reason")
    if history_count < baseline_min:
        note = f"History holds {history_count} endpoint windows; the baseline needs {baseline_min} and the forest {forest_min}."
        return spark.createDataFrame([(0, "ADVISORY_INSUFFICIENT_HISTORY", note)], schema)
    if history_count < forest_min:
        note = f"The forest needs {forest_min} training windows; {history_count} are stored. The baseline ran."
        first = spark.createDataFrame([(0, "ADVISORY_INSUFFICIENT_HISTORY", note)], schema)
        return first.unionByName(items if limit is None else items.where(F.col("position") < limit))
    if items.isEmpty():
        note = "Scoring ran; no endpoint window met the review threshold."
        return spark.createDataFrame([(0, "ADVISORY_NONE", note)], schema)
    return items


def score_current(history: DataFrame, current: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """Scores of the current windows against the stored history."""
    placed = W.assign_day(current, history)
    day = placed.select("day_index").first()
    both = history.unionByName(placed, allowMissingColumns=True)
    scores = score_with_all(both, scorers)
    return scores if day is None else scores.where(F.col("day_index") == day["day_index"])
