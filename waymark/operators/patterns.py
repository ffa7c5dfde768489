"""The pattern detector: trajectories as cell sequences, supports learned from them, windows scored against supports; evaluation by leaving one out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.cells import check_precision
from waymark.functions.scalars import period_micros
from waymark.operators.evaluate import rates
from waymark.operators.tokens import anomaly, pack_scores, sequences, token_rows, whole_windows, window_scores
from waymark.sources.tables import staged


@dataclass(frozen=True)
class PatternParams:
    """precision of cells, threshold of the anomaly score (above 0, at most 1), window as '<minutes>T', cells between points or not."""

    precision: int = 18
    threshold: float = 0.6
    window: str = "1000T"
    interpolate: bool = True

    def __post_init__(self):
        check_precision(self.precision)
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        period_micros(self.window)


def fit(points: DataFrame, params: PatternParams, by: str) -> DataFrame:
    """(by, pattern, freq) of the trajectories of points(uid, by, event_id, ts, lat, lon): at support 1 the closed patterns are the distinct
    sequences themselves. by: the group (a user, a batch) whose trajectories support each other."""
    seqs = sequences(token_rows(points, params.precision, "uid", params.interpolate), "uid")
    groups = points.groupBy("uid").agg(F.first(by).alias(by))
    return seqs.join(groups, "uid").groupBy(by, F.col("seq").alias("pattern")).agg(F.count("*").alias("freq"))


def detect(points: DataFrame, support: DataFrame, params: PatternParams, by: str, leave_one_out: bool = False) -> DataFrame:
    """(uid, by, event_id, ts, lat, lon, similarity, anomaly_score, anomaly) of every trajectory of points, each by itself.

    Rows are those whose cell differs from the row before; the score of a row is 1 less the least similarity of its trajectory so far.
    leave_one_out: a trajectory's own sequence is taken out of the support that it meets. The windows themselves: window_tokens().
    """
    rows = token_rows(points, params.precision, "uid", params.interpolate)
    scored = window_scores(rows.select("uid", by, "event_id", "ts", "lat", "lon", "geohash", "between"), support, params.window, by, "uid", skip_own=leave_one_out)
    return anomaly(scored, params.threshold, "uid").select("uid", by, "event_id", "ts", "lat", "lon", "similarity", "anomaly_score", "anomaly")


def evaluate(points: DataFrame, truth: DataFrame, precisions: list[int], thresholds: list[float], window: str, interpolate: bool = True) -> DataFrame:
    """Leave-one-out outcomes of all trajectories at all parameters: (precision, threshold, batch, uid, anomalous, outcome, delay).

    points(uid, batch, event_id, ts, lat, lon); truth(uid, anomalous, onset). One plan for all folds and parameters: points are encoded once for all precisions, the
    trajectories are staged, supports are counted once a batch and the own sequence is left out. Scores do not depend on the threshold. delay: seconds from the
    onset to the first detection, null where that is negative or there is none.
    """
    for p in precisions:
        PatternParams(p, 1.0, window, interpolate)
    rows = token_rows(points.select("uid", "batch", "event_id", "ts", "lat", "lon"), list(precisions), "uid", interpolate)
    whole = staged(whole_windows(rows, window, ["precision", "batch"], ["precision", "uid"], carry=("ts",)), "trajectories")
    support = whole.groupBy("precision", "batch", F.col("tokens").alias("pattern")).agg(F.count("*").alias("freq"))
    packs = pack_scores(whole, support, ["precision", "batch"], ["precision", "uid"], skip_own=True).repartition("precision", "uid")
    best = packs.groupBy("precision", "uid", "batch", "event_id", "ts").agg(F.max("similarity").alias("similarity"))
    # The least similarity so far falls below a limit where a row's own first does.
    first = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.min(F.when(1 - F.col("similarity") > t, F.col("ts"))).alias("first_ts")) for t in thresholds])
    wanted = best.groupBy("precision", "uid", "batch").agg(first.alias("_first")).join(truth, "uid").select("precision", "uid", "batch", "anomalous", "onset", F.inline("_first"))
    late = (F.unix_micros(F.col("first_ts").cast("timestamp")) - F.unix_micros(F.col("onset").cast("timestamp"))) / 1e6
    return wanted.select("precision", "threshold", "batch", "uid", "anomalous", F.col("first_ts").isNotNull().alias("outcome"), F.when(late >= 0, late).alias("delay"))


def batch_rates(outcomes: DataFrame) -> DataFrame:
    """Confusion counts and both AUCs of each batch at each parameter, with the median delay and, where measured, the median times."""
    found = rates(outcomes, "precision", "threshold", "batch")
    late = outcomes.groupBy("precision", "threshold", "batch").agg(*[F.median(c).alias(c) for c in ("delay", "fit_time", "detect_time") if c in outcomes.columns])
    return found.join(late, ["precision", "threshold", "batch"])
