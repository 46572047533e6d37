"""Outliers judged row by row against a history that grows with the rows accepted.

A detector judges rows in order.  Its line and its neighbours come from a snapshot of its
history, which is taken again once 50 more rows were accepted.  So one detector is a chain
of decisions that nothing can shorten; many detectors (one per receiver, say) work side by
side.  One history too large for a chain is a case for `outliers.outlier_flags`, which
judges any number of rows against a frozen one.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from skysonde import settings as S
from skysonde.operators.filters import drop_absurd_temperature

#: Rows judged at a time; a snapshot is taken after fewer accepted ones.
CHUNK = 64
#: Rows of a micro-batch that are given back at a time.
GIVEN_ROWS = 10_000
_STATE = "altitudes binary, temperatures binary, added int, fitted boolean"


@dataclass(frozen=True)
class Rule:
    """When a row is an outlier, and how much history decides that."""

    size: int = S.HISTORY_SIZE
    refit: int = S.REFIT_ROWS
    least: int = S.HISTORY_MIN
    k: int = S.NEIGHBOURS
    deviation: float = S.DEVIATION_LIMIT_C
    sigma: float = S.SIGMA_LIMIT
    tolerance: float = S.RESIDUAL_TOLERANCE_C


@dataclass
class Snapshot:
    """Line over a history, and the history in order of altitude."""

    slope: float
    intercept: float
    temperatures: np.ndarray
    turns: np.ndarray  # twice the altitudes at which the k nearest rows move up by one

    @classmethod
    def of(cls, altitudes: np.ndarray, temperatures: np.ndarray, k: int) -> "Snapshot":
        off = altitudes - altitudes.mean()
        spread = float(off @ off)
        slope = float(off @ (temperatures - temperatures.mean())) / spread if spread else 0.0
        order = np.argsort(altitudes, kind="stable")
        low = altitudes[order]
        turns = low[:-k] + low[k:] if len(low) > k else np.zeros(0)
        return cls(slope, float(temperatures.mean() - slope * altitudes.mean()), temperatures[order], turns)

    def outliers(self, altitudes: np.ndarray, temperatures: np.ndarray, rule: Rule) -> np.ndarray:
        far = np.abs(temperatures - (self.slope * altitudes + self.intercept)) > rule.tolerance
        for i in np.flatnonzero(far):
            first = int(np.searchsorted(self.turns, 2 * altitudes[i], side="left"))
            near = self.temperatures[first : first + rule.k]
            deviation, std = abs(temperatures[i] - near.mean()), near.std()
            far[i] = deviation > rule.deviation or (std > 0 and deviation / std > rule.sigma)
        return far


@dataclass
class Detector:
    """History of one chain, as much of it as the rule and the current snapshot need."""

    rule: Rule
    altitudes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperatures: np.ndarray = field(default_factory=lambda: np.zeros(0))
    added: int = 0  # rows accepted since the snapshot
    fitted: bool = False
    snapshot: Snapshot | None = None

    def _take(self, end: int | None) -> Snapshot:
        altitudes, temperatures = (x[:end][-self.rule.size :] for x in (self.altitudes, self.temperatures))
        return Snapshot.of(altitudes, temperatures, self.rule.k)

    def _add(self, altitudes: np.ndarray, temperatures: np.ndarray) -> None:
        keep = self.rule.size + self.rule.refit
        self.altitudes = np.append(self.altitudes, altitudes)[-keep:]
        self.temperatures = np.append(self.temperatures, temperatures)[-keep:]
        self.added += len(altitudes)

    def learn(self, altitudes: np.ndarray, temperatures: np.ndarray) -> None:
        """Rows of a history given beforehand."""
        self._add(altitudes, temperatures)

    def judged(self, altitudes: np.ndarray, temperatures: np.ndarray) -> np.ndarray:
        """Whether each of the next rows is an outlier; those that aren't join the history."""
        out = np.zeros(len(altitudes), bool)
        at = 0
        while at < len(altitudes):
            known = min(len(self.altitudes), self.rule.size)
            if known < self.rule.least:  # too little is known: all are accepted
                end = at + self.rule.least - known
                self._add(altitudes[at:end], temperatures[at:end])
                at = min(end, len(altitudes))
                continue
            if not self.fitted or self.added >= self.rule.refit:
                self.snapshot, self.added, self.fitted = self._take(None), 0, True
            elif self.snapshot is None:  # just restored: the snapshot lies `added` rows back
                self.snapshot = self._take(len(self.altitudes) - self.added)
            a, t = altitudes[at : at + CHUNK], temperatures[at : at + CHUNK]
            far = self.snapshot.outliers(a, t, self.rule)
            enough = np.flatnonzero(np.cumsum(~far) == self.rule.refit - self.added)
            n = int(enough[0]) + 1 if len(enough) else len(a)
            out[at : at + n] = far[:n]
            self._add(a[:n][~far[:n]], t[:n][~far[:n]])
            at += n
        return out

    def stored(self) -> tuple:
        return self.altitudes.tobytes(), self.temperatures.tobytes(), self.added, self.fitted

    @classmethod
    def restored(cls, rule: Rule, state: tuple) -> "Detector":
        return cls(rule, np.frombuffer(state[0]), np.frombuffer(state[1]), int(state[2]), bool(state[3]))


def _judgeable(rows: DataFrame, time: str = "time") -> DataFrame:
    return drop_absurd_temperature(rows.where(F.col("altitude").isNotNull() & F.col(time).isNotNull()))


def _numbers(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return frame["altitude"].to_numpy(float), frame["temperature"].to_numpy(float)


def _packed(frame: pd.DataFrame) -> pa.Table:
    """Rows in Arrow's form: texts are buffers, not an object each."""
    return pa.Table.from_pandas(frame, preserve_index=False)


def _detector_key(by: Sequence[str]) -> Column:
    return F.xxhash64(*by) if by else F.lit(0).cast("long")


def _with_verdict(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("is_outlier", BooleanType())])


def outliers_in_order(
    rows: DataFrame, by: Sequence[str] = (), history: DataFrame | None = None, rule: Rule = Rule()
) -> DataFrame:
    """Rows with `is_outlier`, judged in the order of (time, obs_id) by one detector per `by`.

    Rows without time, altitude or a sane temperature are left out.  `history` (the same
    columns) is what detectors know beforehand.  Rows of a detector stream through one task
    in order: only the bounded history is held.  Spark sorts them there with all their columns,
    so pass no more than are wanted.
    """
    columns = rows.columns
    flagged = _judgeable(rows).withColumn("_known", F.lit(False))
    if history is not None:
        flagged = flagged.unionByName(_judgeable(history).select(*columns, F.lit(True).alias("_known")))
    dealt = (
        flagged.withColumn("_detector", _detector_key(by))
        .repartition("_detector")
        .sortWithinPartitions("_detector", F.desc("_known"), "time", "obs_id")
    )

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, detector = None, None
        for frame in frames:
            for (own, known), part in frame.groupby(["_detector", "_known"], sort=False):
                if own != key:
                    key, detector = own, Detector(rule)
                if known:
                    detector.learn(*_numbers(part))
                else:
                    yield part[columns].assign(is_outlier=detector.judged(*_numbers(part)))

    return dealt.mapInPandas(judge, _with_verdict(rows))


def outliers_in_arrival_order(rows: DataFrame, by: Sequence[str] = (), rule: Rule = Rule()) -> DataFrame:
    """As `outliers_in_order`, for a stream: each detector's history is keyed state.

    Rows of a micro-batch are put in order; batches follow each other as they arrive.  The
    state of a detector is its latest accepted rows, so many as the rule bounds, and it lives
    on over restarts with the stream's checkpoint.  The rows of a detector in one micro-batch
    are held packed until they are judged, so pass no more columns than are wanted.
    """
    columns = rows.columns

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pa.concat_tables([_packed(frame[columns]) for frame in frames], promote_options="permissive").combine_chunks()
        order = np.lexsort([batch[c].to_numpy() for c in ("obs_id", "time")])
        detector = Detector.restored(rule, state.get) if state.exists else Detector(rule)
        for at in range(0, len(order), GIVEN_ROWS):
            part = batch.take(order[at : at + GIVEN_ROWS]).to_pandas()
            yield part.assign(is_outlier=detector.judged(*_numbers(part)))
        state.update(detector.stored())

    keyed = _judgeable(rows).withColumn("_detector", _detector_key(by))
    return keyed.groupBy("_detector").applyInPandasWithState(
        judge, _with_verdict(rows), _STATE, "append", GroupStateTimeout.NoTimeout
    )
