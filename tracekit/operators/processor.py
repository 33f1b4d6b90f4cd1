"""Fit, transform and inverse of a whole session table: the pair a generator sits between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.operators import encoders as E
from tracekit.operators.ordered import arrange, running, same_order
from tracekit.operators.reshape import pack_sessions, unpack_sessions
from tracekit.operators.sessions import decode_interarrival, encode_interarrival
from tracekit.roles import RoleSpec


@dataclass
class SessionProcessor:
    """Rows of sessions to one record per session and back.

    Discrete fields become one-hot slots, the others are scaled to [0, 1]; the
    timestamp becomes the session start and the gaps between its rows.
    """

    roles: RoleSpec
    order: tuple[str, ...]
    max_len: int
    ranges: dict | None = None
    choices: dict | None = None

    def _fields(self) -> list[str]:
        return [*self.roles.timeseries, "interarrival"]

    def fit(self, df: DataFrame) -> SessionProcessor:
        gaps = self._gaps(df)
        numeric = [c for c in (*self._fields(), "flow_start") if c not in self.roles.discrete]
        self.ranges = E.fit_ranges(gaps, numeric)
        discrete = [c for c in self.roles.timeseries if c in self.roles.discrete]
        self.choices = E.fit_choices(gaps, discrete) if discrete else {}
        return self

    def _gaps(self, df: DataFrame) -> DataFrame:
        """Truncated sessions with their gaps; the marks of the one sort stay on the rows."""
        keys, ts = list(self.roles.metadata), self.roles.require_timestamp()
        placed = running(arrange(df, [ts, *self.order], keys), keys, position="_pos")
        head = placed.where(F.col("_pos") < self.max_len).drop("_pos")
        return encode_interarrival(head, keys, ts, list(self.order))

    def _slots(self, c: str) -> list:
        if c in self.choices:
            return [F.get(E.one_hot(c, self.choices[c]), i).alias(f"{c}#{i}") for i in range(len(self.choices[c]))]
        return [E.normalize(c, self.ranges[c]).alias(f"{c}#0")]

    def _names(self) -> list[str]:
        return [f"{c}#{i}" for c in self._fields() for i in range(len(self.choices.get(c, (0,))))]

    def transform(self, df: DataFrame) -> DataFrame:
        """(metadata, flow_start, feat, gen_flag)"""
        keys, ts = list(self.roles.metadata), self.roles.require_timestamp()
        start = E.normalize("flow_start", self.ranges["flow_start"]).alias("flow_start")
        slots = [s for c in self._fields() for s in self._slots(c)]
        rows = self._gaps(df).select(*keys, ts, *self.order, start, *slots, "_at", "_bucket")
        # the start of a session is the same on all its rows
        rows = same_order(rows, [ts, *self.order], [*keys, "flow_start"])
        return pack_sessions(rows, [*keys, "flow_start"], self._names(), [ts, *self.order], self.max_len)

    def inverse(self, sessions: DataFrame) -> DataFrame:
        """Rows (metadata, position, timestamp, series) of flagged steps."""
        keys, ts = list(self.roles.metadata), self.roles.require_timestamp()
        rows = unpack_sessions(sessions, self._names())
        cols = []
        for c in self._fields():
            if c in self.choices:
                slots = F.array(*[F.col(f"`{c}#{i}`") for i in range(len(self.choices[c]))])
                cols.append(E.from_one_hot(slots, self.choices[c]).alias(c))
            else:
                cols.append(E.denormalize(F.col(f"`{c}#0`"), self.ranges[c]).alias(c))
        start = E.denormalize("flow_start", self.ranges["flow_start"]).alias("flow_start")
        rows = rows.select(*keys, "pos", start, *cols)
        return decode_interarrival(rows, keys, "pos", "flow_start", "interarrival", ts).select(
            *keys, "pos", ts, *self.roles.timeseries)
