"""Time-series tables: a DataFrame with tags, one time index and fields, and how its rows are merged on read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TimeSeriesTable:
    """A table of rows (tags, time index, fields). merge: append, last_row or last_non_null."""

    df: DataFrame
    time_index: str
    tags: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    merge: str = "append"
    sequence: str | None = None
    tombstone: str | None = None
    ttl_seconds: float | None = None

    def __post_init__(self) -> None:
        if not self.fields:
            taken = {self.time_index, *self.tags, self.sequence, self.tombstone}
            self.fields = [c for c in self.df.columns if c not in taken]

    def read(self, now=None) -> DataFrame:
        """Rows visible to a query. Without a sequence column ties go to the greatest field values."""
        df = self.df
        if self.ttl_seconds is not None and now is not None:
            df = df.where(F.col(self.time_index) >= F.lit(now) - F.make_dt_interval(secs=F.lit(float(self.ttl_seconds))))
        if self.merge == "append":
            return df
        keys = [*self.tags, self.time_index]
        seq = F.col(self.sequence) if self.sequence else F.struct(*self.fields)
        if self.merge == "last_row":
            last = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), seq).alias("_row")
            out = df.groupBy(*keys).agg(last).select(*keys, "_row.*")
        elif self.merge == "last_non_null":
            kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in self.fields]
            if self.tombstone:  # a deletion hides what came before it
                wiped = df.groupBy(*keys).agg(F.max(F.when(F.col(self.tombstone), seq)).alias("_wiped"))
                later = df.join(wiped, keys).where(F.col("_wiped").isNull() | (seq > F.col("_wiped"))).where(~F.col(self.tombstone))
                return later.groupBy(*keys).agg(*kept)
            return df.groupBy(*keys).agg(*kept)
        else:
            raise ValueError(f"unknown merge mode {self.merge}")
        if self.tombstone:
            out = out.where(~F.coalesce(F.col(self.tombstone), F.lit(False))).drop(self.tombstone)
        return out

    def last_rows(self) -> DataFrame:
        """The newest row of every series, by one partial aggregate."""
        rest = [c for c in self.df.columns if c not in self.tags]
        newest = F.max_by(F.struct(*rest), F.struct(F.col(self.time_index), *[F.col(c) for c in self.fields])).alias("_row")
        return self.read().groupBy(*self.tags).agg(newest).select(*self.tags, "_row.*")
