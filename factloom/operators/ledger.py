"""The ledger of stages: a row an item, for each stage when it was done, by which version and on which input.

Columns: the key, a checksum (of what the first stage got), skip_reason, and for each stage s: s_at (date), s_v (version), s_in
(digest of its input). All questions are column expressions, so they are filters that reach the scan; writing is an upsert.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("at", "v", "in")


@dataclass(frozen=True)
class Pillar:
    """Stages in order; the version that a stage has to be of, where it matters; the SQL condition under which a stage applies,
    where not always."""

    key: str
    checksum: str
    stages: tuple[str, ...]
    versions: dict[str, str] = field(default_factory=dict)
    applies: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [self.key, self.checksum, "skip_reason", *[f"{s}_{f}" for s in self.stages for f in FIELDS]]

    def skipped(self) -> Column:
        return F.coalesce(F.col("skip_reason"), F.lit("")) != ""

    def dated(self, stage: str) -> Column:
        return F.col(f"{stage}_at").isNotNull()

    def done(self, stage: str) -> Column:
        """Skipped, or dated and of the version asked for."""
        right = F.col(f"{stage}_v").eqNullSafe(F.lit(self.versions[stage])) if stage in self.versions else F.lit(True)
        return self.skipped() | (self.dated(stage) & right)

    def fresh(self, stage: str, digest: Column) -> Column:
        """Done, and on the input that is there now; a skipped item is always fresh."""
        return self.done(stage) & (self.skipped() | F.col(f"{stage}_in").eqNullSafe(digest))

    def applicable(self, stage: str) -> Column:
        return F.coalesce(F.expr(self.applies.get(stage, "true")), F.lit(False))

    def pending(self, stage: str) -> Column:
        """Not skipped, the stage applies and is not done, and all earlier stages that apply are dated."""
        ready = ~self.skipped() & self.applicable(stage) & ~self.done(stage)
        for s in self.stages[: self.stages.index(stage)]:
            ready = ready & (~self.applicable(s) | self.dated(s))
        return ready

    def next_action(self) -> Column:
        """The first stage that is pending; 'nothing' if none is."""
        out = F
        for s in self.stages:
            out = out.when(self.pending(s), s)
        return out.otherwise("nothing")

    def checked(self, stamps: DataFrame) -> DataFrame:
        """stamps with all columns of the ledger; a column that it does not know is an error."""
        unknown = sorted(set(stamps.columns) - set(self.columns))
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        return stamps.select(*[F.col(c).cast("string") if c in stamps.columns else F.lit(None).cast("string").alias(c) for c in self.columns])

    def stamped(self, ledger: DataFrame, stamps: DataFrame) -> DataFrame:
        """ledger with stamps (one row a key) laid over it: null in a stamp keeps what is there; a checksum that changes clears
        what is known of all stages but for what the stamp itself says."""
        a, b = ledger.select(*self.columns).alias("a"), self.checked(stamps).alias("b")
        both = a.join(b, F.col(f"a.{self.key}") == F.col(f"b.{self.key}"), "full_outer")
        old, new = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
        changed = F.coalesce(old(self.checksum) != new(self.checksum), F.lit(False))
        plain = (self.key, self.checksum, "skip_reason")
        return both.select(*[F.coalesce(new(c), old(c) if c in plain else F.when(~changed, old(c))).alias(c) for c in self.columns])

    def skip(self, ledger: DataFrame, reasons: DataFrame) -> DataFrame:
        """ledger with skip_reason from reasons (key, skip_reason); keys that are new become rows."""
        return self.stamped(ledger, reasons.select(self.key, "skip_reason"))

    def refusals_cleared(self, ledger: DataFrame, *reasons: str) -> DataFrame:
        """ledger where items skipped for one of the reasons are open again."""
        return ledger.withColumn("skip_reason", F.when(~F.col("skip_reason").isin(*reasons), F.col("skip_reason")))

    def merged(self, ledger: DataFrame, stamps: DataFrame, order: str) -> DataFrame:
        """ledger with many stamps of each key, from writers side by side, in the order of a column.

        Each field takes the last stamp that says something of it; of stages only stamps after the key's last change of
        checksum count. All of it is aggregation, so a key with very many stamps is one row a task.
        """
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
        final = stamps.groupBy(self.key).agg(last(self.checksum))
        final = final.select(F.col(self.key).alias("_k"), F.col(self.checksum).alias("_final"))
        same = stamps.join(final, stamps[self.key] == F.col("_k")).drop("_k")
        other = F.col(self.checksum).isNotNull() & (F.col(self.checksum) != F.col("_final"))
        cut = same.groupBy(self.key).agg(F.max(F.when(other, F.col(order))).alias("_cut")).withColumnRenamed(self.key, "_k")
        rows = same.join(cut, same[self.key] == F.col("_k")).drop("_k")
        late = F.col("_cut").isNull() | (F.col(order) > F.col("_cut"))
        plain = {self.key, self.checksum, "skip_reason", order}
        rows = rows.select(*[F.when(late, F.col(c)).alias(c) if c not in plain else F.col(c) for c in stamps.columns])
        one = rows.groupBy(self.key).agg(*[last(c) for c in stamps.columns if c not in (self.key, order)])
        return self.stamped(ledger, one)


def shared_work(rows: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """The rows that worker k of n takes: by a hash of the key, so no worker needs to see the others' rows."""
    return rows.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % n == k)


def file_states(ledger: DataFrame, files: DataFrame, key: str, checksum: str) -> DataFrame:
    """key and state of every item of the ledger and every file (key, checksum): held, changed, lost, released (checksum known,
    file given up: column released), open (nothing got yet), skipped, or unknown (a file that the ledger does not know)."""
    a, b = ledger.alias("a"), files.select(F.col(key).alias("_k"), F.col(checksum).alias("_sha")).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col("_k"), "full_outer")
    sha, there = F.col(f"a.{checksum}"), F.col("_k").isNotNull()
    state = (
        F.when(F.col(f"a.{key}").isNull(), "unknown")
        .when(there & sha.eqNullSafe(F.col("_sha")), "held")
        .when(there & sha.isNotNull(), "changed")
        .when(there, "unrecorded")
        .when(F.coalesce(F.col("skip_reason"), F.lit("")) != "", "skipped")
        .when(sha.isNull(), "open")
        .when(F.coalesce(F.col("released"), F.lit(False)), "released")
        .otherwise("lost")
    )
    return both.select(F.coalesce(F.col(f"a.{key}"), F.col("_k")).alias(key), state.alias("state"))
