"""Key audit that keeps up with batches: an audit after a batch reads what the batch touched.

Every column that a rule names is summed up as (table, column, key, rows) in hash buckets of
the key text, the keys of all tables side by side.  A batch adds its counts, and only
the buckets it touches are looked at again: a child's key and its parent's lie in one bucket
of the summary, so no table is read for a reference.  Findings are kept by bucket too.

NULL keys and NULL counts are rows of the summary like any other.  Rows are only ever
appended; a repeated batch replaces its counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.buckets import N_BUCKETS, BucketLog, Snapshot, Versions


@dataclass(frozen=True)
class Rules:
    """Declared keys of one table; ``references`` lists (column, parent table, parent key)."""

    required: Sequence[str] = ()
    unique: str | None = None
    references: Sequence[tuple[str, str, str]] = ()


_COUNTS = T.StructType(
    [
        T.StructField("bucket_key", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("is_null_count", T.BooleanType()),
        T.StructField("key", T.StringType()),
        T.StructField("n_rows", T.LongType()),
    ]
)
_FINDINGS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("bucket_key", "table", "rule", "key")] + [T.StructField("n_rows", T.LongType())]
)


def _summed(rows: DataFrame) -> DataFrame:
    keys = [f.name for f in _COUNTS.fields if f.name != "n_rows"]
    return rows.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))


class KeyAudit:
    """The audit of several tables under ``root``; ``rules`` by table name."""

    def __init__(self, spark: SparkSession, root: str, rules: Mapping[str, Rules], n_buckets: int = N_BUCKETS):
        self.rules = dict(rules)
        log = BucketLog(spark, root, "key_counts", _COUNTS, "bucket_key", n_buckets)
        self.counts = Snapshot(log, _summed)
        self.findings_by_bucket = Versions(spark, f"{root}/key_findings", _FINDINGS, "bucket_key", log.n_buckets)

    def _key_columns(self, table: str) -> list[str]:
        """Columns of a table whose keys are counted: its own keys and what other tables refer to."""
        rule = self.rules[table]
        own = [c for c, _, _ in rule.references] + ([rule.unique] if rule.unique else [])
        asked = [key for r in self.rules.values() for _, parent, key in r.references if parent == table]
        return sorted({*own, *asked})

    def _counted(self, table: str, rows: DataFrame) -> DataFrame:
        """One pass over a batch: all key columns side by side, and NULLs of the required ones."""
        keys = [F.struct(F.lit(c).alias("column"), F.lit(False).alias("is_null_count"), F.col(c).cast("string").alias("key"))
                for c in self._key_columns(table)]
        nulls = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.lit(True).alias("is_null_count"), F.lit(c).alias("key")))
                 for c in self.rules[table].required]
        item = F.explode(F.array(*keys, *nulls)).alias("i")
        rows = rows.select(item).where("i IS NOT NULL").groupBy("i").agg(F.count("*").alias("n_rows"))
        return rows.select(F.coalesce("i.key", F.lit("")).alias("bucket_key"), F.lit(table).alias("table"), "i.*", "n_rows")

    def apply(self, batch: int, tables: Mapping[str, DataFrame]) -> list[int]:
        """Audit the rows that a batch adds; gives the buckets that were looked at."""
        counted = [self._counted(name, rows) for name, rows in tables.items() if name in self.rules]
        joined = counted[0]
        for more in counted[1:]:
            joined = joined.unionByName(more)
        self.counts.log.append(joined, batch)
        touched = self.counts.fold(batch)
        newest = self.counts.log.batches()[-1]
        self.findings_by_bucket.replace(self._found(self.counts.rows(touched)), touched, newest, base=batch)
        return touched

    def _found(self, counts: DataFrame) -> DataFrame:
        """Violations in whole buckets of the summary."""
        listed = "bucket_key", "table", "rule", "key", "n_rows"
        nulls = counts.where("is_null_count").withColumn("rule", F.lit("not_null")).select(*listed)
        keys = counts.where("NOT is_null_count")
        found = [nulls]
        for table, rule in self.rules.items():
            of = lambda column, table=table: keys.where((F.col("table") == table) & (F.col("column") == column))
            if rule.unique:
                found.append(of(rule.unique).where("n_rows > 1").withColumn("rule", F.lit("unique")).select(*listed))
            for column, parent, key in rule.references:
                known = of(key, parent).where("key IS NOT NULL").select("key")
                missing = of(column).where("key IS NOT NULL").join(known, "key", "left_anti")
                found.append(missing.withColumn("rule", F.lit(f"references {parent}")).select(*listed))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def findings(self) -> DataFrame:
        """All violations as of the last batch: (table, rule, key, n_rows)."""
        return self.findings_by_bucket.rows().select("table", "rule", "key", "n_rows")
