"""Which columns may be features, decided from declared roles and lineage, and an audit of a feature table."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Roles:
    """What a table's columns are. No column is judged by how its name reads.

    ``outcome``: known only once the event is over: labels, scores, the event's own statistics.
    ``keys``: identity, time and status; known before, but no features. ``targets``: what other models learn.
    ``lineage``: for built columns, what they are built from and whether the operator that built them reads earlier
    rows only.
    """
    outcome: frozenset[str] = frozenset()
    keys: frozenset[str] = frozenset()
    targets: frozenset[str] = frozenset()
    lineage: Mapping[str, tuple[Sequence[str], bool]] = field(default_factory=dict)

    def leaks(self, column: str) -> bool:
        """An outcome, or built from one through operators that read the event's own row."""
        seen, todo = set(), [column]
        while todo:
            c = todo.pop()
            if c in self.outcome or c in self.targets:
                return True
            inputs, lagged = self.lineage.get(c, ((), True))
            if not lagged and c not in seen:
                todo += inputs
            seen.add(c)
        return False


def select_features(df: DataFrame, roles: Roles) -> list[str]:
    """Numeric columns that are no keys and no leaks."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in roles.keys and not roles.leaks(f.name)]


def leakage_audit(df: DataFrame, features: Sequence[str], roles: Roles, final: str = "is_final", label: str = "home_win", counts: Sequence[str] = ()) -> DataFrame:
    """One row per issue found: ``issue, detail, n``. Columns are judged by their roles, values by one aggregate."""
    found = {"empty": (F.count(F.lit(1)) == 0).cast("long")}
    if {final, label} <= set(df.columns):
        found["unlabeled_final_has_outcome"] = F.count_if((F.col(final) == 0) & F.col(label).isNotNull())
    found |= {f"negative_{c}": F.count_if(F.col(c) < 0) for c in counts}
    values = [F.struct(F.lit(k).alias("issue"), F.lit("").alias("detail"), v.alias("n")) for k, v in found.items()]
    columns = [F.struct(F.lit("forbidden_column").alias("issue"), F.lit(c).alias("detail"), F.lit(1).cast("long").alias("n")) for c in sorted(set(features)) if roles.leaks(c)]
    return df.agg(F.array(*values, *columns).alias("rows")).select(F.inline("rows")).where("n > 0")
