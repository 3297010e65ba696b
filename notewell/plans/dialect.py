"""One SQL text for Spark and for the DuckDB check, where both have the operator's functions.

An operator's text names its input relations as ``@name``. ``SqlOperator`` runs it on DataFrames;
``oracle`` gives the same relation algebra to DuckDB over sub-selects of the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dialect:
    """The few functions that the engines spell differently."""

    spark: bool

    def lit(self, text: str) -> str:
        """A literal that keeps backslashes as they are."""
        if not self.spark:
            return "'" + text.replace("'", "''") + "'"
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def micros(self, x: str) -> str:
        return f"unix_micros(CAST({x} AS TIMESTAMP))" if self.spark else f"epoch_us(CAST({x} AS TIMESTAMP))"

    def matches(self, x: str, pattern: str) -> str:
        return f"{x} RLIKE {self.lit(pattern)}" if self.spark else f"regexp_matches({x}, {self.lit(pattern)})"

    def replaced(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{by}')" if self.spark else f"regexp_replace({x}, {self.lit(pattern)}, '{by}', 'g')"

    def extracted(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def all_of(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})" if self.spark else f"strlen({x})"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def explode(self, relation: str, array: str, name: str) -> str:
        return f"{relation} LATERAL VIEW explode({array}) t AS {name}" if self.spark else f"{relation}, unnest({array}) AS t({name})"

    def array_of(self, values: list[str]) -> str:
        return f"array({', '.join(values)})" if self.spark else f"[{', '.join(values)}]"

    def last(self, x: str, key: str) -> str:
        return f"max_by({x}, {key})" if self.spark else f"arg_max({x}, {key})"

    def first(self, x: str, key: str) -> str:
        return f"min_by({x}, {key})" if self.spark else f"arg_min({x}, {key})"


SPARK, DUCK = Dialect(True), Dialect(False)


@dataclass(frozen=True)
class SqlOperator:
    """An operator over named relations; call it with DataFrames."""

    inputs: tuple[str, ...]
    text: Callable[[Dialect], str]
    #: The same rows as DataFrames, where Spark's plan of the text grows faster than its inputs or computes otherwise.
    build: Callable[..., DataFrame] | None = None

    def __call__(self, **frames: DataFrame) -> DataFrame:
        if self.build:
            return self.build(**{k: frames[k] for k in self.inputs})
        sql = self.text(SPARK).replace("{", "{{").replace("}", "}}")
        for name in sorted(self.inputs, key=len, reverse=True):
            sql = sql.replace(f"@{name}", f"{{{name}}}")
        return next(iter(frames.values())).sparkSession.sql(sql, **{k: frames[k] for k in self.inputs})

    def oracle(self, **relations: str) -> str:
        sql = self.text(DUCK)
        for name in sorted(self.inputs, key=len, reverse=True):
            sql = sql.replace(f"@{name}", f"({relations[name]})")
        return sql
