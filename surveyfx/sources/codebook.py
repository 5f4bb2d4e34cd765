"""Codebooks: variable labels, value labels and question facts.

Labels travel in column metadata (``label`` for the variable, ``values`` for its codes), as survey files keep them.
A question dimension is bounded by the number of columns of the wide table, so it may sit in the plan as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyfx.functions.recode import col, level_rank, lookup, member

CODEBOOK_SCHEMA = "var_name string, label string, code int, value_label string, question_rank int, question_type string, reverse_coded boolean"


@dataclass(frozen=True)
class Question:
    name: str
    label: str
    kind: str
    reverse_coded: bool = False
    values: Mapping[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Codebook:
    """Questions in display order."""

    questions: tuple[Question, ...]

    @property
    def names(self) -> list[str]:
        return [q.name for q in self.questions]

    @property
    def reversed_names(self) -> list[str]:
        return [q.name for q in self.questions if q.reverse_coded]

    def of_kind(self, kind: str) -> list[str]:
        return [q.name for q in self.questions if q.kind == kind]

    def label(self, question: str | Column = "question") -> Column:
        """Display label of a question."""
        return lookup(question, {q.name: q.label for q in self.questions})

    def rank(self, question: str | Column = "question", descending: bool = False) -> Column:
        """Position of a question in display order (or reversed)."""
        names = self.names[::-1] if descending else self.names
        return level_rank(question, names)

    def kind(self, question: str | Column, first: str, otherwise: str) -> Column:
        """Two-way question class: `first` for its listed questions, `otherwise` for every other one."""
        return F.when(member(question, self.of_kind(first)), F.lit(first)).otherwise(F.lit(otherwise))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per question and code."""
        rows = [
            (q.name, q.label, code, text, rank, q.kind, q.reverse_coded)
            for rank, q in enumerate(self.questions, 1)
            for code, text in q.values.items()
        ]
        return spark.createDataFrame(rows, CODEBOOK_SCHEMA)

    def attach(self, df: DataFrame) -> DataFrame:
        """Put the labels into the metadata of the wide table's question columns."""
        return with_labels(df, {q.name: (q.label, q.values) for q in self.questions if q.name in df.columns})


def with_labels(df: DataFrame, labels: Mapping[str, tuple[str, Mapping[int, str]]]) -> DataFrame:
    """Attach ``{column: (label, {code: text})}`` as metadata."""

    def labelled(name: str) -> Column:
        if name not in labels:
            return F.col(name)
        label, values = labels[name]
        return F.col(name).alias(name, metadata={"label": label, "values": {str(code): text for code, text in values.items()}})

    return df.select(*(labelled(c) for c in df.columns))


def is_labelled(f: T.StructField) -> bool:
    return "values" in f.metadata


def codebook_from_metadata(df: DataFrame) -> DataFrame:
    """Rows ``var_name, label, code, value_label`` read from column metadata; no data is scanned."""
    rows = [
        (f.name, f.metadata.get("label"), int(code), text)
        for f in df.schema.fields
        if is_labelled(f)
        for code, text in f.metadata["values"].items()
    ]
    return df.sparkSession.createDataFrame(rows, "var_name string, label string, code int, value_label string")


def map_columns(df: DataFrame, where, fn) -> DataFrame:
    """Apply `fn(field) -> Column` to every column whose field passes `where`; the others stay as they are."""
    return df.select(*(fn(f).alias(f.name) if where(f) else F.col(f.name) for f in df.schema.fields))


def decode_labelled(df: DataFrame) -> DataFrame:
    """Replace the codes of every labelled column by their labels; a code without a label keeps its digits."""

    def decoded(f: T.StructField) -> Column:
        values = {int(code): text for code, text in f.metadata["values"].items()}
        return lookup(f.name, values, default=col(f.name).cast("string"))

    return map_columns(df, is_labelled, decoded)


def join_value_labels(long: DataFrame, codes: DataFrame, question: str = "question", response: str = "response") -> DataFrame:
    """Label the responses of a long table from a codebook table, one row per (question, code).

    The codebook has as many rows as there are distinct answers, so Spark's own size check decides on a broadcast.
    """
    dim = codes.select(F.col("var_name").alias(question), F.col("code").alias(response), "label", "value_label")
    return long.join(dim, [question, response], "left")


def audit_codes(df: DataFrame, columns: Sequence[str] | None = None, var: str = "var_name", code: str = "code") -> DataFrame:
    """Observed codes against the labels: `var_name`, `code`, `value_label`, `n` and `status` of every labelled column.

    A code is "labelled", "unlabelled" (it would vanish from a table made from the codebook), "unused" (a label without
    answers) or "missing" (null). All columns are counted in one pass: rows are unpivoted in the scan and reduced to the
    codes that occur before anything is shuffled.
    """
    labels = codebook_from_metadata(df)
    names = [f.name for f in df.schema.fields if is_labelled(f) and (columns is None or f.name in columns)]
    tall = df.select(*(F.col(c).cast("long").alias(c) for c in names)).unpivot([], names, var, code)
    seen = tall.groupBy(var, code).agg(F.count(F.lit(1)).alias("n"))
    known = labels.where(F.col("var_name").isin(*names)).select(F.col("var_name").alias("_var"), F.col("code").cast("long").alias("_code"), "value_label")
    both = seen.join(known, (F.col(var) == F.col("_var")) & (F.col(code) == F.col("_code")), "full")
    status = F.when(F.col("n").isNull(), "unused").when(F.col(code).isNull(), "missing").when(F.col("value_label").isNull(), "unlabelled").otherwise("labelled")
    return both.select(
        F.coalesce(var, "_var").alias(var), F.coalesce(code, "_code").alias(code), "value_label", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status")
    )
