"""A survey seen through the order tables: one order is one respondent, its line items are the answers.

Answers come from lineitem in one partially aggregated pass per order. The answer rule depends on the respondent's
party, which lives two joins away, so the pass keeps both candidate answers and the join picks one. Lineitem is
shuffled once, already reduced to a key and a bit mask per order, and meets the orders on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyfx.functions.recode import recode
from surveyfx.sources.codebook import Codebook, Question
from surveyfx.sources.longform import read_wide, to_long, treatment_from_zero

YES_NO = {1: "Yes", 2: "No", 3: "Not sure"}

CODEBOOK = Codebook(
    (
        Question("q1", "First delivery was complete", "Factual", values=YES_NO),
        Question("q2", "Second delivery was late", "Factual", True, YES_NO),
        Question("q3", "Third delivery was insured", "Factual", values=YES_NO),
        Question("q4", "Fourth delivery was inspected", "Factual", values=YES_NO),
        Question("q5", "Fifth delivery was signed for", "Factual", values=YES_NO),
        Question("q6", "Carrier was justified", "Policy", values={1: "Was justified", 2: "Was not justified", 3: "Not sure"}),
        Question("q7", "Carrier should be investigated", "Policy", True, YES_NO),
        Question("q8", "Support ending the contract", "Policy", True, YES_NO),
    )
)

#: Every question but the five-point one, which comes from the order itself, is asked on a line of its own.
LINES = len(CODEBOOK.names) - 1

PARTY = {"Dem": (1, 2, 3), "Rep": (5, 6, 7)}
PARTY3 = {"Dem": (1, 2, 3), "Ind": (4,), "Rep": (5, 6, 7)}


# The columns the survey needs, so that no job is spent on reading file footers for a schema.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_wide(spark, f"{sf_dir}/{name}.parquet", schema=SCHEMAS[name])


def answers(lineitem: DataFrame) -> DataFrame:
    """Per order, the set of answer codes seen on each line, as one bit mask.

    Line j owns six bits: three for the codes that count for respondents outside the party, three for those inside.
    A bit_or over the lines keeps the aggregation buffer and the shuffled row at one long.
    """
    order, flag, supp = F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_suppkey")
    planted = (order % 23 != 0) & (order % 2 == 0) & (flag == "R")
    plain = recode(flag, {1: ("A",), 2: ("N",), 3: ("R",)})
    code = F.when(planted & (supp % 5 == 0), 1).otherwise(plain)
    code_rep = F.when(planted & (supp % 5 == 1), 2).otherwise(code)
    known = lineitem.where((F.col("l_partkey") % 17 != 0) & F.col("l_linenumber").between(1, LINES))
    offset = (F.col("l_linenumber") - 1) * 6
    bits = known.select("l_orderkey", _bit(offset + code - 1).bitwiseOR(_bit(offset + code_rep + 2)).alias("bits"))
    return bits.groupBy("l_orderkey").agg(F.bit_or("bits").alias("bits"))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def _lowest_code(line: int, shift: int) -> str:
    """Smallest answer code whose bit is set for a line; null when the line gave none."""
    at = 6 * (line - 1) + shift
    return "CASE " + " ".join(f"WHEN bits & {1 << (at + k)}L != 0 THEN {k + 1}" for k in range(3)) + " END"


def survey_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table as a survey file would deliver it: raw treatment code, no derived columns."""
    people = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    people = people.join(answers(table(spark, sf_dir, "lineitem")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, pid = F.col("o_orderkey"), F.col("pid7_baseline")
    base = people.withColumn("pid7_baseline", (F.col("c_nationkey") % 8 + 1).cast("int"))
    return base.select(
        key.alias("caseid"),
        F.when(key % 23 != 0, (key % 2).cast("int")).alias("treat_raw"),
        pid,
        F.when(key % 13 == 0, pid % 8 + 1).otherwise(pid).cast("int").alias("pid7"),
        recode(pid, {1: (1, 2, 3), 2: (5, 6, 7), 3: (4,), 4: (8,)}).alias("pid3_baseline"),
        recode("o_orderstatus", {1: ("F",), 2: ("O",), 3: ("P",)}).alias("saw"),
        ((F.col("o_custkey") % 11 + 5) / 10).cast("decimal(18,6)").alias("weight"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("supp"),
        *(
            F.expr(f"CASE WHEN pid7_baseline IN {PARTY['Rep']} THEN {_lowest_code(j, 3)} ELSE {_lowest_code(j, 0)} END AS q{j}")
            for j in range(1, LINES + 1)
        ),
    )


def survey_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned wide table: treatment recoded, five-point item collapsed to an eighth question, labels attached."""
    raw = survey_raw(spark, sf_dir)
    clean = raw.withColumn("treat", treatment_from_zero("treat_raw")).withColumn(
        "q8", recode("supp", {1: (1, 2), 2: (3, 4), 3: (5,)})
    )
    return CODEBOOK.attach(clean.drop("treat_raw"))


def survey_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per randomized respondent and question."""
    wide = survey_wide(spark, sf_dir)
    return to_long(wide.where(F.col("treat").isNotNull()), CODEBOOK.names)
