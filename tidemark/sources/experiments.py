"""An experiment's log derived from orders: each order is a task of one of ten roots, with seven possible events; every root meets another fate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.analogs import table

_R, _I, _ARM = "(o_orderkey % 10)", "(o_orderkey // 10)", "CASE WHEN o_orderkey // 10 % 2 = 0 THEN 'armed' ELSE 'holdback' END"
_OTHER = "CASE WHEN o_orderkey // 10 % 2 = 0 THEN 'holdback' ELSE 'armed' END"
#: Which of an order's events k there are: root 0 only reports, 1 tasks of two arms, 2 leaks and failures, 3 repeated opportunities, 4 attrition, 5 and 6 few tasks, 7 to 9 three outcomes.
_THERE = f"""CASE WHEN {_R} = 0 THEN k = 6 AND {_I} % 5 = 0 WHEN {_R} = 5 AND {_I} >= 30 THEN false WHEN {_R} = 6 AND {_I} >= 100 THEN false WHEN k = 0 THEN {_R} <> 4 OR {_I} % 10 > 0 WHEN k = 3 THEN {_R} <> 4 OR {_I} % 8 <> 1 WHEN k = 4 THEN CASE WHEN {_R} = 4 THEN {_I} % 6 > 0 ELSE {_I} % 25 > 0 END
 WHEN k = 5 THEN CASE {_R} WHEN 1 THEN {_I} % 31 = 0 WHEN 2 THEN {_I} % 7 = 0 WHEN 3 THEN {_I} % 29 = 0 ELSE {_R} > 5 AND {_I} % 11 = 0 END WHEN k = 6 THEN {_R} IN (2, 3) AND {_I} % 50 = 0 ELSE true END"""
_BLIND = f"{_I} // 2 % 10 < CASE {_R} WHEN 7 THEN CASE WHEN {_I} % 2 = 0 THEN 1 ELSE 5 END WHEN 8 THEN CASE WHEN {_I} % 2 = 0 THEN 5 ELSE 1 END ELSE 3 END"
COLUMNS = {
    "root": _R, "ord": "o_orderkey * 10 + k", "ts": f"CASE WHEN {_I} % 13 > 0 THEN o_orderkey * 1000 + k END",
    "name": f"""CASE k WHEN 0 THEN 'coherence.experiment.assigned' WHEN 1 THEN 'coherence.overlap.opportunity' WHEN 2 THEN CASE WHEN {_I} % 2 = 0 THEN 'coherence.overlap.exposed' ELSE 'coherence.overlap.withheld' END WHEN 3 THEN 'coherence.experiment.window_opened'
 WHEN 4 THEN 'coherence.experiment.window_closed' WHEN 5 THEN CASE {_R} WHEN 1 THEN 'coherence.experiment.assigned' WHEN 2 THEN 'coherence.overlap.exposed' WHEN 3 THEN 'coherence.overlap.opportunity' WHEN 9 THEN 'coherence.experiment.window_closed' ELSE 'coherence.experiment.window_opened' END
 ELSE CASE WHEN {_R} = 2 AND {_I} % 100 = 0 THEN 'coherence.experiment.observation_failed' ELSE 'coherence.report' END END""",
    "mode": f"CASE WHEN {_R} = 8 AND {_I} % 20 = 3 THEN 'forced' WHEN k = 6 OR (k = 2 AND {_R} = 7 AND {_I} % 60 = 0) THEN NULL ELSE 'randomized' END",
    "arm": f"CASE WHEN k = 6 THEN NULL WHEN k = 5 AND {_R} = 1 THEN {_OTHER} ELSE {_ARM} END", "experiment_arm": f"CASE WHEN k = 6 THEN {_ARM} END",
    "task": "CONCAT('t', o_orderkey)", "opportunity": f"CASE WHEN k = 6 OR (k = 5 AND {_R} = 6) THEN NULL WHEN k = 5 AND {_R} IN (3, 9) THEN CONCAT('second', o_orderkey) ELSE CONCAT('o', o_orderkey) END",
    "stage": f"CASE WHEN k = 6 THEN CASE WHEN {_R} = 3 THEN 'holdback' ELSE 'delivery' END END", "reason": f"CASE WHEN k = 6 AND {_R} = 2 AND {_I} % 100 = 0 THEN CASE WHEN {_I} % 200 = 0 THEN 'lock_unavailable' ELSE 'state_unavailable' END END",
    "target_read": f"{_I} % 4 > 0", "target_mutation": f"{_I} % 3 > 0", "blind": _BLIND, "first_rank": f"{_I} % 5", "touches": f"{_I} % 9",
    "delivered_pairs": "CASE WHEN k = 6 THEN 3 END", "heldback_changed": f"CASE WHEN k = 6 THEN {_I} % 2 END", "heldback_invalidated": "0",
}
EXPERIMENT_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + f" FROM orders, range(7) t(k) WHERE {_THERE}"


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda e: F.expr(e.replace("//", "div"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).filter(of(_THERE))
    return rows.select(*(of(e).alias(c) for c, e in COLUMNS.items()))
