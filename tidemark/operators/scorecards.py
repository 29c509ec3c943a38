"""The experiment's scorecard: opportunities of tasks, the windows opened and closed for them and what was shown or held back, by arm, with gates of integrity and attrition.

events: root, ord (place in the log), ts (may be null: last), name, mode, arm,
experiment_arm, task, opportunity, stage, reason, target_read, target_mutation, blind,
first_rank, touches, delivered_pairs, heldback_changed, heldback_invalidated. Each root has
a scorecard of its own. Exact opportunities are units of the protocol, tasks with their
first registered opportunity those of the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.statistics import wilson
from tidemark.sources.shared import written

#: Names of events, and what the gates ask.
PREFIX = "coherence."
ASSIGNED, OPPORTUNITY, EXPOSED, WITHHELD, OPENED, CLOSED, FAILED = (PREFIX + n for n in ("experiment.assigned", "overlap.opportunity", "overlap.exposed", "overlap.withheld", "experiment.window_opened", "experiment.window_closed", "experiment.observation_failed"))
REPORT, ARMS = PREFIX + "report", ["armed", "holdback"]
PILOT, CREDIBLE = 40, 150
LEAST_ASSIGNED, LEAST_OPENED, LEAST_CLOSED, LEAST_COMPLIANT, MOST_DIFFERENCE = 0.95, 0.95, 0.90, 0.95, 0.05

#: Names of the events that units count, and their short names.
LEGS = {"registered": OPPORTUNITY, "opened": OPENED, "closed": CLOSED, "exposed": EXPOSED, "withheld": WITHHELD}


def _some(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _count(c: str) -> Column:
    return F.when(F.col(c) > 0, F.floor(c)).otherwise(0)


def _is(name: str) -> Column:
    return F.col("name") == name


def relevant(events: DataFrame) -> DataFrame:
    """The experiment's events, with randomized (by mode, and no event of the task was forced), the arm they go by, and order in the log."""
    own = events.filter(F.col("name").startswith(PREFIX + "experiment.") | F.col("name").startswith(PREFIX + "overlap.") | (_is(REPORT) & F.col("stage").isin("delivery", "holdback")))
    own = own.withColumns({"task": _some("task"), "opportunity": _some("opportunity"), "by": F.coalesce(_some("arm"), _some("experiment_arm"))})
    forced = own.filter("mode = 'forced' and task is not null").select("root", "task").distinct().withColumn("forced", F.lit(True))
    marked = own.join(forced, ["root", "task"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    return marked.withColumns({"randomized": F.coalesce(F.col("mode") == "randomized", F.lit(False)) & ~F.col("forced"), "order": F.struct(F.col("ts").isNull(), "ts", "ord")})


def units(rows: DataFrame) -> DataFrame:
    """One row for each exact opportunity (root, by, task, opportunity): how many events of each leg it has, the first registration and the first close."""
    exact = rows.filter(F.col("randomized") & F.col("by").isin(ARMS) & F.col("task").isNotNull() & F.col("opportunity").isNotNull() & F.col("name").isin(*LEGS.values()))
    outcome = F.struct("target_read", "target_mutation", "blind", "first_rank", "touches")
    first = lambda what, name: F.min_by(F.when(_is(name), what), F.when(_is(name), F.col("order")))
    return exact.groupBy("root", "by", "task", "opportunity").agg(
        *(F.count_if(_is(name)).alias(leg) for leg, name in LEGS.items()), F.min(F.when(_is(OPPORTUNITY), F.col("order"))).alias("order"),
        F.coalesce(first(F.col("arm"), OPPORTUNITY) == F.col("by"), F.lit(False)).alias("own_arm"), first(outcome, CLOSED).alias("outcome"),
    )


def tasks(unit_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each task of an arm (root, by, task): its registrations, which legs any of its units has, whether it was assigned, and the outcome of its first registered unit."""
    has = lambda leg: F.max(F.col(leg) > 0).alias(f"any_{leg}")
    own = unit_rows.groupBy("root", "by", "task").agg(
        F.count_if(F.col("registered") > 0).alias("registrations"), F.max(F.col("own_arm") & (F.col("registered") > 0)).alias("eligible"), *map(has, ("opened", "closed", "exposed", "withheld")),
        F.min_by(F.when(F.col("registered") > 0, F.struct("outcome")), F.when(F.col("registered") > 0, F.col("order"))).alias("first"),
    )
    assigned = rows.filter(_is(ASSIGNED) & F.col("randomized") & F.col("arm").isin(ARMS) & F.col("task").isNotNull()).select("root", F.col("arm").alias("by"), "task").distinct().withColumn("assigned", F.lit(True))
    return own.join(assigned, ["root", "by", "task"], "full_outer").withColumn("outcome", F.col("first.outcome")).na.fill(False, ["eligible", "any_opened", "any_closed", "any_exposed", "any_withheld", "assigned"]).na.fill(0, ["registrations"])


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def arms(unit_rows: DataFrame, task_rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Two rows for each root: the arm's tasks and windows, its rates, and outcomes of closed tasks with the interval of blind mutations."""
    every = roots.select("root").distinct().select("root", F.explode(F.array(*map(F.lit, ARMS))).alias("arm"))
    compliant = lambda c: F.when(F.col("by") == "armed", F.col(f"{c}exposed")).otherwise(F.col(f"{c}withheld"))
    there = F.col("registered") > 0
    windows = unit_rows.groupBy("root", F.col("by").alias("arm")).agg(F.count_if(there).alias("registered"), F.count_if(there & (F.col("opened") > 0)).alias("opened"), F.count_if(there & (F.col("closed") > 0)).alias("closed"), F.count_if(there & (compliant("") > 0)).alias("compliant"))
    done, eligible = F.col("outcome").isNotNull(), F.col("eligible")
    flag = lambda c: F.count_if(done & F.coalesce(F.col(f"outcome.{c}"), F.lit(False)))
    rank = F.when(F.col("outcome.first_rank") > 0, F.col("outcome.first_rank"))
    people = task_rows.groupBy("root", F.col("by").alias("arm")).agg(
        F.count_if(done).alias("tasks"), F.count_if("assigned").alias("assigned_tasks"), F.count_if(eligible).alias("opportunity_tasks"), F.count_if(eligible & F.col("assigned")).alias("assigned_eligible"), F.count_if(eligible & F.col("any_opened")).alias("opened_tasks"),
        F.count_if(eligible & F.col("any_closed")).alias("closed_tasks"), F.count_if(eligible & compliant("any_")).alias("compliant_tasks"), flag("blind").alias("blind"), flag("target_read").alias("reads"), flag("target_mutation").alias("mutations"),
        F.count_if(done & F.coalesce(F.col("outcome.target_mutation"), F.lit(False)) & ~F.coalesce(F.col("outcome.blind"), F.lit(False))).alias("read_first"), F.avg(F.when(done, rank)).alias("mean_rank"), F.avg(F.when(done, F.when(F.col("outcome.touches") > 0, F.col("outcome.touches")).otherwise(0))).alias("mean_touches"),
    )
    counts = [c for t in (windows, people) for c in t.columns[2:] if not c.startswith("mean")]
    rows = every.join(windows, ["root", "arm"], "left").join(people, ["root", "arm"], "left").na.fill(0, counts)
    rates = {
        "assignment_coverage": ("assigned_eligible", "opportunity_tasks"), "assignment_to_opportunity": ("assigned_eligible", "assigned_tasks"), "open_rate": ("opened", "registered"), "closure_rate": ("closed", "registered"), "opened_closure_rate": ("closed", "opened"),
        "compliance_rate": ("compliant", "registered"), "blind_rate": ("blind", "tasks"), "read_rate": ("reads", "tasks"), "mutation_rate": ("mutations", "tasks"), "read_first_rate": ("read_first", "mutations"),
    }
    low, high = wilson(F.col("blind"), F.col("tasks"))
    return rows.withColumns({k: _ratio(*v) for k, v in rates.items()}).withColumns({"blind_low": low, "blind_high": high})


def _failures() -> Column:
    """What attrition the arms show, once both have tasks enough for a pilot."""
    out = []
    for arm in ARMS:
        of = F.col(arm)
        for rate, least, name in (
            ("assignment_coverage", LEAST_ASSIGNED, "assignment coverage"), ("assignment_to_opportunity", LEAST_ASSIGNED, "assignment-to-opportunity coverage"), ("open_rate", LEAST_OPENED, "window-open coverage"),
            ("closure_rate", LEAST_CLOSED, "window-closure coverage"), ("compliance_rate", LEAST_COMPLIANT, "intervention compliance"),
        ):
            out.append(F.when(of[rate].isNull() | (of[rate] < least), f"{arm} {name} below {least:g}"))
    apart = F.abs(F.coalesce(F.col("armed")["closure_rate"], F.lit(0.0)) - F.coalesce(F.col("holdback")["closure_rate"], F.lit(0.0))) > MOST_DIFFERENCE
    out.append(F.when(apart, "differential window closure exceeds 0.05"))
    enough = [F.greatest(F.col(a)["assigned_tasks"], F.col(a)["opportunity_tasks"]) >= PILOT for a in ARMS]
    return F.when(enough[0] & enough[1], F.array_compact(F.array(*out))).otherwise(F.array().cast("array<string>"))


def experiment_scorecard(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scorecard of each root, and its arms."""
    # each is read several times
    rows = written(relevant(events), "experiment")
    unit_rows = written(units(rows), "experiment-units")
    task_rows = written(tasks(unit_rows, rows), "experiment-tasks")
    by_arm = arms(unit_rows, task_rows, events)

    exact = F.col("by").isin(ARMS) & F.col("task").isNotNull() & F.col("opportunity").isNotNull()
    assigned = F.col("by").isin(ARMS) & F.col("task").isNotNull()
    leg = lambda name: F.col("randomized") & _is(name)
    causal = F.col("name").isin(ASSIGNED, *LEGS.values())
    # a report delivers overlaps to a task of the held-back arm that some randomized event names
    both = rows.filter(F.col("randomized") & assigned).groupBy("root", "task").agg((F.count_distinct("by") > 1).alias("flipped"))
    leaks = rows.filter(_is(REPORT) & (F.col("stage") == "delivery") & (F.col("experiment_arm") == "holdback") & ~F.col("forced") & (_count("delivered_pairs") > 0)).join(both.select("root", "task"), ["root", "task"], "left_semi")
    counted = rows.groupBy("root").agg(
        F.count_distinct(F.when(F.col("mode") == "forced", F.col("task"))).alias("forced_tasks"), F.count_if(causal & F.col("mode").isNull()).alias("missing_mode"), F.count_if(leg(EXPOSED) & (F.col("arm") == "holdback")).alias("exposed_leaks"), F.count_if(_is(FAILED)).alias("failures"),
        F.count_if(_is(REPORT) & (F.col("stage") == "holdback") & ((_count("heldback_changed") > 0) | (_count("heldback_invalidated") > 0))).alias("claim_holdbacks"), F.count_if(leg(ASSIGNED) & assigned).alias("valid_assignments"), F.count_if(leg(ASSIGNED) & ~F.coalesce(assigned, F.lit(False))).alias("malformed_assignments"),
        *(F.count_if(leg(name) & ~F.coalesce(exact, F.lit(False))).alias(f"malformed_{k}") for k, name in LEGS.items() if k in ("registered", "opened", "closed")), F.count_distinct(F.when(leg(ASSIGNED) & assigned, F.struct("by", "task"))).alias("unique_assignments"),
    )
    some = lambda k: F.col(k) > 0
    whole = unit_rows.groupBy("root").agg(
        *(F.count_if(some("registered") & some(k)).alias(f"{k}_units") for k in LEGS), F.count_if(some("registered") & some("opened") & ~some("closed")).alias("open_units"),
        *(F.sum(F.when(some(k), F.col(k) - 1)).alias(f"duplicate_{k}") for k in ("registered", "opened", "closed")), *(F.count_if(~some("registered") & some(k)).alias(f"orphan_{k}") for k in ("opened", "closed")),
        F.count_if(~some("registered") & (some("exposed") | some("withheld"))).alias("orphan_compliance"),
    )
    repeated = task_rows.groupBy("root").agg(F.count_if(F.col("registrations") > 1).alias("repeated_tasks"), F.sum(F.when(F.col("registrations") > 1, F.col("registrations") - 1)).alias("repeated_units"))
    wide = by_arm.groupBy("root").agg(*(F.first(F.when(F.col("arm") == a, F.struct(*by_arm.columns[2:])), ignorenulls=True).alias(a) for a in ARMS))
    out = wide.join(both.groupBy("root").agg(F.count_if("flipped").alias("arm_flips")), "root", "left").join(leaks.groupBy("root").agg(F.count("*").alias("report_leaks")), "root", "left")
    for more in (counted, whole, repeated):
        out = out.join(more, "root", "left")
    out = out.na.fill(0).withColumn("control_leaks", F.col("exposed_leaks") + F.col("report_leaks")).withColumn("attrition", _failures())
    least = lambda n: (F.col("armed")["tasks"] >= n) & (F.col("holdback")["tasks"] >= n)
    broken = (F.col("arm_flips") > 0) | (F.col("control_leaks") > 0) | (F.col("claim_holdbacks") > 0) | (F.col("repeated_tasks") > 0) | (F.col("failures") > 0)
    begun = (F.col("armed")["opportunity_tasks"] > 0) | (F.col("holdback")["opportunity_tasks"] > 0)
    status = F.when(broken, "INVESTIGATE").when(F.size("attrition") > 0, "ATTRITION_HOLD").when(~begun, "DORMANT").when(least(CREDIBLE), "CREDIBLE_READ").when(least(PILOT), "PILOT_READY").otherwise("ACCRUING")
    out = out.withColumns({
        "status": status, "delta": F.col("holdback")["blind_rate"] - F.col("armed")["blind_rate"], "delta_low": F.col("holdback")["blind_low"] - F.col("armed")["blind_high"], "delta_high": F.col("holdback")["blind_high"] - F.col("armed")["blind_low"],
    })
    read = F.when(F.col("delta_low") > 0, "ARMED_REDUCES_BLIND_TARGET_MUTATION").when(F.col("delta_high") < 0, "ARMED_INCREASES_BLIND_TARGET_MUTATION").otherwise("INCONCLUSIVE_BEHAVIOR_SHIFT")
    told = F.when(F.col("status") == "INVESTIGATE", "EXPERIMENT_INTEGRITY_FAILURE").when(F.col("status") == "ATTRITION_HOLD", "EXPERIMENT_ATTRITION_FAILURE").when(F.col("status") == "CREDIBLE_READ", read).otherwise("NOT_ENOUGH_DATA")
    duplicates = {"duplicate_assignments": F.col("valid_assignments") - F.col("unique_assignments")}
    return out.withColumn("interpretation", told).withColumns(duplicates).drop("valid_assignments", "unique_assignments", "exposed_leaks", "report_leaks", *ARMS), by_arm
