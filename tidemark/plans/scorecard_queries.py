"""Scorecards of experiments."""

from __future__ import annotations

from tidemark.operators import scorecards
from tidemark.plans.event_queries import _wilson_sql
from tidemark.plans.registry import query
from tidemark.sources.experiments import EXPERIMENT_SQL, experiment

LEGS = {"registered": "overlap.opportunity", "opened": "experiment.window_opened", "closed": "experiment.window_closed", "exposed": "overlap.exposed", "withheld": "overlap.withheld"}


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} END"


def _first(leg: str, what: str) -> str:
    return f"(list({what} ORDER BY ts NULLS LAST, ord) FILTER (name = 'coherence.{LEGS[leg]}'))[1]"


BASE = f"""WITH e AS ({EXPERIMENT_SQL}), forced AS (SELECT DISTINCT root, task FROM e WHERE mode = 'forced'), r AS (SELECT e.*, coalesce(arm, experiment_arm) AS side, f.task IS NOT NULL AS forced, coalesce(mode = 'randomized', false) AND f.task IS NULL AS rnd FROM e LEFT JOIN forced f USING (root, task)),
u AS (SELECT root, side, task, opportunity, {', '.join(f"count(*) FILTER (name = 'coherence.{n}') AS {leg}" for leg, n in LEGS.items())}, {_first('registered', "coalesce(ts, 9e18)")} AS first_ts, {_first('registered', 'ord')} AS at_ord,
 {_first('closed', 'target_read')} AS target_read, {_first('closed', 'target_mutation')} AS target_mutation, {_first('closed', 'blind')} AS blind, {_first('closed', 'first_rank')} AS first_rank, {_first('closed', 'touches')} AS touches
 FROM r WHERE rnd AND side IS NOT NULL AND opportunity IS NOT NULL AND name IN ({', '.join(f"'coherence.{n}'" for n in LEGS.values())}) GROUP BY 1, 2, 3, 4),
firsts AS (SELECT * FROM u WHERE registered > 0 QUALIFY row_number() OVER (PARTITION BY root, side, task ORDER BY first_ts, at_ord) = 1),
t AS (SELECT root, side, task, count(*) FILTER (registered > 0) AS registrations, bool_or(registered > 0) AS eligible, bool_or(opened > 0) AS any_opened, bool_or(closed > 0) AS any_closed, bool_or(exposed > 0) AS any_exposed, bool_or(withheld > 0) AS any_withheld FROM u GROUP BY 1, 2, 3),
assigned AS (SELECT DISTINCT root, arm AS side, task FROM r WHERE name = 'coherence.experiment.assigned' AND rnd),
w AS (SELECT root, side, count(*) FILTER (registered > 0) AS registered, count(*) FILTER (registered > 0 AND opened > 0) AS opened, count(*) FILTER (registered > 0 AND closed > 0) AS closed, count(*) FILTER (registered > 0 AND CASE WHEN side = 'armed' THEN exposed ELSE withheld END > 0) AS compliant FROM u GROUP BY 1, 2),
p AS (SELECT root, side, count(*) FILTER (a.task IS NOT NULL) AS assigned_tasks, count(*) FILTER (eligible) AS opportunity_tasks, count(*) FILTER (eligible AND a.task IS NOT NULL) AS assigned_eligible, count(*) FILTER (eligible AND any_opened) AS opened_tasks, count(*) FILTER (eligible AND any_closed) AS closed_tasks,
 count(*) FILTER (eligible AND CASE WHEN side = 'armed' THEN any_exposed ELSE any_withheld END) AS compliant_tasks FROM t FULL JOIN assigned a USING (root, side, task) GROUP BY 1, 2),
o AS (SELECT root, side, count(*) AS tasks, count(*) FILTER (blind) AS blind, count(*) FILTER (target_read) AS reads, count(*) FILTER (target_mutation) AS mutations, count(*) FILTER (target_mutation AND NOT blind) AS read_first, avg(first_rank) FILTER (first_rank > 0) AS mean_rank, avg(touches) AS mean_touches FROM firsts WHERE closed > 0 GROUP BY 1, 2),
arms AS (SELECT s.root, arm, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'tasks assigned_tasks opportunity_tasks assigned_eligible opened_tasks closed_tasks compliant_tasks registered opened closed compliant blind reads mutations read_first'.split())}, mean_rank, mean_touches
 FROM (SELECT DISTINCT root, unnest(['armed', 'holdback']) AS arm FROM e) s LEFT JOIN w ON w.root = s.root AND w.side = arm LEFT JOIN p ON p.root = s.root AND p.side = arm LEFT JOIN o ON o.root = s.root AND o.side = arm),
rates AS (SELECT *, {_ratio('assigned_eligible', 'opportunity_tasks')} AS assignment_coverage, {_ratio('assigned_eligible', 'assigned_tasks')} AS assignment_to_opportunity, {_ratio('opened', 'registered')} AS open_rate, {_ratio('closed', 'registered')} AS closure_rate, {_ratio('closed', 'opened')} AS opened_closure_rate,
 {_ratio('compliant', 'registered')} AS compliance_rate, {_ratio('blind', 'tasks')} AS blind_rate, {_ratio('reads', 'tasks')} AS read_rate, {_ratio('mutations', 'tasks')} AS mutation_rate, {_ratio('read_first', 'mutations')} AS read_first_rate,
 CASE WHEN tasks > 0 THEN {_wilson_sql('blind', 'tasks', '-')} END AS blind_low, CASE WHEN tasks > 0 THEN {_wilson_sql('blind', 'tasks', '+')} END AS blind_high FROM arms)"""


@query(f"{BASE} SELECT * FROM rates")
def experiment_arms(spark, sf_dir):
    """Both arms of each root: tasks, windows, rates, outcomes."""
    return scorecards.experiment_scorecard(experiment(spark, sf_dir))[1]


def _gate(rate: str, least: str, name: str) -> str:
    return f"CASE WHEN {rate} IS NULL OR {rate} < {least} THEN arm || ' {name} below {least}' END"


COUNTS = """arm_flips forced_tasks missing_mode failures control_leaks claim_holdbacks malformed_assignments malformed_registered malformed_opened malformed_closed duplicate_assignments registered_units opened_units closed_units exposed_units withheld_units
open_units duplicate_registered duplicate_opened duplicate_closed orphan_opened orphan_closed orphan_compliance repeated_tasks repeated_units""".split()


@query(f"""{BASE}, gates AS (SELECT root, arm, greatest(assigned_tasks, opportunity_tasks) >= 40 AS enough, coalesce(closure_rate, 0) AS closure, list_filter([{_gate('assignment_coverage', '0.95', 'assignment coverage')}, {_gate('assignment_to_opportunity', '0.95', 'assignment-to-opportunity coverage')}, {_gate('open_rate', '0.95', 'window-open coverage')},
 {_gate('closure_rate', '0.9', 'window-closure coverage')}, {_gate('compliance_rate', '0.95', 'intervention compliance')}], lambda x: x IS NOT NULL) AS failures FROM rates),
attrition AS (SELECT a.root, CASE WHEN a.enough AND h.enough THEN a.failures || h.failures || CASE WHEN abs(a.closure - h.closure) > 0.05 THEN ['differential window closure exceeds 0.05'] ELSE [] END ELSE [] END AS attrition FROM gates a JOIN gates h ON a.root = h.root AND a.arm = 'armed' AND h.arm = 'holdback'),
sides AS (SELECT root, task, count(DISTINCT side) > 1 AS flipped FROM r WHERE rnd AND side IS NOT NULL GROUP BY 1, 2), flips AS (SELECT root, count(*) FILTER (flipped) AS arm_flips FROM sides GROUP BY 1),
counted AS (SELECT root, count(DISTINCT task) FILTER (mode = 'forced') AS forced_tasks, count(*) FILTER (mode IS NULL AND name <> 'coherence.report' AND name <> 'coherence.experiment.observation_failed') AS missing_mode, count(*) FILTER (name = 'coherence.experiment.observation_failed') AS failures,
 count(*) FILTER (rnd AND name = 'coherence.overlap.exposed' AND arm = 'holdback') + count(*) FILTER (name = 'coherence.report' AND stage = 'delivery' AND experiment_arm = 'holdback' AND NOT forced AND delivered_pairs > 0 AND (root, task) IN (SELECT root, task FROM sides)) AS control_leaks,
 count(*) FILTER (name = 'coherence.report' AND stage = 'holdback' AND (heldback_changed > 0 OR heldback_invalidated > 0)) AS claim_holdbacks, 0::BIGINT AS malformed_assignments, {', '.join(f"count(*) FILTER (rnd AND name = 'coherence.{LEGS[k]}' AND opportunity IS NULL) AS malformed_{k}" for k in ('registered', 'opened', 'closed'))},
 count(*) FILTER (rnd AND name = 'coherence.experiment.assigned') - count(DISTINCT side || task) FILTER (rnd AND name = 'coherence.experiment.assigned') AS duplicate_assignments FROM r GROUP BY 1),
whole AS (SELECT root, {', '.join(f"count(*) FILTER (registered > 0 AND {k} > 0) AS {k}_units" for k in LEGS)}, count(*) FILTER (registered > 0 AND opened > 0 AND closed = 0) AS open_units, {', '.join(f"coalesce(sum({k} - 1) FILTER ({k} > 0), 0)::BIGINT AS duplicate_{k}" for k in ('registered', 'opened', 'closed'))},
 {', '.join(f"count(*) FILTER (registered = 0 AND {k} > 0) AS orphan_{k}" for k in ('opened', 'closed'))}, count(*) FILTER (registered = 0 AND (exposed > 0 OR withheld > 0)) AS orphan_compliance FROM u GROUP BY 1),
repeated AS (SELECT root, count(*) FILTER (registrations > 1) AS repeated_tasks, coalesce(sum(registrations - 1) FILTER (registrations > 1), 0)::BIGINT AS repeated_units FROM t GROUP BY 1),
x AS (SELECT d.root, attrition, a.tasks AS a_tasks, h.tasks AS h_tasks, a.opportunity_tasks + h.opportunity_tasks AS begun, h.blind_rate - a.blind_rate AS delta, h.blind_low - a.blind_high AS delta_low, h.blind_high - a.blind_low AS delta_high
 FROM attrition d JOIN rates a ON a.root = d.root AND a.arm = 'armed' JOIN rates h ON h.root = d.root AND h.arm = 'holdback'),
y AS (SELECT x.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTS)} FROM x LEFT JOIN flips USING (root) LEFT JOIN counted USING (root) LEFT JOIN whole USING (root) LEFT JOIN repeated USING (root)),
z AS (SELECT *, CASE WHEN arm_flips > 0 OR control_leaks > 0 OR claim_holdbacks > 0 OR repeated_tasks > 0 OR failures > 0 THEN 'INVESTIGATE' WHEN len(attrition) > 0 THEN 'ATTRITION_HOLD' WHEN begun = 0 THEN 'DORMANT' WHEN a_tasks >= 150 AND h_tasks >= 150 THEN 'CREDIBLE_READ' WHEN a_tasks >= 40 AND h_tasks >= 40 THEN 'PILOT_READY' ELSE 'ACCRUING' END AS status FROM y)
SELECT * EXCLUDE (a_tasks, h_tasks, begun), CASE status WHEN 'INVESTIGATE' THEN 'EXPERIMENT_INTEGRITY_FAILURE' WHEN 'ATTRITION_HOLD' THEN 'EXPERIMENT_ATTRITION_FAILURE' WHEN 'CREDIBLE_READ' THEN CASE WHEN delta_low > 0 THEN 'ARMED_REDUCES_BLIND_TARGET_MUTATION' WHEN delta_high < 0 THEN 'ARMED_INCREASES_BLIND_TARGET_MUTATION' ELSE 'INCONCLUSIVE_BEHAVIOR_SHIFT' END ELSE 'NOT_ENOUGH_DATA' END AS interpretation FROM z""")
def experiment_status(spark, sf_dir):
    """Each root's status and what it says: integrity first, then attrition, then how many tasks there are."""
    return scorecards.experiment_scorecard(experiment(spark, sf_dir))[0]
