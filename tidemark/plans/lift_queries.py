"""The lift of surfaced files over sets of like sizes that other sessions were given."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lift
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import STEPS_SQL


def _stir(seed: int, *parts: str) -> str:
    state = f"{seed}::BIGINT"
    for part in parts:
        for factor in (48271, 69621):
            state = f"((({state}) + {part}) % 2147483647 * {factor} % 2147483647)"
    return state


#: Sessions of seven repositories; every set of retrieved files, in order of its slots, without those of every fifth order's later slots.
INPUT = f"""steps AS (SELECT * FROM ({STEPS_SQL})), sets AS (SELECT sid % 7 AS repo, sid, ord, list(path ORDER BY slot) AS files, count(*) AS size FROM steps WHERE kind = 'inject' AND mode = 'retrieval' GROUP BY ALL),
ends AS (SELECT sid, ord, array_to_string(parts[k:], '/') AS path FROM (SELECT sid, ord, string_split(path, '/') AS parts FROM steps WHERE kind = 'open'), unnest(range(1, len(parts) + 1)) t(k)), last AS (SELECT sid, path, max(ord) AS last FROM ends GROUP BY 1, 2)"""


def _placed(window: int | None) -> str:
    stratum = f"(row_number() OVER (PARTITION BY repo ORDER BY size, sid, ord) - 1) // {window}" if window else "0"
    return f"""ranked AS (SELECT *, {stratum} AS stratum FROM sets), placed AS (SELECT *, row_number() OVER (PARTITION BY repo, stratum ORDER BY sid, ord) - 1 AS place, count(*) OVER (PARTITION BY repo, stratum) AS pool,
 count(*) OVER (PARTITION BY repo, stratum, sid) AS mine FROM ranked), firsts AS (SELECT *, min(place) OVER (PARTITION BY repo, stratum, sid) AS own FROM placed),
numbers AS (SELECT repo, stratum, sid, ord, size, own, mine, pool, round, {_stir(lift.SEED, 'sid', 'ord', 'round')} % CASE WHEN pool > mine THEN pool - mine ELSE pool END AS n FROM firsts, range(1, 201) r(round)),
given AS (SELECT d.sid, d.ord, d.size, d.round, p.files, p.size AS drawn_size FROM numbers d JOIN placed p ON p.repo = d.repo AND p.stratum = d.stratum AND p.place = CASE WHEN d.pool > d.mine AND d.n >= d.own THEN d.n + d.mine ELSE d.n END)"""


def _lift_sql(window: int | None, resize: bool) -> str:
    slots = f"SELECT sid, ord, files[CASE WHEN size = drawn_size THEN slot ELSE {_stir(lift.SEED, 'sid', 'ord', 'round', 'slot')} % drawn_size + 1 END] AS path FROM given, unnest(range(1, size + 1)) t(slot)" if resize else "SELECT sid, ord, unnest(files) AS path FROM given"
    count = "count(*) AS {0}surfaced, coalesce(sum((last > t.ord)::INTEGER), 0)::BIGINT AS {0}opened"
    return f"""WITH {INPUT}, {_placed(window)}, real AS (SELECT {count.format('')} FROM (SELECT sid, ord, unnest(files) AS path FROM sets) t LEFT JOIN last USING (sid, path)),
null_files AS ({slots}), nulls AS (SELECT {count.format('null_')} FROM null_files t LEFT JOIN last USING (sid, path)), shares AS (SELECT *, 100 * opened / surfaced AS a, 100 * null_opened / null_surfaced AS b FROM real, nulls)
SELECT surfaced, opened, null_surfaced, null_opened, round(a, 2) AS actual_pct, round(b, 2) AS null_pct, round(a / b, 2) AS lift FROM shares"""


def _input(spark, sf_dir):
    steps = analogs.steps(spark, sf_dir)
    shown = steps.filter("kind = 'inject' AND mode = 'retrieval'").groupBy((F.col("sid") % 7).alias("repo"), "sid", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "path"))), lambda x: x["path"]).alias("files"))
    return shown, steps.filter("kind = 'open'").select("sid", "ord", "path")


@query(_lift_sql(None, False))
def session_lift(spark, sf_dir):
    """200 rounds against any set of another session of the repository."""
    return lift.lift(*_input(spark, sf_dir), window=None, resize=False)


@query(_lift_sql(lift.WINDOW, True))
def size_matched_lift(spark, sf_dir):
    """200 rounds against sets of like sizes, brought to the real size."""
    return lift.lift(*_input(spark, sf_dir))
