"""Registered queries over pulses, states, traits and flags of entities, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import development
from .queries_lake import query, slices


def _summary_sql() -> str:
    """The rules over lists, positions from 1."""
    vote = " + ".join(f"CASE WHEN list_contains({m}, i) THEN 1 ELSE 0 END" for m in ("m1", "m2", "m3", "m4"))
    return f""", dl AS (SELECT fire_id, list(ring_area_km2 ORDER BY slice_index) AS v, list(timestamp ORDER BY slice_index) AS t, list(cumulative_area_km2 ORDER BY slice_index) AS c, CAST(count(*) AS INTEGER) AS n FROM sl GROUP BY 1),
da AS (SELECT *, list_max(v) AS peak, CAST(list_position(v, list_max(v)) AS INTEGER) AS pk, range(1, n + 1) AS s, list_sort(v) AS so FROM dl),
db AS (SELECT *, so[CAST(floor(0.75 * (n - 1)) AS INTEGER) + 1] + (0.75 * (n - 1) - floor(0.75 * (n - 1))) * (so[least(CAST(floor(0.75 * (n - 1)) AS INTEGER) + 2, n)] - so[CAST(floor(0.75 * (n - 1)) AS INTEGER) + 1]) AS pct,
       list_filter(s, lambda i: (i = 1 OR v[i] >= v[greatest(i - 1, 1)]) AND (i = n OR v[i] >= v[least(i + 1, n)])) AS loc,
       list_transform(list_filter(s, lambda i: i > 1 AND v[greatest(i - 1, 1)] < v[i]), lambda i: {{'a': i, 'b': coalesce(list_min(list_filter(s, lambda j: j > i AND v[j] <> v[i])), n + 1)}}) AS runs FROM da),
dc AS (SELECT *, list_transform(list_filter(runs, lambda r: r.b <= n AND v[least(r.b, n)] < v[r.a]), lambda r: (r.a + r.b - 1) // 2) AS mids FROM db),
dd AS (SELECT *, list_filter(loc, lambda i: v[i] >= 0.1) AS m1, list_filter(loc, lambda i: v[i] >= pct) AS m2,
       list_distinct(list_concat(list_filter(loc, lambda i: v[i] >= 0.25 * peak), CASE WHEN peak > 0 THEN [pk] ELSE [] END)) AS m3,
       CASE WHEN n >= 3 AND peak > 0 THEN list_filter(mids, lambda p: v[p] - greatest(list_min(v[coalesce(list_max(list_filter(s, lambda j: j < p AND v[j] > v[p])), 0) + 1:p]), list_min(v[p:coalesce(list_min(list_filter(s, lambda j: j > p AND v[j] > v[p])), n + 1) - 1])) >= greatest(0.2 * peak, 1e-9)) ELSE [] END AS m4,
       greatest(0.1, 0.25 * peak) AS thr FROM dc),
de AS (SELECT *, list_transform(s, lambda i: {vote}) AS votes, list_filter(s, lambda i: v[i] >= thr) AS act FROM dd),
df AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(s, lambda i: votes[i] >= 2), [pk]))) AS pulses, coalesce(list_max(act), pk) AS fin FROM de),
dg AS (SELECT *, coalesce(list_min(list_filter(s, lambda i: i > fin AND i + 1 <= n AND v[i] <= thr AND v[least(i + 1, n)] <= thr)), CASE WHEN fin < n THEN fin + 1 END) AS quiet FROM df),
dv AS (SELECT *, CASE WHEN quiet IS NULL THEN [] ELSE list_filter(pulses, lambda i: i > quiet) END AS again FROM dg)"""


SUMMARY_SQL = _summary_sql()
_HIT = "array_to_string(list_filter([CASE WHEN list_contains(m1, i) THEN 'fixed_absolute' END, CASE WHEN list_contains(m2, i) THEN 'within_fire_percentile' END, CASE WHEN list_contains(m3, i) THEN 'fraction_of_peak' END, CASE WHEN list_contains(m4, i) THEN 'prominence' END], lambda x: x IS NOT NULL), ',')"


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return development.pulse_summary(slices(spark, sf_dir))


@query("pulse_events", SUMMARY_SQL + f""", ev AS (SELECT *, 'first observed perimeter' AS k, 1 AS i, 'observed' AS conf, false AS named FROM dv
UNION ALL SELECT *, 'peak expansion', pk, 'observed maximum geometric activity', true FROM dv UNION ALL SELECT *, 'final meaningful expansion', fin, 'threshold-defined final active observation', true FROM dv
UNION ALL SELECT *, 'terminal observed record', n, 'dataset-observed ending; not physical extinction', false FROM dv
UNION ALL SELECT *, 'transition into geometric quiescence', quiet, 'rule-based sustained low activity', false FROM dv WHERE quiet IS NOT NULL
UNION ALL SELECT * EXCLUDE (i), 'expansion pulse', i, concat(votes[i], '/4 threshold methods'), true FROM (SELECT *, unnest(pulses) AS i FROM dv)
UNION ALL SELECT * EXCLUDE (i), 'reactivation after quiescence', i, concat(votes[i], '/4 threshold methods after quiescence'), true FROM (SELECT *, unnest(again) AS i FROM dv))
SELECT fire_id, k AS event_type, CAST(i - 1 AS INTEGER) AS observation_index, CAST(t[i] AS VARCHAR) AS calendar_date, round(v[i], 6) AS activity_magnitude, round(CASE WHEN peak > 0 THEN v[i] / peak END, 6) AS activity_relative_to_peak, conf AS confidence, CASE WHEN named THEN {_HIT} ELSE '' END AS methods FROM ev""")
def pulse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return development.pulse_events(_summary(spark, sf_dir)).withColumn("calendar_date", F.col("calendar_date").cast("string"))


@query("developmental_states", SUMMARY_SQL + """, st AS (SELECT *, unnest(s) AS i FROM dv)
SELECT fire_id, CAST(i - 1 AS INTEGER) AS slice_index, CASE WHEN quiet IS NOT NULL AND i >= quiet THEN CASE WHEN v[i] >= greatest(thr, 0.25 * peak) THEN 'reactivation' ELSE 'quiescence' END WHEN v[i] >= 0.5 * peak THEN 'major expansion' WHEN v[i] >= greatest(thr, 0.25 * peak) THEN 'active expansion' ELSE 'low activity' END AS developmental_state,
list_contains(pulses, i) AS is_expansion_pulse, i = pk AS is_peak_expansion, i = fin AS is_final_meaningful_expansion, coalesce(i = quiet, false) AS is_quiescence_onset FROM st""")
def developmental_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return development.developmental_states(_summary(spark, sf_dir))


_MED = "({x}[(len({x}) + 1) // 2] + {x}[(len({x}) + 2) // 2]) / 2.0"
TRAITS_SQL = SUMMARY_SQL + f""", tq AS (SELECT *, c[n] AS tot, CASE WHEN len(pulses) > 1 THEN list_sort(list_transform(range(2, len(pulses) + 1), lambda i: CAST(pulses[i] - pulses[i - 1] AS DOUBLE))) ELSE [] END AS btw FROM dv),
dt AS (SELECT fire_id, round(tot, 6) AS final_area_km2, n AS observation_count, CAST(len(act) AS INTEGER) AS number_of_active_observations, round(len(act) / n, 6) AS active_fraction, round(peak, 6) AS peak_expansion_magnitude_km2,
round(CASE WHEN n > 1 THEN (pk - 1) / (n - 1) ELSE 0.5 END, 6) AS timing_of_peak_expansion_relative_age, round(CASE WHEN n > 1 THEN (fin - 1) / (n - 1) ELSE 0.5 END, 6) AS final_meaningful_expansion_relative_age, CAST(len(pulses) AS INTEGER) AS number_of_expansion_pulses,
round(list_max(list_transform(pulses, lambda i: v[i])) - {_MED.format(x='so')}, 6) AS pulse_prominence_km2, round(CASE WHEN len(btw) > 0 THEN {_MED.format(x='btw')} END, 6) AS median_inter_pulse_interval_observations,
round(c[greatest(pk - 1, 1)] / tot, 6) AS fraction_final_area_accumulated_before_peak, round(peak / tot, 6) AS fraction_final_area_accumulated_during_largest_pulse, round((tot - c[fin]) / tot, 6) AS fraction_final_area_accumulated_after_final_major_pulse,
CAST(coalesce(n - quiet + 1, 0) AS INTEGER) AS quiescent_persistence_observations, CAST(len(again) AS INTEGER) AS reactivation_count, round(v[n] / peak, 6) AS terminal_taper_fraction_of_peak, round(v[1] - v[n], 6) AS growth_asymmetry_decline_minus_rise_km2,
round(CASE WHEN n > 1 THEN list_sum(list_transform(range(2, n + 1), lambda i: abs(v[i] - v[i - 1]))) ELSE 0 END, 6) AS geometric_trajectory_length_km2, CAST(CASE WHEN n > 1 THEN list_max(list_transform(range(2, n + 1), lambda i: date_diff('day', t[i - 1], t[i]))) ELSE 0 END AS INTEGER) AS max_gap_days,
CAST(n - fin AS INTEGER) AS terminal_lag_observations, CAST(date_diff('day', t[fin], t[n]) AS INTEGER) AS terminal_lag_days, CAST(pk - 1 AS INTEGER) AS peak_index FROM tq)"""


@query("development_traits", TRAITS_SQL + " SELECT * FROM dt")
def development_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return development.development_traits(_summary(spark, sf_dir))


@query("development_qc", TRAITS_SQL + """, cl AS (SELECT fire_id, count(*) FILTER ((fire_id + slice_index) % 9 <> 0) AS climate_records, bool_and((fire_id + slice_index) % 9 <> 0) AS ok FROM sl GROUP BY 1)
SELECT dt.fire_id, observation_count, max_gap_days, greatest(observation_count - 1, 0) AS usable_transitions, climate_records, number_of_expansion_pulses AS expansion_pulse_count, observation_count >= 3 AS usable_for_morphology, observation_count >= 4 AND number_of_expansion_pulses >= 1 AS usable_for_pulse_detection,
peak_index - 3 >= 0 AND peak_index + 3 < observation_count AND ok AS usable_for_lag_analysis, observation_count >= 3 AND max_gap_days <= 2 AS usable_for_terminal_observation_analysis, observation_count >= 5 AS usable_for_clustering, number_of_expansion_pulses >= 1 AND ok AND observation_count >= 5 AS usable_for_climate_transition_analysis, false AS physical_cessation_inference_supported FROM dt JOIN cl USING (fire_id)""")
def development_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir)
    there = (F.col("fire_id") + F.col("slice_index")) % 9 != 0
    climate = s.groupBy("fire_id").agg(F.count_if(there).alias("climate_records"), F.bool_and(there).alias("climate_complete"))
    return development.development_qc(development.development_traits(development.pulse_summary(s)), climate)
