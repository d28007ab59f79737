"""Oracle SQL for streaming forms (rows the watermark has passed) and clustering evidence."""

from __future__ import annotations

from oracles.mapping import MAP, RES, _PREP, dynamics
from oracles.scores import results
from oracles.util import ctes, r, rx
from tidemark.plans.streams import SPACE

_WM = ("wm", "select max(ts) - interval 10 minute as w from events")
_sec = lambda x: f"date_diff('microsecond', timestamp '2024-01-01', {x}) / 1e6"
ORACLES = {
    "w01_window_stream": ctes([_WM,
        ("s", "select *, unnest([0, 1]) as o from events"),
        ("b", "select *, time_bucket(interval 3 hour, ts, timestamp '2024-01-01') - o * interval 3 hour as st from s")],
        f"""select {rx(_sec('st'), 'start_s')}, {rx(_sec('st + interval 6 hour'), 'end_s')}, event_type, count(*) as n, {rx('avg(value)', 'mean_value')}, {rx('max(value)', 'max_value')}
        from b, wm where st + interval 6 hour <= w group by st, event_type"""),
    "w03_session_stream": ctes([_WM,
        ("m", "select date_trunc('milliseconds', w) as w from wm"),
        ("a", "select e.*, case when lag(event_type) over u is distinct from event_type or ts >= lag(ts) over u + interval 12 hour then 1 else 0 end as nw from events e, m where ts <= w window u as (partition by user_id order by ts, event_type)"),
        ("b", "select *, sum(nw) over (partition by user_id order by ts, event_type rows unbounded preceding) as sid from a"),
        ("c", "select user_id, any_value(event_type) as event_type, sid, min(ts) as st, max(ts) + interval 12 hour as ge, count(*) as n from b group by user_id, sid"),
        ("d", "select *, lead(st) over (partition by user_id order by sid) as nx from c")],
        f"select {rx(_sec('st'), 'start_s')}, {rx(_sec('least(ge, coalesce(nx, ge))'), 'end_s')}, user_id, event_type, n from d, m where nx is not null or ge <= w"),
    "w02_w04_causal_stream": ctes(results(["V4"], ["hybrid"]) + RES + [
        ("sm", "select max(window_start_sec) - 600e0 as w from res"), ("pr", "select *, cast(null as double) as RES_ from (" + _PREP.format(src="rm", extra="") + ")")] + dynamics("a", "pr"),
        f"select source_key, segment_id, {r('score', 'score_fast', 'score_smooth_core', 'score_dynamic')}, dynamic_mode from dyn_a, sm where floor(window_start_sec * 1000) <= floor(w * 1000)"),
}
_prev = results(["V4"], ["hybrid"]) + MAP
ORACLES["w05_r06_live_preview"] = ctes(_prev, "select state_map_4, count(*) as n from mp group by all")

_full = " and ".join(f"{m} is not null" for m in SPACE)
CL = results(["V4"], ["hybrid"]) + [
    ("f", f"select * from res where {_full}"),
    ("q", "select " + ", ".join(f"quantile_cont({m}, {p}) as {m}_{i}" for m in SPACE for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + " from f"),
    ("s", "select version, segment_id, label, " + ", ".join(f"({m} - {m}_2) / coalesce(nullif({m}_3 - {m}_1, 0e0), 1e0) as s_{m}" for m in SPACE) + " from f, q"),
    ("c", "select *, case when s_A + s_V > 1 then 2 when s_Gamma > 0 then 1 else 0 end as cluster from s"),
]
_s = [f"s_{m}" for m in SPACE]
ORACLES["k13_robust_scale"] = ctes(CL, f"select segment_id, {r(*_s)} from c")
_d2 = lambda a, b: "(" + " + ".join(f"pow({a}.{x} - {b}.{x}, 2)" for x in _s) + ")"
ORACLES["k16_internal_indices"] = ctes(CL + [
    ("m", f"select cluster, count(*) as n, avg({' + '.join(f'pow({x}, 2)' for x in _s)}) as m2, {', '.join(f'avg({x}) as {x}' for x in _s)} from c group by cluster"),
    ("g", f"select {', '.join(f'avg({x}) as {x}' for x in _s)}, count(*) as n from c"),
    ("pd", f"""select c.segment_id, c.cluster, m.cluster as other, m.n, ({' + '.join(f'pow(c.{x}, 2)' for x in _s)}) + m.m2 - 2e0 * ({' + '.join(f'c.{x} * m.{x}' for x in _s)}) as md, {_d2('c', 'm')} as dc from c, m"""),
    ("ab", "select segment_id, any_value(cluster) as cluster, max(md * n / nullif(n - 1, 0)) filter (cluster = other) as a, min(md) filter (cluster <> other) as b, max(dc) filter (cluster = other) as dc from pd group by segment_id"),
    ("sc", "select cluster, avg(sqrt(dc)) as scatter from ab group by cluster"),
    ("db", f"select a.cluster, max((x.scatter + y.scatter) / sqrt({_d2('a', 'b')})) as worst from m a join m b on a.cluster <> b.cluster join sc x on x.cluster = a.cluster join sc y on y.cluster = b.cluster group by a.cluster"),
    ("bt", f"select sum(m.n * {_d2('m', 'g')}) as between_ from m, g")],
    f"""select 'V4' as version, (select count(*) from m) as k, count(*) as n_samples, {rx('avg(case when a is null then 0e0 else (b - a) / greatest(a, b) end)', 'silhouette_squared')},
    {rx('(select avg(worst) from db)', 'davies_bouldin_index')}, {rx('((select between_ from bt) / ((select count(*) from m) - 1)) / (sum(dc) / (count(*) - (select count(*) from m)))', 'calinski_harabasz_score')} from ab""")
ORACLES["k17_agreement"] = ctes(CL + [
    ("x", "select label, cluster, count(*) as n from c group by all"), ("ra", "select label, sum(n) as n from x group by all"), ("rb", "select cluster, sum(n) as n from x group by all"),
    ("t", """select (select sum(n) from x)::double as n, (select sum(n * (n - 1) / 2e0) from x) as pc, (select sum(n * (n - 1) / 2e0) from ra) as pa, (select sum(n * (n - 1) / 2e0) from rb) as pb,
        (select sum(x.n / (select sum(n) from x)::double * ln(x.n::double * (select sum(n) from x) / (ra.n::double * rb.n))) from x join ra using (label) join rb using (cluster)) as mi,
        (select -sum(n / (select sum(n) from x)::double * ln(n / (select sum(n) from x)::double)) from ra) as ha, (select -sum(n / (select sum(n) from x)::double * ln(n / (select sum(n) from x)::double)) from rb) as hb""")],
    f"select 'V4' as version, {rx('(pc - pa * pb / (n * (n - 1) / 2)) / (0.5e0 * (pa + pb) - pa * pb / (n * (n - 1) / 2))', 'ari')}, {rx('mi / (0.5e0 * (ha + hb))', 'nmi')} from t")
ORACLES["k18_va_quadrant"] = ctes(results(["V4"], ["hybrid"]) + [("q", "select median(valence) as mv, median(arousal) as ma from res")],
    """select segment_id, case when coalesce(valence, mv) >= mv then 'high' else 'low' end || '_valence_' || case when coalesce(arousal, ma) >= ma then 'high' else 'low' end || '_arousal' as va_quadrant from res, q""")
ORACLES["k19_cluster_shares"] = ctes(CL + [("n", "select cluster, count(*) as n from c group by cluster")],
    f"select 'V4' as version, count(*) as clusters, {rx('min(n) / sum(n)', 'smallest_share')}, min(n) / sum(n) < 0.1 as tiny_cluster, {rx('stddev_pop(n) / avg(n)', 'size_cv')} from n")
CAND = [("ct", """select 'V' || (user_id % 3) as version, case when (user_id // 3) % 2 = 0 then 'kmeans' else 'gmm' end as algorithm, 2 + (user_id // 6) % 4 as k, avg(value) / 100 - 0.1e0 as silhouette_score,
    stddev_samp(value) / 50 as davies_bouldin_index, sum(value) as calinski_harabasz_score, min(value) % 1 as label_ari, max(value) % 1 as label_nmi, (max(value) * 7) % 1 as va_ari, (sum(value) * 3) % 1 as va_nmi,
    0.4e0 + (sum(value) % 1) / 2 as bootstrap_mean_ari, (sum(value) * 11) % 1 / 2 as tiny_cluster_rate from events group by 1, 2, 3""")]
_mm = lambda c: f"(case when min({c}) over w = max({c}) over w then 1e0 else coalesce(({c} - min({c}) over w) / nullif(max({c}) over w - min({c}) over w, 0e0), 0e0) end)"
CAND += [
    ("cs", f"""select *, 0.3e0 * {_mm('silhouette_score')} + 0.2e0 * (1 - {_mm('davies_bouldin_index')}) + 0.2e0 * {_mm('calinski_harabasz_score')} + 0.2e0 * {_mm('bootstrap_mean_ari')} + 0.1e0 * (1 - {_mm('tiny_cluster_rate')}) as internal_score,
        0.35e0 * {_mm('label_ari')} + 0.35e0 * {_mm('label_nmi')} + 0.15e0 * {_mm('va_ari')} + 0.15e0 * {_mm('va_nmi')} as alignment_score,
        bootstrap_mean_ari >= 0.55 and tiny_cluster_rate <= 0.35 and silhouette_score > 0 as stable_support from ct window w as (partition by version, algorithm)"""),
    ("cb", "select *, row_number() over (partition by version, algorithm order by stable_support desc, internal_score desc, alignment_score desc, k) = 1 as best_for_algorithm from cs"),
    ("cg", """select version, k, sum(stable_support::int) as stable_algorithm_count, avg(internal_score) as mean_internal_score, avg(alignment_score) as mean_alignment_score, avg(bootstrap_mean_ari) as consensus_mean_bootstrap_ari,
        avg(label_ari) as label_alignment_ari, avg(label_nmi) as label_alignment_nmi, avg(va_ari) as va_alignment_ari, avg(va_nmi) as va_alignment_nmi
        from (select *, bool_or(stable_support) over (partition by version) as anys from cb) where stable_support or not anys group by version, k"""),
    ("cr", "select *, row_number() over (partition by version order by stable_algorithm_count desc, mean_internal_score desc, mean_alignment_score desc, k) as rn from cg"),
]
ORACLES["k22_candidate_scores"] = ctes(CAND, f"select version, algorithm, k, {r('internal_score', 'alignment_score')}, stable_support, best_for_algorithm from cb")
ORACLES["k23_consensus"] = ctes(CAND, f"""select version, k as consensus_supported_k, cast(stable_algorithm_count as bigint) as stable_algorithm_count,
    {r('mean_internal_score', 'mean_alignment_score', 'consensus_mean_bootstrap_ari', 'label_alignment_ari', 'label_alignment_nmi', 'va_alignment_ari', 'va_alignment_nmi')},
    case when stable_algorithm_count >= 2 and consensus_mean_bootstrap_ari >= 0.7 then 'strong' when stable_algorithm_count >= 1 and consensus_mean_bootstrap_ari >= 0.55 then 'moderate' else 'weak' end as consensus_support_strength,
    (select max(k) from cb where cb.version = cr.version and best_for_algorithm and algorithm = 'kmeans') as best_k_kmeans, (select max(k) from cb where cb.version = cr.version and best_for_algorithm and algorithm = 'gmm') as best_k_gmm
    from cr where rn = 1""")
ORACLES["k25_dynamic_notes"] = ctes([
    ("cp", "select 'V' || (user_id % 7) as version, case event_id % 2 when 0 then 'static' else 'dynamic' end as regime, 1 + count(*) % 3 as likely_state_count from events group by 1, 2")],
    """select 'ds' as dataset, 'strict' as mode, a.version, a.regime, a.likely_state_count, case when a.regime = 'dynamic' then case when a.likely_state_count < s.likely_state_count then 'dynamics smooths the states'
    when a.likely_state_count > s.likely_state_count then 'dynamics adds a supported state' when s.version is not null then 'dynamics keeps the number of states' end end as dynamic_vs_static_note
    from cp a left join cp s on s.version = a.version and s.regime = 'static'""")
