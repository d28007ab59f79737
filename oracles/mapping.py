"""Oracle SQL for maps, comparison, dynamics and what-if."""

from __future__ import annotations

from oracles import scores as sc
from oracles.scores import IDS, fx_cte, results, score_ctes
from oracles.util import ctes, layered, num, r, rx
from tidemark import config as cfg

KEYS = "dataset, mode, version"
RES = [
    ("rc", """select *, case when version in ('V4','V5','V6','V7') and A is not null and Gamma is not null and V is not null and score is not null
        then greatest(Gamma, 0e0) end as RES_gamma_load,
        case when version in ('V4','V5','V6','V7') and A is not null and Gamma is not null and V is not null and score is not null then abs(A - V) end as RES_mismatch from res"""),
    ("rr", "select *, 0.7e0 * V - 0.35e0 * RES_gamma_load - 0.25e0 * RES_mismatch as RES_core from rc"),
    ("rm", "select *, case when RES_core is not null then least(greatest(0.5e0 + 0.5e0 * tanh(1.8e0 * RES_core), 0e0), 1e0) end as RES from rr"),
]
MAP = RES + [
    ("th", f"select {KEYS}, quantile_cont(score, 0.5) as ts, quantile_cont(RES, 0.5) as tr from rm where RES is not null group by all"),
    ("mp", f"""select rm.*, case when RES is not null then ts end as score_threshold, case when RES is not null then tr end as RES_threshold,
        case when RES is null then '' when score >= ts and RES >= tr then 'regulated' when score < ts and RES >= tr then 'mobilized'
        when score >= ts and RES < tr then 'fragile' else 'depleted' end as state_map_4,
        case when RES is not null then least(abs(score - ts), abs(RES - tr)) end as state_map_margin
        from rm left join th using ({KEYS})"""),
]
_Q = ("regulated", "mobilized", "fragile", "depleted")
_by_label = f"select {KEYS}, label, " + ", ".join(f"count(*) filter (state_map_4 = '{q}') as {q}" for q in _Q) + " from mp where RES is not null group by all"

ORACLES = {
    "flagship_quadrants": ctes(results(["V4"], ["strict"]) + MAP, _by_label),
    "r01_r05_resource_score": ctes(results(["V1", "V4", "V6"], ["hybrid"]) + RES,
                                   f"select segment_id, version, {r('RES', 'RES_core', 'RES_mismatch', 'RES_gamma_load')} from rm"),
    "r02_r03_state_map": ctes(results(["V1", "V4", "V6"], ["hybrid"]) + MAP,
                              f"select segment_id, version, {r('score_threshold', 'RES_threshold', 'state_map_margin')}, state_map_4 from mp"),
    "r04_quadrants_by_label": ctes(results(["V4", "V6"], ["hybrid"]) + MAP, _by_label),
}


def diamond(axes: dict[str, str], group: str | None) -> list[tuple[str, str]]:
    over = f"(partition by {group})" if group else "()"
    part = f"group by {group}" if group else ""
    keep = f"{group}, " if group else ""
    join = f"using ({group})" if group else "on true"
    stats = ", ".join(f"quantile_cont({c}, {p}) as {a}_{k}" for a, c in axes.items() for k, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)))
    u = [f"({c} - {a}_q2) / ({a}_q3 - {a}_q1 + 1e-6) as u_{a}" for a, c in axes.items()]
    rho = " + ".join(f"abs(u_{a})" for a in axes)
    face = " || ".join(f"case when u_{a} >= 0 then '+' else '-' end" for a in axes)
    mags = ", ".join(f"abs(u_{a})" for a in axes)
    _ = over
    return [
        ("dm", "select segment_id, dataset, label, score, RES, Q from rm where RES is not null"),
        ("st", f"select {keep}{stats} from dm {part}"),
        ("du", layered([*u, f"{rho} as rho", f"case when rho < 0.35e0 then 'transition' else {face} end as region",
                        f"least({mags}) / greatest({mags}) as balance", *[f"u_{a} / rho as v_{a}" for a in axes]],
                       f"(select * from dm join st {join})")),
    ]


_v5 = results(["V5"], ["hybrid"]) + RES
ORACLES["r07_diamond_2d"] = ctes(_v5 + diamond({"i": "score", "r": "RES"}, "dataset"),
    f"select segment_id, {r('u_i', 'u_r', 'rho', 'v_i', 'v_r')}, region, {rx('rho - 0.35e0', 'confidence')}, {r('balance')} from du")
ORACLES["r09_diamond_3d"] = ctes(_v5 + diamond({"i": "score", "r": "RES", "d": "Q"}, None),
    f"select segment_id, {r('u_i', 'u_r', 'u_d', 'rho')}, region, {rx('rho - 0.35e0', 'confidence')} from du")
ORACLES["r08_cell_grid"] = ctes(_v5 + diamond({"i": "score", "r": "RES"}, "dataset") + [
    ("g", """select dataset, cast(floor(u_i / 0.5e0) as bigint) as cell_u_i, cast(floor(u_r / 0.5e0) as bigint) as cell_u_r, region as regime, count(*) as n_regime from du group by all""")],
    f"""select *, cast(sum(n_regime) over w as bigint) as n_cell, {rx('n_regime / sum(n_regime) over w', 'share')} from g
    window w as (partition by dataset, cell_u_i, cell_u_r)""")
_oct = [("o0", """select segment_id, """ + ", ".join(
    f"({c} - (min({c}) over () + max({c}) over ()) / 2e0) / ((max({c}) over () - min({c}) over ()) / 2e0) as {c}" for c in ("score", "RES", "Q")) + " from rm where RES is not null"),
    ("o1", "select *, greatest(max(abs(score) + abs(RES) + abs(Q)) over (), 1e0) as top from o0")]
ORACLES["r11_octahedron"] = ctes(_v5 + _oct, f"select segment_id, {rx('score / top', 'o_score')}, {rx('RES / top', 'o_RES')}, {rx('Q / top', 'o_Q')} from o1")

_PREP = "select *, coalesce(nullif(source_record_id, ''), subject_id, 'unknown') as source_key from {src} where window_start_sec is not null and score is not null{extra}"
_W = "partition by dataset, mode, version, source_key order by window_start_sec, segment_id"
ORACLES["r10_dynamic_axis"] = ctes(results(["V4"], ["hybrid"]) + RES + [
    ("p", _PREP.format(src="rm", extra="")),
    ("a1", f"""select *, nullif(window_start_sec - lag(window_start_sec) over w, 0e0) / 3600e0 as dt, score - lag(score) over w as di, RES - lag(RES) over w as dr from p window w as ({_W})"""),
    ("a2", f"""select *, di / dt as vi, dr / dt as vr, avg(coalesce(abs(di), 0e0)) over ({_W} rows between 3 preceding and current row) as vol, di - lag(di) over ({_W}) as d2 from a1"""),
    ("a3", f"select *, (vi - lag(vi) over ({_W})) / dt as ai from a2")],
    f"""select segment_id, {rx('tanh(0.8e0 * coalesce(vi, 0e0) + 0.4e0 * coalesce(vr, 0e0) + 0.2e0 * coalesce(ai, 0e0) + 0.6e0 * vol)', 'axis_d')},
    {rx('tanh(0.8e0 * coalesce(di, 0e0) + 0.4e0 * coalesce(dr, 0e0) + 0.2e0 * coalesce(d2, 0e0) + 0.6e0 * vol)', 'axis_d_differences')} from a3""")


# --- comparison -----------------------------------------------------------------------------------

def d_expr(n1, m1, v1, n2, m2, v2) -> str:
    pooled = f"sqrt((({n1} - 1) * {v1} + ({n2} - 1) * {v2}) / ({n1} + {n2} - 2))"
    return f"case when {n1} >= 2 and {n2} >= 2 and {pooled} > 0 then ({m1} - {m2}) / {pooled} end"


def corr_expr(x: str, y: str) -> str:
    f = f"filter ({x} is not null and {y} is not null)"
    return f"case when count(*) {f} >= 3 and count(distinct {x}) {f} >= 2 and count(distinct {y}) {f} >= 2 then corr({x}, {y}) end"


def metrics_ctes() -> list[tuple[str, str]]:
    lab = []
    for s in ("stress", "baseline"):
        f = f"filter (label = '{s}')"
        lab += [f"count(score) {f} as n_{s}", f"avg(score) {f} as m_{s}", f"var_samp(score) {f} as v_{s}"]
    wide = f"""select {KEYS}, count(*) as rows_, count(score) as valid_segments, avg(score) as mean_score, stddev_samp(score) as std_score, {', '.join(lab)},
        {corr_expr('score', 'arousal')} as arousal_correlation, {corr_expr('Q', 'valence')} as valence_correlation,
        ({' + '.join(f"avg(case when prov_{c} = 'direct' then 1e0 else 0e0 end)" for c in cfg.COMPONENTS)}) / 6e0 as direct_ratio,
        {', '.join(f'avg(contrib_{c}) as mean_contrib_{c}' for c in cfg.COMPONENTS)}, {', '.join(f'avg(sens_{c}) as mean_sens_{c}' for c in cfg.SENSITIVITY_COMPONENTS)}
        from res group by all"""
    sens = "[" + ", ".join(f"abs(mean_sens_{c})" for c in cfg.SENSITIVITY_COMPONENTS) + "]"
    return [
        ("wide", wide),
        ("lv", f"select {KEYS}, label, var_samp(score) as lvar from res group by all"),
        ("wv", f"select {KEYS}, avg(lvar) as within_group_variance from lv group by all"),
        ("ex", f"select {KEYS}, min(score) as lo, max(score) as hi from res where label in ('stress', 'baseline') and score is not null group by all"),
        ("bn", f"""select {KEYS}, least(floor((score - lo) / nullif(hi - lo, 0e0) * 30), 29) as bin, count(*) filter (label = 'stress') as cs, count(*) filter (label = 'baseline') as cb
            from res join ex using ({KEYS}) where label in ('stress', 'baseline') and score is not null group by all"""),
        ("ov", f"select {KEYS}, sum(least(cs / n_stress, cb / n_baseline)) as ovl from bn join wide using ({KEYS}) group by all"),
        ("mt", f"""select wide.*, within_group_variance, valid_segments / rows_ as coverage, m_stress - m_baseline as stress_baseline_diff,
            {d_expr('n_stress', 'm_stress', 'v_stress', 'n_baseline', 'm_baseline', 'v_baseline')} as effect_size,
            case when n_stress >= 2 and n_baseline >= 2 then case when lo = hi then 1e0 else ovl end end as distribution_overlap,
            list_avg(list_filter({sens}, lambda x: x is not null)) as relative_sensitivity
            from wide left join wv using ({KEYS}) left join ex using ({KEYS}) left join ov using ({KEYS})"""),
    ]


_metric_cols = ["coverage", "mean_score", "std_score", "within_group_variance", "stress_baseline_diff", "effect_size", "distribution_overlap", "arousal_correlation",
                "valence_correlation", "relative_sensitivity", "direct_ratio"] + [f"mean_contrib_{c}" for c in cfg.COMPONENTS] + [f"mean_sens_{c}" for c in cfg.SENSITIVITY_COMPONENTS]
ORACLES["c01_c09_version_metrics"] = ctes(results(["V1", "V4", "V5", "V6"], ["hybrid"], sens=True) + metrics_ctes(),
                                          f"select {KEYS}, valid_segments, {r(*_metric_cols)} from mt")


def _mm(x: str) -> str:
    return f"(case when min({x}) over w = max({x}) over w then 1e0 else ({x} - min({x}) over w) / nullif(max({x}) over w - min({x}) over w, 0e0) end)"


def utility_ctes() -> list[tuple[str, str]]:
    u = cfg.UTILITY_WEIGHTS
    parts = {"effect_size": _mm("abs(effect_size)"), "inverse_overlap": f"(1e0 - {_mm('distribution_overlap')})", "relative_sensitivity": _mm("relative_sensitivity"),
             "arousal_correlation": _mm("abs(arousal_correlation)"), "valence_correlation": _mm("abs(valence_correlation)"),
             "stability": f"(1e0 - {_mm('within_group_variance')})", "coverage": _mm("coverage")}
    score = " + ".join(f"{num(u[k])} * coalesce({x}, 0e0)" for k, x in parts.items())
    return [
        ("ut", f"select *, {score} as utility_score from mt window w as (partition by dataset, mode)"),
        ("cmp", """select *, dense_rank() over (partition by dataset, mode order by round(utility_score, 12) desc) as utility_rank,
            coalesce(distribution_overlap > 0.65 and abs(effect_size) < 0.35 and relative_sensitivity < 0.08, false) as oversmoothing_flag,
            case when valid_segments >= 20 and direct_ratio >= 0.6 then 'high' when valid_segments >= 20 and direct_ratio >= 0.3 then 'medium' else 'low' end as reliability_level from ut"""),
    ]


_cmp = results(["V1", "V3", "V4", "V5"], ["proxy"], sens=True) + metrics_ctes() + utility_ctes()
ORACLES["c10_c14_utility"] = ctes(_cmp, f"select {KEYS}, {r('utility_score')}, utility_rank, oversmoothing_flag, reliability_level from cmp")
ORACLES["c15_rankings"] = ctes(_cmp, """select dataset, mode, string_agg(version, ',' order by utility_rank, version) as version_ranking,
    coalesce(string_agg(version, ',' order by utility_rank, version) filter (reliability_level in ('high', 'medium')), '') as reliable_comparisons,
    coalesce(string_agg(version, ',' order by utility_rank, version) filter (oversmoothing_flag), '') as limitations from cmp group by all""")

ORACLES["c16_trajectories"] = ctes(results(["V4", "V5"], ["hybrid"]) + [
    ("p", "select * from res where version = 'V5' and window_start_sec is not null and score is not null"),
    ("n", """select dataset, source_record_id, row_number() over (partition by dataset order by c desc, source_record_id) as rn from
        (select dataset, source_record_id, count(*) as c from p group by all) where c >= 6"""),
    ("s", "select p.*, source_record_id as source_key from p join n using (dataset, source_record_id) where rn <= 4")],
    f"""select source_key, segment_id, version, {r('window_start_sec', 'score')}, {rx('avg(score) over w', 'rolling_mean')}, {rx('median(score) over w', 'rolling_median')}
    from s window w as (partition by dataset, source_key order by window_start_sec, segment_id rows between 4 preceding and current row)""")
ORACLES["c17_box_quantiles"] = ctes(results(["V4", "V6"], ["hybrid"]),
    f"""select {KEYS}, label, count(score) as n, {rx('min(score)', 'low')}, {rx('max(score)', 'high')}, {rx('quantile_cont(score, 0.25)', 'q1')},
    {rx('quantile_cont(score, 0.5)', 'median')}, {rx('quantile_cont(score, 0.75)', 'q3')} from res where score is not null group by all""")
ORACLES["c17_scatter_pairs"] = ctes(results(["V4"], ["hybrid"]), f"select {KEYS}, segment_id, label, {rx('valence', 'x')}, {rx('Q', 'y')} from res where valence is not null and Q is not null")

ORACLES["c17_k27_scatter_sample"] = ctes(results(["V4", "V6"], ["hybrid"]), f"""select {KEYS}, segment_id, label, {rx('valence', 'x')}, {rx('score', 'y')} from res where valence is not null and score is not null
    qualify row_number() over (partition by {KEYS} order by md5('42:' || segment_id)) <= 2500""")


def _avail(cols, variant):
    return " union all ".join(
        f"""select dataset, '{c}' as feature, count({c}) as valid_segments, round(count({c}) / count(*), 4) + 0e0 as share, '{variant}' as variant from fx group by dataset""" for c in cols)


ORACLES["f19_availability"] = ctes([fx_cte()], _avail(cfg.FEATURES, "full") + " union all " + _avail(cfg.COMPARISON_FEATURES, "comparison"))


# --- dynamics -----------------------------------------------------------------------------------

def dynamics(tag: str, src: str) -> list[tuple[str, str]]:
    """CTEs from prepared rows ``src`` to dyn_<tag>; the recurrences run as one recursive CTE."""
    k = "dataset, mode, version, source_key"
    z = lambda c: f"coalesce({c}, 0e0)"
    clip = lambda x, a, b: f"least(greatest({x}, {num(a)}), {num(b)})"
    return [
        (f"d1_{tag}", f"""select *, row_number() over w as rn, nullif(window_start_sec - lag(window_start_sec) over w, 0e0) as delta_t_sec, lag(score) over w as prev_score,
            coalesce(abs(score - lag(score) over w), 0e0) as step, avg(score) over f as score_causal_mean, median(score) over f as score_causal_median, avg(RES) over f as RES_causal_mean
            from {src} window w as ({_W}), f as ({_W} rows between 4 preceding and current row)"""),
        (f"d2_{tag}", f"select *, avg(step) over ({_W} rows between 3 preceding and current row) as score_volatility from d1_{tag}"),
        (f"d3_{tag}", layered([
            f"{clip('score_volatility / 0.035e0', 0.1, 0.7)} as score_smooth_weight", f"{clip('score_volatility / 0.035e0', 0, 1)} as vn",
            f"0.45e0 * {clip('(' + z('Gamma') + ' + 1e0) / 2e0', 0, 1)} + 0.35e0 * {clip('(1e0 - ' + z('V') + ') / 2e0', 0, 1)} + 0.2e0 * {clip('(1e0 - ' + z('Q') + ') / 2e0', 0, 1)} as stress_drive",
            f"{clip('0.48e0 + 0.22e0 * stress_drive + 0.1e0 * vn', 0.08, 0.85)} as response_gain",
            f"{clip('0.12e0 + 0.1e0 * (1e0 - stress_drive) - 0.04e0 * vn', 0.08, 0.85)} as recovery_gain"], f"d2_{tag}")),
        (f"d4_{tag}", f"""select {k}, rn, score as score_ewma, score as score_fast, 0.6e0 * score + 0.4e0 * score_causal_median as core, RES as res_y,
            1e0 as res_w, 'init' as dynamic_mode, score as score_dynamic from d3_{tag} where rn = 1
            union all select {k}, rn, ew, fa, core, case when RES is null then py when py is null then RES else (wd * py + 0.2975e0 * RES) / (wd + 0.2975e0) end,
            case when RES is null then case when py is null then pw else wd end else 1e0 end,
            case when tgt <= pd then 'response' else 'recovery' end, pd + (case when tgt <= pd then response_gain else recovery_gain end) * (tgt - pd) from (
              select *, (1e0 - score_smooth_weight) * score + score_smooth_weight * core as tgt from (
                select t.dataset, t.mode, t.version, t.source_key, t.rn, 0.65e0 * p.score_ewma + 0.35e0 * t.score as ew, 0.58e0 * p.score_fast + 0.42e0 * t.score as fa,
                  0.6e0 * (0.58e0 * p.score_fast + 0.42e0 * t.score) + 0.4e0 * t.score_causal_median as core, t.RES, p.res_y as py, p.res_w as pw, p.res_w * 0.7025e0 as wd,
                  p.score_dynamic as pd, t.score, t.score_smooth_weight, t.response_gain, t.recovery_gain
                from d4_{tag} p join d3_{tag} t on t.dataset = p.dataset and t.mode = p.mode and t.version = p.version and t.source_key = p.source_key and t.rn = p.rn + 1))"""),
        (f"dyn_{tag}", f"""select t.*, s.score_ewma, s.score_fast, s.core as score_smooth_core, s.res_y as RES_fast, 0.65e0 * s.res_y + 0.35e0 * t.RES_causal_mean as RES_dynamic,
            s.dynamic_mode, s.score_dynamic, (t.score - t.prev_score) / t.delta_t_sec as dscore_raw_dt,
            (s.score_dynamic - lag(s.score_dynamic) over (partition by {k} order by rn)) / t.delta_t_sec as dscore_dynamic_dt
            from d3_{tag} t join d4_{tag} s using ({k}, rn)"""),
    ]


_prep = ("pr", _PREP.format(src="mp", extra=" and version = 'V4'"))
_dyn = results(["V4"], ["hybrid"]) + MAP + [_prep] + dynamics("a", "pr")
ORACLES["d01_d06_causal_frames"] = ctes(_dyn, f"""select segment_id, source_key, {rx('window_start_sec', 'time_sec')},
    {r('delta_t_sec', 'score_causal_mean', 'score_causal_median', 'score_volatility', 'score_smooth_weight', 'dscore_raw_dt')} from dyn_a""")
ORACLES["d05_d11_recurrences"] = ctes(_dyn + [("th2", "select dataset, mode, version, ts, tr from th")], f"""select segment_id, {r('score_ewma', 'score_fast', 'score_smooth_core', 'RES_causal_mean', 'RES_fast', 'RES_dynamic', 'stress_drive',
    'response_gain', 'recovery_gain', 'score_dynamic', 'dscore_dynamic_dt')}, dynamic_mode,
    case when score_threshold is null or RES_dynamic is null then '' when score_dynamic >= score_threshold and RES_dynamic >= RES_threshold then 'regulated'
      when score_dynamic < score_threshold and RES_dynamic >= RES_threshold then 'mobilized'
      when score_dynamic >= score_threshold and RES_dynamic < RES_threshold then 'fragile' else 'depleted' end as state_map_4_dynamic from dyn_a""")
_base4 = results(["V4"], ["hybrid"]) + RES + [("pr", _PREP.format(src="rm", extra=""))]
_sel = [("cn", "select dataset, mode, version, source_key, count(segment_id) as points from pr group by all"),
        ("sl", """select *, row_number() over (partition by dataset, mode, version order by points desc, source_key) as place from (
            select *, max(case when points >= 6 then 1 else 0 end) over (partition by dataset, mode, version) as best from cn) where (case when points >= 6 then 1 else 0 end) = best""")]
ORACLES["d02_record_selection"] = ctes(_base4 + _sel, "select dataset, mode, version, source_key, points, place from sl where place <= 4")
ORACLES["d12_record_rows"] = ctes(
    _base4 + _sel + [("one", "select pr.* exclude (RES), cast(null as double) as RES from pr join sl using (dataset, mode, version, source_key) where place = 1")] + dynamics("b", "one"),
    f"select dataset, source_key, segment_id, {rx('window_start_sec', 'time_sec')}, {r('score', 'score_dynamic')} from dyn_b")


# --- what-if ------------------------------------------------------------------------------------

_CH = ("score", "score_fast", "score_smooth_core", "score_dynamic", "stress_drive", "response_gain", "recovery_gain")


def _ba(before: str, after: str, tb: str, ta: str, mask: str) -> str:
    cols = ", ".join(rx(f"a.{c}", c) + ", " + rx(f"b.{c}", f"{c}_after") for c in _CH)
    return f"""select a.source_key, a.segment_id, {rx('a.window_start_sec', 'time_sec')}, {mask} as intervention_mask, {rx(tb, 'target_before')}, {rx(ta, 'target_after')}, {cols},
        a.dynamic_mode, b.dynamic_mode as dynamic_mode_after from {before} a left join {after} b using (source_key, segment_id)"""


def _suffix(parts, tag):
    names = [n for n, _ in parts]
    import re
    out = []
    for n, q in parts:
        for m in names:
            q = re.sub(rf"\b{m}\b", f"{m}_{tag}", q)
        out.append((f"{n}_{tag}", q))
    return out


_iv = [("iv", """select source_record_id, min(window_start_sec) as st, least(min(window_start_sec) + greatest(0.25e0 * (max(window_end_sec) - min(window_start_sec)), 4e0), max(window_end_sec)) as en from fx group by 1"""),
       ("fm", "select fx.*, window_start_sec between st and en as msk from fx join iv using (source_record_id)"),
       ("fx1", "select * replace (case when msk then heart_rate + 15e0 else heart_rate end as heart_rate) from fm")]
_s0 = score_ctes("V4", "hybrid", src="fx")
_s1 = _suffix(score_ctes("V4", "hybrid", src="fx1"), "p")
_p0 = ("q0", "select *, cast(null as double) as RES from (" + _PREP.format(src="res_v4_hybrid", extra="") + ")")
_p1 = ("q1", "select *, cast(null as double) as RES from (" + _PREP.format(src="res_v4_hybrid_p", extra="") + ")")
ORACLES["i01_i04_perturb_feature"] = ctes(
    [fx_cte()] + _iv + _s0 + _s1 + [_p0, _p1] + dynamics("u", "q0") + dynamics("w", "q1"),
    _ba("dyn_u", "dyn_w", "f0.heart_rate", "f1.heart_rate", "f0.msk") + " join fm f0 on f0.segment_id = a.segment_id join fx1 f1 on f1.segment_id = a.segment_id")

_g = "case when window_start_sec between 86400e0 and 864000e0 then Gamma * 1.3e0 else Gamma end"
ORACLES["i02_perturb_component"] = ctes(
    results(["V6"], ["hybrid"]) + [("q0", "select *, cast(null as double) as RES, window_start_sec between 86400e0 and 864000e0 as msk from (" + _PREP.format(src="res", extra="") + ")"),
                                   ("g1", f"select * replace ({_g} as Gamma) from q0"),
                                   ("g2", layered(sc.final("V6", "y", "A", "Gamma", "V", "Q", "0e0"), "g1")),
                                   ("q1", "select * exclude (score), f_y as score from g2")] + dynamics("u", "q0") + dynamics("w", "q1"),
    _ba("dyn_u", "dyn_w", "a.Gamma", "b.Gamma", "a.msk"))

_w5, _w4 = cfg.WEIGHTS["V5"], cfg.WEIGHTS["V4"]
_lin = lambda w: " + ".join(f"{num(-x if n == 'Gamma' else x)} * coalesce({n}, 0e0)" for n, x in w.items())
_slim = "(select segment_id, dataset, A, Gamma, V, Q from res)"
ORACLES["i03_rescore"] = ctes(
    results(["V4"], ["hybrid"]) + [
        ("x5", layered([f"{_lin(_w5)} as core", "core - 0.08e0 as ctr",
                        "2.6e0 * ctr + 0.8e0 * ctr * ctr * ctr + 0.18e0 * (coalesce(Q, 0e0) - coalesce(V, 0e0)) - 0.06e0 * greatest(coalesce(Gamma, 0e0), 0e0) as drv",
                        f"0.65e0 * {sc.sig('core')} + 0.35e0 * (0.5e0 + 0.5e0 * tanh(drv)) as f_y"], _slim)),
        ("x6", layered(sc.final("V6", "y", "A", "Gamma", "V", "Q", "0e0"), _slim)), ("x7", layered(sc.final("V7", "y", "A", "Gamma", "V", "Q", "0e0"), _slim))],
    f"""select segment_id, 'V1' as rescored_as, {rx(sc.sig(_lin(_w4)), 'rescored')} from res
    union all select segment_id, 'V5', {rx('least(greatest(f_y, 0e0), 1e0)', 'rescored')} from x5
    union all select segment_id, 'V6', {rx('f_y', 'rescored')} from x6 union all select segment_id, 'V7', {rx('f_y', 'rescored')} from x7""")
__all__ = ["ORACLES", "IDS"]
