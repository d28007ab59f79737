"""Oracle SQL for parameter search and cross-run tables."""

from __future__ import annotations

from oracles import scores as sc
from oracles.mapping import KEYS, d_expr, metrics_ctes, utility_ctes
from oracles.scores import fx_cte, results
from oracles.states import rank_cte
from oracles.util import ctes, layered, num, r, rx
from tidemark import config as cfg
from tidemark.operators import crossrun as cr
from tidemark.operators import search as se

T = se.TRANSFORMS
_exprs = {
    "alpha_asymmetry": "alpha_asymmetry", "total_asymmetry": "(eeg_left_power - eeg_right_power) / (eeg_left_power + eeg_right_power + 1e-9)",
    "gamma_log": "ln(1e0 + eeg_gamma_power * 1e12)", "gamma_alpha_log": "ln(1e0 + gamma_alpha_ratio)", "heart_rate": "heart_rate", "hf_lf_log": "ln(1e0 + hrv_hf_lf)",
}
TR = [fx_cte(), ("xt", "select *, " + ", ".join(f"{e} as x_{t}" for t, e in _exprs.items()) + " from fx")]
_cal = ", ".join(f"quantile_cont(x_{t}, 0.5) as c_{t}, greatest((quantile_cont(x_{t}, 0.95) - quantile_cont(x_{t}, 0.05)) / 2e0, 1e-6) as s_{t}" for t in T)
_cols = [f"{k}_{t}" for t in T for k in "cs"]
FOLD = TR + [("sf", "select subject_id, (row_number() over (order by subject_id) - 1) % 4 as fold from (select distinct subject_id from fx)"), ("xf", "select * from xt join sf using (subject_id)")]
BASES = {
    "train": [("bs", f"select f.fold, {_cal} from (select unnest(range(0, 4)) as fold) f join xf on xf.fold <> f.fold group by f.fold"), ("xb", "select * from xf join bs using (fold)")],
    "global": [("xb", "select *, " + ", ".join(f"{num(c)} as c_{t}, {num(s)} as s_{t}" for t, (c, s) in cfg.CALIBRATION.items()) + " from xf")],
}


def params(version: str, trials: int) -> list[tuple[str, str]]:
    rg = se.RANGES[version]
    cand = ", ".join(f"{num(lo)} + {num(hi - lo)} * ((t * 37 + {11 * i + 5}) % 101) / 100e0 as {n}" for i, (n, (lo, hi)) in enumerate(rg.items()))
    w = cfg.WEIGHTS[version]
    mass = " + ".join(f"greatest(weight_{n}, 1e-6)" for n in w)
    defaults = cfg.V5 if version == "V5" else cfg.V7
    cols = [f"greatest(weight_{n}, 1e-6) / ({mass}) as w_{n}" for n in w] + [f"{k if k in rg else num(v)} as p_{k}" for k, v in defaults.items()]
    return [("cd", f"select t as trial_index, {cand} from (select unnest(range(0, {trials})) as t)"), ("pm", f"select trial_index, {', '.join(cols)} from cd")]


def _pcols(version: str) -> list[str]:
    return [f"w_{n}" for n in cfg.WEIGHTS[version]] + [f"p_{k}" for k in (cfg.V5 if version == "V5" else cfg.V7)]


def scored(version: str, trials: int, base: str) -> list[tuple[str, str]]:
    p = lambda k: f"p_{k}"
    z = sc.z
    items = [f"tanh((x_{t} - c_{t}) / s_{t}) as {a}" for t, a in (("alpha_asymmetry", "ta"), ("total_asymmetry", "tt"), ("gamma_log", "tg"), ("gamma_alpha_log", "tb"), ("hf_lf_log", "tr"))]
    items.append("tanh((c_heart_rate - x_heart_rate) / s_heart_rate) as th")
    if version == "V5":
        w = "p_q_signed_power"
        items += [
            "tanh(1.1e0 * ta + 0.4e0 * tt) as A", "tanh(0.3e0 * tg + 0.7e0 * tb) as Gamma", "coalesce(tanh(0.8e0 * th + 0.2e0 * tr), th, tr) as V",
            f"0.5e0 * {z('A')} + 0.42e0 * {z('V')} - 0.3e0 * {z('Gamma')} as ql", f"{sc.spow('A', w)} as qa", f"{sc.spow('V', w)} as qv", f"{sc.spow('Gamma', 1.05)} as qg",
            f"{z('A * V - p_q_mismatch_penalty * abs(A - V)')} - p_q_gamma_penalty * {z(sc.pos('Gamma'))} as qc",
            f"{z('abs(qa - qv)')} + {z('p_q_gamma_v_penalty * ' + sc.pos('qg') + ' * (1e0 - ' + sc.pos('qv') + ')')} as qk",
            f"tanh(p_q_linear_gain * ql + p_q_coherence_gain * qc + p_q_synergy_gain * {z(sc.sroot('qa', 'qv'))} + p_q_energy_gain * {z('0.5e0 * (abs(qa) + abs(qv))')} * sign(ql) - p_q_conflict_gain * qk) as Q",
            f"w_A * {z('A')} - w_Gamma * {z('Gamma')} + w_V * {z('V')} + w_Q * {z('Q')} as core",
            f"{sc.spow('A', 'p_output_signed_power')} as oa", f"{sc.spow('V', 'p_output_signed_power')} as ov", f"{sc.spow('Q', 'p_output_signed_power')} as oq",
            f"0.14e0 * {z('oa')} - 0.08e0 * {z('Gamma')} + 0.22e0 * {z('ov')} + 0.56e0 * {z('oq')} - p_output_center as ctr",
            f"{z(sc.sroot('oa', 'ov'))} + 0.8e0 * {z(sc.sroot('oq', 'ov'))} as syn", f"{z('abs(oa - ov)')} + 0.75e0 * {z('abs(oq - ov)')} as cfl",
            f"sqrt((pow({z('oa')}, 2) + pow({z('ov')}, 2) + pow({z('oq')}, 2)) / 3e0) as nrg", f"greatest({z('Gamma')}, 0e0) as brk",
            f"""p_output_gain * ctr + p_output_curve * pow(ctr, 3) + p_output_balance_coupling * ({z('Q')} - {z('V')}) - p_output_gamma_brake * brk + p_output_regime_gain * syn
            + p_output_energy_gain * nrg * sign(ctr) - p_output_conflict_gain * cfl - p_output_gamma_cross_penalty * brk * (1e0 - greatest({z('V')}, 0e0)) as drv""".replace("\n", " "),
            f"least(greatest((1e0 - p_output_contrast_mix) * {sc.sig('core + 0.22e0 * syn - 0.1e0 * cfl')} + p_output_contrast_mix * (0.5e0 + 0.5e0 * tanh(drv)), 0e0), 1e0) as score",
        ]
    else:
        ks = dict(params=p, keep_single=False)
        items += sc.scalar_steps("ra", ["ta", "0.55e0 * tt", f"0.35e0 * {sc.sroot('ta', 'tt')}"], **ks)
        items += sc.scalar_steps("rg", ["0.35e0 * tg", "0.75e0 * tb", f"0.2e0 * {sc.sroot('tg', 'tb')}"], **ks)
        items += sc.scalar_steps("rv", ["0.85e0 * th", "0.3e0 * tr", f"0.2e0 * {sc.sroot('th', 'tr')}"], **ks)
        items += [f"tanh(p_component_gain * {x}) as {n}" for n, x in (("A", "ra"), ("Gamma", "rg"), ("V", "rv"))]
        items += ["0.52e0 * A + 0.44e0 * V - 0.32e0 * Gamma as q0", f"A * V - p_q_coherence_penalty * abs(A - V) - p_q_gamma_penalty * {sc.pos('Gamma')} as q1"]
        items += sc.scalar_steps("rq", ["q0", "q1", f"0.55e0 * {sc.sroot('q0', 'q1')}"], **ks)
        items.append(f"{sc.clip('0.5e0 + 0.5e0 * tanh(p_q_gain * rq)')} as Q")
        items += sc.final("V7", "y", "A", "Gamma", "V", "Q", "0e0", pf=p, keep_single=False)
        items.append("case when Q is not null then f_y end as score")
    return FOLD + BASES[base] + params(version, trials) + [("sd_", layered(items, "(select * from xb, pm)"))]


def objective(group: str) -> list[tuple[str, str]]:
    lab = ", ".join(f"count(score) filter (label = '{x}') as n_{x}, avg(score) filter (label = '{x}') as m_{x}, var_samp(score) filter (label = '{x}') as v_{x}" for x in se.LABELS)
    d = lambda a, b: "abs(" + d_expr(f"n_{a}", f"m_{a}", f"v_{a}", f"n_{b}", f"m_{b}", f"v_{b}") + ")"
    return [
        ("ag", f"select {group}, {lab}, stddev_samp(score) as std_score, stddev_samp(Gamma) as gamma_std from sd_ group by all"),
        ("ks_", "select * from sd_ where label in ('baseline', 'disbalance', 'stress') and score is not null"),
        ("kr", rank_cte("ks_", group, "score")),
        ("kj", f"select {group}, label, count(*) as nj, sum(rk) as rj, max(n) as n, sum(tie::double * tie - 1) as tj from kr group by all"),
        ("kh", f"""select {group}, max(n) as n, count(*) as k, (12e0 / (max(n)::double * (max(n) + 1)) * sum(rj * rj / nj) - 3e0 * (max(n) + 1)) / (1e0 - sum(tj) / (pow(max(n)::double, 3) - max(n))) as h from kj group by {group}"""),
        ("ob0", f"""select ag.*, greatest((h - k + 1) / (n - k), 0e0) as epsilon_squared, {d('baseline', 'stress')} as baseline_stress_d,
            list_avg(list_filter([{d('baseline', 'disbalance')}, {d('baseline', 'stress')}, {d('disbalance', 'stress')}], lambda x: x is not null)) as avg_pairwise_d,
            case when m_baseline is null or m_disbalance is null or m_stress is null or abs(m_baseline - m_stress) <= 1e-9 then 0e0
              when m_disbalance between least(m_baseline, m_stress) and greatest(m_baseline, m_stress) then greatest(1e0 - abs(m_disbalance - 0.5e0 * (m_baseline + m_stress)) / abs(m_baseline - m_stress), 0e0) else 0e0 end as middle_score
            from ag left join kh using ({group})"""),
        ("ob", "select *, coalesce(avg_pairwise_d, 0) + 0.8e0 * coalesce(baseline_stress_d, 0) + 1.5e0 * coalesce(epsilon_squared, 0) + 0.3e0 * middle_score + 0.1e0 * coalesce(std_score, 0) as objective from ob0"),
        ("av", """select trial_index, avg(objective) as objective_mean, stddev_pop(objective) as objective_std, """ + ", ".join(
            f"avg({x}) as {x}_mean" for x in ("avg_pairwise_d", "baseline_stress_d", "epsilon_squared", "middle_score", "std_score", "gamma_std")) + " from ob group by all"),
    ]


_av = ["objective_mean", "objective_std"] + [f"{x}_mean" for x in ("avg_pairwise_d", "baseline_stress_d", "epsilon_squared", "middle_score", "std_score", "gamma_std")]
_obj = objective("trial_index, fold")
ORACLES = {
    "l01_l02_base_calibration": ctes(TR + [("b", f"select dataset, {_cal} from xt group by dataset")], f"select dataset, {r(*_cols, digits=8)} from b"),
    "l09_subject_folds": ctes(FOLD, "select subject_id, fold from sf"),
    "l06_l08_l11_search_v5": ctes(scored("V5", 3, "train") + _obj, f"select trial_index, {r(*_av)} from av"),
    "l11_search_v7_global": ctes(scored("V7", 3, "global") + _obj, f"select trial_index, {r(*_av)} from av"),
    "l12_top_candidates": ctes(scored("V5", 4, "global") + _obj, f"select trial_index, {r(*_av)} from av order by objective_mean desc, epsilon_squared_mean desc, avg_pairwise_d_mean desc limit 2"),
}
for _v, _n in (("V5", "l03_score_v5"), ("V7", "l04_score_v7")):
    ORACLES[_n] = ctes(scored(_v, 3, "train"), f"select trial_index, fold, segment_id, {r('A', 'Gamma', 'V', 'Q', 'score')} from sd_")
    ORACLES[f"l05_params_{_v.lower()}"] = ctes([fx_cte()] + params(_v, 16),
        f"select trial_index, {r(*_pcols(_v))}, rows from pm join (select cast(segment_id as bigint) % 16 as trial_index, count(*) as rows from fx group by 1) using (trial_index)")

MAT = results(["V1", "V4", "V5"], ["strict", "hybrid"], sens=True) + metrics_ctes() + utility_ctes() + [
    ("cp0", f"""select {KEYS}, valid_segments, 2 + valid_segments % 3 as sz, 2 + valid_segments % 4 as k, case valid_segments % 3 when 0 then 'strong' when 1 then 'moderate' else 'weak' end as st,
        (valid_segments % 100) / 100e0 as ba, (valid_segments % 17) / 100e0 as la, (valid_segments % 13) / 100e0 as ln_ from cmp"""),
    ("cp1", """select *, k >= 4 and sz >= 4 and st = 'strong' and ba >= 0.7 as four, k >= 3 and sz >= 3 and st in ('strong', 'moderate') as three, sz >= 2 or (k >= 2 and (la >= 0.1 or ln_ >= 0.1)) as two from cp0"""),
    ("cp2", f"""select {KEYS}, k as consensus_supported_k, cast(case when four then k when two then 2 else 1 end as bigint) as confident_state_count,
        cast(case when four then k when three then 3 when two or k >= 2 then 2 else 1 end as bigint) as likely_state_count,
        cast(case when four then k + 1 when three then 4 when two or k >= 2 then 3 else 2 end as bigint) as no_evidence_for_above,
        case when four then 'evidence for ' || k || ' states' when three then 'likely 3 states' when two and (sz >= 3 or k >= 3) then 'confidently 2 states, limited evidence for 3rd mode'
          when two then 'confidently 2 states' when k >= 2 then 'tentative evidence for 2 states' else 'weak evidence even for 2 states' end as capacity_verdict from cp1"""),
    ("mx", f"""select cmp.*, abs(effect_size) as effect_abs, 1e0 - distribution_overlap as inverse_overlap, 0.6e0 * abs(effect_size) + 0.4e0 * (1e0 - distribution_overlap) as separation_proxy,
        coverage > 0 and valid_segments > 0 as is_usable, consensus_supported_k, confident_state_count, likely_state_count, no_evidence_for_above, capacity_verdict from cmp left join cp2 using ({KEYS})"""),
]
_show = f"{KEYS}, {r('effect_abs', 'inverse_overlap', 'separation_proxy')}, is_usable, utility_rank, capacity_verdict"
_ord = "case reliability_level when 'high' then 0 when 'medium' then 1 else 2 end, utility_rank, utility_score desc nulls last, effect_abs desc nulls last, inverse_overlap desc nulls last, version"
ORACLES["t01_k24_matrix"] = ctes(MAT, f"select {_show}, confident_state_count, likely_state_count, no_evidence_for_above from mx")
ORACLES["t02_t05_best"] = ctes(MAT, f"select {_show} from (select *, row_number() over (partition by dataset, mode order by {_ord}) as rn from mx where is_usable) where rn = 1")
_first = lambda c: f"(array_agg({c} order by {_ord}) filter ({c} is not null))[1]"
ORACLES["t02_best_mixed"] = ctes(MAT, f"""select dataset, mode, {_first('version')} as version, {', '.join(rx(_first(c), c) for c in ('effect_abs', 'inverse_overlap', 'separation_proxy'))},
    {_first('is_usable')} as is_usable, {_first('utility_rank')} as utility_rank, {_first('capacity_verdict')} as capacity_verdict from mx where is_usable group by dataset, mode""")
_grid = ", ".join(f"('{d}', '{m}', '{v}')" for d, m in cr.SCENARIOS for v in cfg.VERSIONS)
_need = ", ".join(f"('{d}', '{m}')" for d, m in cr.DYNAMIC_SCENARIOS)
SCN = MAT + [("gr", f"select * from (values {_grid}) g(dataset, mode, version)"),
             ("sr", f"""select gr.dataset, gr.mode, gr.version, mx.* exclude (dataset, mode, version), case when coalesce(coverage, 0) > 0 then 'available' else 'not_available' end as availability_status,
                case when gr.version in ('V1', 'V2', 'V3') then 'not_adapted' when gr.version = 'V4' and mx.version is not null then 'available'
                  when (gr.dataset, gr.mode) in ({_need}) then 'missing_required' else 'partial_optional' end as dynamic_state from gr left join mx using (dataset, mode, version)""")]
ORACLES["t03_t04_t08_scenarios"] = ctes(SCN, """select dataset, mode, version, availability_status, dynamic_state, case when availability_status = 'not_available' then 'danger'
    when reliability_level = 'high' and not oversmoothing_flag then 'success' when version in ('V1', 'V2', 'V3') then 'danger' else 'warning' end as status,
    version in ('V4', 'V5', 'V6', 'V7') as dynamic_supported, version in ('V1', 'V2', 'V3') as needs_proxy from sr""")
ORACLES["t06_confirmation"] = ctes(SCN + [
    ("cf", "select *, coalesce(utility_score, 0) + 0.05e0 * coalesce(confident_state_count, 0) + 0.02e0 * coalesce(likely_state_count, 0) as confirmation_score from sr where coalesce(coverage, 0) > 0"),
    ("cb", "select * from (select *, row_number() over (partition by dataset, mode order by confirmation_score desc, utility_rank, version) as rn from cf) where rn = 1")],
    f"""select s.dataset, s.mode, coalesce(cb.version, '-') as best_version, {rx('confirmation_score', 'confirmation_score')}, case when cb.version is null then 'not available' else capacity_verdict end as confirmed_states,
    case when cb.version is null then '-' else 'k=' || consensus_supported_k end as possible_ceiling from (select distinct dataset, mode from gr) s left join cb using (dataset, mode)""")
ORACLES["t07_strongest_strict"] = ctes(MAT, f"select {_show} from mx where mode = 'strict' and coverage > 0 order by abs(effect_size) desc nulls last, utility_score desc nulls last, reliability_level, dataset, version limit 1")
ORACLES["t09_drill_down"] = ctes([fx_cte()], " union all ".join(
    f"""select segment_id, dataset || ' | ' || subject_id || ' | ' || segment_id || ' | ' || printf('%.1f', window_start_sec) as segment_key, '{n}' as feature,
    {rx(f'case when abs({n}) > 1e-3 then {n} end', 'value')}, prov_{n} as provenance, source_{n} as source from fx""" for n in (*cfg.EEG_FEATURES, *cfg.CARDIAC_FEATURES, "stress_label")))
