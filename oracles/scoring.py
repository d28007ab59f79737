"""Oracle SQL for the scoring queries."""

from __future__ import annotations

from oracles import scores as sc
from oracles.scores import fx_cte, results, score_ctes
from oracles.util import case_map, ctes, layered, num, r, rx
from tidemark import config as cfg
from tidemark.operators.indices import REASON_ALL, REASON_NONE

_doubles = ["score", "raw_score", "coverage_ratio"] + [x for n in cfg.COMPONENTS for x in (n, f"contrib_{n}")]
_strings = ["segment_id", "version", "mode", "active", "missing", "active_component_count"] + [x for n in cfg.COMPONENTS for x in (f"prov_{n}", f"source_{n}")]

ORACLES = {
    f"m0{v[1]}_index_{v.lower()}": ctes(results([v], cfg.MODES), f"select {', '.join(_strings)}, {r(*_doubles)} from res")
    for v in cfg.VERSIONS
}

FX = [fx_cte()]
ORACLES["p01_mode_gate"] = ctes(FX, " union all ".join(
    f"""select segment_id, '{m}' as mode,
        {rx(f"case when prov_heart_rate in {ok} then heart_rate end", 'hr')},
        case when prov_heart_rate in {ok} and heart_rate is not null then prov_heart_rate end as hr_prov,
        case when prov_heart_rate in {ok} and heart_rate is not null then source_heart_rate end as hr_source,
        {rx("case when prov_eeg_gamma_power = 'direct' then eeg_gamma_power * 1e12 end", 'gamma_uv2')},
        case when prov_eeg_gamma_power = 'direct' and eeg_gamma_power is not null then 'direct' end as gamma_prov from fx"""
    for m, ok in (("strict", "('direct')"), ("proxy", "('direct', 'proxy')"), ("hybrid", "('direct')"))))

_n = ("eeg_gamma_power", "heart_rate", "stress_label")
ORACLES["p02_p03_merge_traces"] = ctes(FX, f"""select segment_id, {sc.prov_of([f'prov_{x}' for x in _n])} as provenance,
    {sc.src_of([f'source_{x}' for x in _n])} as sources, {sc.prov_of(['prov_eeg_gamma_power', 'prov_alpha_asymmetry'])} as eeg_provenance from fx""")

ORACLES["p04_p10_scalar_functions"] = ctes(FX, f"""select segment_id, {rx('1e0 / (1e0 + exp(5e0 - valence))', 'logistic')},
    {rx('ln(1e0 + greatest(eeg_gamma_power * 1e12, case when eeg_gamma_power is not null then 0e0 end))', 'gamma_log')},
    {rx('ln(1e0 + hrv_hf_lf)', 'ratio_log')}, {rx('case when arousal > 2 then (arousal - 2) / (arousal - 1) else 0e0 end', 'gate')},
    {rx('tanh((heart_rate - 100e0) / 30e0)', 'centred')},
    {rx('case when hrv_hf_lf is not null then least(greatest(hrv_hf_lf - 1e0, 0e0), 1e0) end', 'clipped')},
    {rx('sign(hrv_hf_lf - 3e0) * pow(abs(hrv_hf_lf - 3e0), 0.78e0)', 'signed_power')} from fx""")

ORACLES["p11_softmax"] = ctes(FX + [("e", """select segment_id, exp(1.65e0 * valence / 9e0) as a, exp(1.65e0 * arousal / 9e0) as b,
    exp(1.65e0 * dominance / 9e0) as c from fx""")],
    f"select segment_id, {rx('a / (a + b + c)', 'g0')}, {rx('b / (a + b + c)', 'g1')}, {rx('c / (a + b + c)', 'g2')} from e")

_TERMS = ("terms", """select segment_id, dataset, case when eeg_gamma_power is not null then (valence - 5e0) / 4e0 end as a_term,
    (hrv_hf_lf - 3e0) / 3e0 as b_term, (heart_rate - 100e0) / 50e0 as c_term from fx""")
_abc = ["a_term", "b_term", "c_term"]
ORACLES["p12_structural_scalar"] = ctes(FX + [_TERMS, ("s", layered(sc.scalar_steps("scalar", _abc), "terms"))],
                                        f"select segment_id, {r('scalar')} from s")
ORACLES["p13_structural_frame"] = ctes(
    FX + [_TERMS, ("s", layered(sc.scalar_steps("frame_form", [f"coalesce({t}, 0e0)" for t in _abc], keep_single=False), "terms")),
          ("s2", layered(sc.scalar_steps("matrix_form", _abc, keep_single=False), "s"))],
    f"select segment_id, {r('frame_form', 'matrix_form')} from s2")
ORACLES["m09_structural_trace"] = ctes(
    FX + [_TERMS, ("s", layered(sc.scalar_steps("v", _abc), "terms"))],
    f"""select segment_id, cast(len(v_f) as double) as n, {rx('v_m', 'mean')}, {rx('case when len(v_f) > 0 then v_sd end', 'std')}, {rx('v_am', 'level')},
    {rx('v_sp', 'spread')}, {rx('v_en', 'energy')}, {rx('case when len(v_f) > 0 then cast(v_sg as double) end', 'sign')},
    {rx('v_sg * (' + sc.v7p('structure_weight') + ' * v_sp / (1e0 + v_sp) + ' + sc.v7p('energy_weight') + ' * v_en / (1e0 + v_en))', 'boost')},
    {rx('v', 'value')} from s""")

_mot = case_map("lower(label)", cfg.MOTIVATION_BY_LABEL)
_str = case_map("lower(label)", cfg.STRESS_BY_LABEL)
ORACLES["p14_p17_self_report_levels"] = ctes(
    FX + [("n", layered([f"{sc.norm('valence')} as nv", f"{sc.norm('arousal')} as na",
                         f"coalesce(nv, {_mot}, {sc.clip('1e0 - stress_label')}) as mot", f"coalesce({sc.clip('stress_label')}, na, {_str}) as st"], "fx"))],
    f"""select segment_id, {rx('nv', 'valence_norm')}, {rx('na', 'arousal_norm')}, {rx('mot', 'motivation')},
    case when nv is not null then 'valence' when {_mot} is not null then 'label' when stress_label is not null then 'stress_label' end as motivation_source,
    {rx('st', 'stress')}, case when stress_label is not null then 'stress_label' when na is not null then 'arousal' when {_str} is not null then 'label' end as stress_source,
    {rx('25e0 + 55e0 * mot', 'dopamine')}, {rx('8e0 + 17e0 * st', 'cortisol')} from n""")

_lo = case_map("lower(dataset)", {k: v[0] for k, v in cfg.STATE_THRESHOLDS.items()})
_hi = case_map("lower(dataset)", {k: v[1] for k, v in cfg.STATE_THRESHOLDS.items()})
ORACLES["s21_f17_state_labels"] = ctes(
    FX + [("s", f"select *, case when arousal >= {_hi} and valence <= {_lo} then 'stress' when arousal <= {_lo} and valence >= {_hi} then 'baseline' else 'disbalance' end as state from fx")],
    f"""select segment_id, state, {rx(case_map('label', cfg.LABEL_LOAD), 'load')}, 'proxy' as load_prov, 'self_report_label_logic' as load_source,
    {rx(case_map('state', cfg.LABEL_LOAD), 'derived_load')} from s""")

ORACLES["p18_p20_acceptance"] = ctes(
    results(["V1", "V4"], cfg.MODES),
    f"""select segment_id, version, mode, {r('coverage_ratio')}, active_component_count, active, missing, score is not null as scored,
    case when score is not null then '' when mode = 'hybrid' then '{REASON_NONE}' else '{REASON_ALL}' end as insufficient_reason from res""")

_cl = "[" + ", ".join(f"{{'s': abs(contrib_{n}), 'p': {-i}, 'n': '{n}'}}" for i, n in enumerate(cfg.COMPONENTS)) + "]"
ORACLES["p21_explain"] = ctes(
    results(["V5"], ["hybrid"]) + [("u", f"select segment_id, unnest({_cl}) as x from res"),
                                   ("k", "select segment_id, x.n as name, row_number() over (partition by segment_id order by x.s desc, x.p desc) as rn from u where x.s is not null")],
    "select f.segment_id, coalesce(t.top, '') as top_contributors from fx f left join (select segment_id, string_agg(name, ',' order by rn) as top from k where rn <= 3 group by 1) t using (segment_id)")

for _v, _m in (("V1", "proxy"), ("V2", "strict"), ("V3", "proxy"), ("V4", "hybrid"), ("V5", "hybrid"), ("V6", "strict"), ("V7", "hybrid")):
    ORACLES[f"p22_sensitivity_{_v.lower()}"] = ctes(
        results([_v], [_m], sens=True),
        f"select segment_id, version, {r('score', *[f'sens_{n}' for n in cfg.SENSITIVITY_COMPONENTS])} from res")

ORACLES["p23_p24_all_versions"] = ctes(
    results(cfg.VERSIONS, ["proxy"]),
    f"""select version, mode, label, count(score) as n, {rx('avg(score)', 'mean_score')}, {rx('avg(raw_score)', 'mean_raw')},
    {rx('avg(coverage_ratio)', 'mean_coverage')} from res group by all""")

ORACLES["p25_component_provenance"] = ctes(
    results(cfg.VERSIONS, ["proxy"]),
    " union all ".join(
        f"""select version, '{c}' as component, count(*) filter (prov_{c} = 'direct') as direct, count(*) filter (prov_{c} = 'proxy') as proxy,
        count(*) filter (prov_{c} = 'unavailable') as unavailable from res group by 1""" for c in cfg.COMPONENTS))


def _trace(v: str) -> str:
    t = f"{v}_hybrid".lower()
    n = (lambda k: num(cfg.V6[k])) if v == "V6" else sc.v7p
    lev = lambda k, i: rx(f"{n(k + '_score_base')} + {n(k + '_score_amp')} * tanh(tx[{i}])", f"level_{k}")
    return f"""select segment_id, '{v}' as version, {rx('f_t', 'score')},
        {', '.join(rx(f'tl[{i}]', f'logit_{k}') for i, k in ((1, 'reg'), (2, 'mob'), (3, 'dep')))},
        {', '.join(rx(f'tg[{i}]', f'gate_{k}') for i, k in ((1, 'reg'), (2, 'mob'), (3, 'dep')))},
        {lev('reg', 1)}, {lev('mob', 2)}, {lev('dep', 3)}, {rx('tk', 'conflict')}, {rx('th', 'entropy')}, {rx('tg[1] - tg[3]', 'balance')} from tr_{t}"""


_tr = []
for _v in ("V6", "V7"):
    _tr += score_ctes(_v, "hybrid")[:2]
    _tr.append((f"tr_{_v}_hybrid".lower(), layered(sc.final(_v, "t", "A", "Gamma", "V", "Q", "0e0"), f"(select segment_id, dataset, A, Gamma, V, Q from comp_{_v}_hybrid)".lower().replace(" a, gamma, v, q", " A, Gamma, V, Q"))))
ORACLES["m08_gate_trace"] = ctes(FX + _tr, " union all by name ".join(_trace(v) for v in ("V6", "V7")))

ORACLES["m10_best_rows"] = ctes(
    results(cfg.VERSIONS, ["hybrid"]),
    f"""select version, segment_id, {r('score', 'coverage_ratio')}, active_component_count from (
    select *, row_number() over (partition by version order by coverage_ratio desc nulls last, active_component_count desc, score desc nulls last, segment_id desc) as rn from res) where rn = 1""")
