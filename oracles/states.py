"""Oracle SQL for state separation and window aggregators."""

from __future__ import annotations

from oracles.mapping import d_expr
from oracles.scores import results
from oracles.util import case_map, ctes, r, rx
from tidemark import config as cfg
from tidemark.operators.separation import MEASURES
from tidemark.sources.fixture_sql import duckdb_view

_place = case_map("label", {n: i for i, n in enumerate(cfg.LABEL_ORDER)})
BASE = results(["V4", "V5"], ["hybrid"]) + [
    ("ok", "select * from res where score is not null"),
    ("lb", f"select *, row_number() over (partition by version order by coalesce({_place}, 5), label) as place from (select version, label, count(*) as n from ok group by version, label having count(*) >= 20)"),
    ("ml", " union all ".join(f"select version, label, '{m}' as measure, {m} as x from ok where {m} is not null" for m in MEASURES)),
    ("pr", "select a.version, a.label as label_a, b.label as label_b, a.label || '__' || b.label as pair_key from lb a join lb b on a.version = b.version and a.place < b.place"),
    ("sd", "select m.version, m.measure, m.x, p.pair_key, p.label_a, p.label_b, case when m.label = p.label_a then 'a' else 'b' end as side from ml m join pr p on p.version = m.version and m.label in (p.label_a, p.label_b)"),
]


def rank_cte(src: str, group: str, value: str) -> str:
    return f"""select *, rank() over (partition by {group} order by {value}) + (count(*) over (partition by {group}, {value}) - 1) / 2e0 as rk,
        count(*) over (partition by {group}, {value}) as tie, count(*) over (partition by {group}) as n from {src} where {value} is not null"""


def kw(src: str, group: str, label: str, value: str) -> list[tuple[str, str]]:
    return [
        ("kr", rank_cte(src, group, value)),
        ("kj", f"select {group}, {label}, count(*) as nj, sum(rk) as rj, max(n) as n, sum(tie::double * tie - 1) as tj from kr group by all"),
        ("kh", f"""select {group}, max(n) as n, count(*) as k, min(nj) as smallest,
            (12e0 / (max(n)::double * (max(n) + 1)) * sum(rj * rj / nj) - 3e0 * (max(n) + 1)) / (1e0 - sum(tj) / (pow(max(n)::double, 3) - max(n))) as h from kj group by {group}"""),
    ]


_eps = "case when n > k then greatest((h - k + 1) / (n - k), 0e0) end"
#: Chi-square tail by the series of the lower incomplete gamma function.
_chi2 = """case when k > 1 and h > 0 then 1e0 - list_sum(list_transform(range(0, cast(400 + h as bigint)), lambda i: exp(((k - 1) / 2e0 + i) * ln(h / 2e0) - h / 2e0 - lgamma((k - 1) / 2e0 + i + 1))))
    when k > 1 and h <= 0 then 1e0 end"""
ORACLES = {
    "k01_labels": ctes(BASE, "select version, label, n, place from lb"),
    "k02_measures": ctes(BASE, "select version, measure, count(*) as n_values from ml group by all having measure = 'score' or count(*) >= 20"),
    "k03_l07_kruskal": ctes(BASE + kw("ml", "version, measure", "label", "x"), f"select version, measure, n, k, smallest, {r('h')}, {rx(_eps, 'epsilon_squared')}, {rx(_chi2, 'p_value')} from kh"),
}
PS = [
    ("pa", """select version, measure, pair_key, label_a, label_b, count(*) filter (side = 'a') as n_a, count(*) filter (side = 'b') as n_b, avg(x) filter (side = 'a') as mean_a,
        avg(x) filter (side = 'b') as mean_b, var_samp(x) filter (side = 'a') as var_a, var_samp(x) filter (side = 'b') as var_b, min(x) as lo, max(x) as hi from sd group by all"""),
    ("pb", """select version, measure, pair_key, least(floor((x - lo) / nullif(hi - lo, 0e0) * 60), 59) as bin, count(*) filter (side = 'a') as ca, count(*) filter (side = 'b') as cb
        from sd join pa using (version, measure, pair_key) group by all"""),
    ("po", "select version, measure, pair_key, sum(least(ca / n_a, cb / n_b)) as ovl from pb join pa using (version, measure, pair_key) group by all"),
    ("ps", f"""select pa.*, mean_b - mean_a as mean_diff, {d_expr('n_b', 'mean_b', 'var_b', 'n_a', 'mean_a', 'var_a')} as effect_size,
        case when lo < hi then ovl end as distribution_overlap from pa join po using (version, measure, pair_key)"""),
]
ORACLES["k05_k07_pair_statistics"] = ctes(BASE + PS, f"select version, measure, pair_key, n_a, n_b, {r('mean_a', 'mean_b', 'mean_diff', 'effect_size', 'distribution_overlap')} from ps")
# two-sided normal tail with tie and continuity correction: the chi-square series with one degree of freedom at z squared
_z2 = "pow(greatest(u, n_a * n_b - u) - n_a * n_b / 2e0 - 0.5e0, 2) / nullif(n_a::double * n_b / 12e0 * (n_a + n_b + 1 - tie_term / ((n_a + n_b)::double * (n_a + n_b - 1))), 0e0)"
_tail = """1e0 - list_sum(list_transform(range(0, cast(400 + z2 as bigint)), lambda i: exp((0.5e0 + i) * ln(z2 / 2e0) - z2 / 2e0 - lgamma(1.5e0 + i))))"""
RS = [
    ("rk_", rank_cte("sd", "version, measure, pair_key", "x")),
    ("ru", """select version, measure, pair_key, count(*) filter (side = 'a') as n_a, count(*) filter (side = 'b') as n_b, sum(tie::double * tie - 1) as tie_term,
        sum(rk) filter (side = 'a') - count(*) filter (side = 'a') * (count(*) filter (side = 'a') + 1) / 2e0 as u from rk_ group by all"""),
    ("rz", f"select *, {_z2} as z2 from ru"),
    ("rp", f"select *, case when z2 is null or greatest(u, n_a * n_b - u) - n_a * n_b / 2e0 <= 0.5e0 then 1e0 when z2 > 1400 then 0e0 else greatest({_tail}, 0e0) end as p_value from rz"),
]
ORACLES["k04_rank_sum"] = ctes(BASE + RS, f"select version, measure, pair_key, n_a, n_b, {r('tie_term', 'u', 'p_value')} from rp")
HOLM = PS + RS + [
    ("h1", "select ps.*, p_value as p from ps join rp using (version, measure, pair_key)"),
    ("h2", """select *, least(1e0, coalesce(p, 1e0) * (count(*) over (partition by version, measure) - row_number() over (partition by version, measure order by coalesce(p, 1e0), pair_key) + 1)) as adj from h1"""),
    ("h3", "select *, max(adj) over (partition by version, measure order by coalesce(p, 1e0), pair_key rows unbounded preceding) as p_value_holm from h2"),
    ("h4", """select *, cast(case when effect_size is null or distribution_overlap is null then 0
        when p_value_holm < 0.01 and abs(effect_size) >= 0.75 and distribution_overlap <= 0.7 then 3 when p_value_holm < 0.05 and abs(effect_size) >= 0.35 and distribution_overlap <= 0.85 then 2
        when p_value_holm < 0.1 and (abs(effect_size) >= 0.2 or distribution_overlap <= 0.92) then 1 else 0 end as bigint) as grade from h3"""),
]
ORACLES["k08_k09_holm_grade"] = ctes(BASE + HOLM, f"select version, measure, pair_key, {r('p_value_holm')}, grade from h4")
_full = " and ".join(f"{m} is not null" for m in MEASURES)
_sc = ", ".join(
    f"(avg({m}) - any_value({m}2)) / coalesce(nullif(any_value({m}3) - any_value({m}1), 0e0), 1e0) as {m}" for m in MEASURES)
_gap = "sqrt(" + " + ".join(f"pow(b.{m} - a.{m}, 2)" for m in MEASURES) + ")"
CENTROID = [
    ("cf", f"select ok.* from ok join lb using (version, label) where {_full}"),
    ("cq", "select version, " + ", ".join(f"quantile_cont({m}, {q}) as {m}{i}" for m in MEASURES for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))) + " from cf group by version"),
    ("cc", f"select version, label, {_sc} from cf join cq using (version) group by version, label"),
    ("cd", f"select p.version, p.pair_key, {_gap} as centroid_distance from pr p join cc a on a.version = p.version and a.label = p.label_a join cc b on b.version = p.version and b.label = p.label_b"),
]
ORACLES["k10_centroid_distance"] = ctes(BASE + CENTROID, f"select version, pair_key, {r('centroid_distance')} from cd")
AGGREGATE = HOLM + CENTROID + [
    ("g1", """select version, pair_key, label_a, label_b, count(*) filter (grade >= 2) as supported_measures, coalesce(max(grade) filter (measure = 'score'), 0) as primary_measure_grade
        from h4 group by all"""),
    ("g2", """select g1.*, centroid_distance, cast(case when centroid_distance >= 1.25 then 3 when centroid_distance >= 0.8 then 2 when centroid_distance >= 0.45 then 1 else 0 end as bigint) as centroid_grade
        from g1 left join cd using (version, pair_key)"""),
    ("g3", """select *, primary_measure_grade >= 2 or supported_measures >= 2 or (supported_measures >= 1 and centroid_grade >= 2) as pair_supported from g2"""),
    ("g4", """select *, cast(case when primary_measure_grade >= 3 or (supported_measures >= 3 and centroid_grade >= 2) then 3 when pair_supported then 2
        when primary_measure_grade >= 1 or supported_measures >= 1 or centroid_grade >= 1 then 1 else 0 end as bigint) as grade_score from g3"""),
]
ORACLES["k11_pair_aggregate"] = ctes(BASE + AGGREGATE, f"""select version, pair_key, label_a, label_b, supported_measures, primary_measure_grade, {r('centroid_distance')}, centroid_grade, pair_supported, grade_score,
    case grade_score when 3 then 'strong' when 2 then 'moderate' when 1 then 'weak' else 'none' end as separation_grade from g4""")
# every subset of the (at most five) labels as a bit mask, unsupported pairs excluded
ORACLES["k12_supported_set"] = ctes(BASE + AGGREGATE + [
    ("su", "select version, label_a, label_b from g4 where pair_supported"),
    ("nd", f"select version, label, row_number() over (partition by version order by coalesce({_place}, 5), label) - 1 as i, count(*) over (partition by version) as n from (select distinct version, unnest([label_a, label_b]) as label from su)"),
    ("mk", "select version, n, unnest(range(1, cast(pow(2, n) as int))) as m from (select distinct version, n from nd)"),
    ("bad", """select distinct mk.version, mk.m from mk join nd a on a.version = mk.version join nd b on b.version = mk.version and a.i < b.i
        where (mk.m >> cast(mk.n - 1 - a.i as int)) & 1 = 1 and (mk.m >> cast(mk.n - 1 - b.i as int)) & 1 = 1
        and not exists (select 1 from su where su.version = mk.version and ((label_a = a.label and label_b = b.label) or (label_a = b.label and label_b = a.label)))"""),
    ("bst", "select version, m, bit_count(m) as size, row_number() over (partition by version order by bit_count(m) desc, m desc) as rn from mk anti join bad using (version, m)")],
    """select version, cast(size as bigint) as set_size, (select string_agg(label, ',' order by i) from nd where nd.version = bst.version and (bst.m >> cast(nd.n - 1 - nd.i as int)) & 1 = 1) as labels
    from bst where rn = 1""")

W = [("w", duckdb_view("fx_windows")),
     ("ws", "select *, list_avg(window_values) as w_mean, list_stddev_pop(window_values) as w_std, list_avg(list_transform(window_values, lambda x: x * x)) as sq from w")]
ORACLES["y01_window_statistics"] = ctes(W, f"select sample_index, {r('w_mean', 'w_std')}, {rx('ln(1e0 + sq)', 'w_energy')}, {rx('sqrt(sq)', 'target_rms')} from ws")
_z = lambda c: f"({c} - avg({c}) over ()) / greatest(stddev_pop({c}) over (), 1e-8)"
METHODS = W + [
    ("g", "select avg(x) as gm, stddev_pop(x) as gs from (select unnest(window_values) as x from w)"),
    ("m1", "select ws.*, list_transform(window_values, lambda x: (x - gm) / gs) as zs, list_transform(window_values, lambda x: 0.6e0 * (x - w_mean) / w_std + 0.4e0 * abs((x - w_mean) / w_std)) as dr from ws, g"),
    ("m2", """select *, list_avg(zs) as linear_mean, list_avg(list_transform(zs, lambda x: 1e0 / (1e0 + exp(-x)))) as sigmoid_mean, list_avg(list_transform(zs, lambda x: tanh(x))) as tanh_mean,
        list_avg(list_transform(zs, lambda x: x / (1e0 + abs(x)))) as softsign_mean, list_avg(list_transform(zs, lambda x: 2e0 / pi() * atan(x))) as arctan_mean,
        list_transform(zs, lambda x: exp(x)) as ez, list_transform(dr, lambda d: exp(d)) as ed from m1"""),
    ("m3", "select *, list_dot_product(ez, zs) / list_sum(ez) as softmax_weighted_sum, list_transform(ed, lambda e: e / list_sum(ed)) as aw from m2"),
    ("m4", "select *, list_dot_product(aw, window_values) as a_mean, list_dot_product(aw, list_transform(window_values, lambda x: x * x)) as a_sq, ln(1e0 + sq) as w_energy from m3"),
    ("m5", "select *, sqrt(list_dot_product(aw, list_transform(window_values, lambda x: pow(x - a_mean, 2)))) as a_std, ln(1e0 + a_sq) as a_energy from m4"),
    ("m6", f"""select sample_index, scenario, state, sqrt(sq) as target_rms, linear_mean, sigmoid_mean, tanh_mean, softsign_mean, arctan_mean, softmax_weighted_sum,
        0.35e0 * {_z('w_mean')} + 0.3e0 * {_z('w_std')} + 0.35e0 * {_z('w_energy')} as structural,
        0.32e0 * {_z('a_mean')} + 0.28e0 * {_z('a_std')} + 0.4e0 * {_z('a_energy')} as structural_attentive from m5"""),
]
_names = ("linear_mean", "sigmoid_mean", "tanh_mean", "softsign_mean", "arctan_mean", "softmax_weighted_sum", "structural", "structural_attentive")
LONG = METHODS + [("lg", " union all ".join(f"select scenario, state, sample_index, target_rms, '{m}' as method, {m} as value from m6" for m in _names))]
ORACLES["y02_y06_methods"] = ctes(METHODS, f"select sample_index, scenario, state, {r('target_rms', *_names)} from m6")
ORACLES["y07_y10_method_metrics"] = ctes(LONG + kw("lg", "scenario, method", "state", "value") + [
    ("rk2", """select *, rank() over (partition by method order by value) + (count(*) over (partition by method, value) - 1) / 2e0 as ra,
        rank() over (partition by method order by target_rms) + (count(*) over (partition by method, target_rms) - 1) / 2e0 as rb from lg"""),
    ("b1", "select scenario, method, corr(value, target_rms) as pearson_target_corr, corr(ra, rb) as spearman_target_corr, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) as dynamic_range_p95_p05 from rk2 group by all"),
    ("s1", "select scenario, method, state, count(*) as n, avg(value) as m, var_samp(value) as v from lg group by all"),
    ("d1", f"select a.scenario, a.method, avg(abs({d_expr('a.n', 'a.m', 'a.v', 'b.n', 'b.m', 'b.v')})) as avg_pairwise_d from s1 a join s1 b on a.method = b.method and a.scenario = b.scenario and a.state < b.state group by all")],
    f"select scenario, method, {r('pearson_target_corr', 'spearman_target_corr', 'dynamic_range_p95_p05')}, {rx(_eps, 'epsilon_squared')}, {r('avg_pairwise_d')} from b1 join kh using (scenario, method) join d1 using (scenario, method)")
PLOT = LONG + [("pq", "select method, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from lg group by all"),
               ("pv", "select lg.*, case when hi - lo <= 1e-8 then 0.5e0 else least(greatest((value - lo) / (hi - lo), 0e0), 1e0) end as plot_value from lg join pq using (method)")]
ORACLES["y08_scaled"] = ctes(PLOT, f"select method, sample_index, {r('plot_value')} from pv")
ORACLES["y09_target_bins"] = ctes(PLOT + [
    ("eg", "select quantile_cont(target_rms, [" + ", ".join(f"{i}/12.0" for i in range(13)) + "]) as e from pv"),
    ("bb", "select pv.*, cast(list_sum(list_transform(e[2:12], lambda x: case when target_rms > x then 1 else 0 end)) as bigint) as target_bin from pv, eg")],
    f"select scenario, method, target_bin, {rx('avg(target_rms)', 'target_rms')}, {rx('avg(plot_value)', 'output')} from bb group by all")
