"""Oracle SQL for windowing and signal features."""

from __future__ import annotations

from oracles.scores import fx_cte
from oracles.util import case_map, ctes, num, r, rx
from tidemark import config as cfg
from tidemark.plans.windowing import _DURATIONS
from tidemark.sources.fixture_sql import duckdb_view

V = lambda n: (n, duckdb_view(n))
REC = [V("fx_signals"), ("rec", "select segment_id, dataset, channel, flatten(list(samples order by part)) as samples from fx_signals group by all")]


def _bounds(src: str, keys: str, n: str, fs: float, w: float, s: float) -> str:
    """Fixed windows by counting: index k starts at k*step while the window fits."""
    ws, ss = f"round_even({num(w * fs)}, 0)", f"round_even({num(s * fs)}, 0)"
    return f"""select {keys}, k as window_index, cast(k * {ss} as bigint) as start, cast(k * {ss} + {ws} as bigint) as "end"
        from (select *, unnest(range(0, case when {n} >= {ws} then cast(floor(({n} - {ws}) / {ss}) as bigint) + 1 else 0 end)) as k from {src})"""


_w = ((0.5, 0.25), (1.0, 0.3), (2.51953125, 2.5))
ORACLES = {
    "s01_s02_segment_bounds": ctes(REC + [(f"b{i}", _bounds("rec", f"segment_id, channel, samples, {num(w)} as window_s", "len(samples)", 128.0, w, s)) for i, (w, s) in enumerate(_w)]
                                   + [("b", " union all ".join(f"select * from b{i}" for i in range(3)))],
        f"""select segment_id, channel, {r('window_s')}, window_index, start, "end", {rx('start / 128e0', 'start_s')}, {rx('"end" / 128e0', 'end_s')}, "end" - start as n,
        {rx('list_sum(samples[start + 1:"end"])', 'total')} from b"""),
    "s03_segment_record": ctes([fx_cte()], f"select segment_id, subject_id, label, {rx('window_end_sec - window_start_sec', 'segment_duration_sec')}, {r('valence')}, true as no_rates from fx"),
    "s04_label_run_windows": ctes([V("fx_label_track"),
        ("a", "select *, case when label_code is distinct from lag(label_code) over (partition by recording_id order by i) then 1 else 0 end as nw from fx_label_track"),
        ("b", "select *, sum(nw) over (partition by recording_id order by i) as run_no from a"),
        ("c", f"select recording_id, run_no, {case_map('label_code', cfg.TRACK_LABELS)} as label, min(i) as rs, max(i) + 1 as re from b group by recording_id, run_no, label_code"),
        ("d", "select *, row_number() over (partition by recording_id order by rs) - 1 as run_index from c where label in ('baseline', 'stress', 'amusement')"),
        ("e", _bounds("d", "recording_id, label, run_index, rs", "(re - rs)", 8.0, 2.0, 1.5))],
        f"""select recording_id, label, run_index, window_index, rs + start as start, rs + "end" as "end", {rx('(rs + start) / 8e0', 'window_start_sec')}, {rx('(rs + "end") / 8e0', 'window_end_sec')} from e"""),
    "s05_trim": ctes([V("fx_signals")], f"select segment_id, channel, part, least(64, 20 + part * 5) as n_ecg, least(64, 20 + part * 5) as n_label, {rx('list_sum(samples[1:20 + part * 5])', 'total')} from fx_signals"),
}
TR = [V("fx_trials"), ("t", "select *, 1 + (trial_id * 37 % 81) / 10e0 as valence, 1 + (trial_id * 53 % 81) / 10e0 as arousal, 512 + trial_id % 5 * 128 as n from fx_trials")]
ORACLES["s06_trial_windows"] = ctes(TR + [("b", _bounds("t", "trial_id, valence, arousal", "(n - 384)", 128.0, 1.0, 0.5))],
    f"""select trial_id, window_index, start + 384 as start, "end" + 384 as "end", {rx('(start + 384) / 128e0', 'window_start_sec')}, {rx('("end" + 384) / 128e0', 'window_end_sec')},
    case when arousal >= 5.5 and valence <= 4.5 then 'stress' when arousal <= 4.5 and valence >= 5.5 then 'baseline' else 'disbalance' end as label from b""")
_dual = """select trial_id, '{p}' as phase, window_index, start, "end", cast(round_even(start / 128e0 * 250e0, 0) as bigint) as other_start, cast(round_even("end" / 128e0 * 250e0, 0) as bigint) as other_end from {t}"""
ORACLES["s07_dual_rate"] = ctes(TR + [("b1", _bounds("t", "trial_id", "n", 128.0, 1.0, 0.7)), ("b2", _bounds("t", "trial_id", "256", 128.0, 1.0, 1.0))],
                                _dual.format(p="stimulus", t="b1") + " union all " + _dual.format(p="baseline", t="b2"))
ORACLES["s08_mean_lead"] = ctes([V("fx_signals"), ("s", "select segment_id, part * 64 + unnest(range(0, 64)) as i, unnest(samples) as v from fx_signals")],
                                f"select segment_id, i, {rx('avg(v)', 'v')} from s group by all")
ORACLES["s09_s10_units"] = f"""select event_id, {rx('value / 97e0 * 1000e0', 't_ms')}, {rx('(value / 97e0 - 2.8e0) / 50e0 * 1000e0', 'ecg')}, {rx('58.962e0 * value / 97e0 - 115.09e0', 'bvp')},
    {rx('24e0 * value / 97e0 - 49.2e0', 'gsr')}, {rx('58.923e0 * value / 97e0 - 115.01e0', 'resp')}, {rx('21.341e0 * value / 97e0 - 32.085e0', 'temp')},
    {rx('0.5e0 + 9e0 * (value * 10e0 - 2000e0 + 26225e0) / 52450e0', 'joystick')} from events"""
ORACLES["s11_stimulus_order"] = """select o_orderkey as place, 'seq_sub1' as subject_id, lower(trim(o_orderpriority)) as stimulus from orders
    union all select o_orderkey, 'seq_sub2', lower(o_orderstatus) from orders where o_orderstatus <> 'P'"""
_dur = case_map("lower(trim(stimulus))", _DURATIONS)
ORACLES["s12_s14_stimulus_offsets"] = ctes([V("fx_stimuli"), ("a", f"select subject_id, position, lower(trim(stimulus)) as stimulus, {_dur} as d from fx_stimuli where {_dur} is not null")],
    f"""select subject_id, position, stimulus, {rx('coalesce(sum(d) over (partition by subject_id order by position rows between unbounded preceding and 1 preceding), 0e0)', 'start_s')},
    coalesce({case_map('stimulus', cfg.STIMULUS_LABELS)}, 'disbalance') as label from a""")
ORACLES["s13_interval_windows"] = ctes([V("fx_trials"), V("fx_aux"),
    ("w", "select recording_id, trial_id, onset, k as window_index, onset + k * 150e0 as ws, onset + k * 150e0 + 240e0 as we from (select *, unnest(range(0, 10)) as k from fx_trials) where onset + k * 150e0 + 240e0 <= onset + duration + 1e-6")],
    f"""select trial_id, window_index, {rx('ws', 'window_start_sec')}, count(*) as n, {rx('avg(v) * 1e6', 'mean_v')} from w join fx_aux p on p.recording_id = w.recording_id and t >= ws and t <= we
    group by trial_id, window_index, ws having count(*) >= 2""")
_names = "[" + ", ".join(f"'{n}'" for n in cfg.TARGET_NAMES) + "]"
EV = [V("fx_trials"), ("ev", "select recording_id, trial_id, onset, duration, cast(trial_type as bigint) as tt from fx_trials where cast(trial_type as int) between 1 and 9")]
ORACLES["s15_s16_target_events"] = ctes(EV + [("x", "select *, row_number() over (partition by recording_id order by onset, tt, trial_id) - 1 as trial_index, greatest(cast(round_even(onset * 0.5e0, 0) as bigint), 0) as start, least(cast(round_even((onset + duration) * 0.5e0, 0) as bigint), 1290000) as en from ev")],
    f"""select recording_id, trial_id, trial_index, tt as trial_type, start, en as "end", {rx('[1.5e0, 4.5e0, 7.5e0][(tt - 1) % 3 + 1]', 'target_valence')}, {rx('[1.5e0, 4.5e0, 7.5e0][(tt - 1) // 3 + 1]', 'target_arousal')},
    {_names}[tt] as target from x where en - start >= 256""")
ORACLES["s17_s18_event_means"] = ctes(EV + [V("fx_aux"), ("m", "select trial_id, avg(v) * 1e6 as aux from ev join fx_aux p on p.recording_id = ev.recording_id and t >= onset and t < onset + duration group by all")],
    f"select trial_id, {rx('coalesce(aux, [1.5e0, 4.5e0, 7.5e0][(tt - 1) % 3 + 1])', 'valence')}, aux is not null as measured from ev left join m using (trial_id)")
ORACLES["s19_path_ids"] = """select page_id, lpad(cast(page_id % 40 as varchar), 2, '0') as subject, cast(page_id % 3 as varchar) as session, 'run' || cast(page_id % 5 as varchar) as run,
    'S' || lpad(cast(page_id % 40 as varchar), 2, '0') as subject_code from pages"""
ORACLES["s20_self_report_lookup"] = f"""select subject, phase, {rx('1e0 + doc_id % 9', 'valence')}, {rx('1e0 + doc_id * 7 % 9', 'arousal')} from (
    select doc_id, 'S' || cast(doc_id % 17 as varchar) as subject, lower(trim(lang)) as phase, row_number() over (partition by doc_id % 17, lower(trim(lang)) order by doc_id desc) as rn from documents) where rn = 1"""
_tok = lambda t: f"case when regexp_matches(lower({t}), 'stress|mmst|arousal_high') then 'stress' when regexp_matches(lower({t}), 'calm|baseline|rest') then 'baseline' else 'disbalance' end"
ORACLES["s22_text_labels"] = f"select doc_id, {_tok(chr(40) + 'text || chr(32) || source' + chr(41))} as state from documents"
ORACLES["s23_epochs"] = ctes([("e", """select event_id, 'stem_' || case when event_id % 4 = 0 then 'calm' else 'mmst' end as stem, event_id % 50 as k, case when event_id % 3 = 0 then 'Rest block' end as lab,
    case when event_id % 2 = 0 then event_type end as en, case when event_id % 7 = 0 then 'task' end as ph, case when event_id % 5 = 0 then 1 + (event_id % 9) / 2e0 end as v,
    case when event_id % 5 = 0 then 1 + (event_id * 3 % 9) / 2e0 end as a from events""")],
    f"""select event_id, case when lab is not null then {_tok('lab')} when v is not null then case when a >= 3.5 and v <= 2.5 then 'stress' when a <= 2.5 and v >= 3.5 then 'baseline' else 'disbalance' end
    when en is not null then {_tok('en')} else {_tok('stem')} end as state, coalesce(ph, lower(en), stem) as phase_name, {rx('k * 4e0', 'window_start_sec')}, {rx('(k + 1) * 4e0', 'window_end_sec')} from e""")
ORACLES["s24_fallback_signal"] = ctes([V("fx_signals")],
    f"select segment_id, channel, part, {rx('case when part % 3 <> 0 then samples[1] when part % 2 = 0 then samples[2] * 10e0 end', 'ecg')} from fx_signals")
ORACLES["s25_s26_expand_segments"] = ctes([fx_cte(),
    ("a", """select segment_id, cast(segment_id as bigint) as e, window_start_sec as ws, case when cast(segment_id as bigint) % 4 <> 0 then window_start_sec + 3 + cast(segment_id as bigint) % 20 end as we,
        case when cast(segment_id as bigint) % 3 = 0 then 5e0 + cast(segment_id as bigint) % 17 end as sd from fx"""),
    ("b", "select *, coalesce(sd, we - ws, nullif(e % 30, 0)::double) as d from a"),
    ("c", "select *, unnest(case when d > 8 then range(0, cast(floor((round_even(d * 1000, 0) - 8000) / 4000) as bigint) + 1) else [null] end) as k from b"),
    ("f", "select *, ws + k * 4e0 as b, least(ws + k * 4e0 + 8e0, coalesce(we, ws + d)) as s from c")],
    f"""select case when k is null then segment_id else segment_id || '_dyn' || lpad(cast(k as varchar), 3, '0') end as segment_id, case when k is not null then segment_id end as parent_segment_id, k as dynamic_window_index,
    {rx('coalesce(b, ws)', 'window_start_sec')}, {rx('case when k is null then we else s end', 'window_end_sec')}, {rx('case when k is null then sd else s - b end', 'segment_duration_sec')},
    k * 512 as from_sample, (k * 4 + 8) * 128 as to_sample from f""")
ORACLES["s27_quarantine"] = ctes([fx_cte()], "select case when heart_rate is not null and eeg_left_power is not null then 'valid' else 'quarantine' end as part, count(*) as n from fx group by all")
_defaults = ", ".join(f"('{d}', '{regime}', {num(w)}, {num(st)})" for regime, table in (("static", cfg.STATIC_WINDOWS), ("dynamic", cfg.DYNAMIC_WINDOWS)) for d, (w, st) in table.items())
ORACLES["s30_default_windows"] = ctes([fx_cte(),
    ("wd", f"select * from (values {_defaults}) as t(dataset, regime, w, st)"),
    ("cu", """select fx.segment_id, fx.dataset, regime, cast(w * 128 as bigint) as w, cast(st * 128 as bigint) as st, (cast(fx.segment_id as bigint) % 120 + 1) * 128 as n
        from fx join wd on wd.dataset = lower(fx.dataset)"""),
    ("ct", "select *, (n - w) // st as k from cu where n >= w")],
    "select dataset, regime, cast(sum(k + 1) as bigint) as windows, count(distinct segment_id) as segments, max(k * st + w) as last_sample from ct group by all")
ORACLES["s28_discover_runs"] = "select distinct event_type as dataset, case event_id % 3 when 0 then 'strict' else 'proxy' end as mode from events where event_id % 3 < 2"
ORACLES["s29_sinks"] = ctes([fx_cte()], "select 'parquet' as sink, count(*) as rows from fx union all select 'csv', count(*) from fx union all select 'json', count(distinct dataset) from fx")


def dft(frames: str, key: str, size: str, fs: float, lo: float, hi: float) -> list[tuple[str, str]]:
    """Density per bin of Hann-windowed frames (key, frame, j, x): bins with lo <= f <= hi, averaged over frames."""
    k = f"{key}, frame"
    return [
        ("fm", f"select *, x - avg(x) over (partition by {k}) as y, 0.5e0 - 0.5e0 * cos(2e0 * pi() * j / {size}) as h from {frames}"),
        ("fn", f"select {k}, any_value({size}) as size, sum(h * h) as hh from fm group by all"),
        ("fk", f"select *, unnest(range(cast(ceil({num(lo)} * size / {num(fs)}) as bigint), cast(floor({num(hi)} * size / {num(fs)}) as bigint) + 1)) as b from fn"),
        ("fd", f"""select {k}, b, any_value(fk.size) as size, (pow(sum(y * h * cos(2e0 * pi() * b * j / fk.size)), 2) + pow(sum(y * h * sin(2e0 * pi() * b * j / fk.size)), 2))
            / ({num(fs)} * any_value(hh)) * case when b = 0 or b * 2 = any_value(fk.size) then 1 else 2 end as p from fk join fm using ({k}) group by {k}, b"""),
        ("psd", f"select {key}, b, b * {num(fs)} / any_value(size) as f, avg(p) as p from fd group by {key}, b"),
    ]


def trapz(key: str, bands: dict[str, tuple[float, float]]) -> str:
    cols = ", ".join(f"case when count(*) filter (f between {num(a)} and {num(b)}) > 0 then coalesce(sum(t) filter (pf >= {num(a)} and f <= {num(b)}), 0e0) end as {n}" for n, (a, b) in bands.items())
    return f"select {key}, {cols} from (select *, lag(f) over w as pf, (p + lag(p) over w) / 2e0 * (f - lag(f) over w) as t from psd window w as (partition by {key} order by b)) group by all"


SPEC = REC + [("fr", "select segment_id, channel, frame, unnest(range(0, 256)) as j, unnest(samples[frame * 128 + 1:frame * 128 + 256]) as x from (select *, unnest(range(0, (len(samples) - 256) // 128 + 1)) as frame from rec where len(samples) >= 256)")] \
    + dft("fr", "segment_id, channel", "256", 128.0, 1.0, 45.0) + [
    ("bp", trapz("segment_id, channel", cfg.EEG_BANDS)),
    ("cp", "select r.segment_id, r.channel, case when right(r.channel, 1) in ('3', '7') then 'left' else 'right' end as side, \"full\", alpha, gamma from rec r left join bp using (segment_id, channel)")]
ORACLES["f01_f02_band_power"] = ctes(SPEC, f"select segment_id, channel, side, {rx(chr(34) + 'full' + chr(34) + ' * 1e3', 'full')}, {rx('alpha * 1e3', 'alpha')}, {rx('gamma * 1e3', 'gamma')} from cp".replace("as full", 'as "full"'))
ORACLES["f03_default_channels"] = ctes(SPEC + [
    ("p0", """select segment_id, "full", list_position(['AF3', 'F7', 'AF4', 'F8'], channel) - 1 as position, cast(substr(segment_id, 2) as bigint) as s, channel as given from cp"""),
    ("p1", "select *, case when s % 2 = 0 and position = 2 then null else given end as kept, case when s % 5 = 0 then 'unlisted' else 'dreamer' end as dataset from p0"),
    ("p2", """select *, case when count(kept) over (partition by segment_id) = count(*) over (partition by segment_id) then kept
        when dataset = 'unlisted' then 'EEG_' || (position + 1) else ['AF3', 'F7', 'F3', 'FC5'][position + 1] end as channel from p1""")],
    f"""select segment_id, dataset, cast(position as bigint) as position, channel, case when dataset = 'unlisted' then 'mid' when right(channel, 1) in ('3', '5', '7') then 'left' else 'right' end as side,
    {rx('"full" * 1e3', 'full').replace('as full', 'as "full"')} from p2""")
_side = lambda s, b: f"avg({b}) filter (side = '{s}')"
ORACLES["f03_f06_eeg_features"] = ctes(SPEC + [
    ("e0", f"""select segment_id, {_side('left', '"full"')} as l, {_side('right', '"full"')} as rr, avg(gamma) as g, {_side('left', 'alpha')} as al, {_side('right', 'alpha')} as ar,
        count(*) filter (side = 'left') > 0 and count(*) filter (side = 'right') > 0 as two from cp group by segment_id"""),
    ("e1", "select segment_id, case when two then l end as l, case when two then rr end as rr, case when two then g end as g, case when two then al end as al, case when two then ar end as ar from e0")],
    f"""select segment_id, {rx('l * 1e3', 'eeg_left_power')}, {rx('rr * 1e3', 'eeg_right_power')}, {rx('g * 1e3', 'eeg_gamma_power')}, {rx('al * 1e3', 'eeg_alpha_left')}, {rx('ar * 1e3', 'eeg_alpha_right')},
    {rx('ln(ar + 1e-8) - ln(al + 1e-8)', 'alpha_asymmetry')}, {rx('g / (al + ar + 1e-8) * 1e3', 'gamma_alpha_ratio')}, case when g is not null then 'direct' else 'unavailable' end as prov_eeg_gamma_power, 'eeg' as source_eeg_gamma_power from e1""")
ORACLES["f09_f13_rr_features"] = ctes([V("fx_beats"),
    ("b", "select segment_id, rr, row_number() over w as k, lag(rr) over w as pr, count(*) over (partition by segment_id) as n from fx_beats where rr between 0.3 and 2.0 window w as (partition by segment_id order by beat)"),
    ("td", "select segment_id, avg(rr) as m, sqrt(avg(pow(rr - pr, 2))) * 1e3 as rmssd, stddev_samp(rr) * 1e3 as sdnn from b where n >= 6 group by all"),
    ("c", "select *, sum(rr) over (partition by segment_id order by k) - first(rr) over (partition by segment_id order by k) as t from b where n >= 6"),
    ("d", "select *, lead(t) over (partition by segment_id order by k) as t2, lead(rr) over (partition by segment_id order by k) as r2, max(t) over (partition by segment_id) as tm from c"),
    ("g", "select segment_id, unnest(range(0, cast(ceil(tm * 4) as bigint))) as j from (select distinct segment_id, tm from d)"),
    ("i", "select g.segment_id, j, rr + (r2 - rr) * (j / 4e0 - t) / (t2 - t) as y from g join d on d.segment_id = g.segment_id and j / 4e0 >= t and j / 4e0 < t2"),
    ("h", "select segment_id, regr_slope(y, j) as sl, regr_intercept(y, j) as ic, count(*) as size from i group by all having count(*) >= 8"),
    ("fr", "select segment_id, 0 as frame, j, y - (sl * j + ic) as x, size from i join h using (segment_id)")] + dft("fr", "segment_id", "size", 4.0, 0.04, 0.4) + [("bp", trapz("segment_id", cfg.HRV_BANDS))],
    f"""select s.segment_id, {rx('hf * 1e3', 'hrv_hf')}, {rx('lf * 1e3', 'hrv_lf')}, {rx('hf / (lf + 1e-8)', 'hrv_hf_lf')}, {rx('lf / (hf + 1e-8)', 'hrv_lf_hf')}, {rx('60e0 / m', 'heart_rate')}, {rx('rmssd', 'hrv_rmssd')}, {rx('sdnn', 'hrv_sdnn')}
    from (select distinct segment_id from b) s left join td using (segment_id) left join bp using (segment_id)""")
ORACLES["f14_f15_source_preference"] = ctes([fx_cte()],
    f"""select segment_id, {rx('case when cast(segment_id as bigint) % 4 <> 0 then heart_rate else heart_rate + 1 end', 'heart_rate')}, case when cast(segment_id as bigint) % 4 <> 0 then 'direct' else 'proxy' end as prov_heart_rate,
    case when cast(segment_id as bigint) % 4 <> 0 then 'ecg' else 'ppg' end as source_heart_rate from fx where heart_rate is not null""")
_provs = ["stress_label", *cfg.EEG_FEATURES, *cfg.CARDIAC_FEATURES]
_cnt = lambda kind: "cast(" + " + ".join(f"(prov_{p} = '{kind}')::int" for p in _provs) + " as bigint)"
ORACLES["f16_provenance_counts"] = ctes([fx_cte()], f"select segment_id, {_cnt('direct')} as direct_feature_count, {_cnt('proxy')} as proxy_feature_count, {_cnt('unavailable')} as unavailable_feature_count, prov_heart_rate as heart_rate_prov from fx")

_rate = "case when channel in ('AF3', 'AF4') then 128e0 else 100e0 end"
ORACLES["s25_s07_cut_signals"] = ctes([*REC, ("a", f"select *, {_rate} as rate from rec"), ("d", "select segment_id, max(len(samples) / rate) as d from a group by all"),
    ("w", "select segment_id, unnest(case when d > 1.5 then range(0, cast(floor((round_even(d * 1000, 0) - 1500) / 700) as bigint) + 1) else [null] end) as k from d"),
    ("b", """select a.*, k, case when k is null then 0 else cast(round_even(k * 700 / 1000e0 * rate, 0) as bigint) end as s,
        case when k is null then len(samples) else cast(round_even((k * 700 + 1500) / 1000e0 * rate, 0) as bigint) end as e from a join w using (segment_id)"""),
    ("c", "select *, samples[s + 1:e] as x from b")],
    f"""select segment_id, case when k is null then segment_id else segment_id || '_dyn' || lpad(cast(k as varchar), 3, '0') end as sub_id, case when channel in ('AF3', 'AF4') then 'eeg' else 'ecg' end as signal, channel,
    s as start, e as "end", len(x) as n, {rx('coalesce(list_sum(list_transform(x, lambda v: cast(v as double))), 0e0)', 'total')}, {rx('coalesce(list_sum(list_transform(x, lambda v, i: cast(v as double) * i)), 0e0)', 'moment')} from c""")
_place = "list_value(" + ", ".join(f"'{c}'" for c in (*cfg.DEAP_CHANNELS, *cfg.DEAP_PERIPHERAL)) + ")[position + 1]"
ORACLES["s06_trial_signals"] = ctes([
    ("p", "select cast(vec_id as bigint) // 80 as trial_id, (cast(vec_id as bigint) % 80) // 2 as position, cast(vec_id as bigint) % 2 as part, embedding from embeddings"),
    ("g", "select trial_id, position, flatten(list(embedding order by part)) as samples from p group by all"),
    ("t", "select trial_id, max(part) * 64 + 64 as n, 1 + (trial_id * 37 % 81) / 10e0 as valence, 1 + (trial_id * 53 % 81) / 10e0 as arousal from p group by trial_id"),
    ("w", _bounds("t", "trial_id, valence, arousal", "(n - 96)", 32.0, 0.5, 0.25)),
    ("c", 'select *, start + 96 as s, "end" + 96 as e, samples[start + 97:"end" + 96] as x from g join w using (trial_id) where position < 32 or position > 35')],
    f"""select trial_id, window_index, case when arousal >= 5.5 and valence <= 4.5 then 'stress' when arousal <= 4.5 and valence >= 5.5 then 'baseline' else 'disbalance' end as label,
    case position when 36 then 'gsr' when 37 then 'respiration' when 38 then 'ppg' when 39 then 'temperature' else 'eeg' end as signal, {_place} as channel, s as start, e as "end", len(x) as n,
    {rx('coalesce(list_sum(list_transform(x, lambda v: cast(v as double))), 0e0)', 'total')} from c""")
