"""Fixture views over the shared tables, written once as SQL and rendered for Spark or DuckDB.

Only plain arithmetic and a few functions differ between the dialects; numeric literals are
written with an exponent so that both engines read them as doubles.
"""

from __future__ import annotations

import re

_DIALECT = {
    "spark": {
        "SECONDS": "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {0}) / 1e6",
        "DAYS": "datediff({0}, date'1992-01-01')",
        "INTDIV": "{0} div {1}",
        "SCALED": "transform({0}, x -> cast(x as double) * cast(1 + {1} % 7 as double))",
        "LIST": "transform({0}, x -> cast(x as double))",
    },
    "duckdb": {
        "SECONDS": "date_diff('microsecond', timestamp '2024-01-01 00:00:00', {0}) / 1e6",
        "DAYS": "date_diff('day', date '1992-01-01', cast({0} as date))",
        "INTDIV": "{0} // {1}",
        "SCALED": "list_transform({0}, lambda x: cast(x as double) * cast(1 + {1} % 7 as double))",
        "LIST": "list_transform({0}, lambda x: cast(x as double))",
    },
}


def _h(prime: int) -> str:
    """Deterministic pseudo-uniform number on [0, 1) from the event id."""
    return f"(cast((event_id * {prime}) % 1009 as double) / 1009e0)"


_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}

_VIEWS["fx_features"] = (
    f"""
    select subject_id, segment_id, dataset, label, source_record_id,
      window_start_sec, window_start_sec + 1e1 as window_end_sec, 1e1 as segment_duration_sec,
      valence, arousal, 1e0 + 8e0 * {_h(43)} as dominance, cast(null as double) as liking,
      case label when 'baseline' then 0e0 when 'amusement' then 35e-2 when 'disbalance' then 6e-1
        when 'stress' then 1e0 end as stress_label,
      'proxy' as prov_stress_label, 'self_report_label_logic' as source_stress_label,
      case when has_eeg then left_power end as eeg_left_power,
      case when has_eeg then right_power end as eeg_right_power,
      case when has_eeg then 4e-12 * (4e-1 + 12e-1 * {_h(17)} - 2e-1 * tone) end as eeg_gamma_power,
      case when has_eeg then left_power * (15e-2 + 1e-1 * {_h(47)}) end as eeg_alpha_left,
      case when has_eeg then right_power * (15e-2 + 1e-1 * {_h(53)}) end as eeg_alpha_right,
      case when has_eeg then 6e-4 + 5e-4 * (16e-1 * {_h(7)} - 8e-1 + 3e-1 * tone) end as alpha_asymmetry,
      case when has_eeg then 4e-4 * (2e-1 + 16e-1 * {_h(19)} - 1e-1 * tone) end as gamma_alpha_ratio,
      case when has_hrv then lf * ratio end as hrv_hf,
      case when has_hrv then lf end as hrv_lf,
      case when has_hrv then ratio end as hrv_hf_lf,
      case when has_hrv then 1e0 / ratio end as hrv_lf_hf,
      case when has_hrv then 7e1 + 7e1 * {_h(23)} - 8e0 * tone end as heart_rate,
      case when has_hrv then 2e1 + 6e1 * {_h(37)} end as hrv_rmssd,
      case when has_hrv then 25e0 + 7e1 * {_h(41)} end as hrv_sdnn,
      {', '.join(f"case when has_eeg then 'direct' else 'unavailable' end as prov_{c}, 'eeg' as source_{c}"
                 for c in ('eeg_left_power','eeg_right_power','eeg_gamma_power','eeg_alpha_left',
                           'eeg_alpha_right','alpha_asymmetry','gamma_alpha_ratio'))},
      {', '.join(f"case when not has_hrv then 'unavailable' when ppg then 'proxy' else 'direct' end as prov_{c}, "
                 f"case when not has_hrv then '' when ppg then 'ppg' else 'ecg' end as source_{c}"
                 for c in ('hrv_hf','hrv_lf','hrv_hf_lf','hrv_lf_hf','heart_rate','hrv_rmssd','hrv_sdnn'))}
    from (
      select b.*,
        case label when 'baseline' then 1e0 when 'stress' then -1e0 when 'amusement' then 5e-1 else 0e0 end as tone,
        1e-8 * (5e-1 + {_h(11)}) as left_power,
        1e-8 * (5e-1 + {_h(11)}) * (106e-2 + 12e-2 * ({_h(13)} - 5e-1)) as right_power,
        1e-4 * (1e0 + {_h(31)}) as lf,
        2e-1 + 58e-1 * {_h(29)} as ratio
      from (
        select event_id,
          concat('U', cast(user_id as varchar(20))) as subject_id,
          lpad(cast(event_id as varchar(20)), 12, '0') as segment_id,
          case user_id % 3 when 0 then 'ds002724' when 1 then 'dreamer' else 'case' end as dataset,
          case event_type when 'view' then 'baseline' when 'error' then 'stress'
            when 'signup' then 'amusement' else 'disbalance' end as label,
          concat('R', cast(user_id as varchar(20))) as source_record_id,
          SECONDS(ts) as window_start_sec,
          1e0 + 8e0 * cast(regexp_extract(props, '([0-9]+)', 1) as double) / 99e0 as valence,
          least(9e0, 1e0 + value / 5e1) as arousal,
          event_id % 11 <> 0 as has_eeg, event_id % 13 <> 0 as has_hrv, event_id % 5 = 0 as ppg
        from {{events}}
      ) b
    ) v
    """,
    ("events",),
)

_VIEWS["fx_windows"] = (
    "select cast(vec_id as bigint) as sample_index, concat('S', cast(label as varchar(10))) as state, "
    "'embedded' as scenario, SCALED(embedding, vec_id) as window_values from {embeddings}",
    ("embeddings",),
)

# Four channels per pseudo dataset: two left and two right electrodes of the dreamer montage.
_VIEWS["fx_signals"] = (
    """
    select concat('E', cast(INTDIV(vec_id, 32) as varchar(20))) as segment_id, 'dreamer' as dataset,
      case INTDIV(vec_id, 8) % 4 when 0 then 'AF3' when 1 then 'F7' when 2 then 'AF4' else 'F8' end as channel,
      vec_id % 8 as part, LIST(embedding) as samples
    from (select cast(vec_id as bigint) as vec_id, embedding from {embeddings}) e
    """,
    ("embeddings",),
)

# Label track: recordings of 4000 samples, runs of 40 samples with one code, 0 is not a known label.
_VIEWS["fx_label_track"] = (
    """
    select concat('R', cast(INTDIV(event_id, 4000) as varchar(20))) as recording_id, event_id % 4000 as i,
      cast((INTDIV(event_id, 40) * 7 + INTDIV(event_id, 400)) % 5 as int) as label_code, value
    from {events}
    """,
    ("events",),
)

_VIEWS["fx_beats"] = (
    """
    select concat('B', cast(INTDIV(event_id, 64) as varchar(20))) as segment_id, event_id % 64 as beat,
      25137e-5 + cast((event_id * 37) % 101 as double) / 97e0 as rr
    from {events}
    """,
    ("events",),
)

_VIEWS["fx_stimuli"] = (
    """
    select concat('C', cast(o_custkey as varchar(20))) as subject_id, o_orderkey as position,
      case o_orderpriority when '1-URGENT' then 'Scary-1 ' when '2-HIGH' then 'amusing-1'
        when '3-MEDIUM' then ' boring-1' when '4-NOT SPECIFIED' then 'bluVid' else 'unknown-clip' end as stimulus
    from {orders}
    """,
    ("orders",),
)

_VIEWS["fx_trials"] = (
    """
    select concat('U', cast(o_custkey % 15 as varchar(20))) as recording_id, o_orderkey as trial_id,
      cast((o_orderkey * 7919) % 2592000 as double) as onset, 6e2 as duration,
      cast(o_orderkey % 12 as varchar(10)) as trial_type
    from {orders}
    """,
    ("orders",),
)

_VIEWS["fx_aux"] = (
    """
    select concat('U', cast(user_id % 15 as varchar(20))) as recording_id, event_id, SECONDS(ts) as t, value / 1e6 as v
    from {events}
    """,
    ("events",),
)


def _expand(text: str, dialect: str) -> str:
    for word, template in _DIALECT[dialect].items():
        text = re.sub(
            rf"\b{word}\(([\w, .]+)\)", lambda m, t=template: "(" + t.format(*m.group(1).split(", ")) + ")", text
        )
    return text


def spark_view(name: str) -> tuple[str, tuple[str, ...]]:
    body, sources = _VIEWS[name]
    return _expand(body, "spark"), sources


def duckdb_view(name: str) -> str:
    body, sources = _VIEWS[name]
    return _expand(body, "duckdb").format(**{s: s for s in sources})
