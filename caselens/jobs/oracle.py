"""The queries' SQL for another engine, from shared fragments that follow the definitions and not the Spark code."""

from __future__ import annotations

_CTE = {
    "runs": """select n as case_no, 'svc' || cast(n // 4 as varchar) as service, case when n % 4 < 2 then 'cpu' else 'delay' end as fault_type,
      cast(n % 2 + 1 as varchar) as run_number, case when n = 7 then 1706313600 else 1704585600 + 172800 * n end as inject_s,
      'svc' || cast(n // 4 as varchar) || '_' || case when n % 4 < 2 then 'cpu' else 'delay' end as scenario,
      'svc' || cast(n // 4 as varchar) || '_' || case when n % 4 < 2 then 'cpu' else 'delay' end || '-' || cast(n % 2 + 1 as varchar) as case_id from range(8) t(n)""",
    "ev": "select user_id % 8 as case_no, event_type as e, epoch_us(ts) as ts_us, value, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type in ('view','error','click','purchase','signup')",
    "samples": """select case_no, case when e in ('view','error') then 'metrics' when e = 'click' then 'logs' when e = 'purchase' then 'trace_latency' else 'trace_error' end as data_name,
      case when e in ('view','error') then 'metric' when e = 'click' then 'log' when e = 'purchase' then 'trace_latency' else 'trace_error' end || '__svc' || cast(k % 2 as varchar) || '_' ||
      case when e = 'view' then 'cpu' when e = 'error' then 'error' when e = 'click' then cast(k % 3 as varchar) when k % 4 < 2 then 'Get' else 'Put' end as column_name,
      ts_us, case when k % 23 <> 0 then value end as value from ev where not (case_no = 5 and e = 'error' and k % 2 = 1) and not (case_no = 6 and e = 'purchase' and k % 2 = 0 and k % 4 >= 2)""",
    "win": """select s.case_no, data_name, column_name, value, cast(floor((ts_us - inject_s * 1000000) / 21600000000.0) as integer) as bin_index,
      case when ts_us < inject_s * 1000000 then 'baseline' else 'incident' end as window_type from samples s join runs r on s.case_no = r.case_no
      where ts_us >= (inject_s - 432000) * 1000000 and ts_us < (inject_s + 432000) * 1000000""",
    "aligned": """select case_no, data_name, column_name, bin_index, case when count(value) = count(*) then case when max(data_name) in ('logs','trace_error') then sum(value) else avg(value) end end as value,
      count(*) as sample_count from win group by case_no, data_name, column_name, bin_index""",
    "dense": """select k.case_no, k.column_name, cast(b as integer) as bin_index, a.value, coalesce(a.sample_count, 0) as sample_count from (select distinct case_no, column_name from aligned) k
      cross join range(-20, 20) g(b) left join aligned a on a.case_no = k.case_no and a.column_name = k.column_name and a.bin_index = b""",
    "harm": """select case_no, column_name, bin_index, value, sample_count from aligned where data_name <> 'logs' union all
      select a.case_no, 'log__' || split_part(column_name, '_', 3) || '__' || category, bin_index, sum(value), cast(sum(sample_count) as bigint) from aligned a
      join cl on cl.case_no = a.case_no and cl.cluster_id = cast(split_part(column_name, '_', 4) as bigint) where data_name = 'logs' group by all""",
    "sch": """select *, case when keep then '' else 'gauge_coverage_below_threshold' end as drop_reason, row_number() over (order by case modality when 'metric' then 1 when 'log' then 2 when 'trace_latency' then 3 else 4 end, column_name) as position
      from (select *, case when family in ('log_count', 'trace_error', 'error_signal') then 'zero' else 'interpolate' end as fill_policy, family in ('log_count', 'trace_error', 'error_signal') or run_coverage >= 0.5 as keep
      from (select column_name, split_part(column_name, '__', 1) as modality, case when column_name like 'log%' then 'log_count' when column_name like 'trace_latency%' then 'trace_latency' when column_name like 'trace_error%' then 'trace_error'
      when column_name like '%_error' then 'error_signal' else 'continuous_resource' end as family, count(distinct case_no) / (select count(distinct case_no) from aligned) as run_coverage from harm group by column_name))""",
    "bins": """select r.case_no, d as data_name, w as window_type, 20 - count(distinct bin_index) as empty_bins, (20 - count(distinct bin_index)) / 20 as ratio, (20 - count(distinct bin_index)) / 20 > /*most*/0.25 as excluded, any_value(o) as o
      from runs r cross join (values ('metrics',1),('logs',2),('trace_latency',3),('trace_error',4)) a(d,o) cross join (values ('baseline'),('incident')) b(w) left join win on win.case_no = r.case_no and data_name = d and window_type = w group by r.case_no, d, w""",
    "verd": "select case_no, not bool_or(excluded) as eligible, coalesce(string_agg(data_name || '_' || window_type || '_missing_ratio=' || printf('%.2f', ratio), '|' order by o, window_type) filter (excluded), '') as exclusion_reason from bins group by case_no",
    "comp": """select c.case_no, s.column_name, cast(b as integer) as bin_index, s.modality, s.family, s.fill_policy, not exists (select 1 from harm h where h.case_no = c.case_no and h.column_name = s.column_name) as absent, h.value
      from (select case_no from verd where eligible) c cross join (select * from sch where keep) s cross join range(-20, 20) g(b) left join harm h on h.case_no = c.case_no and h.column_name = s.column_name and h.bin_index = b""",
    "near": """select d.*, case when column_name like 'log%' or column_name like 'trace_error%' or column_name like '%_error' then 'zero' else 'interpolate' end as policy,
      (select max(x.bin_index) from comp x where x.case_no = d.case_no and x.column_name = d.column_name and x.value is not null and x.bin_index <= d.bin_index) as pb,
      (select min(x.bin_index) from comp x where x.case_no = d.case_no and x.column_name = d.column_name and x.value is not null and x.bin_index >= d.bin_index) as nb from comp d""",
    "filled": """select n.case_no, n.column_name, n.bin_index, n.policy, n.value, case when n.value is not null then n.value when n.policy = 'zero' then 0.0
      when pb is not null and nb is not null then p.value + (q.value - p.value) * (n.bin_index - pb) / (nb - pb) when pb is not null and n.bin_index - pb <= 2 then p.value
      when nb is not null and nb - n.bin_index <= 2 then q.value end as filled from near n
      left join comp p on p.case_no = n.case_no and p.column_name = n.column_name and p.bin_index = n.pb left join comp q on q.case_no = n.case_no and q.column_name = n.column_name and q.bin_index = n.nb""",
    "st": """select case_no, column_name, avg(filled) filter (bin_index < 0) as bm, stddev_pop(filled) filter (bin_index < 0) as sd, min(filled) filter (bin_index < 0) as lo,
      max(filled) filter (bin_index < 0) as hi, avg(filled) filter (bin_index >= 0) as im, max(filled) filter (bin_index >= 0) as mx from filled group by all""",
    "stats": """select case_no, column_name, bm as baseline_mean, mx as incident_max, im - bm as delta_mean,
      case when mx is null or bm is null then null when lo = hi then 100.0 * sign(mx - bm) else greatest(-100.0, least(100.0, (mx - bm) / sd)) end as zscore_max,
      case when im is null or bm is null then null when lo = hi then 100.0 * sign(im - bm) else greatest(-100.0, least(100.0, (im - bm) / sd)) end as zscore_mean from st""",
    "long": "select case_no, column_name || '__baseline_mean' as feature_name, baseline_mean as value from stats union all select case_no, column_name || '__incident_max' as feature_name, incident_max as value from stats union all select case_no, column_name || '__delta_mean' as feature_name, delta_mean as value from stats union all select case_no, column_name || '__zscore_max' as feature_name, zscore_max as value from stats union all select case_no, column_name || '__zscore_mean' as feature_name, zscore_mean as value from stats",
    "quality": """select c.case_no, c.data_name, row_count, feature_count, invalid_timestamp_count, missing_feature_count, duplicate_timestamp_count, start_us, end_us, inject_s from
      (select case_no, data_name, count(distinct column_name) as feature_count, count(*) - count(value) as missing_feature_count, min(ts_us) as start_us, max(ts_us) as end_us from samples group by all) c
      join (select case_no, data_name, cast(sum(m) as bigint) as row_count, coalesce(cast(sum(m) filter (ts_us is null) as bigint), 0) as invalid_timestamp_count, cast(sum(m - 1) filter (ts_us is not null) as bigint) as duplicate_timestamp_count
        from (select case_no, data_name, ts_us, max(n) as m from (select case_no, data_name, column_name, ts_us, count(*) as n from samples group by all) group by all) group by all) t
      on t.case_no = c.case_no and t.data_name = c.data_name join runs r on r.case_no = c.case_no""",
    "q2": """select case_no, data_name, row_count, feature_count, invalid_timestamp_count, missing_feature_count, duplicate_timestamp_count, start_us, end_us, round(inject_s - start_us / 1e6, 3) as seconds_before_injection, round(end_us / 1e6 - inject_s, 3) as seconds_after_injection, ok as window_covered,
      coalesce(nullif(concat_ws('|', case when invalid_timestamp_count > 0 then 'invalid_timestamp' end, case when missing_feature_count > 0 then 'missing_feature' end, case when duplicate_timestamp_count > 0 then 'duplicate_timestamp' end, case when not ok then 'insufficient_window' end), ''), 'valid') as status
      from (select *, inject_s - start_us / 1e6 >= 432000 and end_us / 1e6 - inject_s >= 432000 as ok from quality)""",
    "gapped": """select s.*, inject_s, value is null as gap, row_number() over (partition by s.case_no, data_name, column_name order by ts_us, case when value is null then 1 else 0 end) as rn from samples s join runs r on s.case_no = r.case_no""",
    "isl": "select *, rn - row_number() over (partition by case_no, data_name, column_name order by rn) as island from gapped where gap",
    "cl": """select n // 3 as case_no, n % 3 as cluster_id, case (n % 3 + n // 3) % 3 when 0 then 'lifecycle' when 1 then 'error' else 'routine' end as category from range(24) t(n)""",
    "clt": "select *, case category when 'lifecycle' then 'server initializing on port' when 'error' then 'request failed with error code' else 'handled request in time' end as template from cl",
    "maps": """select a.case_no, column_name, split_part(column_name, '_', 3) as service, clt.cluster_id, template, category, 'log__' || split_part(column_name, '_', 3) || '__' || category as harmonized_column,
      count(*) as n, coalesce(sum(value) filter (bin_index < 0), 0.0) as baseline_sum, coalesce(sum(value) filter (bin_index >= 0), 0.0) as incident_sum
      from aligned a join clt on clt.case_no = a.case_no and clt.cluster_id = cast(split_part(column_name, '_', 4) as bigint) where data_name = 'logs' group by all""",
    "cmaps": "select * from maps where case_no in (select case_no from verd where eligible)",
    "how": """select case_no, column_name, bin_index, policy, case when value is not null then 'observed' when policy = 'zero' then 'zero' when pb is not null and nb is not null then 'linear'
      when bin_index - pb <= 2 or nb - bin_index <= 2 then 'edge' else 'none' end as method from near""",
    "chg": """select case_no, round(avg(case when baseline_calls > 0 and (baseline_calls - incident_calls) / baseline_calls > 0.2 then 1.0 else 0.0 end), 6) as edge_drop_share, round(max(case when baseline_calls > 0 then (baseline_calls - incident_calls) / baseline_calls else 0.0 end), 6) as max_drop,
      round(coalesce((sum(incident_calls) - sum(baseline_calls)) / nullif(sum(baseline_calls), 0), 0), 6) as total_change from vol group by case_no""",
    "cnt": "select count(*) as np from part",
    "spans": """select o_custkey % 8 as case_no, l_quantity as duration, cast(l_orderkey as varchar) as trace_id, l_orderkey || '-' || l_linenumber as span_id,
      case when l_linenumber = 1 or l_partkey % 40 = 0 or l_linenumber = 5 then null else l_orderkey || '-' || (l_linenumber - 1) end as parent_id, lower(a.p_type) || 'service' as service,
      'shop.' || upper(b.p_type) || 'Service/Get' as operation, lower(b.p_type) || 'service' as callee, epoch_us(o_orderdate) as start_us,
      case when l_suppkey % 11 = 0 then null when l_returnflag = 'R' then 14 else 0 end as status,
      row_number() over (partition by o_custkey % 8, l_orderkey, l_linenumber order by o_orderdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) as rn
      from lineitem join orders on l_orderkey = o_orderkey join part a on a.p_partkey = l_partkey cross join cnt join part b on b.p_partkey = (l_suppkey * 7) % np""",
    "firsts": "select * from spans where rn = 1",
    "struct": """select *, coalesce(nullif(concat_ws('|', case when missing_trace_id_count > 0 then 'missing_trace_id' end, case when missing_span_id_count > 0 then 'missing_span_id' end, case when invalid_timestamp_count > 0 then 'invalid_timestamp' end,
      case when invalid_duration_count > 0 then 'invalid_duration' end, case when negative_duration_count > 0 then 'negative_duration' end, case when duplicate_span_id_count > 0 then 'duplicate_span_id' end), ''), 'valid') as status from
      (select case_no, count(*) as span_count, count(distinct span_id) as unique_span_count, count(span_id) - count(distinct span_id) as duplicate_span_id_count, count(*) - count(trace_id) as missing_trace_id_count, count(*) - count(span_id) as missing_span_id_count,
      count(*) - count(service) as missing_service_count, count(*) - count(operation) as missing_operation_count, count(*) - count(status) as missing_status_code_count, count(*) - count(start_us) as invalid_timestamp_count, count(*) - count(duration) as invalid_duration_count,
      count(*) filter (duration < 0) as negative_duration_count, min(start_us) as start_us, max(start_us) as end_us, count(distinct trace_id) as unique_trace_count from spans group by case_no)""",
    "rt": "select case_no, trace_id, count(distinct span_id) filter (parent_id is null) as roots from spans group by all",
    "roots": """select *, coalesce(nullif(concat_ws('|', case when zero_root_trace_count > 0 then 'zero_root_trace' end, case when multiple_root_trace_count > 0 then 'multiple_root_trace' end), ''), 'valid') as status from
      (select case_no, count(*) as unique_trace_count, cast(sum(roots) as bigint) as unique_root_span_count, count(*) filter (roots = 0) as zero_root_trace_count, count(*) filter (roots = 1) as single_root_trace_count,
      count(*) filter (roots > 1) as multiple_root_trace_count, 0 as root_missing_trace_id_count, 0 as root_missing_span_id_count, round(count(*) filter (roots = 1) / count(*), 6) as single_root_ratio, true as identity_balance_valid from rt group by case_no)""",
    "ops": "select *, round(span_count / sum(span_count) over (partition by case_no), 6) as share from (select case_no, service, operation, count(*) as span_count from firsts where parent_id is null group by case_no, service, operation)",
    "stc": """select *, round(span_count / sum(span_count) over (partition by case_no), 6) as share from (select case_no, scope, service, status_code, status_category, count(*) as span_count, count(distinct trace_id) as trace_count
      from (select *, case when parent_id is null then 'root' else 'child' end as scope, coalesce(cast(status as varchar), '<missing>') as status_code,
      case when status is null then 'missing' when status = 0 then 'zero' else 'nonzero' end as status_category from firsts) group by case_no, scope, service, status_code, status_category)""",
    "vol": """select case_no, service as caller, callee, count(*) filter (start_us < (899251200000000 + case_no * 604800000000)) as baseline_calls, count(*) filter (start_us >= (899251200000000 + case_no * 604800000000)) as incident_calls from spans
      where start_us >= (899251200000000 + case_no * 604800000000) - 31536000000000 and start_us < (899251200000000 + case_no * 604800000000) + 31536000000000 and service <> callee group by all""",
    "sw": """select case_no, service, avg(duration) filter (b) as lb, stddev_pop(duration) filter (b) as ls, avg(duration) filter (not b) as li, avg(e) filter (b) as eb, stddev_pop(e) filter (b) as es, avg(e) filter (not b) as ei
      from (select case_no, service, duration, case when status = 14 then 1.0::double else 0.0 end as e, start_us < t as b from (select *, 899251200000000 + case_no * 604800000000 as t from spans) where start_us >= t - 31536000000000 and start_us < t + 31536000000000) group by all""",
    "sanom": """select case_no, m as modality, service, case when s > 0 and case when bm = 0 then im > 0 else im > bm end then greatest((im - bm) / s, 0) else 0 end as magnitude
      from (select case_no, service, 'trace_latency' as m, lb as bm, ls as s, li as im from sw union all select case_no, service, 'trace_error', eb, es, ei from sw)""",
    "hot": "select case_no, service from sanom where modality = 'trace_latency' and magnitude > 0",
    "ed": "select distinct caller, callee from vol",
    "hed": "select a.case_no, caller, callee from ed join hot a on a.service = caller join hot b on b.service = callee and b.case_no = a.case_no",
    "hn": "select case_no, count(*) as n from hot group by all",
    "walk": "select case_no, service, [service] as met, 1 as depth from hot union all select w.case_no, e.callee, list_append(w.met, e.callee), w.depth + 1 from walk w join hed e on e.case_no = w.case_no and e.caller = w.service where not list_contains(w.met, e.callee)",
    "nb": "select caller as s, callee as t from ed union select callee, caller from ed",
    "con": "select case_no, avg(r) as r from (select h.case_no, h.service, count(g.service) / count(*) as r from hot h join nb on nb.s = h.service left join hot g on g.case_no = h.case_no and g.service = nb.t group by all) group by all",
    "deg": "select s, (select count(*) from ed where callee = s) as i, (select count(*) from ed where caller = s) as o from (select distinct s from nb)",
    "anom": """select case_no, split_part(column_name, '__', 1) as modality, split_part(split_part(column_name, '__', 2), '_', 1) as service,
      greatest(0.0, coalesce(max(zscore_mean) filter (case when zscore_mean is null then false when baseline_mean = 0 then baseline_mean + delta_mean > 0 else zscore_mean > 3 and (baseline_mean + delta_mean) / baseline_mean > 1.5 end), 0.0)) as magnitude
      from stats where column_name like 'trace%' group by all""",
    "pol": "select * from (values ('default','svc0','core',3),('default','svc1','edge',1),('flat','svc0','core',1),('flat','svc1','core',1),('reversed','svc0','edge',1),('reversed','svc1','core',3)) t(scheme, service, service_tier, sct)",
    "lab": """select scheme, case_no, case_id, scenario, r.service, fault_type, case fault_type when 'cpu' then 'resource' else 'network' end as fault_category, cast(case fault_type when 'cpu' then 1 else 2 end as bigint) as fcw, service_tier,
      cast(sct as bigint) as sct, cast(case fault_type when 'cpu' then 1 else 2 end * sct as bigint) as severity_score,
      case when case fault_type when 'cpu' then 1 else 2 end * sct <= 2 then 'Low' when case fault_type when 'cpu' then 1 else 2 end * sct <= 4 then 'Medium' else 'High' end as severity from runs r join pol p on p.service = r.service""",
    "dl": "select * from lab where scheme = 'default'",
    "oof": """select doc_id as case_id, cast(r as integer) as repeat, doc_id % 30 as scenario, list_extract(['High','Low','Medium'], quality + toxic + 1) as y_true,
      list_extract(['High','Low','Medium'], (quality + toxic + case when (doc_id * 31 + r * 17) % 7 < 2 then 1 else 0 end) % 3 + 1) as y_pred from labels cross join range(3) t(r)""",
    "cm": "select repeat, c, count(*) filter (y_true = c and y_pred = c) as tp, count(*) filter (y_true = c) as t, count(*) filter (y_pred = c) as p from oof cross join (values ('Low'),('Medium'),('High')) v(c) group by all",
    "sc": """select repeat, round(sum(tp) / sum(t), 6) as accuracy, round(sum(case when t > 0 then tp / t else 0 end) / count(*) filter (t > 0), 6) as balanced_accuracy, round(sum(case when t + p > 0 then 2 * tp / (t + p) else 0 end) / 3, 6) as macro_f1,
      round(coalesce(max(tp / nullif(t, 0)) filter (c = 'Low'), 0), 6) as recall_low, round(coalesce(max(tp / nullif(t, 0)) filter (c = 'Medium'), 0), 6) as recall_medium, round(coalesce(max(tp / nullif(t, 0)) filter (c = 'High'), 0), 6) as recall_high from cm group by repeat""",
    "df": """select scenario, round(avg(case when y_true = y_pred then 1.0 else 0.0 end) filter (repeat = 0) - avg(case when y_true = y_pred then 1.0 else 0.0 end) filter (repeat = 1), 6) as diff from oof where repeat < 2 group by scenario""",
}
_NEEDS = {"samples": "ev", "win": "samples runs", "aligned": "win", "dense": "aligned", "harm": "aligned cl", "sch": "harm", "bins": "win runs", "verd": "bins", "comp": "sch verd", "near": "comp", "filled": "near", "st": "filled", "stats": "st", "long": "stats", "quality": "samples runs", "q2": "quality", "gapped": "samples runs", "isl": "gapped", "spans": "cnt", "firsts": "spans", "struct": "spans", "rt": "spans", "roots": "rt", "ops": "firsts", "stc": "firsts", "vol": "spans", "anom": "stats", "sw": "spans", "sanom": "sw", "hot": "sanom", "ed": "vol", "hed": "ed hot", "hn": "hot", "walk": "hed hn", "nb": "ed", "con": "hot nb", "deg": "nb", "lab": "runs pol", "dl": "lab", "cm": "oof", "sc": "cm", "df": "oof", "clt": "cl", "maps": "aligned clt", "cmaps": "maps verd", "how": "near", "chg": "vol"}


#: Fragments of the queries over all samples, those too that two cases are made to lack elsewhere, and with the operator's own limit of empty bins.
_WHOLE = {"samples": _CTE["samples"].partition(" where not ")[0], "bins": _CTE["bins"].replace("/*most*/0.25", "0.10")}


def sql(body: str, *heads: str, whole: bool = False) -> str:
    """The query over the fragments named, and those they need."""
    cte = _CTE | _WHOLE if whole else _CTE
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for h in heads:
        add(h)
    return "with " + ", ".join(f"{n} as ({cte[n]})" for n in order) + " " + body


EXTRA_SQL = {
    "jn_anomalous_edges": sql("select * from hed", "hed"),
    "agg_propagation_depth": sql("select c.case_no, coalesce(max(w.depth), 0) as depth from (select distinct case_no from sanom) c left join walk w on w.case_no = c.case_no group by all", "walk").replace("with ", "with recursive ", 1),
    "agg_service_context": sql("""select c.case_no, coalesce(h.n, 0) as svc__anomalous_service_count, round(coalesce(h.n, 0) / (select count(distinct s) from nb), 6) as svc__anomalous_service_share, round(c.m, 6) as svc__latency_anomaly_magnitude, c.e as svc__error_service_count,
      (select count(*) from hed where hed.case_no = c.case_no) as svc__anomalous_edge_count, round((select count(*) from hed where hed.case_no = c.case_no) / (select count(*) from ed), 6) as svc__anomalous_edge_share,
      coalesce((select max(depth) from walk where walk.case_no = c.case_no), 0) as svc__propagation_depth, (select count(*) from hot where hot.case_no = c.case_no and not exists (select 1 from hed where hed.case_no = hot.case_no and hed.callee = hot.service)) as svc__anomalous_root_count,
      round(coalesce(con.r, 0), 6) as svc__contagion_ratio, (select count(*) from hot where hot.case_no = c.case_no and service = 'promoservice') as svc__frontend_anomalous,
      coalesce((select max(i) from hot join deg on s = service where hot.case_no = c.case_no), 0) as svc__max_in_degree_anomalous, coalesce((select max(o) from hot join deg on s = service where hot.case_no = c.case_no), 0) as svc__max_out_degree_anomalous,
      round(coalesce(v.x, 0), 6) as svc__call_volume_drop_share, round(coalesce(v.y, 0), 6) as svc__call_volume_max_drop, round(coalesce(v.z, 0), 6) as svc__call_volume_total_change
      from (select case_no, sum(magnitude) filter (modality = 'trace_latency') as m, count(*) filter (modality = 'trace_error' and magnitude > 0) as e from sanom group by all) c left join hn h on h.case_no = c.case_no left join con on con.case_no = c.case_no
      left join (select case_no, avg(case when baseline_calls > 0 and (baseline_calls - incident_calls) / baseline_calls > 0.2 then 1.0 else 0.0 end) as x, max(case when baseline_calls > 0 then (baseline_calls - incident_calls) / baseline_calls else 0.0 end) as y, (sum(incident_calls) - sum(baseline_calls)) / nullif(sum(baseline_calls), 0) as z from vol group by case_no) v on v.case_no = c.case_no""", "walk", "con", "deg").replace("with ", "with recursive ", 1),
    "prj_trace_column_service": sql("select distinct column_name, case when column_name like '%svc0%' then 'svc0' else 'svc1' end as service from samples where data_name like 'trace%'", "samples"),
    "prj_blank_missing": sql("select case_no, count(*) - count(trace_id) as missing_trace_id, count(*) - count(span_id) as missing_span_id, count(*) - count(parent_id) as missing_parent_id from spans group by case_no", "spans"),
    "jn_cluster_dictionary": sql("select case_no, column_name, template, category, n from maps", "maps"),
    "jn_window_range": sql("select case_no, case when start_us < (899251200000000 + case_no * 604800000000) then 'baseline' else 'incident' end as window_type, count(*) as n from spans where start_us >= (899251200000000 + case_no * 604800000000) - 31536000000000 and start_us < (899251200000000 + case_no * 604800000000) + 31536000000000 group by all", "spans"),
    "agg_harmonization_map": sql("select * exclude (n) replace (round(baseline_sum, 6) as baseline_sum, round(incident_sum, 6) as incident_sum) from cmaps", "cmaps"),
    "agg_template_catalog": sql("select template, category, count(distinct case_no) as run_count from cmaps group by all", "cmaps"),
    "agg_align_quality": sql("select w.*, observed_bins, incomplete_cells, 40 - observed_bins as missing_bins, source_features * 40 - f as aligned_missing_cells from (select case_no, data_name, count(*) as source_rows, count(distinct column_name) as source_features, count(*) - count(value) as source_missing_cells from win group by all) w join (select case_no, data_name, count(distinct bin_index) as observed_bins, count(*) - count(value) as incomplete_cells, count(value) as f from aligned group by all) a on a.case_no = w.case_no and a.data_name = w.data_name", "aligned"),
    "agg_validate_aligned": sql("select case_no, count(*) as column_count, cast(sum(n) as bigint) as cell_count, -20 as first_bin, 19 as last_bin, count(*) filter (n <> 40 or d <> 40 or b <> 20) as bad_column_count, 0 as negative_count_cells, 4 - (select count(distinct data_name) from aligned a where a.case_no = x.case_no) as missing_sources, count(*) filter (n <> 40 or d <> 40 or b <> 20) = 0 and (select count(distinct data_name) from aligned a where a.case_no = x.case_no) = 4 as valid from (select case_no, column_name, count(*) as n, count(distinct bin_index) as d, count(*) filter (bin_index < 0) as b from dense group by all) x group by case_no", "dense"),
    "win_edge_fill": sql("select case_no, column_name, bin_index, round(filled, 6) as filled from filled join how using (case_no, column_name, bin_index) where method = 'edge'", "filled", "how"),
    "win_zero_fill": sql("select case_no, column_name, count(*) as n from how where method = 'zero' group by all", "how"),
    "set_missing_extra": sql("select c.case_no, count(a.column_name) as column_count, count(*) - count(a.column_name) as missing_count, coalesce(string_agg(n.column_name, '|' order by n.column_name) filter (a.column_name is null), '') as missing_columns from (select distinct case_no from aligned) c cross join (select distinct column_name from aligned) n left join (select distinct case_no, column_name from aligned) a on a.case_no = c.case_no and a.column_name = n.column_name group by c.case_no", "aligned"),
    "set_traces_without_root": sql("select case_no, trace_id from spans group by all having count(*) = count(parent_id)", "spans"),
    "agg_excluded_runs": sql("select case_no, 'coverage' as stage, 'trace_window_incomplete' as reason from struct where not (start_us <= (899251200000000 + case_no * 604800000000) - 31536000000000 and end_us >= (899251200000000 + case_no * 604800000000) + 31536000000000) union all select case_no, 'bins', exclusion_reason from verd where not eligible", "struct", "verd", whole=True),
    "jn_case_metadata": sql('select case_no, case_id, scenario, service, fault_type, run_number, inject_s from runs where case_no in (select case_no from long)', "long", "runs"),
    "jn_align_labels": sql('select dl.case_no, severity, dl.case_no in (select case_no from long) as featured from dl', "long", "dl"),
}
EXTRA_SQL["agg_validate_cleaned"] = sql("select case_no, (select count(*) from sch where keep) as column_count, 0 as lacking_columns, 0 as extra_columns, 0 as wrong_bin_columns, 0 as zero_policy_gaps, true as valid from verd where eligible", "sch", "verd")
R5 = "round(baseline_mean, 6) as baseline_mean, round(incident_max, 6) as incident_max, round(delta_mean, 6) as delta_mean, round(zscore_max, 6) as zscore_max, round(zscore_mean, 6) as zscore_mean"
ORACLE_SQL = EXTRA_SQL | {
    "src_run_metadata": sql("select case_no, case_id, scenario, service, fault_type, run_number, inject_s from runs", "runs"),
    "flt_observation_window": sql("select case_no, data_name, window_type, count(*) as n from win group by all", "win"),
    "prj_bin_index": sql("select case_no, bin_index, count(*) as n from win group by all", "win"),
    "prj_feature_family": sql("select distinct column_name, case when column_name like 'log%' then 'log_count' when column_name like 'trace_latency%' then 'trace_latency' when column_name like 'trace_error%' then 'trace_error' when column_name like '%_error' then 'error_signal' else 'continuous_resource' end as family from samples", "samples"),
    "prj_log_column_split": sql("select distinct column_name, split_part(column_name, '_', 3) as service, split_part(column_name, '_', 4) as cluster_id from samples where data_name = 'logs'", "samples"),
    "prj_callee": sql("select operation, callee, count(*) as n from spans group by all", "spans"),
    "agg_align_grid": sql("select case_no, data_name, column_name, bin_index, round(value, 6) as value, sample_count from aligned", "aligned", whole=True),
    "jn_grid_densify": sql("select case_no, column_name, bin_index, round(value, 6) as value, sample_count from dense", "dense", whole=True),
    "agg_harmonize_logs": sql("select case_no, column_name, bin_index, round(value, 6) as value, sample_count from harm where column_name like 'log%'", "harm"),
    "win_linear_fill": sql("select case_no, column_name, bin_index, policy, round(filled, 6) as filled from filled", "filled"),
    "agg_cleaning_log": sql("select *, missing_before - missing_after as filled_count, case when missing_before = 0 then 'none' when fill_policy = 'zero' then 'zero_fill' else 'linear_interpolate_edge_fill' end as method from (select c.case_no, c.column_name, any_value(modality) as modality, any_value(family) as family, any_value(fill_policy) as fill_policy, any_value(absent) as column_absent_in_run, count(*) filter (c.value is null) as missing_before, count(*) filter (filled is null) as missing_after from comp c join filled f on f.case_no = c.case_no and f.column_name = c.column_name and f.bin_index = c.bin_index group by c.case_no, c.column_name) where missing_before > 0 or column_absent_in_run", "comp", "filled"),
    "agg_feature_statistics": sql(f"select case_no, column_name, {R5} from stats", "stats"),
    "agg_feature_schema": sql("select * replace (round(run_coverage, 6) as run_coverage) from sch", "sch"),
    "agg_bin_eligibility": sql("select case_no, data_name, window_type, empty_bins, round(ratio, 4) as ratio, excluded, eligible, exclusion_reason from bins join verd using (case_no)", "verd"),
    "agg_log_novelty": sql("select r.case_no, 'log__' || s.service || '__new_template_count' as feature_name, count(m.column_name) as value from verd r cross join (select distinct service from cmaps) s left join cmaps m on m.case_no = r.case_no and m.service = s.service and baseline_sum = 0 and incident_sum > 0 where r.eligible group by all union all select r.case_no, 'log__all__new_template_count', count(m.column_name) from verd r left join cmaps m on m.case_no = r.case_no and baseline_sum = 0 and incident_sum > 0 where r.eligible group by all", "cmaps"),
    "agg_constant_features": sql('select feature_name, (select count(distinct case_no) from stats) - count(value) as missing_count, count(value) = (select count(distinct case_no) from stats) and min(value) = max(value) as constant from long group by feature_name', "long"),
    "win_topk_features": sql("select case_no, rank, column_name, round(zscore_mean, 6) as zscore_mean from (select *, row_number() over (partition by case_no order by abs(zscore_mean) desc nulls last, column_name) as rank from stats) where rank <= 5", "stats"),
    "agg_timeseries_quality": sql("select * from q2", "q2"),
    "agg_missing_by_column": sql("select i.case_no, i.data_name, i.column_name, i.missing_count, longest_missing_streak, missing_before_injection, first_missing_us, last_missing_us, row_count, i.missing_count - missing_before_injection - missing_on_invalid_timestamp as missing_after_injection, missing_on_invalid_timestamp, round(100 * i.missing_count / row_count, 6) as missing_percentage from (select case_no, data_name, column_name, count(*) as missing_count, count(*) filter (ts_us < inject_s * 1000000) as missing_before_injection, count(*) filter (ts_us is null) as missing_on_invalid_timestamp, min(ts_us) as first_missing_us, max(ts_us) as last_missing_us from isl group by all) i join (select case_no, data_name, column_name, max(n) as longest_missing_streak from (select case_no, data_name, column_name, island, count(*) as n from isl group by all) group by all) m using (case_no, data_name, column_name) join (select case_no, data_name, column_name, count(*) as row_count from samples group by all) c using (case_no, data_name, column_name)", "isl"),
    "jn_eligibility": sql("select r.case_no, case_id, bool_and(window_covered) as series_covered, coalesce(string_agg(data_name, '|' order by data_name) filter (not window_covered), '') as uncovered, any_value(t.c) as trace_covered, any_value(t.c) as eligible, case when any_value(t.c) then '' else 'trace_window_incomplete' end as reason from runs r join q2 on q2.case_no = r.case_no join (select case_no, start_us <= (899251200000000 + case_no * 604800000000) - 31536000000000 and end_us >= (899251200000000 + case_no * 604800000000) + 31536000000000 as c from struct) t on t.case_no = r.case_no group by r.case_no, case_id", "q2", "struct", whole=True),
    "agg_trace_structure": sql("select * from struct", "struct"),
    "agg_root_identity": sql("select * from roots", "roots"),
    "agg_root_operations": sql("select * from ops", "ops"),
    "agg_span_status": sql("select * from stc", "stc"),
    "win_first_span": sql("select case_no, service, count(*) as n, cast(sum(start_us) as bigint) as s from firsts group by all", "firsts"),
    "jn_reconcile": sql("select s.case_no, unique_span_count, unique_root_span_count, (select cast(sum(span_count) as bigint) from ops where ops.case_no = s.case_no) as operation_roots, (select cast(sum(span_count) as bigint) from stc where stc.case_no = s.case_no) as status_spans, unique_root_span_count = (select sum(span_count) from ops where ops.case_no = s.case_no) as roots_agree, unique_span_count = (select sum(span_count) from stc where stc.case_no = s.case_no) as spans_agree, true as shares_valid from struct s join roots r on r.case_no = s.case_no", "struct", "roots", "ops", "stc"),
    "agg_call_volume": sql("select * from vol", "vol"),
    "agg_call_graph": sql("select caller, callee, count(*) as run_count, cast(sum(baseline_calls + incident_calls) as bigint) as total_calls from vol group by all", "vol"),
    "agg_call_volume_change": sql("select case_no, round(avg(case when baseline_calls > 0 and (baseline_calls - incident_calls) / baseline_calls > 0.2 then 1.0 else 0.0 end), 6) as edge_drop_share, round(max(case when baseline_calls > 0 then (baseline_calls - incident_calls) / baseline_calls else 0.0 end), 6) as max_drop, round(coalesce((sum(incident_calls) - sum(baseline_calls)) / nullif(sum(baseline_calls), 0), 0), 6) as total_change from vol group by case_no", "vol"),
    "agg_service_anomalies": sql('select case_no, modality, service, round(magnitude, 6) as magnitude from anom', "anom"),
    "jn_label_lookup": sql("select * exclude (scheme), 'fcw_sct_v2' as label_policy_version, 'candidate' as label_status from dl", "dl"),
    "agg_label_distribution": sql("select k.kind, k.name, c as severity, count(case_id) as case_count from (select distinct 'all' as kind, 'all' as name from dl union select distinct 'service', service from dl union select distinct 'fault', fault_type from dl) k cross join (values ('Low'),('Medium'),('High')) v(c) left join dl on dl.severity = c and (k.kind = 'all' or k.kind = 'service' and dl.service = k.name or k.kind = 'fault' and dl.fault_type = k.name) group by all", "dl"),
    "agg_label_sensitivity": sql("select scheme, severity, count(*) as case_count, count(distinct scenario) as scenario_count from lab group by all", "lab"),
    "ml_scores": sql("select * from sc", "sc"),
    "ml_score_summary": sql("select round(avg(macro_f1), 6) as macro_f1_mean, round(stddev_samp(macro_f1), 6) as macro_f1_std, round(avg(accuracy), 6) as accuracy_mean from sc", "sc"),
    "ml_confusion": sql("select y_true, count(*) filter (y_pred = 'Low') as pred_low, count(*) filter (y_pred = 'Medium') as pred_medium, count(*) filter (y_pred = 'High') as pred_high from oof group by y_true", "oof"),
    "ml_scenario_accuracy": sql("select scenario, round(avg(a), 6) as accuracy, count(*) as case_count from (select scenario, case_id, avg(case when y_true = y_pred then 1.0 else 0.0 end) as a from oof group by all) group by scenario", "oof"),
    "win_majority_class": sql("select case_id, y_pred as majority, n as votes from (select case_id, y_pred, count(*) as n, row_number() over (partition by case_id order by count(*) desc, y_pred) as rn from oof group by case_id, y_pred) where rn = 1", "oof"),
}

# The service context's features in long form, audited by trees and variances, merged with the others, described and selected.
_CONTEXT = EXTRA_SQL["agg_service_context"]
_AUDIT = f"""ctx as ({_CONTEXT}), svc as (unpivot (select case_no, cast(columns(* exclude (case_no)) as double) from ctx where case_no in (select case_no from verd where eligible)) on columns(* exclude (case_no)) into name feature_name value value),
  meta as (select case_no, service, service_tier as tier from dl), fm as (select * from svc join meta using (case_no)),
  v as (select feature_name, value as x, count(*) filter (tier = 'core') as a, count(*) filter (tier = 'edge') as b from fm group by all),
  w as (select *, sum(a) over h as la, sum(b) over h as lb, sum(a) over (partition by feature_name) as ta, sum(b) over (partition by feature_name) as tb from v window h as (partition by feature_name order by x)),
  root as (select feature_name, x as r from w where la + lb < ta + tb qualify row_number() over (partition by feature_name order by round((la * la + lb * lb) / (la + lb) + ((ta - la) * (ta - la) + (tb - lb) * (tb - lb)) / (ta + tb - la - lb), 9) desc, x) = 1),
  v2 as (select v.*, coalesce(x > r, false) as s from v left join root using (feature_name)),
  w2 as (select *, sum(a) over h as la, sum(b) over h as lb, sum(a) over (partition by feature_name, s) as ta, sum(b) over (partition by feature_name, s) as tb from v2 window h as (partition by feature_name, s order by x)),
  cut as (select feature_name, s, x as r from w2 where la + lb < ta + tb qualify row_number() over (partition by feature_name, s order by round((la * la + lb * lb) / (la + lb) + ((ta - la) * (ta - la) + (tb - lb) * (tb - lb)) / (ta + tb - la - lb), 9) desc, x) = 1),
  leaf as (select v2.feature_name, v2.s, coalesce(x > r, false) as u, sum(a) as a, sum(b) as b from v2 left join cut on cut.feature_name = v2.feature_name and cut.s = v2.s group by all),
  acc as (select feature_name, list_avg(list_filter([sum(case when a >= b then a else 0 end) / nullif(sum(a), 0), sum(case when b > a then b else 0 end) / nullif(sum(b), 0)], lambda q: q is not null)) as acc from leaf group by feature_name),
  ratio as (select feature_name, wi / nullif(va, 0) as ratio, lo = hi as c from (select feature_name, var_pop(value) as va, min(value) as lo, max(value) as hi from fm group by all) join (select feature_name, avg(q) as wi from (select feature_name, service, var_pop(value) as q from fm group by all) group by all) using (feature_name)),
  proxy as (select *, case when reason = '' then 'passed' else 'rejected' end as decision from (select feature_name, case when not c then round(acc, 4) end as acc, case when not c then round(ratio, 4) end as ratio,
    case when c then 'constant' else concat_ws('|', case when acc >= 0.85 then 'encodes_tier' end, case when ratio < 0.05 then 'service_identifier' end) end as reason from ratio join acc using (feature_name)))"""
_MERGED = f"""{_AUDIT}, nov as (select r.case_no, 'log__' || s.service || '__new_template_count' as feature_name, count(m.column_name) as value from verd r cross join (select distinct service from cmaps) s
    left join cmaps m on m.case_no = r.case_no and m.service = s.service and baseline_sum = 0 and incident_sum > 0 where r.eligible group by all union all
    select r.case_no, 'log__all__new_template_count', count(m.column_name) from verd r left join cmaps m on m.case_no = r.case_no and baseline_sum = 0 and incident_sum > 0 where r.eligible group by all),
  every as (select * from long union all select case_no, feature_name, cast(value as double) from nov union all select case_no, feature_name, value from svc where feature_name in (select feature_name from proxy where decision = 'passed')),
  merged as (select * from every where feature_name not in (select feature_name from every group by feature_name having count(value) = (select count(distinct case_no) from long) and min(value) = max(value))),
  mani as (select feature_name, split_part(feature_name, '__', 1) as modality, case split_part(feature_name, '__', 1) when 'metric' then 'E0' when 'log' then 'E1' when 'svc' then 'E3' else 'E2' end as config,
    case when feature_name like '%__new_template_count' then 'column_harmonization_map.csv' else regexp_extract(feature_name, '^(.*)__', 1) end as source_column, split_part(feature_name, '__', -1) as statistic, 'derived' as origin,
    case when feature_name like 'svc%' then 'passed' else 'n/a' end as audit_status from (select distinct feature_name from merged))"""


def _over(chain: str, body: str, *heads: str) -> str:
    return sql("", *heads).rstrip() + f", {chain}{body if body.startswith(',') else ' ' + body}"


ORACLE_SQL |= {
    "agg_proxy_variance": _over(_AUDIT, "select feature_name, ratio as within_service_variance_ratio, decision, reason from proxy", "verd", "dl"),
    "agg_proxy_tree": _over(_AUDIT, "select feature_name, round(acc, 6) as tier_balanced_accuracy from acc", "verd", "dl"),
    "jn_feature_merge": _over(_MERGED, "select case_no, feature_name, round(value, 6) as value from merged", "verd", "dl", "cmaps", "long"),
    "prj_feature_manifest": _over(_MERGED, "select * from mani", "verd", "dl", "cmaps", "long"),
    "prj_select_config": _over(_MERGED, "select c.config, case_no, count(*) as feature_count, count(value) as value_count from merged join mani using (feature_name) join (values ('E0'),('E1'),('E2'),('E3')) c(config) on mani.config <= c.config group by all", "verd", "dl", "cmaps", "long"),
}
ORACLE_SQL |= {
    "sink_partitioned": sql("select r.case_no, case_id, scenario, run_number, count(distinct bin_index) as row_count, count(distinct column_name) as feature_column_count, count(distinct bin_index) filter (bin_index < 0) as baseline_bin_count, count(distinct bin_index) filter (bin_index >= 0) as incident_bin_count, count(*) filter (d.case_no is not null and value is null) as missing_feature_cell_count, case when count(d.case_no) = 0 then 'alignment_error' else 'valid' end as status from runs r left join dense d on d.case_no = r.case_no group by all", "dense", "runs"),
    "agg_numeric_quality": _over(_MERGED, "select c.config, count(*) as feature_count, sum(i) as infinite_count, count(*) filter (n = 0) as empty_features, count(*) filter (n = k and lo = hi) as constant_features, sum(k - n) as missing_cell_count, count(*) filter (n < k) as features_with_missing, sum(i) + count(*) filter (n = 0) + count(*) filter (n = k and lo = hi) = 0 as valid from (select feature_name, count(*) filter (isinf(value)) as i, count(value) as n, min(value) as lo, max(value) as hi, (select count(distinct case_no) from merged) as k from merged group by feature_name) join mani using (feature_name) join (values ('E0'),('E1'),('E2'),('E3')) c(config) on mani.config <= c.config group by c.config", "verd", "dl", "cmaps", "long"),
    "agg_leakage_audit": _over(_MERGED, ", cp as (select feature_name, i from (select feature_name, i, bool_and(value is not distinct from x) and count(*) = (select count(distinct case_no) from merged) as same from merged join (select case_no, unnest(['fcw', 'sct', 'severity_score']) as i, unnest([fcw, sct, severity_score])::double as x from dl) using (case_no) group by all) where same) select c.config, '' as forbidden, '' as rejected, coalesce(string_agg(cp.feature_name || ' == ' || i, '|' order by cp.feature_name || ' == ' || i), '') as copies, count(cp.feature_name) = 0 as clean from mani join (values ('E0'),('E1'),('E2'),('E3')) c(config) on mani.config <= c.config left join cp using (feature_name) group by c.config", "verd", "dl", "cmaps", "long"),
    "agg_case_consistency": _over(_MERGED, 'select t as "table", count(*) as case_count, 0 as duplicate_cases, 0 as missing_cases, 0 as extra_cases, count(distinct scenario) as group_count, count(*) filter (severity = \'Low\') as n_low, count(*) filter (severity = \'Medium\') as n_medium, count(*) filter (severity = \'High\') as n_high, true as consistent from (select distinct case_no from merged) join dl using (case_no) cross join (values (\'features_E0\'),(\'features_E1\'),(\'features_E2\'),(\'features_E3\'),(\'labels\'),(\'metadata\')) v(t) group by t', "verd", "dl", "cmaps", "long"),
    "agg_run_summaries": _over(_MERGED, "select 'series_by_status' as report, status as name, count(*) as n from q2 group by all union all select 'gaps_by_source', data_name, sum(missing_feature_count) from q2 group by all union all select 'spans_by_status_code', status_code, sum(span_count) from stc group by all union all select 'cells_by_method', policy || ':' || method, count(*) from how group by all union all select 'templates_by_category', category, count(distinct template) from cmaps group by all union all select 'features_by_configuration', config, count(*) from mani group by all", "verd", "dl", "cmaps", "long", "q2", "stc", "how"),
    "sink_training": _over(_MERGED, "select c.config, count(distinct feature_name) as feature_count, count(distinct case_no) as case_count, count(value) as value_count, true as nested from merged join mani using (feature_name) join (values ('E0'),('E1'),('E2'),('E3')) c(config) on mani.config <= c.config group by all", "verd", "dl", "cmaps", "long"),
    "srt_schema_order": sql("select row_number() over (order by position) as position, column_name from sch where keep", "sch"),
    "srt_case_order": sql("select case_id, scenario from runs where case_no in (select case_no from long) order by case_id", "long", "runs"),
    "srt_report_order": sql("select case_no, service, operation, span_count from ops order by span_count desc, service, operation, case_no", "ops"),
    "top_features_first_case": sql("select case_no, column_name, round(zscore_mean, 6) as zscore_mean from stats where case_no = (select min(case_no) from stats) and zscore_mean is not null order by stats.zscore_mean desc, column_name limit 5", "stats"),
}
