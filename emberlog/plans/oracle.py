"""SQL for DuckDB that gives the same rows as the queries, for comparison."""

from __future__ import annotations

from ..functions import core
from ..operators import cases, correlate, detect, ioc
from ..rules.catalog import RULES, TACTICS
from .adapter import EV_SQL

PATTERN_RULES = [r for r in RULES if r.type == "regex"]
PRIVATE = r"'^(10[.]|127[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::varchar[]"


def _filter(where: dict) -> str:
    out = []
    for k, v in where.items():
        if k == "http_method":
            out.append(f"upper(http_method) = {q(str(v).upper())}")
        elif k.endswith("_in"):
            out.append(f"{k.removesuffix('_in')} in ({', '.join(map(str, v))})")
        else:
            out.append(f"{k}::varchar = {q(str(v))}")
    return "".join(f"{c} and " for c in out)


def _marked(field: str, prefix: str, names: str) -> str:
    """The field with a mark in place of names that stand right after the prefix: RE2 has no lookaheads."""
    return f"regexp_replace({field}, '(?i)({prefix})({names})', '\\1' || chr(1), 'g')"


_WEB = "https?://"
_REPOS = r"pypi\.org|files\.pythonhosted\.org|registry\.npmjs\.org|dl\.google\.com"
_IMAGES = r"docker\.io\/library\/|gcr\.io\/|public\.ecr\.aws\/|mcr\.microsoft\.com\/|registry\.k8s\.io\/"
_TYPOS = "requets|reqeusts|requsts|urllib4|urlib3|boto|b0to3|botto3|djang0|flaskk|fastap1|cryptograpy|pycrypto2|openssl2|numpy2|nump1|panads|pnadas|setup-tools|setuptool|pip-tools2|requests-html2"
LOOKAHEAD = {
    "API-008": r"(regexp_matches(message, '(?i)(Upgrade:\s*websocket.*Origin:\s*null|text/event-stream.*Origin:\s*null|websocket.*CSWSH|cross.site.*websocket)') "
    r"or (regexp_matches(message, '(?i)Upgrade:\s*websocket.*Origin:\s*https?://') and not regexp_matches(regexp_extract(message, '(?i)Upgrade:\s*websocket.*Origin:\s*https?://(.*)', 1), '(?i)same-origin')) "
    r"or (regexp_matches(message, '(?i)Upgrade:\s*websocket\s*\n') and not regexp_matches(regexp_extract(message, '(?i)Upgrade:\s*websocket\s*\n(.*)', 1), '(?i)Origin:')))",
    "SC-001": "("
    + " or ".join(
        [f"regexp_matches({_marked('message', _WEB, names)}, '(?i){head}https?://([^\\x01]|$)')" for names, head in ((r"registry\.npmjs\.org", r"npm\s+install.*--registry\s+"), (r"pypi\.org", r"pip\s+install.*(-i|--index-url)\s+"), (r"rubygems\.org", r"gem\s+install.*--source\s+"))]
        + [r"regexp_matches(message, '(?i)(package.*installed.*from.*internal.*public|dependency.*confusion)')", f"regexp_matches({_marked('message', _WEB, _REPOS)}, '(?i)Downloading\\s+https?://[^\\s\\x01][^\\s]*\\.(whl|tar\\.gz|tgz|zip)')"]
    )
    + ")",
    "SC-004": f"regexp_matches(message, '(?i)(Collecting\\s+({_TYPOS})(\\s|==|>|$)|installing\\s+(requets|djang0|flaskk|urllib4|boto([^3]|$)))')",
    "SC-007": f"(regexp_matches({_marked('message', 'docker' + chr(92) + 's+pull' + chr(92) + 's+', _IMAGES)}, '(?i)docker\\s+pull\\s+[^\\s\\x01][^\\s]*/[^\\s]+') or regexp_matches(message, '(?i)Pulling\\s+from\\s+[^\\s]+/(xmrig|minerd)') "
    + f"or regexp_matches({_marked('message', 'registry', r'(?:' + chr(92) + '.k8s' + chr(92) + '.io|' + chr(92) + '.microsoft' + chr(92) + '.com|' + chr(92) + '.docker' + chr(92) + '.com|gcr' + chr(92) + '.io|ecr' + chr(92) + '.aws)')}, '(?i)image.*pulled.*from.*registry([^\\x01]|$)'))",
}


def _case(rule) -> str:
    if rule.id in LOOKAHEAD:
        return f"case when {LOOKAHEAD[rule.id]} then {q(rule.id)} end"
    pattern = "(?i)" + rule.pattern.replace("(?i)", "")
    return f"case when {_filter(rule.where)} regexp_matches({rule.match_field}::varchar, {q(pattern)}) then {q(rule.id)} end"


HITS = "hits as (select * from (select *, unnest([" + ", ".join(map(_case, PATTERN_RULES)) + "]) as rule_id from ev) where rule_id is not null)"
RULE_ROWS = "rules(rule_id, rule_name, severity, category, base, tactic_ids, tactic_names, mitre_ids) as (values " + ", ".join(
    f"({q(r.id)}, {q(r.name)}, {q(r.severity)}, {q(r.category)}, {r.confidence}::double, {_list(r.tactics)}, {_list([TACTICS.get(t, t) for t in r.tactics])}, {_list(r.techniques)})" for r in PATTERN_RULES
) + ")"
WEIGHT = "case severity when 'CRITICAL' then 10.0::double when 'HIGH' then 7.0 when 'MEDIUM' then 4.0 when 'LOW' then 2.0 when 'INFO' then 1.0 else 4.0 end"
RANK = "case severity when 'INFO' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 when 'CRITICAL' then 4 end"
FOUND = (
    f"found0 as (select h.*, r.* exclude (rule_id), round(least(1.0, greatest(0.0, base + case when regexp_matches(http_user_agent, '(?i)({detect.TOOLS})') then 0.10::double else 0 end "
    f"+ case when not regexp_matches(source_ip, {PRIVATE}) then 0.08::double else 0 end + case when http_status = 200 and http_method in ('POST', 'GET') then 0.08::double else 0 end "
    f"+ case when auth_result = 'failure' then 0.05::double else 0 end + case when len(tactic_ids) > 1 then 0.05::double else 0 end "
    f"- case when regexp_matches(source_ip, {PRIVATE}) then 0.15::double else 0 end)), 4) as confidence from hits h join rules r using (rule_id)), "
    f"found as (select *, round(least({WEIGHT} * confidence, 10.0), 2) as risk_score, {RANK} as sev_rank from found0)"
)
EV = f"with {EV_SQL} "
FINDINGS = f"with recursive {EV_SQL}, {HITS}, {RULE_ROWS}, {FOUND} "

SQL: dict[str, str] = {}
SQL["event_rows"] = EV + "select line_number, username, source_ip, auth_result, http_status, http_uri_decoded, http_bytes, session_id from ev"
SQL["detect_patterns"] = FINDINGS + "select rule_id, line_number from hits"
SQL["findings"] = FINDINGS + "select sha256(concat_ws(':', source_file, rule_id, line_number::varchar)) as id, rule_id, line_number, severity, confidence, risk_score from found"

_T = "seen as (select source_ip as key, us, line_number, row_number() over (partition by source_ip order by us, line_number) as rn from ev where auth_result = 'failure')"
SQL["threshold_fires"] = (
    f"with recursive {EV_SQL}, {_T}, able as (select s.key, s.rn, s.us, s.line_number, p.us as first_us from seen s join seen p on p.key = s.key and p.rn = s.rn - 3 where s.us - p.us <= 172800000000), "
    "f as (select key, min(rn) as rn from able group by key union all select f.key, min(a.rn) as rn from f join able a on a.key = f.key and a.rn >= f.rn + 4 group by f.key) "
    "select a.key, a.line_number, a.first_us, 4 as event_count from f join able a on a.key = f.key and a.rn = f.rn where f.rn is not null"
)
_RN = "select username as key, us, line_number, {c}, row_number() over (partition by username order by us, line_number) as rn from ev"
SQL["distinct_threshold_fires"] = (
    f"with recursive {EV_SQL}, seen as ({_RN.format(c='dest_port as v')}), "
    "f(key, rn, start, line_number, fired) as (select key, 0::bigint, 1::bigint, null::bigint, false from seen where rn = 1 union all "
    "select f.key, s.rn, case when n.n >= 4 then s.rn + 1 else f.start end, s.line_number, n.n >= 4 from f join seen s on s.key = f.key and s.rn = f.rn + 1, "
    "lateral (select count(distinct p.v) as n from seen p where p.key = s.key and p.rn >= f.start and p.rn <= s.rn and p.us >= s.us - 86400000000) n) "
    "select key, line_number from f where fired"
)
SQL["sequence_fires"] = (
    f"with recursive {EV_SQL}, seen as ({_RN.format(c='auth_result')}), "
    "f(key, rn, step, n, first_us, line_number, fired) as (select key, 0::bigint, 0, 0, null::bigint, null::bigint, false from seen where rn = 1 union all "
    "select key, rn, case when not ok then step when n + 1 < need then step when step = 0 then 1 else 0 end, case when not ok then n when n + 1 < need then n + 1 else 0 end, "
    "case when ok and step = 1 then us else first_us end, line_number, ok and step = 1 from ("
    "select s.key, s.rn, s.us, s.line_number, case when late then 0 else f.step end as step, case when late then 0 else f.n end as n, case when late then s.us else f.first_us end as first_us, "
    "coalesce(case when (case when late then 0 else f.step end) = 0 then auth_result = 'failure' else auth_result = 'success' end, false) as ok, case when (case when late then 0 else f.step end) = 0 then 2 else 1 end as need "
    "from (select *, 1 from f) f join seen s on s.key = f.key and s.rn = f.rn + 1, lateral (select f.first_us is null or s.us - f.first_us > 432000000000 as late) l)) "
    "select key, line_number from f where fired"
)
SQL["composite_fires"] = (
    # p: a failure that counts; a, b: when the threshold and the pattern were met
    f"with recursive {EV_SQL}, seen as ({_RN.format(c=chr(97) + 'uth_result, http_user_agent')}), "
    "f(key, rn, p, a, b, line_number, fired) as (select key, 0::bigint, null::bigint, null::bigint, null::bigint, null::bigint, false from seen where rn = 1 union all "
    "select key, rn, p, case when a is null or b is null then a end, case when a is null or b is null then b end, line_number, a is not null and b is not null from ("
    "select key, rn, line_number, case when a0 is not null or auth_result is distinct from 'failure' then p when p >= us - 172800000000 then null else us end as p, "
    "case when a0 is not null then a0 when auth_result = 'failure' and p >= us - 172800000000 then us end as a, "
    "case when b0 is not null then b0 when regexp_matches(http_user_agent, '(?i)^sqlmap') then us end as b from ("
    "select s.key, s.rn, s.us, s.line_number, s.auth_result, s.http_user_agent, f.p, case when f.a >= s.us - 345600000000 then f.a end as a0, case when f.b >= s.us - 345600000000 then f.b end as b0 "
    "from f join seen s on s.key = f.key and s.rn = f.rn + 1))) "
    "select key, line_number, 2 as event_count from f where fired"
)
SQL["deduplicated"] = FINDINGS + (
    ", seen as (select rule_id, source_ip as source, us, line_number, raw_line, row_number() over (partition by rule_id, source_ip order by us, line_number) as rn from found), "
    "f(rule_id, source, rn, anchor_us, anchor) as (select rule_id, source, rn, us, line_number from seen where rn = 1 union all "
    "select s.rule_id, s.source, s.rn, case when s.us - f.anchor_us > 21600000000 then s.us else f.anchor_us end, case when s.us - f.anchor_us > 21600000000 then s.line_number else f.anchor end "
    "from f join seen s on s.rule_id = f.rule_id and s.source = f.source and s.rn = f.rn + 1) "
    "select f.rule_id, f.source, f.anchor as line_number, (count(distinct s.raw_line) - 1)::bigint as n_merged from f join seen s using (rule_id, source, rn) group by f.rule_id, f.source, f.anchor"
)
SQL["first_per_minute"] = FINDINGS + "select rule_id, source_ip, min(line_number) as line_number from found group by rule_id, source_ip, raw_line, severity, us // 60000000"
SQL["kill_chains"] = FINDINGS + ", chains(chain_name, steps, confidence_boost) as (values " + ", ".join(f"({q(n)}, {_list(s)}, {b}::double)" for n, s, b in correlate.CHAINS) + (
    "), met as (select chain_name, source_ip, confidence_boost, list_sort(list(distinct category)) as cats, len(any_value(steps)) as wanted, count(*) as finding_count, max(risk_score) as max_risk_score "
    "from found join chains on list_contains(steps, category) group by chain_name, source_ip, confidence_boost) "
    "select chain_name, source_ip, array_to_string(cats, ',') as categories, finding_count, max_risk_score, confidence_boost from met where len(cats) = wanted"
)
_ENT = ", ent as (select *, unnest([{'kind': 'ip', 'value': source_ip}, {'kind': 'ip', 'value': dest_ip}, {'kind': 'user', 'value': username}, {'kind': 'host', 'value': hostname}, {'kind': 'process', 'value': process_name}], recursive := true) from scored) "
_BONUS = "case t " + " ".join(f"when {q(k)} then {v}::double" for k, v in correlate.TACTIC_BONUS.items()) + " else 1.0 end"
_SCORED = f", bonus as (select rule_id, max({_BONUS}) as bonus from (select rule_id, unnest(tactic_names) as t from rules) group by rule_id), scored as (select f.*, greatest(risk_score, {WEIGHT}) * confidence * bonus * case when category in ('lateral_movement', 'persistence', 'exfiltration', 'privilege_escalation') then 1.15::double else 1.0 end as part from found f join bonus using (rule_id))"
BAND = "case when s >= 85 then 'CRITICAL' when s >= 70 then 'HIGH' when s >= 40 then 'MEDIUM' when s > 0 then 'LOW' else 'INFO' end"
SQL["entity_risk"] = FINDINGS + _SCORED + _ENT + f"select kind, value, s as risk_score, {BAND} as risk_band, n as finding_count, latest_us from (select kind, value, least(100.0, round(sum(part) * 2.4, 2)) as s, count(*) as n, max(us) as latest_us from ent group by kind, value)"
SQL["entity_top_rules"] = FINDINGS + _SCORED + _ENT + "select kind, value, rule_id as item, n, rank::int as rank from (select kind, value, rule_id, count(*) as n, row_number() over (partition by kind, value order by count(*) desc, rule_id) as rank from ent group by kind, value, rule_id) where rank <= 5"
_BEH = f", beh as (select session_id, source_ip as entity, count(*)::double as finding_count, avg(case when auth_result = 'failure' or contains(lower(category), 'auth') then 1.0 else 0 end) as auth_failure_rate, count(distinct dest_ip)::double as distinct_dests, avg(case when hour_of_day < 8 or hour_of_day >= 18 then 1.0 else 0 end) as off_hours_share, avg(case when severity in ('HIGH', 'CRITICAL') then 1.0 else 0 end) as high_share, avg({RANK}) as mean_severity from found group by session_id, source_ip), long as (unpivot beh on {', '.join(correlate.FEATURES)} into name feature value x)"
SQL["behaviour"] = FINDINGS + _BEH + "select session_id, entity, " + ", ".join(f"round({f}, 6) as {f}" for f in correlate.FEATURES) + " from beh"
SQL["behaviour_baseline"] = FINDINGS + _BEH + "select entity, feature, round(avg(x), 6) as mean, round(greatest(coalesce(stddev_samp(x), 1.0), 0.01), 6) as std, count(*) as sessions from long where session_id <> '2024-01-10' group by entity, feature"
SQL["anomaly"] = FINDINGS + _BEH + (
    ", past as (select entity, feature, avg(x) as mean, greatest(coalesce(stddev_samp(x), 1.0), 0.01) as std from long where session_id <> '2024-01-10' group by entity, feature), "
    "z as (select l.entity, avg(abs((x - mean) / std)) as z from long l left join past p using (entity, feature) where session_id = '2024-01-10' group by l.entity), "
    "s as (select b.*, z is not null as has_baseline, round(least(coalesce(z * 2, (case when auth_failure_rate > 0.5 then 3 else 0 end + case when high_share > 0.3 then 3 else 0 end + case when off_hours_share > 0.5 then 2 else 0 end + case when distinct_dests > 10 then 2 else 0 end + case when mean_severity > 2.5 then 2 else 0 end)::double), 10.0), 1) as score from beh b join z using (entity) where session_id = '2024-01-10') "
    "select entity, score, case when score >= 8 then 'CRITICAL anomaly' when score >= 6 then 'HIGH anomaly' when score >= 4 then 'SUSPICIOUS' else 'Normal' end as label, score >= 6.0 as anomalous, has_baseline, "
    "concat_ws(',', case when auth_failure_rate > 0.4 then 'failures' end, case when high_share > 0.25 then 'grave' end, case when off_hours_share > 0.4 then 'off hours' end, case when distinct_dests > 8 then 'many destinations' end) as flags from s"
)
_EDGES = ", edges as (select source_ip as source, hostname as target, count(*) as weight, max(risk_score) as max_risk, max(sev_rank) as r from found group by source_ip, hostname)"
SQL["graph_edges"] = FINDINGS + _EDGES + ", tech as (select source_ip as source, hostname as target, array_to_string(list_sort(list(distinct t)), ',') as techniques from (select source_ip, hostname, unnest(mitre_ids) as t from found) group by all) select source, target, weight, max_risk, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[r + 1] as max_severity, techniques from edges join tech using (source, target)"
_NODES = ", nodes as (select node, sum(weight)::bigint as weight, max(max_risk) as max_risk, max(s) = 1 as is_source, max(t) = 1 as is_target, max(s) = 1 and max(t) = 1 as is_pivot from (select source as node, weight, max_risk, 1 as s, 0 as t from edges union all select target, weight, max_risk, 0, 1 from edges) group by node)"
SQL["graph_nodes"] = FINDINGS + _EDGES + _NODES + "select * from nodes"
SQL["graph_reduced"] = FINDINGS + _EDGES + _NODES + ", kept as (select node from nodes order by max_risk desc, weight desc, node limit 30) select source, target, weight, max_risk from edges where source in (select node from kept) and target in (select node from kept)"
SQL["graph_layers"] = FINDINGS + "select layer, source, target, count(*) as weight, max(risk_score) as max_risk from (select 'source-category' as layer, source_ip as source, category as target, risk_score from found union all select 'category-rule', category, rule_id, risk_score from found union all select 'rule-technique', rule_id, unnest(mitre_ids), risk_score from found) group by all"
SQL["tactic_coverage"] = FINDINGS + "select tactic_id, count(*) as n from (select unnest(tactic_ids) as tactic_id from found) group by tactic_id"
SQL["technique_counts"] = FINDINGS + "select technique, count(*) as n, max(risk_score) as max_risk from (select unnest(mitre_ids) as technique, risk_score from found) group by technique order by n desc, technique limit 20"
SQL["technique_coverage"] = FINDINGS + ", a as (select technique, count(*) as rules from (select unnest(mitre_ids) as technique from rules) group by technique), b as (select technique, count(*) as fired from (select unnest(mitre_ids) as technique from found) group by technique) select technique, coalesce(rules, 0) as rules, coalesce(fired, 0) as fired, case when coalesce(fired, 0) > 0 then 'covered' else 'silent' end as state from a full join b using (technique)"
SQL["source_chains"] = FINDINGS + ", per as (select source_ip, category, count(*) as n, max(risk_score) as risk from found group by source_ip, category) select source_ip, sum(n)::bigint as finding_count, max(risk) as max_risk, array_to_string(list(category order by risk desc, category)[1:8], ',') as categories from per group by source_ip order by max_risk desc, finding_count desc, source_ip limit 20"
SQL["hunt"] = FINDINGS + "select rule_id, line_number, risk_score from found where category = 'web_attack' and risk_score >= 4 and sev_rank >= 3 and list_has_any(mitre_ids, ['T1190']) and contains(lower(raw_line), 'login') order by risk_score desc, us desc, line_number, rule_id limit 100"
SQL["findings_page"] = FINDINGS + "select rule_id, line_number, true as has_more from found order by risk_score desc, us desc, line_number, rule_id limit 50 offset 100"
SQL["timeline"] = FINDINGS + "select rule_id, line_number, us from found where severity in ('HIGH', 'CRITICAL') order by us, line_number, rule_id limit 200"
_DIM = "select '{c}' as dimension, {c} as value, count(*) as n, max(risk_score) as max_risk, round(sum(cast(round(risk_score * 100) as bigint)) / (100.0::double * count(*)), 6) as avg_risk from found group by {c}"
SQL["findings_summary"] = FINDINGS + " union all ".join(f"select * from ({_DIM.format(c=c)}{l})" for c, l in (("severity", ""), ("category", ""), ("source_ip", " order by n desc, value limit 10"), ("hostname", " order by n desc, value limit 10"), ("rule_id", " order by n desc, value limit 10")))
SQL["threat_levels"] = FINDINGS + "select *, case when critical > 0 then 'CRITICAL' when high > 0 then 'HIGH' when medium > 0 then 'ELEVATED' when low > 0 then 'LOW' else 'QUIET' end as level, case when critical > 0 then 'CRITICAL' when high > 0 then 'HIGH' when medium > 0 then 'MEDIUM' when low > 0 then 'LOW' else 'READY' end as label from (select session_id, count(*) filter (severity = 'LOW') as low, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'CRITICAL') as critical, max(risk_score) as max_risk from found group by session_id)"
SQL["triage"] = FINDINGS + "select rule_id, line_number, case when line_number % 7 = 0 then 'closed' when line_number % 3 = 0 then 'open' else 'new' end as state from found"
SQL["rule_tests"] = FINDINGS + "select rule_id, 'missing' as problem from rules where rule_id in ('WEB-001', 'IMP-001', 'SC-002') and rule_id not in (select rule_id from found) union all select distinct rule_id, 'forbidden' from found where rule_id in ('WEB-002', 'LAT-006')"
SQL["ip_classes"] = EV + f"select ip, case when regexp_matches(ip, {PRIVATE}) then 'private' else 'public' end as class, count(*) as n from (select source_ip as ip from ev union all select dest_ip from ev) group by ip"
SQL["http_severities"] = EV + "select case when http_status >= 500 then 'ERROR' when http_status >= 400 then 'WARNING' else 'INFO' end as severity, us // 60000000 as minute, count(*) as n from ev group by all"
SQL["parse_apache"] = EV + "select line_number, source_ip, http_method, http_uri_decoded, http_status, http_user_agent, us // 1000000 as second from ev"
SQL["parse_syslog"] = EV + "select line_number, hostname, username, source_ip, auth_result, us // 1000000 as second from ev where auth_result is not null"
SQL["parse_key_values"] = EV + "select line_number, source_ip, dest_ip, dest_port, 'block' as action from ev where auth_result = 'failure'"
SQL["parse_json"] = EV + "select line_number, source_ip, http_status, http_user_agent, us // 1000000 as second from ev"
SQL["parse_stats"] = EV + "select log_format, count(*) as lines, count(distinct source_ip) as ips, min(us) as first_us, max(us) as last_us from ev group by log_format"
def _found_in(kind: str, pattern: str) -> str:
    values = f"regexp_extract_all(coalesce(text, ''), {q(pattern)}{', 1' if '(/(?:etc' in pattern else ''})"
    return f"unnest(list_distinct({f'list_transform({values}, lambda v: lower(v))' if kind in ioc.LOWER else values}))"


_IOC = " union all ".join(f"select doc_id, coalesce(lang, '-') as lang, coalesce(source, '-') as source, '{k}' as type, {_found_in(k, p)} as value, {w}::double as w from documents" for k, p, w in ioc.KINDS)
_OPEN = r"(type <> 'ipv4' or not regexp_matches(value, '^(10[.]|127[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]0[.][02][.]|198[.]51[.]100[.]|203[.]0[.]113[.]|169[.]254[.]|0[.]|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|198[.]1[89][.]|(24[0-9]|25[0-5])[.])')) and (type <> 'domain' or len(value) > 4)"
SQL["ioc_extract"] = f"select doc_id, type, value, w as confidence from ({_IOC}) where {_OPEN}"
_MERGED = f"with i as (select * from ({_IOC}) where {_OPEN}), m as (select type, min(value) as value, max(w) as confidence, count(*) as n, array_to_string(list_sort(list(distinct lang)), ',') as tags, arg_min(source, struct_pack(v := value, s := source)) as source_rule from i group by type, lower(value)) "
SQL["ioc_merge"] = _MERGED + "select * from m"
SQL["ioc_summary"] = _MERGED + "select 'total' as kind, 'all' as name, count(*) as n, round(sum(cast(round(confidence * 1000000) as bigint)) / (1000000.0::double * count(*)), 3) as mean_confidence from m union all select 'type', type, count(*), round(sum(cast(round(confidence * 1000000) as bigint)) / (1000000.0::double * count(*)), 3) from m group by type union all select * from (select 'rule', source_rule, count(*) as n, round(sum(cast(round(confidence * 1000000) as bigint)) / (1000000.0::double * count(*)), 3) from m group by source_rule order by n desc, source_rule limit 5)"
SQL["ioc_reputation"] = _MERGED + (
    ", o as (select *, case when type = 'ipv4' then split_part(value, '.', 4)::int end as o from m), s as (select *, o % 101 >= 25 as bad from o) "
    "select type, value, round(case when bad then least(confidence + (o % 101) / 100.0::double * 0.2, 1.0) else confidence end, 6) as confidence, "
    "concat_ws(',', tags, case when bad then concat('known_bad_ip,abuse_score:', o % 101) end, case when o % 3 = 0 then 'country:de' end) as tags from s"
)
SQL["ioc_feeds"] = _MERGED + (
    ", l as (select *, len(value) as n0 from m), g as (select type, value, round(greatest(0.0::double, case when n0 % 2 = 0 then (n0 % 7) / 10.0::double * 10 end, case when n0 % 2 = 0 and n0 * 3 > 50 then 7.0 end, "
    "case when n0 % 3 = 0 then case when n0 % 20 > 5 then least((n0 % 20) / 2.0::double, 8.0) when n0 % 20 > 0 then 4.0 end end, case when type = 'url' then 7.0 end, case when type = 'hash_sha1' then 8.0 end), 4) as threat_score from l) "
    "select *, case when threat_score < 4 then 'clean' when threat_score < 7 then 'suspicious' else 'malicious' end as verdict from g"
)
SQL["finding_tags"] = FINDINGS + "select rule_id, line_number, case when line_number % 10 = 0 then concat('checked,', category, ',late') when line_number % 5 = 0 then concat('checked,', category) else '' end as tags from found"
SQL["hardening"] = FINDINGS + "select * from (values ('web_attack', 1, 'check what requests may hold'), ('web_attack', 2, 'close directory lists'), ('auth', 1, 'lock accounts after failures'), ('impact', 1, 'keep copies apart')) a(category, position, step) where category in (select category from found)"
SQL["session_summaries"] = FINDINGS + "select s.session_id, count(f.rule_id) as findings, count(f.rule_id) filter (sev_rank >= 3) as grave, coalesce(max(risk_score), 0.0) as max_risk from (select distinct session_id from ev) s left join found f using (session_id) group by s.session_id"
SQL["report_numbers"] = FINDINGS + (
    "select count(*) as findings, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, max(risk_score) as max_risk, round(sum(cast(round(risk_score * 100) as bigint)) / (100.0::double * count(*)), 6) as avg_risk, "
    "array_to_string(list_sort(list(distinct category)), ',') as categories, (select array_to_string(list_sort(list(distinct t)), ',') from (select unnest(mitre_ids) as t from found)) as techniques from found"
)
SQL["report_top"] = FINDINGS + "select rule_id, line_number, case when line_number % 2 = 0 then 'open' else 'new' end as triage_state, risk_score, raw_line from found order by risk_score desc, us desc, line_number, rule_id limit 5"
_STAT = "select '{c}' as dimension, {v} as value, count(*) as n, max(risk_score) as max_risk, round(sum(cast(round(risk_score * 100) as bigint)) / (100.0::double * count(*)), 6) as avg_risk, min(us) as first_us, max(us) as last_us from found group by all"
_COUNTED = " union all ".join(f"select '{k}', 'all', count(*), null, null, null, null from ({t})" for k, t in (("sessions", "select distinct session_id from found"), ("evidence", "select 1 from documents"), ("attack_chains", "select chain_name, source_ip from met where len(cats) = wanted")))
SQL["case_stats"] = (
    SQL["kill_chains"].rpartition("select chain_name, source_ip, array_to_string")[0]
    + " union all ".join(f"select * from ({_STAT.format(c=c, v=v)}{' order by n desc, value limit 10' if top else ''})" for c, v, top in (("total", "'all'", 0), ("severity", "severity", 0), ("category", "category", 0), ("source_ip", "source_ip", 1), ("hostname", "hostname", 1), ("rule_id", "rule_id", 1)))
    + " union all " + _COUNTED
)
_PART = "select '{s}' as section, {c} as name, count(*) as n, max(risk_score) as max_risk from {t} group by all"
SQL["dashboard"] = FINDINGS + ", x as (select unnest(mitre_ids) as technique, risk_score from found) " + " union all ".join(
    f"select * from ({_PART.format(s=s, c=c, t=t)}{' order by n desc, name limit 12' if top else ''})" for s, c, t, top in (("severity", "severity", "found", 0), ("category", "category", "found", 0), ("source", "source_ip", "found", 1), ("host", "hostname", "found", 1), ("rule", "rule_id", "found", 1), ("technique", "technique", "x", 1))
)
_SEEN = "select source, array_to_string(list(v order by us, line_number, rule_id, i, v)[1:{k}], ',') as {n} from (select source, v, min(struct_pack(us := us, line_number := line_number, rule_id := rule_id, i := i)) as f from ({t}) group by source, v), lateral (select f.us as us, f.line_number as line_number, f.rule_id as rule_id, f.i as i) group by source"
SQL["derived_chains"] = FINDINGS + (
    ", rows as (select source_ip as source, * from found), c as (" + _SEEN.format(k=8, n="categories", t="select source, category as v, us, line_number, rule_id, 0 as i from rows") + "), "
    "r as (" + _SEEN.format(k=12, n="rules", t="select source, rule_id as v, us, line_number, rule_id, 0 as i from rows") + "), "
    "t as (" + _SEEN.format(k=12, n="techniques", t="select source, unnest(mitre_ids[1:4]) as v, us, line_number, rule_id, unnest(range(len(mitre_ids[1:4]))) as i from rows") + "), "
    "n as (select source, count(*) as finding_count, round(max(risk_score), 2) as max_risk_score from rows group by source) "
    "select source, concat(source, ': ', array_to_string(list_transform(string_split(categories, ',')[1:5], lambda c: array_to_string(list_transform(string_split(c, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ')), ' -> ')) as chain_name, finding_count, max_risk_score, categories, rules, techniques "
    "from n join c using (source) join r using (source) join t using (source) order by max_risk_score desc, finding_count desc, chain_name limit 20"
)
SQL["raw_formats"] = EV + "select concat('file', line_number % 4) as source_file, (['apache_combined', 'auth_log', 'json_generic', 'iptables'])[1 + line_number % 4] as log_format, count(*) as lines, count(distinct source_ip) as ips from ev group by all"
SQL["zeek_headers"] = EV + "select line_number, source_ip, dest_ip, dest_port, 'tcp' as protocol, us // 1000000 as second from ev"
SQL["condition"] = EV + "select line_number from ev where (http_uri_decoded ilike '%login%' or http_uri_decoded ilike '%etc_passwd%') and (http_user_agent ilike 'sql%' or http_status <> 200)"
SQL["threshold_evidence"] = SQL["threshold_fires"].replace("select source_ip as key, us, line_number,", "select source_ip as key, us, line_number, raw_line,").replace(
    "select a.key, a.line_number, a.first_us, 4 as event_count from f join able a on a.key = f.key and a.rn = f.rn where f.rn is not null",
    "select a.key, a.line_number, string_agg(p.raw_line, '|' order by p.rn) as lines from f join able a on a.key = f.key and a.rn = f.rn join seen p on p.key = a.key and p.rn between a.rn - 3 and a.rn group by a.key, a.line_number",
)
SQL["enrich_reputation"] = FINDINGS + ", rep as (select distinct source_ip as ip, (us % 1)::double + user_score as score from (select source_ip, us, (split_part(source_ip, '.', 4)::int % 101)::double as user_score from ev)) select rule_id, line_number, score as reputation, coalesce(score >= 25, false) as known_bad, case when score >= 25 then 'known_malicious_ip' else '' end as tags, round(least(1.0, confidence + case when score >= 25 then least(score / 100 * 0.15, 0.15) else 0 end), 6) as confidence from found left join rep on source_ip = ip"
SQL["enrich_geo"] = EV + ", nets as (select 757137408 + n_nationkey * 1024 * 10 as lo, 757137408 + n_nationkey * 1024 * 10 + 10239 as hi, n_name as country from nation), addr as (select line_number, source_ip, case when starts_with(source_ip, '10.') then null else split_part(source_ip, '.', 1)::bigint * 16777216 + split_part(source_ip, '.', 2)::bigint * 65536 + split_part(source_ip, '.', 3)::bigint * 256 + split_part(source_ip, '.', 4)::bigint end as n from ev) select line_number, source_ip, country, coalesce('country:' || country, '') as tags from addr left join nets on n between lo and hi"
SQL["rate_windows"] = EV + "select source_ip, (us // 3600000000) * 3600 as hour, count(*) as n from ev where auth_result = 'failure' group by all"
_TERMS = r"select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.-]{2,}')) as term from documents"
_WORDS = r"select doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z0-9_.-]{2,}') as t from documents"
SQL["tf_idf"] = f"with words as ({_WORDS}), tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from words union all select doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from words) group by all), df as (select term, sum(tf) as total, count(*) as df from tf group by term order by total desc, term limit 1024), w as (select doc_id, term, (1 + ln(tf)) * (ln((1 + (select count(*) from documents)) / (1 + df)::double) + 1) as w from tf join df using (term)) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w"
SQL["keyword_search"] = f"with t as (select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.-]{{2,}}')) as n from documents), s as (select count(*) as docs, avg(n) as a from t), h as (select doc_id, term, count(*) as tf from ({_TERMS}) where term in ('license', 'password', 'token') group by all), d as (select term, count(*) as df from h group by term) select doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a))), 6) as score from h join d using (term) join t using (doc_id), s group by doc_id order by score desc, doc_id limit 10"
SQL["cosine_top"] = "with q as (select embedding::double[] as e from embeddings where vec_id = 7) select vec_id, round(list_cosine_similarity(x.embedding::double[], q.e), 6) as score from embeddings x, q where label is not null order by score desc, vec_id limit 5"
SQL["document_ids"] = "select doc_id, substr(sha256(concat_ws(':', source, lang, doc_id::varchar)), 1, 16) as id from documents"
SQL["evidence_trust"] = (
    "with s as (select source as session_id, case when doc_id % 50 = 3 then 'missing' when doc_id % 40 = 7 then 'changed' else 'verified' end as state from documents), "
    "n as (select session_id, count(*) filter (state = 'verified') as verified, count(*) filter (state = 'changed') as changed, count(*) filter (state = 'missing') as missing from s group by session_id) "
    "select *, case when changed > 0 then 'compromised' when missing > 0 then 'warning' when verified > 0 then 'trusted' else 'no_evidence' end as status from n"
)
SQL["playbook_steps"] = FINDINGS + (
    ", steps(c, phase, step) as (values ('web_attack', 'contain', 'block the source'), ('web_attack', 'recover', 'patch'), ('auth_attack', 'contain', 'lock the account'), ('malware', 'contain', 'take it off the net'), ('default', 'triage', 'look at it')), "
    "named as (select category, case when category in ('web_attack', 'api_security', 'bot_activity') then 'web_attack' when category in ('insider_threat', 'auth_attack') then 'auth_attack' when category in ('malware', 'impact', 'supply_chain') then 'malware' else 'default' end as c from found) "
    "select category, phase, step, count(*) as n from named join steps using (c) group by all"
)
SQL["decoy_hits"] = EV + (
    "select token_id, count(*) as n from (select distinct token_id, line_number from (select distinct concat('t', source_ip) as token_id, source_ip as value from ev where dest_port = 1007) "
    "join ev on contains(lower(raw_line), lower(value)) where value <> '') group by token_id"
)
SQL["year_rollover"] = EV + "select (2020 + (line_number + 50) // 100)::bigint as year, count(*) as n from ev group by 1"
SQL["observed"] = FINDINGS + "select source_ip, min(us) as first_us, max(us) as last_us, count(*) as n, count(*) filter (sev_rank >= 3) as high, array_to_string(list_sort(list(distinct rule_id))[1:10], ',') as rules, round(sum(cast(round(confidence * 10000) as bigint)) / (10000.0::double * count(*)), 6) as mean_confidence from found group by source_ip"
_SOME = ", ".join(f"array_to_string(list_sort(list(distinct {c}))[1:20], ',') as {c}" for c in ("source_ip", "hostname", "username"))
SQL["case_numbers"] = FINDINGS + f"select session_id, count(*) as findings, {_SOME}, max(risk_score) as max_risk from found group by session_id"
SQL["session_history"] = FINDINGS + "select session_id, count(*) as n, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[max(sev_rank) + 1] as top_severity, case when d = 0 then 'today' when d = 1 then 'yesterday' when d < 7 then 'this week' else 'earlier' end as label from (select *, date '2024-01-30' - session_id::date as d from found) group by session_id, d"
SQL["stix_relationships"] = FINDINGS + (
    ", h as (select distinct source_ip, unnest(mitre_ids) as t from found where sev_rank >= 3), "
    "x as (select sha256(concat_ws(':', 'threat-actor', source_ip)) as a, sha256(concat_ws(':', 'attack-pattern', t)) as b from h) "
    "select concat('threat-actor--', a[1:8], '-', a[9:12], '-', a[13:16], '-', a[17:20], '-', a[21:32]) as source, 'uses' as relation, concat('attack-pattern--', b[1:8], '-', b[9:12], '-', b[13:16], '-', b[17:20], '-', b[21:32]) as target from x"
)
SQL["export_zeek"] = f"select min(value) as indicator, case when type = 'ipv4' then 'Intel::ADDR' when type = 'domain' then 'Intel::DOMAIN' when type = 'email' then 'Intel::EMAIL' when starts_with(type, 'hash') then 'Intel::FILE_HASH' else 'Intel::SOFTWARE' end as indicator_type, 'emberlog' as source from ({_IOC}) where {_OPEN} group by type, lower(value)"
SQL["export_misp"] = _MERGED + "select case when type in ('ipv4', 'domain') then 'Network activity' when type = 'email' then 'Payload delivery' else 'Artifacts dropped' end as category, type, value, replace(tags, ',', ';') as comment, confidence >= 0.75 as to_ids from m"
SQL["blocklist"] = f"select distinct lower(value) as value from ({_IOC}) where {_OPEN} and type = 'ipv4' and w >= 0.75"
SQL["selection"] = EV + "select line_number from ev where (http_uri_decoded ilike '%login%' or http_uri_decoded ilike '%etc_passwd%') and http_user_agent ilike 'sql%'"
_TOP = "select technique, array_to_string(list({c} order by n desc, {c})[1:5], ',') as top_{c} from (select technique, {c}, count(*) as n from x group by technique, {c}) group by technique"
SQL["technique_rows"] = FINDINGS + (
    ", x as (select unnest(mitre_ids) as technique, risk_score, sev_rank, rule_id, source_ip from found), t as (select technique, count(*) as n, max(risk_score) as max_risk, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[max(sev_rank) + 1] as top_severity from x group by technique order by n desc, technique limit 30) "
    f"select * from t left join ({_TOP.format(c='rule_id')}) a using (technique) left join ({_TOP.format(c='source_ip')}) b using (technique)"
)
SQL["decoys_any_length"] = EV + (
    ", first as (select substr(username, 2, 9) as uid, arg_min(raw_line, line_number) as line from ev group by 1), "
    "decoys as (select concat('u', uid) as token_id, substr(line, cast(1 + uid::int % 60 as int), cast(1 + uid::int % 40 as int)) as value from first "
    "union all select concat('d', coalesce(source, '-')), min(lang) from documents group by source) "
    "select token_id, count(*) as n, min(line_number) as first_line from (select distinct token_id, line_number from decoys join ev on contains(lower(raw_line), lower(value)) where value <> '') group by token_id"
)
SQL["impossible_travel"] = EV + (
    ", logins as (select hostname as username, line_number, source_ip, us from ev where auth_result = 'success'), "
    "pairs as (select a.username, a.line_number, a.source_ip, a.us, b.line_number as l, b.source_ip as ip, b.us as t, row_number() over (partition by a.line_number order by b.us desc, b.line_number desc) as place "
    "from logins a join logins b on a.username = b.username and a.source_ip <> b.source_ip and (b.us, b.line_number) < (a.us, a.line_number) and b.us >= a.us - 3600000000) "
    "select username, line_number, source_ip, l as other_line_number, ip as other_source_ip, us - t as apart_us from pairs where place = 1"
)
SQL["logins_after_failures"] = EV + (
    "select f.username, count(*) as pairs, min(s.us - f.us) as least_us from ev f join ev s on f.username = s.username and s.us between f.us and f.us + 43200000000 "
    "where f.auth_result = 'failure' and s.auth_result = 'success' group by f.username"
)
_TITLE = "array_to_string(list_transform(string_split({0}, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ')"
_LAYERS = FINDINGS + (
    f", ch as (select source, string_split(categories, ',') as c, string_split(rules, ',')[1:8] as r, string_split(techniques, ',')[1:8] as t, max_risk_score as risk, 3 as rank from ({SQL['derived_chains']})), "
    f"f as (select source_ip as s, category as c, rule_id as r, mitre_ids[1:4] as t, risk_score as risk, {RANK} as rank from found), "
    "n0 as (select concat('src:', s) as node, s as label, 'source' as kind, risk, rank from f union all select concat('cat:', c), " + _TITLE.format("c") + ", 'category', risk, rank from f "
    "union all select concat('rule:', r), r, 'rule', risk, rank from f union all select concat('tech:', x), x, 'technique', risk, rank from (select unnest(t) as x, * from f) "
    "union all select concat('src:', source), source, 'source', risk, rank from ch union all select concat('rule:', x), x, 'rule', risk, rank from (select unnest(r) as x, * from ch) "
    "union all select concat('tech:', x), x, 'technique', risk, rank from (select unnest(t) as x, * from ch)), "
    "nodes as (select node, label, kind, count(*) as weight, max(risk) as risk, max(rank) as rank from n0 group by all), "
    "e0 as (select concat('src:', s) as source, concat('cat:', c) as target, 'triggered' as relation, risk, rank from f union all select concat('cat:', c), concat('rule:', r), 'matched', risk, rank from f "
    "union all select concat('rule:', r), concat('tech:', x), 'maps_to', risk, rank from (select unnest(t) as x, * from f) "
    "union all select concat('cat:', c[i]), concat('cat:', c[i + 1]), 'chain', risk, rank from (select unnest(range(1, len(c))) as i, * from ch) "
    "union all select concat('src:', source), concat('cat:', c[1]), 'chain_start', risk, rank from ch union all select concat('cat:', c[-1]), concat('rule:', x), 'chain_rule', risk, rank from (select unnest(r) as x, * from ch) "
    "union all select concat('rule:', r[-1]), concat('tech:', x), 'chain_technique', risk, rank from (select unnest(t) as x, * from ch)), "
    "edges as (select source, target, relation, count(*) as weight, max(risk) as risk, max(rank) as rank from e0 group by all), "
    "kn as (select * from nodes order by rank * 6.0::double + risk * 2.8::double + weight * 0.7::double + case kind when 'source' then 4.0::double when 'category' then 2.2 when 'rule' then 2.8 else 2.5 end desc, node limit 60), "
    "ke as (select * from edges where source in (select node from kn) and target in (select node from kn) order by rank * 5.0::double + risk * 2.2::double + weight * 0.8::double + "
    "case relation when 'chain' then 3.0::double when 'chain_start' then 3.0 when 'chain_rule' then 2.6 when 'chain_technique' then 2.6 when 'maps_to' then 2.2 when 'matched' then 1.8 else 1.6 end desc, source, target, relation limit 150) "
)
SQL["layered_nodes"] = _LAYERS + "select * from kn"
SQL["layered_edges"] = _LAYERS + "select *, round(least(1.0::double, weight::double / (select max(weight) from ke)), 3) as weight_norm from ke"
SQL["layered_reduction"] = _LAYERS + (
    "select *, nodes_raw - nodes_kept as nodes_dropped, edges_raw - edges_kept as edges_dropped, nodes_raw > nodes_kept or edges_raw > edges_kept as reduced from (select (select count(*) from nodes) as nodes_raw, (select max(risk) from nodes) as max_risk, "
    "(select count(*) from edges) as edges_raw, (select count(*) from kn) as nodes_kept, (select count(*) from ke) as edges_kept, (select count(*) from ch) as chain_count)"
)
SQL["index_upkeep"] = FINDINGS + (
    ", d as (select session_id, rule_id, raw_line, bool_or(severity = 'CRITICAL') as early from found group by all) select cast(case when early then 1 else 2 end as int) as run, rule_id, count(*) as n from d group by all"
)


# --- indicators of findings, and objects -------------------------------------------------


def _matched() -> str:
    """What a rule's pattern matched; rules that RE2 can't read match in none of these tables."""
    each = " ".join(f"when {q(r.id)} then regexp_extract({r.match_field}::varchar, {q('(?i)' + r.pattern.replace('(?i)', ''))}, 0)" for r in PATTERN_RULES if r.id not in LOOKAHEAD)
    return f"substr(case rule_id {each} end, 1, 200)"


_TEXT_IOCS = " union all ".join(f"select fid, '{k}' as type, {_found_in(k, p).replace('coalesce(text', 'coalesce(_text')} as value, confidence * {w}::double as c from rows" for k, p, w in ioc.KINDS)
_BEST = "struct_pack(a := -c, b := value, d := source_rule, e := source_ip, f := us)"
_FOUND_IOCS = FINDINGS + (
    f", rows as materialized (select *, row_number() over () as fid, concat_ws(' ', raw_line, matched, message) as _text from (select *, {_matched()} as matched from found)), "
    "i0 as (select fid, 'ipv4' as type, source_ip as value, confidence as c from rows union all select fid, 'ipv4', dest_ip, case when dest_ip = source_ip then confidence else confidence * 0.9::double end from rows "
    f"union all select fid, 'hostname', hostname, confidence * 0.85::double from rows where hostname <> '' union all select fid, 'process', process_name, least(confidence + 0.05::double, 1.0) from rows where regexp_matches(process_name, {q(ioc.PROCESSES)}) "
    f"union all select fid, 'user_agent', http_user_agent, least(confidence + 0.1::double, 1.0) from rows where regexp_matches(http_user_agent, {q(ioc.SCANNERS)}) "
    f"union all select fid, 'url', substr(unnest(list_distinct(regexp_extract_all(http_uri_decoded, {q(ioc.URL)}))), 1, 500), confidence from rows "
    f"union all select fid, 'domain', unnest(list_distinct(list_transform(regexp_extract_all(http_uri_decoded, {q(ioc.KINDS[-1][1])}), lambda v: lower(v)))), confidence * 0.8::double from rows union all {_TEXT_IOCS}), "
    f"i1 as (select type, value, round(c + 1e-9, 3) as c, rule_id as source_rule, source_ip, us, list_concat([category], mitre_ids, case when event_id is null then [] else [concat('EventID:', event_id)] end) as tags from i0 join rows using (fid) where {_OPEN}), "
    "i as materialized (select type, "
    + ", ".join(f"arg_min({v}, {_BEST}) as {v}" for v in ("value", "source_rule", "source_ip", "us"))
    + ", max(c) as confidence, count(*) as n, list_sort(list_distinct(flatten(list(tags)))) as tags from i1 group by type, lower(i1.value)) "
)
SQL["ioc_of_findings"] = _FOUND_IOCS + "select type, value, confidence, n, array_to_string(tags, ',') as tags, source_rule, source_ip, us from i"


def _oid(kind: str, key: str) -> str:
    h = f"sha256(concat('{kind}:', {key}))"
    return f"concat('{kind}--', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"


_PATTERN_NAMES = {
    "ipv4": "ipv4-addr:value", "domain": "domain-name:value", "url": "url:value", "email": "email-addr:value", "hash_md5": "file:hashes.MD5", "hash_sha1": "file:hashes.'SHA-1'", "hash_sha256": "file:hashes.'SHA-256'", "hostname": "domain-name:value",
    "file_path": "file:name", "process": "process:name", "user_agent": "network-traffic:extensions.'http-request-ext'.request_header.'User-Agent'",
}
_NULLS = "null::varchar as labels, null::varchar as detail, null::int as confidence, null::bigint as n, null::bigint as first_us, null::bigint as last_us"
_FIRST = lambda c, n: f"array_to_string(list_sort(list(distinct {c}))[1:{n}], ',')"
_MARK = _oid("indicator", "type, ':', lower(value)")
_WHEN = lambda names: "case type " + " ".join(f"when {q(k)} then {q(v)}" for k, v in names.items()) + " end"
_ESCAPED = r"replace(replace(value, '\', '\\'), '''', '\''')"
_OBJECTS = _FOUND_IOCS + (
    ", high as (select * from found where sev_rank >= 3), "
    f"actors as (select * from (select source_ip, count(*) as n, max(risk_score) as risk, cast(floor(sum(cast(round(confidence * 10000) as bigint)) / count(*) / 100) as int) as confidence, min(us) as first_us, max(us) as last_us, {_FIRST('category', 5)} as goals from high group by source_ip) "
    f"left join (select source_ip, {_FIRST('t', 8)} as techniques from (select source_ip, unnest(mitre_ids) as t from high) group by source_ip) using (source_ip)), "
    "mal as (select rule_id, arg_min(struct_pack(rule_name := rule_name, category := category, confidence := confidence, raw_line := raw_line), struct_pack(a := us, b := line_number)) as x from found where category in ('malware', 'lolbin', 'impact') group by rule_id) "
)
SQL["stix_objects"] = _OBJECTS + (
    f"select {_oid('identity', q('emberlog'))} as id, 'identity' as type, 'emberlog' as name, {_NULLS} "
    f"union all select {_oid('attack-pattern', 't')}, 'attack-pattern', t, {_NULLS} from (select distinct unnest(mitre_ids) as t from found) "
    f"union all select {_oid('threat-actor', 'source_ip')}, 'threat-actor', source_ip, techniques, concat(case when risk >= 7 then 'intermediate' else 'minimal' end, ': ', goals), confidence, n, first_us, last_us from actors "
    f"union all select {_oid('malware', 'rule_id')}, 'malware', x.rule_name, concat(rule_id, ',', x.category), case when starts_with(rule_id, 'IMP') then 'ransomware' when contains(lower(x.raw_line), 'lsass') then 'rootkit' when x.category = 'lolbin' then 'tool' else 'unknown' end, cast(floor(round(x.confidence * 10000) / 100) as int), null, null, null from mal "
    f"union all select {_oid('course-of-action', 'category')}, 'course-of-action', concat('Mitigate: ', {_TITLE.format('category')}), category, null, null, null, null, null from (select distinct category from found) "
    f"union all select {_MARK}, 'indicator', concat(type, ': ', substr(value, 1, 80)), concat({_WHEN({k: ','.join(v) for k, v in ioc.INDICATOR_TYPES.items()})}, ';', array_to_string(tags[1:10], ',')), "
    f"concat('[', {_WHEN(_PATTERN_NAMES)}, ' = ''', {_ESCAPED}, ''']'), cast(floor(round(confidence * 10000) / 100) as int), n, null, null from i "
    f"union all select {_oid('observed-data', 'source_ip')}, 'observed-data', source_ip, {_FIRST('rule_id', 10)}, {_FIRST('severity', 5)}, null, count(*), min(us), max(us) from found group by source_ip"
)
SQL["object_relations"] = _OBJECTS + (
    f"select distinct {_oid('threat-actor', 'source_ip')} as source, 'uses' as relation, {_oid('attack-pattern', 't')} as target from (select source_ip, unnest(mitre_ids) as t from found where source_ip in (select source_ip from actors)) "
    f"union all select distinct {_MARK}, 'indicates', {_oid('threat-actor', 'value')} from i where type = 'ipv4' and value in (select source_ip from actors) "
    f"union all select distinct {_MARK}, 'indicates', {_oid('malware', 'source_rule')} from i where source_rule in (select rule_id from mal) "
    f"union all select distinct {_oid('attack-pattern', 't')}, 'mitigated-by', {_oid('course-of-action', 'category')} from (select unnest(mitre_ids) as t, category from found) "
    f"union all select distinct {_oid('observed-data', 'source_ip')}, 'related-to', {_MARK} from (select *, row_number() over (partition by source_ip order by confidence desc, type, value) as r from i where source_ip <> '') where r <= 5"
)
_TESTS = [("h1", ["IMP-001", "SC-002"], ["LAT-006"], 10), ("h3", ["WEB-001", "WEB-009"], ["WEB-002", "IMP-002"], 1), ("h9", [], ["NET-001"], 100_000), ("none", ["WEB-001"], [], 0)]
SQL["corpus_tests"] = FINDINGS + (
    ", t(test, must, must_not, least) as (values " + ", ".join(f"({q(n)}, {_list(a)}, {_list(b)}, {k})" for n, a, b, k in _TESTS) + "), "
    "f as (select hostname as test, count(*) as findings, list(distinct rule_id) as fired from found group by 1), "
    "x as (select test, coalesce(findings, 0) as findings, array_to_string(list_sort(list_filter(must, lambda r: not list_contains(coalesce(fired, []), r))), ',') as missing, array_to_string(list_sort(list_filter(must_not, lambda r: list_contains(coalesce(fired, []), r))), ',') as forbidden, least from t left join f using (test)) "
    "select test, findings, missing, forbidden, missing = '' and forbidden = '' and findings >= least as ok from x"
)

_NAMES = lambda c, n: f"coalesce(array_to_string(list_sort(list(distinct {c}) filter ({c} is not null))[1:{n}], ','), '')"
SQL["case_numbers"] = FINDINGS + (
    f"select * from (select session_id, count(*) as findings, max(risk_score) as max_risk, {', '.join(f'{_NAMES(c, 20)} as {c}' for c in ('source_ip', 'hostname', 'username'))}, {_NAMES('category', 10)} as category from found group by session_id) "
    f"left join (select session_id, {_NAMES('t', 10)} as tactic from (select session_id, unnest(tactic_names) as t from found) group by session_id) using (session_id)"
)
_ORDERED = "(select source_ip, array_to_string(list(v order by risk desc, v)[1:8], ',') as {n} from (select source_ip, v, max(risk_score) as risk from (select source_ip, risk_score, {v} as v from found) group by all) group by source_ip)"
SQL["source_chains"] = FINDINGS + (
    f"select * from (select source_ip, count(*) as finding_count, max(risk_score) as max_risk from found group by source_ip) join {_ORDERED.format(n='categories', v='category')} using (source_ip) "
    f"join {_ORDERED.format(n='rules', v='rule_id')} using (source_ip) join {_ORDERED.format(n='techniques', v='unnest(mitre_ids)')} using (source_ip) order by max_risk desc, finding_count desc, source_ip limit 20"
)
SQL["entity_totals"] = (
    "select count(*) as entities, count(*) filter (risk_score >= 70) as high_risk, max(risk_score) as max_score, "
    + ", ".join(f"count(*) filter (risk_band = '{b}') as band_{b.lower()}" for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
    + f" from ({SQL['entity_risk']})"
)
_AT = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ')"
_HASH = "sha256(concat('x:', type, ':', lower(value)))"
SQL["export_csv"] = _FOUND_IOCS + f"select type, value, printf('%.3f', confidence) as confidence, source_rule, source_ip, {_AT} as timestamp, array_to_string(tags, '|') as tags, 'IR-2024-001' as case_ref, '2024-02-01T00:00:00Z' as exported_at from i"
SQL["export_zeek"] = _FOUND_IOCS + (
    f"select value as indicator, {_WHEN(cases.ZEEK_TYPES)} as indicator_type, 'emberlog/IR-2024-001' as source, concat('emberlog case IR-2024-001 | rule:', source_rule, ' | conf:', printf('%.0f', confidence * 100 + 1e-9), '%') as description, '-' as url, 'T' as do_notice from i"
)
SQL["export_misp"] = _FOUND_IOCS + (
    f"select concat(substr({_HASH}, 1, 8), '-', substr({_HASH}, 9, 4), '-', substr({_HASH}, 13, 4), '-', substr({_HASH}, 17, 4), '-', substr({_HASH}, 21, 12)) as uuid, '' as event_id, {_WHEN(cases.MISP_CATEGORIES)} as category, {_WHEN(cases.MISP_TYPES)} as type, value, "
    f"concat('emberlog | Case:IR-2024-001 | Rule:', source_rule, ' | Conf:', printf('%.0f', confidence * 100 + 1e-9), '%') as comment, '1' as to_ids, '0' as distribution, {_AT} as timestamp from i"
)
SQL["hash_vectors"] = (
    "with h as (select doc_id, sha256(coalesce(text, '')) as h from documents), d as (select doc_id, list_transform(range(0, 32), lambda i: ((instr('0123456789abcdef', substr(h, i * 2 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, i * 2 + 2, 1)) - 1) - 127.5::double) as v from h), "
    "n as (select doc_id, v, sqrt(8 * list_sum(list_transform(v, lambda x: x * x))) as n from d) select doc_id, list_transform(flatten([v, v, v, v, v, v, v, v]), lambda x: round(x / n, 6)) as vector from n"
)
SQL["digest"] = FINDINGS + (
    "select substr(string_agg(line, chr(10) order by i), 1, 8000) as digest from (select row_number() over (order by sev_rank desc, risk_score desc, line_number, rule_id) as i, "
    "concat('[', severity, '] ', rule_id, ' (', rule_name, ') | IP:', coalesce(source_ip, ''), ' | Host:', coalesce(hostname, ''), ' | Risk:', printf('%.1f', round(risk_score + 1e-9, 1)), ' | MITRE:', array_to_string(mitre_ids, ', '), ' | ', substr(raw_line, 1, 200)) as line from found) where i <= 200"
)
SQL["context_block"] = FINDINGS + (
    "select substr(string_agg(concat('[', i, '] ', rule_id, ' ', severity, ' ', coalesce(source_ip, '-'), ' risk ', printf('%.2f', risk_score)), chr(10) order by i), 1, 4000) as context "
    "from (select *, row_number() over (order by risk_score desc, us desc, line_number, rule_id) as i from found) where i <= 10"
)
_EVERY = lambda p, k=1: f"array_to_string(regexp_extract_all(raw_line, {q(p)}, {k}), ',')"
SQL["rule_hints"] = FINDINGS + (
    ", first as (select rule_id, category, arg_min(raw_line, line_number) as raw_line from found group by all) "
    f"select rule_id, category, array_to_string(list_distinct(regexp_extract_all(raw_line, {q(core.IN_TEXT)})), ',') as addresses, {_EVERY('(?:GET|POST|PUT|DELETE|HEAD)' + chr(92) + 's+(' + chr(92) + 'S+)')} as paths, "
    + _EVERY('"([^"]{3,80})"') + " as quoted, " + _EVERY(r"(?i)EventID[=:\s]+(\d+)") + " as event_ids, " + _EVERY(r"(?i)(?:user|username|account)[=:\s]+(\S+)") + " as users, " + _EVERY(r"(?i)(?:process|image|commandline)[=:\s]+([^\s,;]+)") + " as processes from first"
)


# --- all rules, those with state by recursion --------------------------------------------


def _sees(where: dict) -> str:
    out = []
    for k, v in where.items():
        if k.endswith("_contains"):
            out.append(f"contains(lower(coalesce({k.removesuffix('_contains')}, '')), {q(str(v).lower())})")
        else:
            out.append(_filter({k: v}).removesuffix(" and "))
    return " and ".join(out) or "true"


def _step(step: dict) -> str:
    own = f"contains(lower({step['match_field']}::varchar), {q(str(step['value_contains']).lower())})" if "value_contains" in step else f"{step['match_field']}::varchar = {q(str(step['value']))}"
    more = f" and {step['match_field2']}::varchar = {q(str(step['value2']))}" if "match_field2" in step else ""
    return f"coalesce({own}{more}, false)"


def _stateful() -> str:
    """rule_id, line_number and event_count of every fire: counts by candidates that are N apart, distinct values and two-step sequences event by event."""
    of = lambda kind: [r for r in RULES if r.type != "regex" and kind(r)]
    seen = lambda rs, more: " union all ".join(f"select {q(r.id)} as rule_id, {r.key}::varchar as key, us, line_number, {more(r)} from ev where {r.key} is not null and {r.key}::varchar <> ''" for r in rs)
    counts, values, steps = of(lambda r: r.type == "threshold" and not r.distinct), of(lambda r: r.distinct), of(lambda r: r.type == "sequence")
    assert all(len(r.steps) == 2 and all(s.get("min_count", 1) == 1 for s in r.steps) for r in steps)
    place = "row_number() over (partition by rule_id, key order by us, line_number) as rn"
    c = seen(counts, lambda r: f"{r.count} as n, {r.seconds}::bigint * 1000000 as w, {_sees(r.where)} as ok")
    v = seen(values, lambda r: f"{r.count} as n, {r.seconds}::bigint * 1000000 as w, {r.distinct}::varchar as v, {_sees(r.where)} as ok")
    s = seen(steps, lambda r: f"{r.seconds}::bigint * 1000000 as w, {_step(r.steps[0])} as s1, {_step(r.steps[1])} as s2")
    return (
        f"cseen as materialized (select *, {place} from ({c}) where ok), "
        "able as materialized (select s.rule_id, s.key, s.rn, s.line_number, s.n from cseen s join cseen p on p.rule_id = s.rule_id and p.key = s.key and p.rn = s.rn - s.n + 1 where s.us - p.us <= s.w), "
        "cf(rule_id, key, rn) as (select rule_id, key, min(rn) from able group by all union all select f.rule_id, f.key, min(a.rn) from cf f join able a on a.rule_id = f.rule_id and a.key = f.key and a.rn >= f.rn + a.n group by f.rule_id, f.key, f.rn), "
        f"vseen as materialized (select *, {place} from ({v}) where ok and v is not null qualify count(*) over (partition by rule_id, key) >= n), "
        "vf(rule_id, key, rn, start, line_number, fired) as (select rule_id, key, 0::bigint, 1::bigint, null::bigint, false from vseen where rn = 1 union all "
        "select f.rule_id, f.key, s.rn, case when m.n >= s.n then s.rn + 1 else f.start end, s.line_number, m.n >= s.n from vf f join vseen s on s.rule_id = f.rule_id and s.key = f.key and s.rn = f.rn + 1, "
        "lateral (select count(distinct p.v) as n from vseen p where p.rule_id = s.rule_id and p.key = s.key and p.rn >= f.start and p.rn <= s.rn and p.us >= s.us - s.w) m), "
        f"sseen as materialized (select *, {place} from ({s}) qualify bool_or(s1) over (partition by rule_id, key) and bool_or(s2) over (partition by rule_id, key)), "
        "sf(rule_id, key, rn, step, anchor, line_number, fired) as (select rule_id, key, 0::bigint, 0, us, null::bigint, false from sseen where rn = 1 union all "
        "select t.rule_id, t.key, t.rn, case when t.step = 2 then 0 else t.step end, case when t.step = 2 then t.us else t.anchor end, t.line_number, t.step = 2 from ("
        "select e.*, case when (e.base = 0 and e.s1) or (e.base = 1 and e.s2) then e.base + 1 else e.base end as step from ("
        "select x.rule_id, x.key, x.rn, x.us, x.line_number, x.s1, x.s2, case when x.us - f.anchor > x.w then 0 else f.step end as base, case when x.us - f.anchor > x.w then x.us else f.anchor end as anchor "
        "from sf f join sseen x on x.rule_id = f.rule_id and x.key = f.key and x.rn = f.rn + 1) e) t), "
        "fires as (select f.rule_id, a.line_number, a.n as event_count from cf f join able a using (rule_id, key, rn) where f.rn is not null "
        "union all select rule_id, line_number, (select any_value(n) from vseen s where s.rule_id = vf.rule_id) from vf where fired union all select rule_id, line_number, 2 from sf where fired)"
    )


_ALL_ROWS = "every" + RULE_ROWS.removeprefix("rules")[:-1] + ", " + ", ".join(
    f"({q(r.id)}, {q(r.name)}, {q(r.severity)}, {q(r.category)}, {r.confidence}::double, {_list(r.tactics)}, {_list([TACTICS.get(t, t) for t in r.tactics])}, {_list(r.techniques)})" for r in RULES if r.type != "regex"
) + ")"
_CONFIDENCE = FOUND[FOUND.index("round(least(") : FOUND.index(" as confidence")]
_AFTER = _CONFIDENCE.replace("else 0 end)), 4)", "else 0 end - case when event_count < 3 then 0.10::double else 0 end)), 4)")
SQL["detect_all_rules"] = FINDINGS.rstrip() + ", " + _stateful() + (
    f", {_ALL_ROWS}, later as (select rule_id, line_number, severity, {_AFTER} as confidence from fires join ev using (line_number) join every using (rule_id)) "
    f"select rule_id, line_number, severity, confidence, risk_score from found union all select rule_id, line_number, severity, confidence, round(least({WEIGHT} * confidence, 10.0), 2) from later"
)
SQL["timeline_newest"] = FINDINGS + "select rule_id, line_number, us from found order by us desc, line_number desc, rule_id limit 300"
_TYPES = ", ".join(f"({q(r.id)}, {q(r.type)}, {q(r.category)})" for r in RULES)
SQL["detection_summary"] = (
    f"with f as (select * from ({SQL['detect_all_rules']}) join (values {_TYPES}) t(rule_id, rule_type, category) using (rule_id)) select 'total' as dimension, 'all' as value, count(*) as n from f union all select 'rule_type', rule_type, count(*) from f group by 2 "
    "union all select 'category', category, count(*) from f group by 2 union all select * from (select 'rule_id', rule_id, count(*) as n from f group by 2 order by n desc, rule_id limit 5)"
)
SQL["mixed_files"] = EV + (
    "select line_number, (['zeek_conn', 'zeek_conn', 'aws_vpc_flow', 'iis_w3c', 'apache_combined', 'json_lines'])[1 + line_number % 6] as log_format, source_ip, case when line_number % 6 < 4 then dest_ip end as dest_ip, "
    "case when line_number % 6 < 4 then dest_port end as dest_port, case when line_number % 6 >= 3 then http_status end as http_status, us // 1000000 as second from ev"
)
