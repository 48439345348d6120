"""DuckDB statements that give the expected result of every registered query.

They compute from the columns of the given tables and never parse a line, so
an error in the parser cannot cancel out.
"""

from __future__ import annotations

RECORDS = """
base as (
 select
  case when l_orderkey%50=7 then 'bad' when l_orderkey%10 in (0,1) then 'json' when l_orderkey%10=2 then 'json_old'
       when l_orderkey%10=3 then 'envelope' else 'text' end as fmt,
  timestamp '2025-08-01 00:00:00' + to_seconds((l_orderkey*7919+l_linenumber*104729)%2678400) as ts,
  l_orderkey, l_linenumber,
  concat('10.',cast(l_suppkey%8 as varchar),'.',cast(l_partkey%250 as varchar),'.1') as ip_cliente_externo,
  concat('10.233.',cast(l_linenumber as varchar),'.14') as ip_red_interna,
  case when l_orderkey%97=0 then 'PROPFIND' when l_linenumber=5 then 'HEAD' else 'GET' end as metodo,
  concat('/org-',cast(l_suppkey%20 as varchar),'/files/',cast(l_partkey as varchar),
   case l_partkey%4 when 0 then '.js?v=1' when 1 then '.css' when 2 then '.png' else '' end) as recurso,
  cast(case (l_partkey+l_linenumber)%20 when 0 then 404 when 1 then 403 when 2 then 500 when 3 then 301
   when 4 then 302 when 5 then 304 when 6 then 503 else 200 end as integer) as code,
  cast(floor(l_extendedprice*case when l_linenumber=1 then 400 else 1 end) as bigint) as size,
  case when l_returnflag='R' then '-' else 'https://www.example.org/' end as referer,
  case l_orderkey%4 when 0 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 18_5) Mobile/15E148'
   when 1 then 'Mozilla/5.0 (Linux; Android 14)' when 2 then '' else 'Mozilla/5.0 (Windows NT 10.0)' end as user_agent,
  (cast(floor(l_extendedprice) as bigint)*l_linenumber)%9000 as ms,
  case l_partkey%3 when 0 then '' when 1 then '-' else '120' end as edad_cache,
  case l_partkey%9 when 0 then 'application/javascript' when 1 then 'text/css' when 2 then 'image/png'
   when 3 then 'text/html' when 4 then 'application/json' when 5 then 'font/woff2' when 6 then 'application/pdf'
   when 7 then '-' else '' end as content_type,
  concat('/Portal/vs-',case when l_linestatus='O' then 'TEPROD' else 'PAPROD' end) as ambiente_origen,
  concat('/Portal/Pool_',cast(l_suppkey%20 as varchar)) as ambiente_pool,
  case when l_linestatus='O' then 'TEPROD' else 'PAPROD' end as entorno_nodo
 from lineitem),
rec as (
 select *,
  strftime(ts,'%b ') || lpad(cast(day(ts) as varchar),2,' ') || strftime(ts,' %H:%M:%S') as timestamp_syslog,
  strftime(ts,'%d/%b/%Y:%H:%M:%S') || ' -0300' as timestamp_apache,
  'www.example.org' as hostname, 'HTTP/1.1' as protocolo
 from base),
lines as (
 select *, timestamp_syslog || ' ' || hostname || ' ' || ip_cliente_externo || ' [' || ip_red_interna || '] - "" ['
  || timestamp_apache || '] "' || metodo || ' ' || recurso || ' ' || protocolo || '" ' || cast(code as varchar) || ' '
  || cast(size as varchar) || ' "' || referer || '" "' || user_agent || '" Time ' || cast(ms as varchar) || ' Age "'
  || edad_cache || '" "' || content_type || '" "" - "' || ambiente_origen || '" "' || ambiente_pool || '" '
  || entorno_nodo as line
 from rec),
logs as (
 select fmt, ts, l_orderkey,
  cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day,
  cast(hour(ts) as integer) as hour, metodo, recurso, ip_cliente_externo, ip_red_interna,
  code, size, ms, nullif(referer,'-') as referer, user_agent, nullif(edad_cache,'-') as edad_cache,
  nullif(content_type,'-') as content_type, ambiente_origen, ambiente_pool, entorno_nodo,
  timestamp_syslog, timestamp_apache, hostname, protocolo,
  code >= 400 as is_error,
  case when code < 300 then 'success' when code < 400 then 'redirect' when code < 500 then 'client_error'
   else 'server_error' end as status_category,
  ms > 5000 as is_slow,
  case when ms = 0 then 'unknown' when ms < 100 then 'fast' when ms < 1000 then 'normal' when ms < 5000 then 'slow'
   else 'very_slow' end as response_time_category,
  l_orderkey%4 in (0,1) as is_mobile,
  case content_type when 'application/javascript' then 'js' when 'text/css' then 'css' when 'image/png' then 'image'
   when 'text/html' then 'html' when 'application/json' then 'api' when '-' then 'unknown' when '' then 'unknown'
   else 'other' end as content_category,
  edad_cache = '120' as cache_hit
 from lines),
ok as (select * from logs where fmt <> 'bad')
"""


def _sql(body: str, ctes: str = "") -> str:
    return "with " + RECORDS + (", " + ctes if ctes else "") + body


# The 22 fields by cleaning rules; ``{x}`` stands for the expression of a cleaned field.
def _fields(source: str, where: str = "", raw: bool = False, empty_is_null: bool = False,
            numbers: bool = True, old_names: bool = False, quoted: bool = False) -> str:
    def text(name):
        if raw:
            return name
        if quoted:
            return f"nullif({name},'')"
        inner = f"nullif({name},'-')"
        return f"nullif({inner},'')" if empty_is_null else inner

    names = {"ip_red_interna": "ip_backend_interno", "timestamp_apache": "timestamp_rp", "recurso": "request",
             "campo_reservado_1": "jsession_id", "ambiente_origen": "f5_virtualserver", "ambiente_pool": "f5_pool",
             "entorno_nodo": "f5_bigip_name"}
    number = (lambda c, t: c) if numbers else (lambda c, t: f"cast({c} as varchar)")
    columns = {
        "timestamp_syslog": "timestamp_syslog", "hostname": "hostname", "ip_cliente_externo": "ip_cliente_externo",
        "ip_red_interna": "ip_red_interna", "usuario_autenticado": "cast(null as varchar)",
        "identidad": "cast(null as varchar)", "timestamp_apache": "timestamp_apache", "metodo": "metodo",
        "recurso": "recurso", "protocolo": "protocolo", "codigo_respuesta": number("code", "integer"),
        "tamano_respuesta": number("size", "bigint"), "referer": text("referer"), "user_agent": "user_agent",
        "tiempo_respuesta_ms": number("ms", "bigint"), "edad_cache": text("edad_cache"),
        "content_type": text("content_type"),
        "campo_reservado_1": "cast(null as varchar)" if empty_is_null else "''",
        "campo_reservado_2": "cast(null as varchar)", "ambiente_origen": "ambiente_origen",
        "ambiente_pool": "ambiente_pool", "entorno_nodo": "entorno_nodo",
    }
    if quoted:
        columns["campo_reservado_1"] = "cast(null as varchar)"
    if empty_is_null or quoted:
        columns["user_agent"] = "nullif(user_agent,'')"
    listed = ", ".join(f"{e} as {names.get(n, n) if old_names else n}" for n, e in columns.items())
    return f" select {listed} from {source} {where}"


CLEANED = """nullif(referer,'-') as referer, user_agent, nullif(edad_cache,'-') as edad_cache,
 nullif(content_type,'-') as content_type, '' as campo_reservado_1"""

PCT = "* 100.0::double / count(*)"


def _rate(flag: str) -> str:
    return f"count(*) filter ({flag}) {PCT}"


def _avg(column: str) -> str:
    return f"avg({column})"


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) as {name}"


PERIOD = "year = 2025 and month = 8"
RANGE = "ts between timestamp '2025-08-01 00:00:00' and timestamp '2025-08-31 12:00:00'"


def statements() -> dict[str, str]:
    q: dict[str, str] = {}

    # parsing
    q["parse_text_tolerant"] = _sql(_fields("rec"))
    q["parse_text_strict"] = _sql(_fields("rec", "where day(ts) < 10"))
    q["parse_json_alias"] = _sql(_fields("rec", "where fmt in ('json','json_old')"))
    # A grok token keeps the quotes, so "" is a placeholder and "-" is not.
    q["parse_grok"] = _sql(_fields("rec", quoted=True))
    q["parse_unquoted"] = _sql(
        """ select timestamp_syslog, ip_cliente_externo, recurso, code as codigo_respuesta, size as tamano_respuesta,
        ms as tiempo_respuesta_ms, case when edad_cache = '120' then '120' else '0' end as edad_cache,
        code >= 400 as is_error, ms > 1000 as is_slow, l_orderkey%4 = 0 as is_mobile, edad_cache = '120' as cache_hit
        from rec"""
    )
    q["detect_format"] = _sql(
        """ select case when fmt in ('json','json_old','envelope') then 'json' when fmt = 'bad' then 'unknown'
        else 'text' end as format, count(*) as records from rec group by 1"""
    )
    q["reject_reasons"] = _sql(
        """ select case when fmt in ('json','json_old','envelope') then 'json' when fmt = 'bad' then 'unknown'
        else 'text' end as record_format, case fmt when 'envelope' then 'missing_keys' when 'bad' then 'unknown_format'
        end as reject_reason, count(*) as records from rec group by 1, 2"""
    )
    q["null_cleaning_main"] = _sql(
        f""" select cast(null as varchar) as usuario_autenticado, cast(null as varchar) as identidad, {CLEANED},
        cast(null as varchar) as campo_reservado_2, count(*) as records from rec group by all"""
    )
    for name in ("legacy", "checker"):
        agent = "nullif(user_agent,'')" if name == "legacy" else "user_agent"
        q[f"null_cleaning_{name}"] = _sql(
            f""" select cast(null as varchar) as usuario_autenticado, cast(null as varchar) as identidad,
            nullif(referer,'-') as referer, {agent} as user_agent, nullif(nullif(edad_cache,'-'),'') as edad_cache,
            nullif(nullif(content_type,'-'),'') as content_type, cast(null as varchar) as campo_reservado_1,
            cast(null as varchar) as campo_reservado_2, count(*) as records from rec group by all"""
        )
    q["positional_extract"] = _sql(_fields("rec", numbers=False))
    q["envelope_unwrap"] = _sql(" select line as value from lines where fmt in ('text','envelope')")
    q["line_carrier"] = _sql(" select line as value from lines")
    q["adjacent_json_split"] = _sql(
        _fields("rec", "") + " union all " + _fields("rec", "")
    )
    q["syslog_timestamp"] = _sql(
        """ select timestamp_syslog, ts - interval 1 year as in_2024, ts as in_request_year, count(*) as records
        from rec group by 1, 2, 3"""
    )
    q["request_timestamp"] = _sql(
        """ select timestamp_apache, ts as wall_time, cast(epoch(ts) as bigint) + 10800 as epoch_seconds,
        count(*) as records from rec group by 1, 2, 3"""
    )
    q["date_parts"] = _sql(
        " select year, month, day, hour, count(*) as records from ok group by all"
    )
    q["raw_log_rebuild"] = _sql(
        """ select timestamp_syslog || ' ' || hostname || ' ' || ip_cliente_externo || ' ' || metodo || ' ' || recurso
        || ' ' || protocolo || ' ' || code || ' ' || size as raw_log, code as codigo_respuesta,
        size as tamano_respuesta, ms as tiempo_respuesta_ms, ts as parsed_timestamp_rp,
        cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour from rec"""
    )
    q["json_source"] = _sql(
        """ select ambiente_pool, count(*) as records, sum(size)::bigint as bytes from rec
        where fmt in ('json','json_old') group by 1"""
    )
    q["decode_payload"] = _sql(" select line as value from lines")

    # classification
    q["enrich_main"] = _sql(
        """ select is_error, status_category, is_slow, response_time_category, is_mobile, content_category, cache_hit,
        '3.0-multiformato' as etl_version, count(*) as records, sum(code)::bigint as codes, sum(ms)::bigint as ms
        from ok group by all"""
    )
    q["enrich_legacy_udf"] = _sql(
        """ select is_error, status_category, is_slow, case when ms = 0 then 'unknown' when ms < 100 then 'fast'
        when ms < 500 then 'normal' when ms < 2000 then 'slow' else 'critical' end as response_time_category,
        is_mobile, case content_type when 'application/javascript' then 'javascript' when 'text/css' then 'css'
        when 'image/png' then 'image' when 'text/html' then 'html' when 'application/json' then 'api'
        when 'font/woff2' then 'font' when 'application/pdf' then 'document' else 'unknown' end as content_category,
        coalesce(edad_cache,'') <> '' as cache_hit, size > 10485760 as is_large, '2.1.0' as etl_version,
        count(*) as records from logs group by all"""
    )
    q["enrich_legacy_native"] = _sql(
        """ select f5_bigip_name, status_category, response_time_category, is_error, is_slow, etl_version, day, hour,
        count(*) as records, sum(ms)::bigint as ms from (select entorno_nodo as f5_bigip_name,
        case when code < 300 then 'Success' when code < 400 then 'Redirect' when code < 500 then 'Client Error'
        else 'Server Error' end as status_category, case when ms < 1000 then 'Fast' when ms < 5000 then 'Normal'
        else 'Slow' end as response_time_category, code >= 400 as is_error, ms > 5000 as is_slow,
        '2.1.0' as etl_version, day, hour, ms from logs where day < 10) group by all"""
    )
    q["legacy_preparsed"] = q["enrich_legacy_native"].replace("from logs where day < 10", "from logs")
    q["enrich_bridge"] = _sql(
        """ select code >= 400 as is_error, ms > 1000 as is_slow, status_category, case when ms < 100 then 'fast'
        when ms < 500 then 'normal' when ms < 1000 then 'slow' else 'very_slow' end as response_time_category,
        'f5_access' as log_type, '2.0' as processor_version, count(*) as records from logs group by all"""
    )
    q["request_path_features"] = _sql(
        """ select recurso, '' as request_domain, cast(3 as integer) as request_path_depth,
        case when recurso like '%.js?v=1' then 'js' when recurso like '%.css' then 'css' when recurso like '%.png'
        then 'png' end as file_extension, count(*) as records from ok group by all"""
    )
    category = """case when concat_ws(',', case when code between 400 and 499 then 'client_error' when code >= 500
     then 'server_error' end, case when ms > 5000 then 'performance_slow' end, case when size > 10485760
     then 'performance_large' end) = '' then 'unknown' else concat_ws(',', case when code between 400 and 499
     then 'client_error' when code >= 500 then 'server_error' end, case when ms > 5000 then 'performance_slow' end,
     case when size > 10485760 then 'performance_large' end) end"""
    reasons = """concat_ws('; ', case when code >= 500 then 'HTTP ' || code || ' (server_error)' when code >= 400 then
     'HTTP ' || code || ' (client_error)' end, case when ms > 5000 then 'Slow response: ' || ms ||
     'ms (threshold: 5000ms)' end, case when size > 10485760 then 'Large response: ' || size ||
     ' bytes (threshold: 10485760 bytes)' end)"""
    q["error_category"] = _sql(f" select {category} as error_category, count(*) as records from ok group by 1")
    q["error_reasons"] = _sql(f" select {reasons} as error_reasons, count(*) as records from ok group by 1")
    keywords = ", ".join(
        f"case when contains(upper(text),'{k}') then '{k}' end"
        for k in ("ERROR", "CRITICAL", "FATAL", "EXCEPTION", "FAILED")
    )
    q["keyword_detection"] = f"select doc_id, concat_ws(',', {keywords}) as detected_keywords from documents"
    q["alert_generic"] = f"""select * from (select concat_ws(',', {keywords}) as detected_keywords, count(*) as records
        from documents group by 1) where detected_keywords <> ''"""
    q["record_accounting"] = _sql(
        """ select case when fmt = 'bad' then 'unknown_format' else 'accepted' end as outcome, count(*) as records from rec group by 1
        union all select case l_orderkey % 3 when 0 then 'empty_message' when 1 then 'missing_keys' else 'undecodable' end, count(*)
        from lineitem where l_linenumber = 1 group by 1"""
    )

    # reports
    q["error_analysis"] = _sql(
        f""" select * from (select entorno_nodo as f5_bigip, ambiente_pool as f5_pool,
        ambiente_origen as f5_virtualserver, status_category, code as codigo_respuesta, count(*) as error_count,
        {_r('avg(ms)', 'avg_response_time_ms')}, quantile_disc(ms, 0.95) as p95_response_time_ms,
        count(distinct ip_cliente_externo) as unique_clients, sum(size)::bigint as total_bytes_served,
        min(ts) as first_error, max(ts) as last_error from ok where is_error and {PERIOD} group by all)
        order by error_count desc, avg_response_time_ms desc, f5_bigip, f5_pool, f5_virtualserver, status_category,
        codigo_respuesta limit 50"""
    )
    q["error_analysis_by_origin"] = _sql(
        f""" select * from (select ambiente_origen as bigip_device, ambiente_pool as pool_name,
        entorno_nodo as virtual_server, code as status_code, status_category, count(*) as error_count,
        {_r('avg(ms)', 'avg_response_time')}, quantile_disc(ms, 0.95) as p95_response_time,
        min(ts) as first_error, max(ts) as last_error from ok where is_error and {PERIOD} group by all)
        order by error_count desc, avg_response_time desc, bigip_device, pool_name, virtual_server, status_code,
        status_category limit 100"""
    )
    q["performance_analysis"] = _sql(
        f""" select * from (select entorno_nodo as f5_bigip, ambiente_pool as f5_pool, response_time_category,
        content_category, is_mobile, cache_hit, count(*) as request_count, {_r('avg(ms)', 'avg_response_time_ms')},
        quantile_disc(ms, 0.5) as p50_response_time_ms, quantile_disc(ms, 0.95) as p95_response_time_ms,
        quantile_disc(ms, 0.99) as p99_response_time_ms, {_r('avg(size)', 'avg_response_size_bytes')},
        count(*) filter (is_error) as error_count, {_r(_rate('is_error'), 'error_rate_percent')}
        from ok where {PERIOD} group by all having count(*) >= 10)
        order by avg_response_time_ms desc, error_rate_percent desc, f5_bigip, f5_pool, response_time_category,
        content_category, is_mobile, cache_hit limit 100"""
    )
    q["performance_by_origin"] = _sql(
        f""" select * from (select ambiente_origen as bigip_device, ambiente_pool as pool_name, response_time_category,
        count(*) as request_count, {_r('avg(ms)', 'avg_response_time')},
        quantile_disc(ms, 0.5) as p50_response_time, quantile_disc(ms, 0.95) as p95_response_time,
        quantile_disc(ms, 0.99) as p99_response_time, count(*) filter (is_slow) as slow_requests,
        {_r(_rate('is_slow'), 'slow_request_percentage')} from ok where {PERIOD} group by all)
        order by avg_response_time desc, bigip_device, pool_name, response_time_category limit 50"""
    )
    q["pool_health"] = _sql(
        f""" select f5_pool, f5_bigip, total_requests, round(a, 6) as avg_response_time_ms, p95_response_time_ms,
        max_response_time_ms, error_count, server_errors, client_errors, round(e, 6) as error_rate_percent,
        round(se, 6) as server_error_rate_percent, unique_clients, total_bytes_served,
        round(greatest(0, 100 - e - least(a / 100, 50)), 6) as pool_health_score
        from (select ambiente_pool as f5_pool, entorno_nodo as f5_bigip, count(*) as total_requests, avg(ms) as a,
        quantile_disc(ms, 0.95) as p95_response_time_ms, max(ms) as max_response_time_ms,
        count(*) filter (is_error) as error_count, count(*) filter (code >= 500) as server_errors,
        count(*) filter (code >= 400 and code < 500) as client_errors, {_rate('is_error')} as e,
        {_rate('code >= 500')} as se, count(distinct ip_cliente_externo) as unique_clients,
        sum(size)::bigint as total_bytes_served from ok where {PERIOD} and ambiente_pool is not null group by all
        having count(*) >= 10) order by greatest(0, 100 - e - least(a / 100, 50)), e desc, a desc, f5_pool, f5_bigip
        limit 50"""
    )
    q["pool_health_origin"] = _sql(
        f""" select bigip_device, pool_name, total_requests, round(a, 6) as avg_response_time, p95_response_time,
        error_count, round(e, 6) as error_rate, slow_requests, round(s, 6) as slow_request_rate,
        round(greatest(0, 100 - e * 2 - s - least(50, a / 20)), 6) as health_score
        from (select ambiente_origen as bigip_device, ambiente_pool as pool_name, count(*) as total_requests,
        avg(ms) as a, quantile_disc(ms, 0.95) as p95_response_time, count(*) filter (is_error) as error_count,
        {_rate('is_error')} as e, count(*) filter (is_slow) as slow_requests, {_rate('is_slow')} as s
        from ok where {PERIOD} group by all having count(*) >= 10)
        order by greatest(0, 100 - e * 2 - s - least(50, a / 20)), e desc, bigip_device, pool_name limit 100"""
    )
    q["pool_health_panel"] = _sql(
        f""" select pool_name, round(greatest(0, 100 - e * 2 - s - least(50, a / 20)), 6) as health_score
        from (select ambiente_pool as pool_name, {_rate('is_error')} as e, {_rate('is_slow')} as s, avg(ms) as a
        from ok where {RANGE} group by 1)"""
    )
    q["request_summary"] = _sql(
        f""" select entorno_nodo as f5_bigip, ambiente_pool as f5_pool, count(*) as request_count,
        {_r('avg(ms)', 'avg_response_time_ms')} from ok where {PERIOD} group by 1, 2
        order by request_count desc, f5_bigip, f5_pool limit 50"""
    )
    q["traffic_distribution"] = _sql(
        f""" select ambiente_origen as bigip_device, ambiente_pool as pool_name, entorno_nodo as virtual_server,
        metodo as http_method, count(*) as request_count, sum(size)::bigint as total_bytes_served,
        {_r('avg(size)', 'avg_response_size')}, count(distinct ip_cliente_externo) as unique_clients,
        round(count(*) * 100.0::double / sum(count(*)) over (), 6) as traffic_percentage
        from ok where {PERIOD} group by 1, 2, 3, 4
        order by request_count desc, bigip_device, pool_name, virtual_server, http_method limit 100"""
    )
    q["client_behavior"] = _sql(
        f""" select case when is_mobile then 'Mobile' else 'Desktop' end as device_type, content_category,
        count(*) as request_count, count(distinct ip_cliente_externo) as unique_clients,
        {_r('avg(ms)', 'avg_response_time')}, count(*) filter (cache_hit) as cache_hits,
        {_r(_rate('cache_hit'), 'cache_hit_rate')}, count(*) filter (is_error) as error_count,
        {_r(_rate('is_error'), 'error_rate')} from ok where {PERIOD} group by is_mobile, content_category"""
    )
    q["content_performance"] = _sql(
        f""" select content_category, content_type, count(*) as total_requests, count(*) filter (cache_hit) as cache_hits,
        {_r(_rate('cache_hit'), 'cache_hit_rate')}, {_r('avg(ms)', 'avg_response_time')},
        {_r('avg(ms) filter (cache_hit)', 'avg_cached_response_time')},
        {_r('avg(ms) filter (not cache_hit)', 'avg_uncached_response_time')},
        sum(size)::bigint as total_bytes_served, {_r('avg(size)', 'avg_response_size')}
        from ok where {PERIOD} and content_type is not null group by 1, 2
        order by total_requests desc, count(*) filter (cache_hit) {PCT}, content_category, content_type limit 50"""
    )
    q["hourly_summary"] = _sql(
        f""" select year, month, day, hour, count(*) as total_requests,
        count(distinct ip_cliente_externo) as unique_clients,
        count(distinct ambiente_origen) as active_bigip_devices, count(distinct ambiente_pool) as active_pools,
        {_r('avg(ms)', 'avg_response_time')}, quantile_disc(ms, 0.95) as p95_response_time,
        count(*) filter (is_error) as error_count, {_r(_rate('is_error'), 'error_rate')},
        count(*) filter (cache_hit) as cache_hits, {_r(_rate('cache_hit'), 'cache_hit_rate')},
        sum(size)::bigint as total_bytes_served from ok where {PERIOD} group by 1, 2, 3, 4"""
    )
    q["partition_distribution"] = _sql(" select year, month, day, count(*) as record_count from ok group by 1, 2, 3")
    q["origin_errors_day"] = _sql(
        f" select ambiente_origen, count(*) as errors from ok where {PERIOD} and day = 21 and is_error group by 1"
    )
    q["errors_by_pool_top10"] = _sql(
        f""" select ambiente_pool as pool_name, count(*) as error_count from ok where is_error and {RANGE}
        group by 1 order by error_count desc, pool_name limit 10"""
    )
    q["error_timeline"] = _sql(
        f" select ts as time, count(*) as errors from ok where is_error and {RANGE} group by 1"
    )
    q["error_timeline_bucketed"] = _sql(
        f""" select time_bucket(interval '5 minutes', ts, timestamp '1970-01-01') as time, count(*) as errors
        from ok where is_error and {RANGE} group by 1"""
    )
    q["slow_rate"] = _sql(f" select {_r(_rate('is_slow'), 'slow_rate')} from ok where {RANGE}")
    q["time_range_filter"] = _sql(
        """ select entorno_nodo, count(*) as records, sum(size)::bigint as bytes from ok
        where ts between timestamp '2025-08-07 06:30:00' and timestamp '2025-08-19 18:45:00' group by 1"""
    )
    q["etl_error_stats"] = _sql(
        f""" select count(*) as total_records, count(*) filter (code >= 400) as error_records,
        count(*) filter (ms > 5000) as slow_records, {_r(_rate('code >= 400'), 'error_rate')},
        {_r(_rate('ms > 5000'), 'slow_rate')} from ok"""
    )
    formats = """ select count(*) as total_records, count(*) filter (fmt in ({json})) as json_records,
        count(*) filter (fmt in ({text})) as text_records, count(*) filter (fmt not in ({lost})) as parsed_successfully,
        count(*) filter (fmt in ({errors})) as parsing_errors, count(*) filter (fmt = 'bad') as format_detection_errors,
        round(count(*) filter (fmt not in ({lost})) * 100.0::double / count(*), 6) as success_rate from rec"""
    q["etl_format_stats"] = _sql(
        formats.format(json="'json','json_old','envelope'", text="'text'", lost="'bad','envelope'", errors="'envelope'")
    )
    q["etl_format_stats_unwrapped"] = _sql(
        formats.format(json="'json','json_old'", text="'text','envelope'", lost="'bad'", errors="'none'")
    )
    q["etl_run"] = _sql(
        """ select count(*) as total_records, count(*) filter (fmt in ('json','json_old')) as json_records,
        count(*) filter (fmt in ('text','envelope')) as text_records, count(*) filter (fmt <> 'bad') as parsed_successfully,
        count(*) filter (fmt = 'bad') as rejected, count(*) filter (fmt <> 'bad') as stored,
        count(*) filter (fmt = 'bad') as quarantined from rec"""
    )
    flagged = "(code >= 400 or ms > 5000 or size > 10485760)"
    q["volume_metrics"] = _sql(
        f""" select count(*) as logs_processed, count(*) filter (fmt <> 'bad' and {flagged}) as error_logs_filtered,
        count(*) filter (fmt in ('json','json_old')) as json_format_detected,
        count(*) filter (fmt in ('text','envelope')) as text_format_detected,
        count(*) filter (fmt <> 'bad') as enrichment_success from rec"""
    )
    q["traffic_metrics_windowed"] = _sql(
        f""" select time_bucket(interval '5 minutes', ts, timestamp '1970-01-01') as window_start,
        {_r(_rate('is_mobile'), 'mobile_traffic_percentage')}, {_r(_rate('cache_hit'), 'cache_hit_rate')},
        round(count(*) / 300.0::double, 6) as request_volume from ok group by 1"""
    )

    # alerts and metrics
    access = f"""select 'f5_access' as log_type, {reasons} as error_reasons, {category} as error_category,
        code as codigo_respuesta, ms as tiempo_respuesta_ms, size as tamano_respuesta, entorno_nodo as f5_bigip_name,
        ambiente_pool as f5_pool, recurso as request, edad_cache, content_type, timestamp_rp,
        cast('' as varchar) as detected_keywords
        from (select *, timestamp_apache as timestamp_rp from rec) where {flagged} and fmt <> 'bad'"""
    q["alert_records"] = _sql(" " + access)
    q["alert_records_strict"] = _sql(f" {access} and (fmt in ('json','json_old') or day(ts) < 10)")
    generic = """select 'f5_generic_error', 'Contains error keyword', cast(null as varchar), cast(0 as integer),
        cast(0 as bigint), cast(0 as bigint), cast(null as varchar), cast(null as varchar),
        cast(null as varchar), cast(null as varchar), cast(null as varchar), cast(null as varchar), 'ERROR'
        from rec where fmt = 'json_old'"""
    q["alert_records_faithful"] = _sql(f" {access} and fmt in ('text','envelope') and day(ts) < 10 union all {generic}")
    q["stream_filter_available_now"] = q["alert_records"]
    metrics = """, agg as (select entorno_nodo as F5Environment, ambiente_pool as Pool, ambiente_origen as VirtualServer,
        count(*) as n, avg(ms) as a, list_sort(list(ms)) as l, count(*) filter (code >= 400) * 100.0::double / count(*)
        as e, count(*) filter (ms > 5000) * 100.0::double / count(*) as s from ok {where} group by 1, 2, 3),
        wide as (select *, l[least(n, (95 * n) // 100 + 1)] as p, greatest(0, 100 - e - s / 2) as h from agg)
        select F5Environment, Pool, VirtualServer, 'RequestCount' as metric, cast(n as double) as value,
        'Count' as unit from wide
        union all select F5Environment, Pool, VirtualServer, 'AverageResponseTime', round(a, 6), 'Milliseconds' from wide
        union all select F5Environment, Pool, VirtualServer, 'P95ResponseTime', cast(p as double), 'Milliseconds' from wide
        union all select F5Environment, Pool, VirtualServer, 'ErrorRate', round(e, 6), 'Percent' from wide
        union all select F5Environment, Pool, VirtualServer, 'PoolHealthScore', round(h, 6), 'Percent' from wide"""
    q["stream_metrics_flagged"] = _sql(metrics.format(where=f"where {flagged}"))
    q["stream_metrics_all"] = _sql(metrics.format(where=""))
    windowed = """, agg as (select time_bucket(interval '5 minutes', ts, timestamp '1970-01-01') as window_start,
        entorno_nodo as F5Environment, ambiente_pool as Pool, ambiente_origen as VirtualServer,
        count(*) as n, avg(ms) as a, {p95} as p, count(*) filter (code >= 400) * 100.0::double
        / count(*) as e, count(*) filter (ms > 5000) * 100.0::double / count(*) as s from ok group by 1, 2, 3, 4),
        wide as (select *, window_start + interval 5 minutes as window_end, greatest(0, 100 - e - s / 2) as h from agg)"""
    for i, (name, expression, unit) in enumerate(
        (("RequestCount", "cast(n as double)", "Count"), ("AverageResponseTime", "round(a, 6)", "Milliseconds"),
         ("P95ResponseTime", "cast(p as double)", "Milliseconds"), ("ErrorRate", "round(e, 6)", "Percent"),
         ("PoolHealthScore", "round(h, 6)", "Percent"))
    ):
        windowed += (" union all" if i else "") + f""" select window_start, window_end, F5Environment, Pool,
        VirtualServer, '{name}' as metric, {expression} as value, '{unit}' as unit from wide"""
    nearest = "list_sort(list(ms))[least(count(*), (95 * count(*)) // 100 + 1)]"
    q["windowed_pool_metrics"] = _sql(windowed.replace("{p95}", nearest))
    q["stream_window_metrics"] = q["windowed_pool_metrics"]
    q["stream_filter_encoded"] = q["alert_records"]
    q["windowed_health"] = _sql(
        f""" select *, window_start + interval 10 minutes as window_end from (select
        time_bucket(interval '10 minutes', ts, timestamp '1970-01-01') as window_start, entorno_nodo as F5Environment,
        ambiente_pool as Pool, ambiente_origen as VirtualServer,
        round(greatest(0, 100 - {_rate('is_error')} - {_rate('is_slow')} / 2), 6) as PoolHealthScore
        from ok group by 1, 2, 3, 4)"""
    )

    # alarms
    def alarm(windows: str, period: int, n: int, breach: str, missing: str = "false") -> str:
        return f"""w as ({windows}), judged as (select *, coalesce({breach}, {missing}) as breaching from w),
        states as (select *, sum(breaching::int) over (order by window_start
         range between interval {(n - 1) * period} seconds preceding and current row) as run from judged),
        result as (select window_start, round(value, 6) as value, breaching, cast(run as bigint) as datapoints_breaching,
         case when run >= {n} then 'ALARM' else 'OK' end as state from states)"""

    def bucket(period: int, time: str = "ts") -> str:
        return f"time_bucket(interval '{period} seconds', {time}, timestamp '1970-01-01')"

    no_data = f"""select window_start, value from (select unnest(generate_series(min(b), max(b), interval 5 minutes))
        as window_start from (select {bucket(300)} as b from events)) left join (select {bucket(300)} as window_start,
        cast(count(*) as double) as value from events group by 1) using (window_start)"""
    lag = f"""select {bucket(300, 'seen')} as window_start, max(lag) as value from (select seen, cast(epoch_ms(seen) - epoch_ms(newest) as double) as lag
        from (select max(ts) as newest, timestamp '2025-08-01 00:00:00' + to_seconds((slot + 1) * 21600 + slot * 7919 % 600) as seen
         from (select ts, (epoch(ts)::bigint - 1754006400) // 21600 as slot from ok) group by slot)) group by 1"""
    q["alarm_no_data"] = "with " + alarm(no_data, 300, 2, "value < 1", "true") + " select * from result"
    q["alarm_lag"] = _sql(" select * from result", alarm(lag, 300, 2, "value > 300000"))
    of = {
        "alarm_parse_errors": (f"select {bucket(300)} as window_start, cast(count(*) filter (fmt = 'bad') as double)"
                               " as value from rec group by 1", 300, 2, "value > 5"),
        "alarm_response_time": (f"select {bucket(300)} as window_start, avg(ms) as value from ok group by 1",
                                300, 3, "value > 2000"),
        "alarm_error_rate": (f"select {bucket(300)} as window_start, {_rate('is_error')} as value from ok group by 1",
                             300, 2, "value > 5"),
        "alarm_pool_health": (f"""select window_start, avg(h) as value from (select {bucket(600)} as window_start,
            greatest(0, 100 - {_rate('is_error')} - {_rate('is_slow')} / 2) as h from ok
            group by 1, entorno_nodo, ambiente_pool, ambiente_origen) group by 1""", 600, 2, "value < 70"),
    }
    for name, (windows, period, n, breach) in of.items():
        q[name] = _sql(" select * from result", alarm(windows, period, n, breach))
    for name in ("alarm_response_time", "alarm_error_rate"):
        windows, period, n, breach = of[name]
        each = alarm(windows.replace("as window_start,", "as window_start, ambiente_pool,").replace("group by 1", "group by 1, 2"),
                     period, n, breach)
        each = each.replace("over (order by", "over (partition by ambiente_pool order by")
        q[f"{name}_by_pool"] = _sql(" select * from result", each.replace("(select window_start, round", "(select window_start, ambiente_pool, round"))
    windows, period, n, breach = of["alarm_response_time"]
    q["alarm_transitions"] = _sql(
        """ select 'Average-Response-Time' as alarm_name, 'Responses are slow' as alarm_description, old_state,
        state as new_state, 'Threshold Crossed: ' || datapoints_breaching || ' out of the last 3 datapoints [' ||
        cast(round(v, 2) as varchar) || ' (' || strftime(window_start, '%d/%m/%y %H:%M:%S') || ')] ' ||
        case when breaching then 'was' else 'was not' end || ' greater than the threshold (2000.0).' as reason,
        window_start + interval 5 minutes as state_change_time from (select *, coalesce(lag(state) over
        (order by window_start), 'OK') as old_state from (select r.*, w.value as v from result r join w
        using (window_start))) where old_state <> state""",
        alarm(windows, period, n, breach),
    )
    q["stream_alarm_transitions"] = q["alarm_transitions"]

    # quality
    q["schema_conformance"] = _sql(
        """ select 33::integer as schema_columns, 4::integer as partition_keys, '' as missing_columns,
        'f5_environment' as missing_partitions, 'PARTIAL' as status, count(*) as records from ok"""
    )
    q["data_profile"] = _sql(
        """ select count(*) as records, count(distinct nullif(content_type,'')) as content_types,
        count(distinct code) as response_codes, count(distinct metodo) as methods,
        count(distinct ambiente_pool) as pools, min(nullif(ms,0)) as min_response_time, max(ms) as max_response_time,
        cast(floor(sum(ms)::double / count(nullif(ms,0))) as bigint) as mean_response_time,
        min(nullif(size,0)) as min_response_size, max(size) as max_response_size,
        cast(floor(sum(size)::double / count(nullif(size,0))) as bigint) as mean_response_size from ok"""
    )
    q["data_profile_values"] = _sql(
        """ select 'content_type' as field, content_type as value, count(*) as records from ok
        where content_type <> '' group by 2
        union all select 'codigo_respuesta', cast(code as varchar), count(*) from ok group by 2
        union all select 'metodo', metodo, count(*) from ok group by 2
        union all select 'ambiente_pool', ambiente_pool, count(*) from ok group by 2"""
    )
    fill = {
        "timestamp_syslog": "timestamp_syslog", "parsed_timestamp_syslog": "ts", "hostname": "hostname",
        "ip_cliente_externo": "ip_cliente_externo", "ip_red_interna": "ip_red_interna", "metodo": "metodo",
        "recurso": "recurso", "codigo_respuesta": "code", "tamano_respuesta": "size", "tiempo_respuesta_ms": "ms",
        "ambiente_origen": "ambiente_origen", "ambiente_pool": "ambiente_pool", "entorno_nodo": "entorno_nodo",
        "is_error": "is_error", "is_slow": "is_slow", "status_category": "status_category",
        "response_time_category": "response_time_category", "content_category": "content_category",
        "is_mobile": "is_mobile", "cache_hit": "cache_hit", "content_type": "content_type", "referer": "referer",
    }
    q["schema_column_fill"] = _sql(
        " union all ".join(
            f" select '{n}' as field, count(*) as records, count({c}) as filled from ok" for n, c in fill.items()
        )
        + " union all select 'f5_environment', count(*), 0 from ok"
    )
    required = ["timestamp_syslog", "hostname", "ip_cliente_externo", "ip_red_interna", "metodo", "recurso", "protocolo",
                "codigo_respuesta", "tamano_respuesta", "user_agent", "tiempo_respuesta_ms", "ambiente_origen",
                "ambiente_pool", "entorno_nodo"]
    own = {"codigo_respuesta": "code", "tamano_respuesta": "size", "tiempo_respuesta_ms": "ms"}
    q["field_completeness"] = _sql(
        " union all ".join(
            f" select '{n}' as field, count(*) as records, count(*) - count({own.get(n, n)}) as missing,"
            f" cast(0 as bigint) as type_errors from ok" for n in required
        )
    )
    q["parse_validity"] = _sql(
        """ select count(*) as total_lines, count(*) filter (fmt <> 'bad') as valid_lines,
        count(*) filter (fmt = 'bad') as invalid_lines from rec"""
    )
    numbered = "row_number() over (partition by l_orderkey % 64 order by l_orderkey, line) as line_number"
    q["invalid_line_excerpts"] = _sql(
        f""" select cast(l_orderkey % 64 as integer) as file, line_number, 'corrupt ' || line as line, 'unknown_format' as error
        from (select *, {numbered} from lines) where fmt = 'bad'"""
    )
    q["field_type_errors"] = _sql(
        " union all ".join(
            f" select '{n}' as field, count(*) as records, {missing.get(n, '0')}::bigint as missing, {wrong}::bigint as type_errors from lineitem"
            for missing in [{
                "user_agent": "0", "entorno_nodo": "count(*) filter (l_partkey % 10 = 0)",
                "tiempo_respuesta_ms": "count(*) filter (l_partkey % 7 = 0)",
            }]
            for n in required
            for wrong in ["count(*) filter (l_partkey % 7 = 0)" if n == "tiempo_respuesta_ms" else "0"]
        )
    )
    q["nodes_and_paths"] = _sql(
        """ select f5_environment, case when path <> '-' then split_part(path, '/', 1) end as request_domain,
        cast(case when path = '-' then 0 else len(list_filter(string_split(path, '/'), lambda x: x <> '')) end as integer) as request_path_depth,
        case when contains(path, '.') then lower(split_part(list_last(string_split(path, '.')), '?', 1)) end as file_extension, count(*) as records
        from (select case when l_partkey % 10 = 0 then 'UNKNOWN' when l_linestatus = 'O' then 'TEPROD' else 'PAPROD' end as f5_environment,
         case l_partkey % 5 when 1 then 'cdn.example.org' || path when 2 then '-' when 3 then path || '/deep/er/Index.HTML' else path end as path
         from (select *, concat('/org-',cast(l_suppkey%20 as varchar),'/files/',cast(l_partkey as varchar),
          case l_partkey%4 when 0 then '.js?v=1' when 1 then '.css' when 2 then '.png' else '' end) as path from lineitem))
        group by all"""
    )
    q["group_count_check"] = _sql(
        """ select count(*) as lines, count(*) filter (fmt = 'text') as matched, count(*) filter (fmt <> 'text')
        as skipped, count(*) filter (fmt = 'text') as complete, cast(0 as bigint) as partial from rec"""
    )
    q["group_count_check_nested"] = _sql(
        """ select count(*) as lines, count(*) filter (fmt = 'text') as matched, count(*) filter (fmt <> 'text')
        as skipped, cast(0 as bigint) as complete, count(*) filter (fmt = 'text') as partial from rec"""
    )
    q["parser_reconciliation"] = _sql(
        """ select 'outcome' as kind, case when fmt <> 'text' then 'neither' when day(ts) < 10 then 'both'
        else 'numbered_only' end as name, count(*) as lines from rec group by 2
        union all select 'difference', 'campo_reservado_1', count(*) from rec where fmt = 'text' and day(ts) < 10
        union all select 'difference', 'edad_cache', count(*) from rec where fmt = 'text' and day(ts) < 10
         and edad_cache = ''
        union all select 'difference', 'content_type', count(*) from rec where fmt = 'text' and day(ts) < 10
         and content_type = ''"""
    )

    # storage and streams
    q["partitioned_roundtrip"] = q["error_analysis"]
    q["append_roundtrip"] = _sql(
        " select day, hour, 2 * count(*) as records, (2 * sum(size))::bigint as bytes from ok group by 1, 2"
    )
    q["dynamic_overwrite"] = _sql(
        " select day, count(*) as records, sum(size)::bigint as bytes from ok group by 1"
    )
    q["catalog_table"] = _sql(
        " select entorno_nodo, count(*) as records, sum(size)::bigint as bytes from ok group by 1"
    )
    q["quarantine"] = _sql(
        """ select case fmt when 'envelope' then 'missing_keys' else 'unknown_format' end as reject_reason,
        count(*) as records from rec where fmt in ('envelope', 'bad') group by 1"""
    )
    q["incremental_ingest"] = _sql(
        " select year, month, day, hour, count(*) as records, sum(size)::bigint as bytes from ok group by 1, 2, 3, 4"
    )
    q["compaction"] = _sql(
        """ select year, month, day, hour, count(*) as records, sum(size)::bigint as bytes, 1::bigint as files
        from ok group by 1, 2, 3, 4"""
    )
    q["retention"] = _sql(
        " select day, count(*) as records, sum(size)::bigint as bytes from ok where day >= 17 group by 1"
    )
    q["stream_landing"] = _sql(
        """ select cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour,
        case fmt when 'text' then line when 'bad' then 'corrupt ' || line end as line, count(*) as records, true as within_limit
        from lines group by all"""
    )
    q["stream_batch_metrics"] = q["stream_metrics_flagged"]
    q["bridge_publication"] = _sql(
        f""" select cast(line_number % 10 as varchar) as key, count(*) as messages, sum(size)::bigint as bytes,
        count(*) filter (code >= 400) as errors from (select *, {numbered} from lines) where fmt <> 'bad' group by 1"""
    )
    q["catalog_evolution"] = _sql(
        """ select day, count(*) as records, count(*) filter (day >= 10) as with_cache_hit, sum(ms)::bigint as ms from ok group by day"""
    )
    q["sketched_pools"] = _sql(
        """ select ambiente_pool, count(*) as records, count(distinct ip_cliente_externo) as clients, true as clients_close,
        true as p50_close, true as p95_close, true as p99_close from ok group by 1"""
    )
    q["ingest_envelope"] = _sql(
        " select 'f5_access' as log_type, 'spark' as processed_by, '1' as agent_version, line as message from lines"
    )
    q["result_export"] = q["request_summary"]
    q["log_message_filters"] = """select 'level' as filter, count(*) as records from events where event_type = 'error'
        union all select 'message', count(*) from events where contains(props, '9')
        union all select 'both', count(*) from events where event_type = 'error' and contains(props, '9')"""
    return q
