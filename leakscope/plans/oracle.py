"""The same results as ANSI SQL over the source tables.

Written from the definitions, not from the Spark plans: plain windows, joins
on ranges and products of tables where the Spark side counts, bins or cells.
"""

from __future__ import annotations

import re

from leakscope import schemas
from leakscope.functions import demand, geo, text
from leakscope.sources.testdata import (ANSI, EVENT_COLUMNS, PAYMENT_MODE, ROUTE_COLUMNS,
                                        ROUTE_NUMBER, STOP_COLUMNS, STOPS_PER_ROUTE, render)


def _select(columns) -> str:
    return ", ".join(f"{render(x, ANSI)} as {n}" for n, x in columns)


def _round(x: str, digits: int) -> str:
    return f"floor(({x})*1e{digits}+0.5e0)/1e{digits}"


def _cents(x: str) -> str:
    return f"cast(floor(({x})*100e0+0.5e0) as bigint)"


def _money(x: str) -> str:
    return f"coalesce(cast(sum({_cents(x)}) as double),0e0)/100e0"


def _ladder(column: str, steps: list[tuple[str, str]], otherwise: str) -> str:
    whens = " ".join(f"when {column} {test} then {value}" for test, value in steps)
    return f"(case {whens} else {otherwise} end)"


def _lit(x: float) -> str:
    return f"{x!r}e0"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2}-{lat1})/2e0),2)+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians({lon2}-{lon1})/2e0),2))")
    return f"(2e0*{_lit(geo.EARTH_RADIUS_KM)}*atan2(sqrt({a}),sqrt(1e0-{a})))"


def _label(start: str, end: str) -> str:
    return f"concat(cast({start} as varchar), ':00-', cast({end} as varchar), ':00')"


def _clock(minutes: str) -> str:
    m = f"cast(floor({minutes}) as int)"
    return (f"concat(lpad(cast(least({m}//60, 23) as varchar),2,'0'),':',"
            f"lpad(cast({m}%60 as varchar),2,'0'),':00')")


HOUR_FACTOR = _ladder("sim_hour", [(f"between {lo} and {hi}", _lit(f))
                                   for (lo, hi), f in demand.HOUR_FACTORS], "1e0")
DAY_FACTOR = _ladder("day_of_week", [(f"= {d}", _lit(f)) for d, f in demand.DAY_FACTORS.items()], "1e0")
BASE = _ladder("route_category", [(f"= '{c}'", _lit(f)) for c, f in demand.BASE_RIDERSHIP.items()],
               _lit(demand.DEFAULT_RIDERSHIP))
CODE = _ladder("route_category", [(f"= '{c}'", str(n)) for c, n in schemas.ROUTE_CATEGORY_CODES.items()],
               str(schemas.UNKNOWN_CATEGORY_CODE))


def _bucket(weights) -> str:
    reach, steps = 0.0, []
    for name, weight in weights:
        reach += weight
        steps.append((f"<= {_lit(reach)}", f"'{name}'"))
    return _ladder("u", steps, f"'{weights[0][0]}'")


def _has_word(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(stop_name, '{w}')" for w in words) + ")"


def _scores(date_col: str) -> str:
    pct = ("case when e > 0 then (cast(e as double)-cast(r as double))/cast(e as double)*100e0 "
           "else 0e0 end")
    return f"""
        select route_id, sim_date, 'full_day' as time_window,
               cast(e as double)/100e0 as expected_revenue, cast(r as double)/100e0 as reported_revenue,
               cast(e-r as double)/100e0 as leakage_amount, {_round('pct', 2)} as leakage_percentage,
               case when pct > 15 then 'critical' when pct > 8 then 'high' when pct > 3 then 'medium'
                    else 'low' end as risk_level, anomaly_count
        from (select *, {pct} as pct from (
              select route_id, {date_col} as sim_date, sum({_cents('expected_revenue')}) as e,
                     sum({_cents('reported_revenue')}) as r,
                     count(*) filter (where is_anomalous = 1) as anomaly_count
              from ev group by route_id, {date_col}))"""


def _learned(source: str, keys: str) -> str:
    c = _cents("expected_revenue")
    return f"""
        select {keys}, cast(s as double)/100e0/n as mean,
               sqrt(cast(n*q - s*s as double))/n/100e0 as stddev, n
        from (select {keys}, count(*) as n, sum(cast({c} as hugeint)) as s,
                     sum(cast({c} as hugeint)*{c}) as q from {source} group by {keys})"""


SCORE = ("least(1e0, greatest(0e0, baseline_score*0.4e0 "
         "+ abs(case when expected_revenue > 0 then (expected_revenue-reported_revenue)/expected_revenue "
         "else 0e0 end)*0.35e0 "
         "+ abs(case when boarding_count > 0 then cast(boarding_count-ticket_count as double)/boarding_count "
         "else 0e0 end)*0.25e0))")

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], f"select {_select(EVENT_COLUMNS)} from lineitem"),
    "evm": ([], f"select {_select(EVENT_COLUMNS)}, {PAYMENT_MODE} as payment_mode "
                "from lineitem left join orders on l_orderkey = o_orderkey"),
    "routes": ([], f"select {_select(ROUTE_COLUMNS)} from supplier"),
    "stops": ([], f"select {_select(STOP_COLUMNS)} from supplier, "
                  f"range(1, {STOPS_PER_ROUTE + 1}) places(seq)"),
    "enriched": (["ev", "routes", "stops"],
             "select ev.*, route_category, boarding_density from ev join routes using (route_id) "
             "join stops on ev.stop_id = stops.stop_id"),
    "learned": (["ev"], _learned("(select * from ev where is_anomalous = 0)",
                                 "route_id, sim_hour, day_of_week")),
    "scored": (["enriched", "learned"], """
        select *, least(1e0, abs(z)/5e0) as baseline_score, abs(z) > 2.5e0 as is_anomaly from (
        select enriched.*, case when stddev is not null and stddev <> 0
               then (expected_revenue-reported_revenue)/stddev else 0e0 end as z
        from enriched left join learned using (route_id, sim_hour, day_of_week))"""),
    "det": (["scored"], f"""
        select event_id, route_id, trip_id, stop_id, stop_sequence, sim_date, sim_hour as hour,
               {_round('score', 4)} as anomaly_score, expected_revenue, reported_revenue,
               {_round('expected_revenue-reported_revenue', 2)} as discrepancy,
               {_round('z', 2)} as z_score, score > 0.3e0 as is_flagged, boarding_count, ticket_count,
               is_anomalous as is_ground_truth_anomaly, anomaly_id
        from (select *, {SCORE} as score from scored)"""),
    "rec": (["det"], f"""
        select sha256(event_id) as detection_id, anomaly_score, route_id, trip_id, stop_id,
               stop_sequence, stop_id as segment_start_stop, stop_id as segment_end_stop,
               {_label('hour', 'hour+1')} as time_window, sim_date, 'ml_ensemble' as detection_type,
               expected_revenue as expected_value, reported_revenue as reported_value, discrepancy,
               anomaly_id as matched_ground_truth_id, 'new' as status
        from det where is_flagged"""),
    "sc": (["ev"], _scores("period")),
    "truth": (["ev"], f"""
        select concat(case place when 1 then 'A' else 'B' end, '-', route_id, '-',
                      cast(year(period_year) as varchar)) as anomaly_id,
               case {ROUTE_NUMBER} % 4 when 0 then 'under_reporting' when 1 then 'ghost_trip'
                    when 2 then 'qr_upi_fraud' else 'fare_evasion_cluster' end as anomaly_type,
               route_id, least(stop_sequence, coalesce(other, stop_sequence)) as start_seq,
               greatest(stop_sequence, coalesce(other, stop_sequence)) as end_seq,
               first_hour, last_hour, period_year as sim_date,
               {_round(f'0.3e0 + ({ROUTE_NUMBER} % 8)*0.05e0', 2)} as severity
        from (select *, row_number() over w as place, lag(stop_sequence) over w as other from (
                select route_id, period_year, stop_sequence, min(sim_hour) as first_hour,
                       max(sim_hour) as last_hour,
                       sum({_cents('expected_revenue')} - {_cents('reported_revenue')}) as gap
                from ev where is_anomalous = 1 group by all)
              window w as (partition by route_id, period_year order by gap desc, stop_sequence))
        where place <= 2"""),
    "truthdays": (["ev"], f"""
        select concat(case place when 1 then 'A' else 'B' end, '-', route_id, '-',
                      cast(sim_date as varchar)) as anomaly_id,
               case {ROUTE_NUMBER} % 4 when 0 then 'under_reporting' when 1 then 'ghost_trip'
                    when 2 then 'qr_upi_fraud' else 'fare_evasion_cluster' end as anomaly_type,
               route_id, least(stop_sequence, coalesce(other, stop_sequence)) as start_seq,
               greatest(stop_sequence, coalesce(other, stop_sequence)) as end_seq,
               first_hour, last_hour, sim_date,
               {_round(f'0.3e0 + ({ROUTE_NUMBER} % 8)*0.05e0', 2)} as severity
        from (select *, row_number() over w as place, lag(stop_sequence) over w as other from (
                select route_id, sim_date, stop_sequence, min(sim_hour) as first_hour,
                       max(sim_hour) as last_hour,
                       sum({_cents('expected_revenue')} - {_cents('reported_revenue')}) as gap
                from ev where is_anomalous = 1 group by all)
              window w as (partition by route_id, sim_date order by gap desc, stop_sequence))
        where place <= 2"""),
    "matched": (["evm", "truth"], """
        select * from (
        select e.*, truth.anomaly_id as found_id, anomaly_type, severity,
               row_number() over (partition by e.row_no order by truth.anomaly_id) as nth
        from (select *, row_number() over () as row_no from evm) e
        left join truth on e.route_id = truth.route_id and e.period_year = truth.sim_date
         and sim_hour between first_hour and last_hour and stop_sequence between start_seq and end_seq)
        where nth = 1"""),
    "changed": (["matched"], f"""
        select event_id, boarding_count,
               greatest(0, cast(floor(boarding_count*kt+0.5e0) as int)) as ticket_count,
               expected_revenue, greatest(0e0, {_round('expected_revenue*kr', 2)}) as reported_revenue,
               cast(found_id is not null as int) as is_anomalous, found_id
        from (select *, case when anomaly_type in ('under_reporting','fare_evasion_cluster') then 1e0-severity
                        when anomaly_type = 'ghost_trip' then 0.05e0 else 1e0 end as kt,
                   case when anomaly_type in ('under_reporting','fare_evasion_cluster') then 1e0-severity
                        when anomaly_type = 'ghost_trip' then 0.05e0
                        when anomaly_type = 'qr_upi_fraud' and payment_mode in ('upi','card')
                        then 1e0-severity else 1e0 end as kr from matched)"""),
    "win": ([], "select cast(t as int) as window_index, cast(5+t as int) as ws, "
                "cast(6+t as int) as we from range(0, 18) w(t)"),
    "seg": (["stops"], """
        select a.route_id, a.stop_sequence - 1 as segment_index, a.stop_id as segment_start_stop,
               b.stop_id as segment_end_stop, a.stop_sequence as segment_start_seq,
               b.stop_sequence as segment_end_seq
        from stops a join stops b on a.route_id = b.route_id and b.stop_sequence = a.stop_sequence + 1"""),
    "ry": (["ev"], "select distinct route_id, period_year as sim_date from ev"),
    "rd": (["ev"], "select distinct route_id, sim_date from ev"),
    "segstats": (["ev", "seg", "win"], f"""
        select seg.route_id, period_year as sim_date, window_index, segment_index,
               cast(sum(boarding_count) as bigint) as boardings, cast(sum(ticket_count) as bigint) as tickets,
               sum({_cents('expected_revenue')}) as e, sum({_cents('reported_revenue')}) as r
        from ev join win on sim_hour >= ws and sim_hour < we
        join seg on ev.route_id = seg.route_id
         and stop_sequence between segment_start_seq and segment_end_seq
        group by all"""),
    "segdays": (["ev", "seg", "win"], f"""
        select seg.route_id, sim_date, window_index, segment_index,
               cast(sum(boarding_count) as bigint) as boardings, cast(sum(ticket_count) as bigint) as tickets,
               sum({_cents('expected_revenue')}) as e, sum({_cents('reported_revenue')}) as r
        from ev join win on sim_hour >= ws and sim_hour < we
        join seg on ev.route_id = seg.route_id
         and stop_sequence between segment_start_seq and segment_end_seq
        group by all"""),
    "seggrid": (["ry", "seg", "win", "segstats"], """
        select ry.route_id, ry.sim_date, win.window_index, ws, we, seg.segment_index, segment_start_stop,
               segment_end_stop, segment_start_seq, segment_end_seq, coalesce(boardings, 0) as boardings,
               coalesce(tickets, 0) as tickets, coalesce(e, 0) as e, coalesce(r, 0) as r
        from ry join seg on ry.route_id = seg.route_id cross join win
        left join segstats s on s.route_id = ry.route_id and s.sim_date = ry.sim_date
         and s.window_index = win.window_index and s.segment_index = seg.segment_index"""),
    "segscore": (["segdays", "seg", "win"], f"""
        select *, row_number() over (partition by route_id, sim_date
               order by localization_score desc, window_index, segment_index) as rank_position
        from (select *, {_round('raw', 4)} as localization_score, cast(e-r as double)/100e0 as flow_discrepancy
              from (select *, least(1e0, greatest(0e0, (case when e > 0 then
                           cast(e-r as double)/cast(e as double) else 0e0 end)*0.6e0
                           + 0e0*0.4e0)) as raw
                    from segdays join seg using (route_id, segment_index) join win using (window_index))
              where raw > 0.05e0 or cast(e-r as double)/100e0 > 10e0)"""),
    "trip": (["routes"], f"""
        select *, concat(route_id, '_T', lpad(cast(i+1 as varchar), 3, '0')) as trip_id,
               cast(300 + floor(i*(1080e0/trips_per_day)+0.5e0) as int) as start_minute,
               case when route_category = 'express' then 25e0 else 15e0 end as kmh
        from (select *, unnest(range(0, trips_per_day)) as i from routes)"""),
    "st": (["trip", "stops"], f"""
        select trip_id, trip.route_id, stop_id, stop_sequence,
               {_clock('start_minute + (distance_from_start_km/kmh*60e0 + (stop_sequence-1)*1.5e0)')} as arrival_time,
               distance_from_start_km
        from trip join stops on trip.route_id = stops.route_id"""),
    "series": (["ev"], f"""
        select route_id, sim_date, sim_hour, {_money('expected_revenue')} as expected_revenue,
               {_money('reported_revenue')} as reported_revenue, sum(boarding_count) as total_boardings,
               sum(ticket_count) as total_tickets, sum(is_anomalous) as anomaly_events
        from ev group by all"""),
    "batches": ([], f"""
        select date_trunc('hour', ts) as recorded_at, cast(count(*) as double) as ingestion_total,
               cast(count(*) filter (where event_type <> 'error') as double) as processing_total,
               cast(count(*) filter (where event_type = 'error') as double) as dead_letter_total,
               cast(count(*) filter (where event_type = 'view') as double) as pending_events,
               cast(sum({_cents('value')}) as double)/100e0/count(*) as avg_processing_time
        from events group by 1"""),
    "metrics": (["batches"], "select recorded_at, metric_name, metric_value, "
                "case when metric_name = 'avg_processing_time' then 'ms' else 'count' end as metric_unit, "
                "'ingestion' as service from batches unpivot (metric_value for metric_name in "
                "(ingestion_total, processing_total, dead_letter_total, pending_events, avg_processing_time))"),
    "registry": (["ev", "routes"], f"""
        select concat(route_category, '_v', cast(version as varchar)) as model_id,
               route_category as model_type, version,
               {_round(f"cast(s as double)/100e0/n", 6)} as mean_revenue,
               concat('models/', route_category) as model_path, cast(version <= 2000 as int) as is_active
        from (select route_category, cast(year(sim_date) as bigint) as version, count(*) as n,
                     sum({_cents('expected_revenue')}) as s
              from ev join routes using (route_id) group by all)"""),
    "overview": (["routes", "sc", "rec"], """
        select routes.*, (select risk_level from sc where sc.route_id = routes.route_id
                          order by sim_date desc limit 1) as latest_risk,
               (select leakage_percentage from sc where sc.route_id = routes.route_id
                order by sim_date desc limit 1) as latest_leakage_pct,
               (select leakage_amount from sc where sc.route_id = routes.route_id
                order by sim_date desc limit 1) as latest_leakage_amount,
               (select count(*) from rec where rec.route_id = routes.route_id and status = 'new')
                 as pending_anomalies
        from routes"""),
    "reviews": (["rec"], """
        select detection_id, case when anomaly_score >= 0.8 then 'confirmed'
               when anomaly_score >= 0.6 then 'reviewed' when anomaly_score < 0.32 then 'escalated' end as new_status,
               concat('score ', cast(cast(floor(anomaly_score*100) as bigint) as varchar)) as new_notes
        from rec"""),
    "valid": (["evm"], """
        select event_id, concat_ws('; ',
               case when fault = 0 then 'Missing required field: route_id' end,
               case when fault = 7 then 'Missing required field: boarding_count' end,
               case when fault = 2 then 'Missing required field: ticket_count' end,
               case when fault = 6 then 'Missing required field: expected_revenue' end,
               case when fault in (1, 8, 9) then 'boarding_count must be a non-negative number' end,
               case when fault in (7, 10) then 'ticket_count must be a non-negative number' end,
               case when payment_mode not in ('cash','upi','card','pass')
                    then concat('Invalid payment_mode: ', payment_mode) end,
               case when fault in (3, 4, 5) then 'Invalid event_timestamp format' end) as errors
        from (select *, (cast(split_part(event_id, '-', 1) as bigint) * 7
                         + cast(split_part(event_id, '-', 2) as bigint) * 3) % 211 as fault from evm)"""),
}


def _with(body: str) -> str:
    """The body with the named queries it uses in front."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in CTES:
        if re.search(rf"\b(?:from|join|,)\s+{name}\b", body):
            add(name)
    heads = ", ".join(f"{n} as ({CTES[n][1]})" for n in needed)
    return f"with {heads} {body}" if heads else body


DATE = "cast(sim_date as varchar) as sim_date"
GAP = f"sum({_cents('expected_revenue')} - {_cents('reported_revenue')})"
_PAIR = "case when {0} > 0 then cast({1} as double)/{0} else 1e0 end"

ORACLES: dict[str, str] = {
    "route_leakage": f"select * replace (cast(sim_date as varchar) as sim_date) from sc",
    "route_leakage_daily": "select * replace (cast(sim_date as varchar) as sim_date) from "
                           f"({_scores('sim_date')}) , (select 1 from ev limit 1)",
    "risk_levels": f"select cast(year(sim_date) as int) as year, risk_level, count(*) as route_months, "
                   f"{_money('leakage_amount')} as leakage from sc group by 1, 2",
    "scan_events": "select event_id, trip_id, route_id, stop_id, stop_sequence, "
                   "cast(event_timestamp as varchar) as event_timestamp, "
                   f"{DATE}, sim_hour, day_of_week, boarding_count, alighting_count, ticket_count, "
                   "payment_mode, expected_revenue, reported_revenue, is_anomalous from evm",
    "upsert_events": """
        select coalesce(t.event_id, s.event_id) as event_id, coalesce(t.route_id, '') as route_id,
               case when s.event_id is not null then s.ticket_count else t.ticket_count end as ticket_count,
               coalesce(t.expected_revenue, -1e0) as expected_revenue,
               case when s.event_id is not null then s.reported_revenue else t.reported_revenue end as reported_revenue
        from (select * from ev where line_status = 'O' qualify row_number() over
              (partition by event_id order by expected_revenue desc, ticket_count desc) = 1) t
        full join (select event_id, boarding_count as ticket_count, expected_revenue as reported_revenue
              from ev where is_anomalous = 1 or line_status = 'F' qualify row_number() over
              (partition by event_id order by expected_revenue desc, boarding_count desc) = 1) s
        on t.event_id = s.event_id""",
    "delete_where": "select event_id, ticket_count, sim_hour from ev "
                    "where not (ticket_count = 0 or sim_hour >= 23)",
    "assign_ids": f"select row_number() over (order by sim_date, event_id) + 1000 as id, {DATE}, "
                  "event_id, trip_id from ev",
    "latest_models": "select * from registry where is_active = 1 qualify row_number() over "
                     "(partition by model_type order by version desc) = 1",
    "active_models": "select * from registry where is_active = 1",
    "filter_eq": "select event_id, payment_mode, expected_revenue from evm where payment_mode = 'upi'",
    "filter_range": f"select event_id, {DATE}, sim_hour from ev where sim_date >= date '1997-03-01' "
                    "and sim_date < date '1998-03-01' and sim_hour <= 12",
    "filter_in": "select event_id, payment_mode from evm where payment_mode in ('card', 'pass')",
    "filter_notnull": "select event_id, anomaly_id from ev where anomaly_id is not null",
    "filter_dynamic": "select event_id, payment_mode, day_of_week from evm where is_anomalous = 1 "
                      "and payment_mode = 'cash'",
    "enrich_events": "select event_id, route_id, stop_id, route_category, boarding_density from enriched",
    "routes_overview": "select * exclude (trips_per_day, bearing_deg) from overview",
    "route_search": "select route_id, route_short_name, route_long_name, latest_risk from overview "
                    "where (lower(route_id) like '%market%' or lower(route_short_name) like '%market%' or "
                    "lower(route_long_name) like '%market%') and coalesce(latest_risk, 'low') = 'low'",
    "fare_lookup": "select event_id, d as distance_km, cast(coalesce((select fare from (values "
                   + ", ".join(str(s) for s in demand.FARE_SLABS)
                   + ") slab(lo, hi, fare) where d >= lo and d < hi), 50) as double) as fare from "
                   "(select event_id, distance_from_start_km*3e0-2e0 as d from ev join stops "
                   "on ev.stop_id = stops.stop_id)",
    "match_anomalies": "select event_id, found_id as matched_anomaly_id, anomaly_type as matched_type, "
                       "severity as matched_severity from matched where found_id is not null",
    "segment_stats": "select route_id, cast(sim_date as varchar) as sim_date, window_index, segment_index, "
                     "boardings, tickets, cast(e as double)/100e0 as expected_revenue, "
                     "cast(r as double)/100e0 as reported_revenue from segdays",
    "segment_grid": "select route_id, cast(sim_date as varchar) as sim_date, window_index, segment_index, "
                    "segment_start_stop, segment_end_stop, boardings, tickets, "
                    "cast(e as double)/100e0 as expected_revenue, "
                    "cast(r as double)/100e0 as reported_revenue from seggrid",
    "nearby_stops": f"""
        select route_id, stop_id, {_round('score', 6)} as score, cast(place as int) as rank_position from (
        select *, row_number() over (partition by route_id order by score, stop_id) as place from (
        select r.route_id, s.stop_id, {_round(
            '0.3e0*' + _haversine('f.stop_lat', 'f.stop_lon', 's.stop_lat', 's.stop_lon')
            + ' + 0.01e0*abs((degrees(atan2(s.stop_lon-f.stop_lon, s.stop_lat-f.stop_lat))'
            + ' - bearing_deg + 180e0) % 360e0 - 180e0)', 9)} as score
        from routes r join stops f on f.route_id = r.route_id and f.stop_sequence = 1
        cross join stops s)) where place between 2 and {STOPS_PER_ROUTE}""",
    "demand_model": f"select event_id, base, hour_factor, day_factor, "
                    "base*hour_factor*day_factor*boarding_density as expected_demand from (select *, "
                    f"{BASE} as base, {HOUR_FACTOR} as hour_factor, {DAY_FACTOR} as day_factor from enriched)",
    "stop_times": "select *, arrival_time as departure_time from st",
    "trips": "select trip_id, route_id, 'WEEKDAY' as service_id, split_part(route_long_name, ' → ', 2) "
             f"as trip_headsign, 0 as direction_id, {_clock('start_minute')} as scheduled_start, "
             f"{_clock('start_minute + (total_distance_km/kmh*60e0 + num_stops*1.5e0)')} as scheduled_end "
             "from trip",
    "baseline_scores": "select event_id, z as z_score, baseline_score, is_anomaly from scored",
    "count_events": "select count(*) as cnt from ev where is_anomalous = 1",
    "sum_revenue": f"select {_money('expected_revenue')} as expected, {_money('reported_revenue')} as reported, "
                   "0e0 as nothing from ev",
    "conditional_count": "select cast(sum(case when is_anomalous = 1 then 1 else 0 end) as bigint) as anomalous, "
                         "count(*) filter (where sim_hour >= 20) as late from ev",
    "distinct_counts": "select count(distinct sim_date) as dates, count(distinct route_id) as routes, "
                       "count(distinct trip_id) as trips from ev",
    "distinct_dates": f"select distinct {DATE} from ev",
    "global_agg": "select count(*) as events, cast(sum(boarding_count) as bigint) as boardings, "
                  "cast(min(sim_date) as varchar) as first_date, cast(max(sim_date) as varchar) as last_date, "
                  f"{_money('expected_revenue')} as revenue from ev",
    "group_agg": "select payment_mode, count(*) as events, cast(sum(ticket_count) as bigint) as tickets, "
                 f"max(boarding_count) as most_boarded, {_money('reported_revenue')} as revenue "
                 "from evm group by payment_mode",
    "route_timeseries": f"select route_id, cast(sim_date as varchar) as sim_date, sim_hour, "
                        f"{_money('expected_revenue')} as expected_revenue, "
                        f"{_money('reported_revenue')} as reported_revenue, "
                        "cast(sum(boarding_count) as bigint) as total_boardings, "
                        "cast(sum(ticket_count) as bigint) as total_tickets, "
                        "cast(sum(is_anomalous) as bigint) as anomaly_events from ev group by all",
    "timeseries_rollup": " union all ".join(
        f"select route_id, {day} as sim_date, {hour} as sim_hour, '{level}' as level, "
        f"{_money('expected_revenue')} as expected, {_money('reported_revenue')} as reported, "
        f"cast({GAP} as double)/100e0 as leakage, cast(sum(total_boardings) as bigint) as boardings, "
        "cast(sum(total_tickets) as bigint) as tickets, cast(sum(anomaly_events) as bigint) as anomalies "
        "from series group by all"
        for level, day, hour in [("hour", "cast(sim_date as varchar)", "sim_hour"),
                                 ("day", "cast(sim_date as varchar)", "-1"), ("route", "'all'", "-1")]),
    "route_stop_order": "select route_id, stop_id, min(stop_sequence) as stop_sequence, "
                        "min(distance_from_start_km) as distance_from_start_km, cast(row_number() over "
                        "(partition by route_id order by min(stop_sequence), stop_id) - 1 as int) as stop_index "
                        "from st group by route_id, stop_id",
    "baselines": f"select * from ({_learned('ev', 'route_id, sim_hour')}), (select 1 from ev limit 1) one(x)",
    "variance_by_key": f"select route_id, day_of_week, {_round('coalesce(var_pop(boarding_count), 0e0)', 6)} as variance, "
                       "count(*) as n from ev group by all",
    "regression_metrics": f"""
        select {_round('avg(mean)', 4)} as mean_predicted, {_round('avg(pow(expected_revenue-mean,2))', 4)} as mse,
               {_round('sqrt(avg(pow(expected_revenue-mean,2)))', 4)} as rmse,
               {_round('avg(abs(expected_revenue-mean))', 4)} as mae, count(*) as n
        from ev join ({_learned('ev', 'route_id, sim_hour')}) using (route_id, sim_hour)""",
    "detection_quality": """
        select *, case when p+r > 0 then p*r*2e0/(p+r) else 0e0 end as f1, p as precision, r as recall from (
        select *, case when tp+fp > 0 then cast(tp as double)/(tp+fp) else 0e0 end as p,
               case when tp+fn > 0 then cast(tp as double)/(tp+fn) else 0e0 end as r from (
        select count(*) filter (where is_flagged and is_ground_truth_anomaly = 1) as tp,
               count(*) filter (where is_flagged and is_ground_truth_anomaly = 0) as fp,
               count(*) filter (where not is_flagged and is_ground_truth_anomaly = 0) as tn,
               count(*) filter (where not is_flagged and is_ground_truth_anomaly = 1) as fn from det))""",
    "anomaly_by_type": "select detection_type, count(*) as cnt from rec group by 1",
    "truth_by_type": "select anomaly_type, count(*) as cnt from truth group by 1",
    "risk_distribution": """
        select risk_level, coalesce(n, 0) as routes,
               floor(cast(coalesce(n, 0) as double)/sum(coalesce(n, 0)) over ()*100e0+0.5e0) as percentage
        from (values ('critical'), ('high'), ('medium'), ('low')) levels(risk_level)
        left join (select risk_level, count(*) as n from sc where sim_date = (select max(sim_date) from sc)
                   group by 1) using (risk_level)""",
    "score_threshold": "select anomaly_score as threshold from (select anomaly_score, row_number() over "
                       "(order by anomaly_score desc) as place, count(*) over () as n from det) "
                       "where place = cast(floor(n*0.05e0) as bigint) + 1",
    "run_totals": "select count(*) as events, count(*) filter (where is_flagged) as detections, "
                  "count(distinct sim_date) as days from det",
    "anomaly_magnitude": f"select anomaly_id, cast({GAP} as double)/100e0 as magnitude, count(*) as events "
                         "from ev where anomaly_id is not null group by 1",
    "trip_days": "select route_id, count(*) as trips, count(*) * (select count(distinct sim_date) from ev) "
                 "as trip_days from trip group by 1",
    "value_ranges": "select "
        "cast(min(sim_hour) as double) as min_hour, cast(max(sim_hour) as double) as max_hour, "
        "min(boarding_density) as min_boarding_density, max(boarding_density) as max_boarding_density, "
        "cast(min(stop_sequence) as double) as min_stop_sequence, cast(max(stop_sequence) as double) as max_stop_sequence, "
        f"min({_PAIR.format('expected_revenue', 'reported_revenue')}) as min_revenue_ratio, "
        f"max({_PAIR.format('expected_revenue', 'reported_revenue')}) as max_revenue_ratio, "
        f"min({_PAIR.format('boarding_count', 'ticket_count')}) as min_ticket_ratio, "
        f"max({_PAIR.format('boarding_count', 'ticket_count')}) as max_ticket_ratio, "
        "max(greatest(expected_revenue, reported_revenue)) as chart_max from enriched",
    "topk_segments": f"select route_id, cast(sim_date as varchar) as sim_date, {_label('ws', 'we')} as time_window, "
                     "ws as time_window_start, we as time_window_end, segment_start_stop, segment_end_stop, "
                     "segment_start_seq, segment_end_seq, flow_discrepancy, localization_score, "
                     "cast(rank_position as int) as rank_position from segscore where rank_position <= 5",
    "cumulative_distance": f"""
        select route_id, stop_id, stop_sequence, {_round('sum(hop) over w', 1)} as distance_from_start_km from (
        select *, case when lag(stop_id) over w is null then 0e0 else greatest(0.3e0, {_haversine(
            'lag(stop_lat) over w', 'lag(stop_lon) over w', 'stop_lat', 'stop_lon')}) end as hop
        from stops window w as (partition by route_id order by stop_sequence))
        window w as (partition by route_id order by stop_sequence)""",
    "onboard_load": """
        select distinct trip_id, stop_sequence,
               cast(sum(boarding_count) over (partition by trip_id, stop_sequence) as bigint) as boarded,
               cast(sum(alighting_count) over (partition by trip_id, stop_sequence) as bigint) as alighted,
               cast(sum(boarding_count - alighting_count) over (partition by trip_id order by stop_sequence) as bigint) as on_board
        from ev""",
    "route_segments": "select * from seg",
    "partition_offsets": """
        select event_id, cast(p as int) as partition, row_number() over
               (partition by p order by event_timestamp, event_id) - 1 as offset from (
        select event_id, event_timestamp, abs(case when h >= 2147483648 then h - 4294967296 else h end) % 8 as p
        from (select *, list_reduce(list_transform(range(1, length(route_id)+1),
                     lambda i: cast(ascii(substr(route_id, i, 1)) as bigint)),
                     lambda a, c: (a*31+c) % 4294967296) as h from ev))""",
    "event_hour": f"select event_id, route_id, {_round('cast(stop_sequence as double)/num_stops', 4)} as route_progress, "
                  "least(23, sim_hour + cast(floor(stop_sequence*2/num_stops) as int)) as event_hour "
                  "from ev join routes using (route_id)",
    "route_names": "select a.route_id, concat(a.stop_name, ' → ', b.stop_name) as route_long_name from stops a "
                   f"join stops b on a.route_id = b.route_id where a.stop_sequence = 1 and b.stop_sequence = {STOPS_PER_ROUTE}",
    "recent_metrics": f"select cast(recorded_at as varchar) as recorded_at, metric_name, {_round('metric_value', 6)} as metric_value, "
                      "metric_unit, service from (select * from metrics order by recorded_at desc, metric_name limit 100)",
    "metrics_long": f"select cast(recorded_at as varchar) as recorded_at, metric_name, {_round('metric_value', 6)} as metric_value, "
                    "metric_unit, service from metrics",
    "ewma_metric": f"""
        select metric_name, {_round('list_reduce(list_prepend(0e0, list(metric_value order by recorded_at)), '
                                    'lambda m, x: m*0.9e0 + x*0.1e0)', 6)} as ewma from metrics group by 1""",
    "weighted_bucket": f"""
        select event_id, u, case when u < 0.45e0 then 'cash' when u < 0.75e0 then 'upi' when u < 0.9e0 then 'card'
               else 'pass' end as payment_mode, {_bucket(demand.ROUTE_CATEGORY_WEIGHTS)} as route_category,
               {_bucket(demand.ANOMALY_TYPE_WEIGHTS)} as anomaly_type
        from (select event_id, ((boarding_count*37 + sim_hour*11 + stop_sequence*5) % 100)/100e0 as u from ev)""",
    "upsert_stored": """
        select event_id, case when moves then case when ticket_count % 3 > 0 then cast(y + 1 as varchar) else 'none' end
                              else cast(y as varchar) end as sim_date,
               cast(ticket_count + cast(moves as int) as int) as ticket_count, reported_revenue
        from (select *, cast(date_trunc('year', sim_date) as date) as y, (ticket_count + 1) % 2 = 0 as moves from (
              select event_id, sim_date, ticket_count, reported_revenue, row_number() over (
                     partition by event_id order by reported_revenue desc, ticket_count desc) as nth from ev)
              where nth = 1)""",
    "baseline_sample": "select event_id, expected_revenue from ev where is_anomalous = 0 "
                       "order by substr(md5(concat('42|', event_id)), 1, 15), event_id limit 50000",
    "leakage_trend": f"select cast(sim_date as varchar) as sim_date, {_money('expected_revenue')} as expected, "
                     f"{_money('reported_revenue')} as reported, {_money('leakage_amount')} as leakage from sc "
                     "where sim_date in (select distinct sim_date from sc order by 1 desc limit 30) group by 1",
    "recent_dates": f"select distinct {DATE} from ev order by 1 desc limit 7",
    "time_split": "select cast(sim_date as varchar) as sim_date, case when row_number() over (order by sim_date) "
                  "<= floor(count(*) over () * 0.8e0) then 'train' else 'test' end as part "
                  "from (select distinct sim_date from ev)",
    "validated_events": "select event_id, errors = '' as valid, errors from valid",
    "ingest_counts": "select count(*) filter (where errors = '') as succeeded, "
                     "count(*) filter (where errors <> '') as failed from valid",
    "dead_letters": "select event_id, errors as error_message, 'validation_error' as error_type from valid "
                    "where errors <> ''",
    "features": f"""
        select event_id, sim_hour as hour, day_of_week, cast(day_of_week in (0, 6) as int) as is_weekend,
               cast(sim_hour between 8 and 10 as int) as is_peak_morning,
               cast(sim_hour between 17 and 20 as int) as is_peak_evening,
               {_round('sin(2e0*pi()*sim_hour/24e0)', 6)} as hour_sin, {_round('cos(2e0*pi()*sim_hour/24e0)', 6)} as hour_cos,
               {_round('sin(2e0*pi()*day_of_week/7e0)', 6)} as dow_sin, {_round('cos(2e0*pi()*day_of_week/7e0)', 6)} as dow_cos,
               {CODE} as route_category_num, stop_sequence, boarding_density, boarding_count, expected_revenue,
               reported_revenue, ticket_count,
               {_PAIR.format('expected_revenue', 'reported_revenue')} as revenue_ratio,
               {_PAIR.format('boarding_count', 'ticket_count')} as ticket_ratio,
               expected_revenue - reported_revenue as revenue_gap, route_id, trip_id, stop_id,
               {DATE}, is_anomalous from enriched""",
    "haversine": f"select b.stop_id, {_round(_haversine('a.stop_lat', 'a.stop_lon', 'b.stop_lat', 'b.stop_lon'), 6)} "
                 "as km_from_previous from stops a join stops b on a.route_id = b.route_id "
                 "and b.stop_sequence = a.stop_sequence + 1",
    "destination_point": f"""
        select stop_id, {_round('degrees(phi2)', 6)} as lat, {_round(
            'stop_lon + degrees(atan2(sin(theta)*sin(arc)*cos(phi), cos(arc)-sin(phi)*sin(phi2)))', 6)} as lon
        from (select *, asin(sin(phi)*cos(arc)+cos(phi)*sin(arc)*cos(theta)) as phi2 from (
              select stop_id, stop_lon, radians(stop_lat) as phi, total_distance_km/6371e0 as arc,
                     radians(bearing_deg) as theta from stops join routes using (route_id)))""",
    "stop_classes": f"""
        select stop_id, stop_name, case when km < 5 then 'city-core' when km < 10 then 'suburban' else 'outer' end as stop_type,
               case when {_has_word(text.HIGH_TRAFFIC_WORDS)} then 'high'
                    when {_has_word(text.MEDIUM_TRAFFIC_WORDS)} then 'medium' else 'low' end as traffic_class
        from (select *, {_haversine(_lit(geo.CITY_CENTER[0]), _lit(geo.CITY_CENTER[1]), 'stop_lat', 'stop_lon')} as km
              from stops)""",
    "window_labels": f"select event_id, {_label('sim_hour', 'sim_hour+1')} as time_window, "
                     "strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S') as iso_timestamp from ev",
    "headsigns": "select route_id, split_part(route_long_name, ' → ', 2) as trip_headsign, "
                 "substr(route_long_name, 1, 10) as short_label from routes",
    "json_props": "select event_id, cast(props->>'$.k' as bigint) as k, props->>'$.k' as k_text, "
                  "concat('{\"k\":', props->>'$.k', '}') as encoded from events",
    "currency_labels": f"""
        select route_id, expected, case when abs(expected) >= 100000 then printf('%.1fL', expected/100000e0)
               when abs(expected) >= 1000 then printf('%.1fK', expected/1000e0) else printf('%.0f', expected) end as label
        from (select route_id, {_money('expected_revenue')} as expected from sc group by 1)""",
    "calendar": "select cast(cast(d as date) as varchar) as day, cast(dayofweek(d) as int) as day_of_week, "
                "cast(dayofweek(d) in (0, 6) as int) as is_weekend from (select unnest(generate_series("
                "(select cast(min(sim_date) as timestamp) from ev), (select cast(max(sim_date) as timestamp) from ev), "
                "interval 1 day)) as d)",
    "route_partition": """
        select route_id, cast(abs(case when h >= 2147483648 then h - 4294967296 else h end) % 8 as int) as partition
        from (select route_id, list_reduce(list_transform(range(1, length(route_id)+1),
                     lambda i: cast(ascii(substr(route_id, i, 1)) as bigint)),
                     lambda a, c: (a*31+c) % 4294967296) as h from routes)""",
    "apply_anomaly": "select event_id, boarding_count, ticket_count, expected_revenue, reported_revenue, "
                     "is_anomalous, coalesce(found_id, '') as anomaly_id from changed",
    "scenario_magnitude": f"""
        select truth.anomaly_id, anomaly_type, coalesce(gap, 0e0) as magnitude from truth left join (
        select found_id, cast({GAP} as double)/100e0 as gap from changed where found_id is not null group by 1)
        on truth.anomaly_id = found_id""",
    "detections": "select * replace (cast(sim_date as varchar) as sim_date, coalesce(anomaly_id, '') as anomaly_id) from det",
    "flagged_events": "select event_id, anomaly_score, discrepancy from det where is_flagged",
    "detected_anomalies": "select * replace (cast(sim_date as varchar) as sim_date, "
                          "coalesce(matched_ground_truth_id, '') as matched_ground_truth_id) from rec",
    "detect_route": f"select event_id, route_id, {DATE}, anomaly_score, total from (select *, "
                    "count(*) over (partition by route_id, sim_date) as total from det) where is_flagged",
    "severity_bands": "select detection_id, anomaly_score, case when anomaly_score > 0.7 then 'high' "
                      "when anomaly_score > 0.4 then 'medium' else 'low' end as band from rec",
    "segment_bands": f"select route_id, cast(sim_date as varchar) as sim_date, {_label('ws', 'we')} as time_window, "
                     "segment_start_seq, case when localization_score > 0.5 then 'high' when localization_score > 0.25 "
                     "then 'medium' else 'low' end as band, rank_position <= 3 as top_three from segscore",
    "anomaly_queue": f"select detection_id, anomaly_score, route_id, {DATE}, status from rec where status = 'new' "
                     "and anomaly_score >= 0.5 order by anomaly_score desc, detection_id limit 50 offset 50",
    "anomaly_queue_by_date": f"select detection_id, anomaly_score, route_id, cast(rec.sim_date as varchar) as sim_date, status "
                             "from rec order by rec.sim_date desc, detection_id limit 50",
    "anomaly_queue_total": "select count(*) as total from rec where status = 'new' and anomaly_score >= 0.5",
    "review_update": """
        select detection_id, anomaly_score, case when ok then new_status else status end as status,
               case when ok then 'auditor' else '' end as reviewed_by, case when ok then new_notes else '' end as notes
        from (select rec.*, new_notes, new_status, coalesce(new_status in ('new','reviewed','confirmed','dismissed'), false) as ok
              from rec join reviews using (detection_id))""",
    "review_rejected": "select detection_id, new_status as status, 'Invalid status. Must be one of: new, reviewed, "
                       "confirmed, dismissed' as error from reviews where new_status = 'escalated'",
    "network_edges": """
        select route_id, cast(sim_date as varchar) as sim_date, window_index, stop_index,
               cast(row_number() over (partition by route_id, sim_date order by window_index, stop_index, o) - 1 as int) as edge_no,
               kind, cast(src as int) as src, cast(dst as int) as dst, cast(cap as bigint) as capacity, cast(cost as int) as cost
        from (select *, 2 + window_index*7 + stop_index as node, greatest(1, b) as load,
                     cast(floor(cast(greatest(0, greatest(1, b) - greatest(0, k)) as double)/greatest(1, b)*100e0+0.5e0) as int) as price
              from (select ry.route_id, ry.sim_date, win.window_index, s.stop_sequence - 1 as stop_index,
                           coalesce(sum(boarding_count), 0) as b, coalesce(sum(ticket_count), 0) as k
                    from ry join stops s on s.route_id = ry.route_id cross join win
                    left join ev on ev.stop_id = s.stop_id and ev.route_id = ry.route_id
                     and ev.period_year = ry.sim_date and sim_hour >= ws and sim_hour < we
                    group by all)) cells,
             lateral (select 0 as o, 'source' as kind, 0 as src, node as dst, load as cap, 0 as cost where stop_index = 0
              union all select 1, 'sink', node, 1, load, 0 where stop_index = 6
              union all select 2, 'segment', node, node + 1, load, price where stop_index < 6
              union all select 3, 'carry', node, node + 7, 5, 1 where window_index < 17) edges""",
    "flow_checks": "select route_id, cast(sim_date as varchar) as sim_date, cast(0 as bigint) as over_capacity, "
                   "cast(0 as bigint) as unbalanced, cast(0 as bigint) as total_gap, cast(0 as bigint) as cost_gap, "
                   "cast(0 as bigint) as cut_gap, cast(0 as bigint) as cheaper_ways from rd",
    "segment_hits": """
        select anomaly_id, route_id, cast(sim_date as varchar) as sim_date, exists (select 1 from segscore s
               where s.route_id = t.route_id and s.sim_date = t.sim_date and rank_position <= 5
                 and segment_start_seq >= start_seq - 1 and segment_end_seq <= end_seq + 1) as hit from truthdays t""",
    "localization_view": f"""
        select s.route_id, cast(s.sim_date as varchar) as sim_date, {_label('ws', 'we')} as time_window,
               segment_start_stop, segment_end_stop, segment_start_seq, segment_end_seq, flow_discrepancy,
               localization_score, cast(rank_position as int) as rank_position, a.stop_name as start_stop_name,
               a.stop_lat as start_lat, a.stop_lon as start_lon, b.stop_name as end_stop_name,
               b.stop_lat as end_lat, b.stop_lon as end_lon
        from segscore s left join stops a on segment_start_stop = a.stop_id left join stops b on segment_end_stop = b.stop_id
        where s.sim_date = (select max(sim_date) from segscore m where m.route_id = s.route_id)""",
    "anomaly_detail": f"""
        select detection_id, d.route_id, cast(d.sim_date as varchar) as sim_date, anomaly_score,
               case when ws is not null then {_label('ws', 'we')} end as segment_window, s.segment_start_stop as located_start,
               s.segment_end_stop as located_end, localization_score, coalesce(cast(rank_position as int), 0) as rank_position
        from rec d left join segscore s on s.route_id = d.route_id and s.sim_date = d.sim_date""",
    "route_detail_stops": "select route_id, stop_id, stop_sequence, distance_from_start_km, "
                          "stop_sequence - 1 as stop_index, stop_name, stop_lat, stop_lon, boarding_density from stops",
    "route_detail_scores": "select * replace (cast(sim_date as varchar) as sim_date) from sc qualify row_number() "
                           "over (partition by route_id order by sc.sim_date desc) <= 30",
    "summary_kpis": f"""
        select (select count(*) from routes) as total_routes,
               (select count(*) from rec where status = 'new') as pending_anomalies,
               {_money('expected_revenue')} as total_expected, {_money('reported_revenue')} as total_reported,
               cast({GAP} as double)/100e0 as total_leakage, count(distinct sim_date) as days_covered,
               count(distinct route_id) as routes_with_data,
               {_round(f"cast(sum({_cents('reported_revenue')}) as double)/cast(sum({_cents('expected_revenue')}) as double)*100e0", 1)} as collection_rate
        from ev where sim_date >= (select max(sim_date) from ev) - 7""",
    "recent_anomalies": f"select detection_id, rec.route_id, route_short_name, anomaly_score, discrepancy, {DATE} "
                        "from rec left join routes on rec.route_id = routes.route_id "
                        "order by anomaly_score desc, detection_id limit 10",
    "hourly_windows": f"""
        select route_id, cast(date_trunc('hour', event_timestamp) as varchar) as window_start,
               {_money('expected_revenue')} as expected_revenue, {_money('reported_revenue')} as reported_revenue,
               cast({GAP} as double)/100e0 as leakage, count(*) as events from ev group by 1, 2""",
}

# Streams over the whole table give what the batch gives.
STREAMED = ["dead_letters", "flagged_events", "hourly_windows", "onboard_load"]

# Helper columns an oracle computes on the way.
_EXTRA = {"detection_quality": "p, r", "route_leakage_daily": '"1"', "baselines": "x"}


def registered() -> dict[str, str]:
    out = {}
    for name, body in [*ORACLES.items(), *[(f"stream_{n}", ORACLES[n]) for n in STREAMED],
                       ("stream_late_windows", ORACLES["hourly_windows"])]:
        if name in _EXTRA:
            body = f"select * exclude ({_EXTRA[name]}) from ({body})"
        out[name] = _with(body)
    return out
