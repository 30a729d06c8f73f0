"""Transit tables derived from a folder of TPC-H-like parquet files.

Every derived column is one SQL text that Spark and an ANSI engine evaluate
alike; a few date functions and the timestamp type differ by name and are
filled in per engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.functions.demand import FARE_SLABS
from leakscope.functions.numeric import cents

SPARK = {"dow": "dayofweek({0}) - 1", "month": "trunc({0}, 'MM')", "year": "trunc({0}, 'YEAR')",
         "ts": "timestamp_ntz"}
ANSI = {"dow": "dayofweek({0})", "month": "cast(date_trunc('month', {0}) as date)",
        "year": "cast(date_trunc('year', {0}) as date)", "ts": "timestamp"}

# Declared, so that no job has to read file footers for them.
SOURCE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string"}

STOPS_PER_ROUTE = 7
ROUTE_NUMBER = "cast(substring(route_id, 2) as bigint)"


def cents_text(x: str) -> str:
    return f"floor(({x})*100e0+0.5e0)/100e0"


def route_text(key: str) -> str:
    return f"concat('R', lpad(cast({key} as string), 9, '0'))"


ANOMALOUS = "case when l_returnflag = 'R' and l_discount >= 0.08e0 then 1 else 0 end"
HOUR = "cast(5 + (l_orderkey * 7 + l_linenumber) % 19 as int)"
MINUTE = "cast((l_partkey * 13 + l_linenumber * 7) % 60 as int)"
SIM_DATE = "cast(l_shipdate as date)"
EXPECTED = cents_text("l_extendedprice/100e0")
SHORTFALL = (f"case when {ANOMALOUS} = 1 then 0.3e0 + 4e0*l_discount else 0.2e0*l_discount end")
TICKET_SHORTFALL = f"case when {ANOMALOUS} = 1 then 0.3e0 + 4e0*l_discount else 0e0 end"
REPORTED = cents_text(f"({EXPECTED})*(1e0 - ({SHORTFALL}))")
STAMP = (f"concat(cast({SIM_DATE} as string), 'T', lpad(cast({HOUR} as string), 2, '0'), ':', "
         f"lpad(cast({MINUTE} as string), 2, '0'), ':00')")

# name, expression over lineitem
EVENT_COLUMNS = [
    ("event_id", "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', "
                 "cast(l_partkey as string), '-', cast(l_suppkey as string))"),
    ("trip_id", "concat('T', cast(l_orderkey as string))"),
    ("route_id", route_text("l_suppkey")),
    ("stop_id", f"concat({route_text('l_suppkey')}, '_S', cast(l_linenumber as string))"),
    ("stop_sequence", "cast(l_linenumber as int)"),
    ("event_timestamp", f"cast({STAMP} as {{ts}})"),
    ("sim_date", SIM_DATE),
    ("sim_hour", HOUR),
    ("day_of_week", f"cast({{dow:{SIM_DATE}}} as int)"),
    ("boarding_count", "cast(l_quantity as int)"),
    ("alighting_count", "cast(floor(l_quantity * l_tax * 10e0) as int)"),
    ("ticket_count", f"cast(floor(cast(l_quantity as int) * (1e0 - ({TICKET_SHORTFALL}))) as int)"),
    ("expected_revenue", EXPECTED),
    ("reported_revenue", REPORTED),
    ("is_anomalous", ANOMALOUS),
    ("anomaly_id", f"case when {ANOMALOUS} = 1 then concat('A-', {route_text('l_suppkey')}, '-', "
                   f"cast(year({SIM_DATE}) as string)) end"),
    ("line_status", "l_linestatus"),
    ("period", f"{{month:{SIM_DATE}}}"),
    ("period_year", f"{{year:{SIM_DATE}}}"),
]
# Faults of events as they arrive, by the last digits of a number: field, number, text.
FAULT = "(l_orderkey * 7 + l_linenumber * 3) % 211"
FAULTS = [("route_id", 0, "null"), ("boarding_count", 1, "'-1'"), ("ticket_count", 2, "null"),
          ("event_timestamp", 3, "'not a date'"), ("event_timestamp", 4, "''"), ("event_timestamp", 5, "'10:00'"),
          ("expected_revenue", 6, "null"), ("ticket_count", 7, "'-2'"), ("boarding_count", 7, "null"),
          ("boarding_count", 8, "'1000000000000'"), ("boarding_count", 9, "'NaN'"), ("ticket_count", 10, "'2.7'")]
# from orders: the fifth mode is not a known one and feeds the dead letters
PAYMENT_MODE = ("case o_orderpriority when '1-URGENT' then 'cash' when '2-HIGH' then 'upi' "
                "when '3-MEDIUM' then 'card' when '5-LOW' then 'pass' else 'voucher' end")

CATEGORY = ("case s_nationkey % 5 when 0 then 'city-core' when 1 then 'suburban' when 2 then 'feeder' "
            "when 3 then 'express' else 'outer' end")
STOP_LABEL = ("concat(case (s_suppkey + {seq}) % 6 when 0 then 'Old Market' when 1 then 'Ring Road' "
              "when 2 then 'Lake View' when 3 then 'Tech Park' when 4 then 'Garden Layout' "
              "else 'Temple' end, ' ', cast(s_suppkey as string), '-', cast({seq} as string))")
ROUTE_COLUMNS = [
    ("route_id", route_text("s_suppkey")),
    ("route_short_name", "concat('K', cast(s_suppkey as string))"),
    ("route_long_name", f"concat({STOP_LABEL.format(seq='1')}, ' → ', "
                        f"{STOP_LABEL.format(seq=str(STOPS_PER_ROUTE))})"),
    ("route_type", "3"),
    ("route_category", CATEGORY),
    ("total_distance_km", "cast(4 + (s_suppkey * 13) % 400 as double)/10e0"),
    ("num_stops", str(STOPS_PER_ROUTE)),
    ("trips_per_day", "cast(6 + s_suppkey % 11 as int)"),
    ("bearing_deg", "cast((s_suppkey * 29) % 360 as double)"),
]
STOP_COLUMNS = [
    ("stop_id", f"concat({route_text('s_suppkey')}, '_S', cast(seq as string))"),
    ("route_id", route_text("s_suppkey")),
    ("stop_sequence", "cast(seq as int)"),
    ("stop_name", STOP_LABEL.format(seq="seq")),
    ("stop_lat", "12.85e0 + ((s_suppkey*37 + seq*11) % 250)/1000e0"),
    ("stop_lon", "77.45e0 + ((s_suppkey*53 + seq*17) % 300)/1000e0"),
    ("boarding_density", "0.5e0 + ((s_suppkey*7 + seq) % 7)*0.5e0"),
    ("distance_from_start_km", "cast((seq - 1) * (5 + s_suppkey % 30) as double)/10e0"),
]


def render(expression: str, engine: dict[str, str]) -> str:
    """Fill in the engine's own names: {ts}, and {dow:x}, {month:x}, {year:x} for a date x."""
    return re.sub(r"\{(\w+):?([^{}]*)\}", lambda m: engine[m[1]].format(m[2]), expression)


class TransitTables:
    """The transit tables of one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _columns(columns) -> list[str]:
        return [f"{render(text, SPARK)} as {name}" for name, text in columns]

    @cached_property
    def events(self) -> DataFrame:
        """Ticketing events without the payment mode: a scan of one table."""
        return self.table("lineitem").selectExpr(*self._columns(EVENT_COLUMNS))

    def _with_modes(self, lines: DataFrame | None = None) -> DataFrame:
        modes = self.table("orders").selectExpr(
            "o_orderkey", f"{PAYMENT_MODE} as payment_mode")
        rows = self.table("lineitem") if lines is None else lines
        return rows.join(modes, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    @cached_property
    def events_with_mode(self) -> DataFrame:
        """Ticketing events with the payment mode, which another table holds."""
        return self._with_modes().selectExpr(*self._columns(EVENT_COLUMNS), "payment_mode")

    @cached_property
    def raw_events(self) -> DataFrame:
        """Events as they arrive: text for the timestamp and the counts, some fields missing or wrong."""
        return self._raw(self._with_modes())

    def _raw(self, lines: DataFrame) -> DataFrame:
        def sent(name: str, text: str) -> str:
            text = STAMP if name == "event_timestamp" else text
            if name in ("boarding_count", "ticket_count"):
                text = f"cast({text} as string)"
            cases = " ".join(f"when {number} then {value}" for field, number, value in FAULTS if field == name)
            return f"case {FAULT} {cases} else {text} end" if cases else text

        columns = [(n, sent(n, x)) for n, x in EVENT_COLUMNS]
        df = lines.selectExpr(*self._columns(columns), "payment_mode")
        return df.select(*[f.name for f in schemas.RAW_EVENTS.fields])

    @cached_property
    def line_stream(self) -> DataFrame:
        # a pattern, because a stream takes a plain path for a folder
        return (self.spark.readStream.schema(SOURCE_SCHEMAS["lineitem"])
                .parquet(f"{self.dir}/lineitem.parque[t]"))

    @cached_property
    def event_stream(self) -> DataFrame:
        return self.line_stream.selectExpr(*self._columns(EVENT_COLUMNS))

    @cached_property
    def raw_event_stream(self) -> DataFrame:
        return self._raw(self._with_modes(self.line_stream))

    @cached_property
    def routes(self) -> DataFrame:
        return self.table("supplier").selectExpr(*self._columns(ROUTE_COLUMNS))

    @cached_property
    def stops(self) -> DataFrame:
        """Stops, with the route and position each one serves."""
        return (self.table("supplier")
                .selectExpr("*", f"explode(sequence(1, {STOPS_PER_ROUTE})) as seq")
                .selectExpr(*self._columns(STOP_COLUMNS)))

    @cached_property
    def fare_slabs(self) -> DataFrame:
        rows = [(float(lo), float(hi), fare, "ordinary") for lo, hi, fare in FARE_SLABS]
        return self.spark.createDataFrame(
            rows, "min_distance_km double, max_distance_km double, fare_amount int, fare_type string"
        ).withColumn("fare_amount", F.col("fare_amount").cast("decimal(10,2)"))

    @cached_property
    def truth(self) -> DataFrame:
        """Labelled anomalies per route and year."""
        return self._labelled("period_year", "cast(year(period_year) as string)")

    @cached_property
    def truth_days(self) -> DataFrame:
        """Labelled anomalies per route and day."""
        return self._labelled("sim_date", "cast(sim_date as string)")

    def _labelled(self, period: str, name: str) -> DataFrame:
        """The stop position with the largest loss in a period, and the stretch from
        there to the second largest."""
        gap = cents("expected_revenue") - cents("reported_revenue")
        losses = (self.events.filter("is_anomalous = 1")
                  .groupBy("route_id", period, "stop_sequence")
                  .agg(F.sum(gap).alias("gap"), F.min("sim_hour").alias("first_hour"),
                       F.max("sim_hour").alias("last_hour")))
        by_gap = W.partitionBy("route_id", period).orderBy(F.desc("gap"), "stop_sequence")
        ranked = (losses.withColumn("place", F.row_number().over(by_gap))
                  .withColumn("other", F.lag("stop_sequence").over(by_gap))
                  .filter("place <= 2"))
        return ranked.selectExpr(
            "concat(case place when 1 then 'A' else 'B' end, '-', route_id, '-', "
            f"{name}) as anomaly_id",
            f"case {ROUTE_NUMBER} % 4 when 0 then 'under_reporting' when 1 then 'ghost_trip' "
            "when 2 then 'qr_upi_fraud' else 'fare_evasion_cluster' end as anomaly_type",
            "route_id", "least(stop_sequence, coalesce(other, stop_sequence)) as start_stop_sequence",
            "greatest(stop_sequence, coalesce(other, stop_sequence)) as end_stop_sequence",
            "first_hour as time_window_start", "last_hour as time_window_end",
            f"{period} as sim_date",
            f"{cents_text(f'0.3e0 + ({ROUTE_NUMBER} % 8)*0.05e0')} as severity",
            "cast(gap as double)/100e0 as magnitude"
        ).selectExpr(
            "*", "concat(route_id, '_S', start_stop_sequence) as start_stop_id",
            "concat(route_id, '_S', end_stop_sequence) as end_stop_id",
            "concat(anomaly_type, ' on route ', route_id, ', stops ', start_stop_sequence, '-', "
            "end_stop_sequence) as description")

    @cached_property
    def batches(self) -> DataFrame:
        """Health figures of the event stream, one row per hour of the events table."""
        return (self.table("events")
                .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("recorded_at"))
                .agg(F.count("*").cast("double").alias("ingestion_total"),
                     F.count_if(F.col("event_type") != "error").cast("double")
                     .alias("processing_total"),
                     F.count_if(F.col("event_type") == "error").cast("double")
                     .alias("dead_letter_total"),
                     F.count_if(F.col("event_type") == "view").cast("double")
                     .alias("pending_events"),
                     (F.sum(cents("value")).cast("double") / 100.0 / F.count("*"))
                     .alias("avg_processing_time")))

    @cached_property
    def model_registry(self) -> DataFrame:
        """One model per route category and year, with the spread of its revenue as metric."""
        years = (self.events.groupBy("route_id", F.year("sim_date").cast("bigint").alias("version"))
                 .agg(F.count("*").alias("_n"),
                      F.sum(cents("expected_revenue")).alias("_sum")))
        per_type = (years.join(self.routes.select("route_id", "route_category"), "route_id")
                    .groupBy(F.col("route_category").alias("model_type"), "version")
                    .agg((F.sum("_sum").cast("double") / 100.0 / F.sum("_n")).alias("mean_revenue")))
        return per_type.select(
            F.concat("model_type", F.lit("_v"), F.col("version").cast("string")).alias("model_id"),
            "model_type", "version", "mean_revenue",
            F.concat(F.lit("models/"), "model_type").alias("model_path"),
            (F.col("version") <= 2000).cast("int").alias("is_active"))
