"""Canonical table layouts as DDL text: logs, long metric rows, spans, errors, raw events."""

from __future__ import annotations

_LOG_BODY = """
cloud STRUCT<provider STRING, region STRING, account STRUCT<id STRING, name STRING>,
             service STRUCT<name STRING>>,
event STRUCT<action STRING, outcome STRING, category {category}, type {category}, kind STRING,
             dataset STRING, provider STRING, module STRING, severity DOUBLE, duration DOUBLE>,
log STRUCT<level STRING>, message STRING,
service STRUCT<name STRING, type STRING>, ecs STRUCT<version STRING>,
data_stream STRUCT<type STRING, dataset STRING, namespace STRING>,
agent STRUCT<type STRING, version STRING, name STRING, id STRING, ephemeral_id STRING>,
input STRUCT<type STRING>, host STRUCT<name STRING, hostname STRING>,
error STRUCT<code STRING, message STRING, type STRING>,
source STRUCT<ip STRING, port INT, geo STRUCT<country_iso_code STRING, country_name STRING,
              city_name STRING, location STRUCT<lat DOUBLE, lon DOUBLE>>>,
destination STRUCT<ip STRING, port INT>,
network STRUCT<transport STRING, bytes BIGINT, packets BIGINT, direction STRING>,
http STRUCT<request STRUCT<method STRING>, response STRUCT<status_code INT>>,
dns STRUCT<question STRUCT<name STRING, type STRING>, response_code STRING>,
user STRUCT<name STRING>, user_agent STRUCT<original STRING>,
kubernetes STRUCT<namespace STRING>, container STRUCT<image STRUCT<name STRING>>,
threat STRUCT<tactic STRUCT<id STRING, name STRING>, technique STRUCT<id STRING, name STRING>>,
rule STRUCT<id STRING, name STRING, section STRING>, result STRUCT<evaluation STRING>,
telemetry STRUCT<sdk STRUCT<name STRING, language STRING, version STRING>,
                 distro STRUCT<name STRING, version STRING>>,
aws VARIANT, __dataset STRING
"""

# What the JSON reader is asked for: the list-or-scalar fields stay VARIANT until normalised.
RAW_LOG = "`@timestamp` STRING, " + _LOG_BODY.format(category="VARIANT")
LOG = "ts TIMESTAMP, " + _LOG_BODY.format(category="ARRAY<STRING>")

METRIC = """ts TIMESTAMP, dataset STRING, metricset STRING, period_ms BIGINT, region STRING,
       account_id STRING, dimensions MAP<STRING,STRING>, metric STRING,
       avg DOUBLE, sum DOUBLE, count BIGINT, max DOUBLE, min DOUBLE"""

RAW_METRIC = """`@timestamp` STRING, cloud STRUCT<region STRING, account STRUCT<id STRING>>,
       data_stream STRUCT<dataset STRING>, event STRUCT<dataset STRING>,
       metricset STRUCT<name STRING, period BIGINT>, aws VARIANT, __dataset STRING"""

SPAN = """ts TIMESTAMP, trace_id STRING, id STRING, parent_id STRING, transaction_id STRING,
       kind STRING, name STRING, type STRING, subtype STRING, action STRING, duration_us BIGINT,
       outcome STRING, service_name STRING, environment STRING, language STRING, region STRING,
       account_id STRING, destination STRING, span_started INT, sampled BOOLEAN,
       coldstart BOOLEAN, distro STRING, labels MAP<STRING,STRING>"""

ERROR = """ts TIMESTAMP, error_id STRING, trace_id STRING, transaction_id STRING, parent_id STRING,
       service_name STRING, grouping_key STRING, culprit STRING,
       exception ARRAY<STRUCT<type STRING, message STRING, handled BOOLEAN,
         stacktrace ARRAY<STRUCT<`function` STRING, filename STRING, lineno INT,
                                 library_frame BOOLEAN>>>>"""

SUBSCRIPTION = "log_group STRING, log_stream STRING, ts TIMESTAMP, message STRING"
