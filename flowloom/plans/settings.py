"""Parameters shared by the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from flowloom.operators.flows import assign_flows, assign_sessions
from flowloom.operators.windows import window_packets
from flowloom.schemas import APPLICATION_CATEGORY, APPLICATIONS
from flowloom.session import tune
from flowloom.sources.packets import event_packets, read_table

# Events of one user are hours apart, so windows are five days long, an exact
# multiple of 4096 bins.
WINDOW = 432_000.0
BIN = 105.46875
MINIMUM = 5
ACTIVITY = 21_600.0
STALE = 432_000.0
MAX_FLOWS = 3
# Short windows for the live capture clock, so that flows come and go.
CLOCK_WINDOW = 21_600.0
CLOCK_STALE = 43_200.0
CLOCK_FLOWS = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table on a session with the library's settings."""
    return read_table(tune(spark), folder, name)


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Events as packets, ordered by event id."""
    return event_packets(table(spark, folder, "events"), numbered=False)


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Flow-assigned packets."""
    return assign_flows(packets(spark, folder))


def in_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Packets in expiring flow sessions."""
    return assign_sessions(packets(spark, folder), STALE)


def windowed(spark: SparkSession, folder: str) -> DataFrame:
    """Flow-assigned packets with their window."""
    return window_packets(assigned(spark, folder), WINDOW)


def as_float(value: Column) -> Column:
    """A double rounded to float precision, as features are stored."""
    return value.cast("float").cast("double")


def float_sql(value: str) -> str:
    """SQL twin of :func:`as_float`."""
    return f"CAST(CAST({value} AS FLOAT) AS DOUBLE)"


_APPS = "[" + ", ".join(f"'{a}'" for a in APPLICATIONS) + "]"
_CATEGORY = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in APPLICATION_CATEGORY.items())

CAPTURE_SQL = f"""(CASE WHEN ((user_id % 40) // 10) % 2 = 1 THEN 'vpn' ELSE 'nonvpn' END)
    || '_' || ({_APPS})[(user_id % 10) + 1] || '_capture' || (user_id % 40)::VARCHAR || '.pcap'"""


def application_sql(name: str) -> str:
    """Application keyword in a well-formed capture name."""
    return f"list_filter({_APPS}, lambda a: contains(lower({name}), a))[1]"


def category_sql(name: str) -> str:
    """Category of a well-formed capture name."""
    return f"(CASE {application_sql(name)} {_CATEGORY} END)"


def labels_sql(name: str) -> str:
    """Label columns parsed from a well-formed capture name."""
    return f"""(CASE WHEN starts_with(lower({name}), 'nonvpn_') THEN 'nonvpn' ELSE 'vpn' END)
        AS vpn_status, {application_sql(name)} AS application, {category_sql(name)} AS category"""


def role_sql(key: str) -> str:
    """SQL twin of the hashed partition of a text key."""
    digits = f"substr(sha256({key}), 1, 2)"
    return f"""(CASE WHEN {digits} < '9a' THEN 'train' WHEN {digits} < 'c0' THEN 'validation'
        WHEN {digits} < 'da' THEN 'calibration' ELSE 'test' END)"""


PACKETS_SQL = f"""events_in AS (
  SELECT *, {CAPTURE_SQL} AS capture_id,
    '10.0.' || (user_id // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR AS client,
    (1024 + user_id % 64511)::INTEGER AS client_port,
    (event_id % 3 <> 1) AS forward
  FROM events),
packets AS (
  SELECT capture_id, event_id AS packet_number, epoch_us(ts) / 1e6 AS sec,
    CASE WHEN forward THEN client ELSE '192.0.2.1' END AS src,
    CASE WHEN forward THEN client_port ELSE 443 END AS sport,
    CASE WHEN forward THEN '192.0.2.1' ELSE client END AS dst,
    CASE WHEN forward THEN 443 ELSE client_port END AS dport,
    CASE WHEN user_id % 2 = 0 THEN 6 ELSE 17 END AS proto,
    40 + CAST(floor(value * 10) AS BIGINT) AS size
  FROM events_in)"""

ASSIGNED_SQL = f"""{PACKETS_SQL},
oriented AS (
  SELECT *, (src < dst OR (src = dst AND sport <= dport)) AS up,
    CASE WHEN src < dst OR (src = dst AND sport <= dport)
      THEN src || '|' || sport || '|' || dst || '|' || dport
      ELSE dst || '|' || dport || '|' || src || '|' || sport END || '|' || proto AS flow_key
  FROM packets),
firsts AS (
  SELECT *, first_value(src) OVER f AS c_src, first_value(sport) OVER f AS c_sport,
    first_value(dst) OVER f AS c_dst, first_value(dport) OVER f AS c_dport,
    min(sec) OVER (PARTITION BY capture_id) AS origin
  FROM oriented
  WINDOW f AS (PARTITION BY capture_id, flow_key ORDER BY packet_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
assigned AS (
  SELECT *, CASE WHEN src = c_src AND sport = c_sport AND dst = c_dst AND dport = c_dport
      THEN 1 ELSE 0 END AS direction,
    substr(sha256(capture_id || chr(0) || c_src || chr(0) || c_sport || chr(0) || c_dst
      || chr(0) || c_dport || chr(0) || proto), 1, 24) AS flow_id
  FROM firsts)"""

WINDOWED_SQL = f"""{ASSIGNED_SQL},
indexed AS (
  SELECT *, CAST(floor((sec - origin) / {WINDOW}::DOUBLE) AS BIGINT) AS window_index
  FROM assigned),
windowed AS (
  SELECT *, (sec - origin) - window_index * {WINDOW}::DOUBLE AS off FROM indexed)"""

def sessions_sql(stale: float) -> str:
    """Packets in flow sessions that end after ``stale`` idle seconds."""
    return f"""{PACKETS_SQL},
oriented AS (
  SELECT *,
    CASE WHEN src < dst OR (src = dst AND sport <= dport)
      THEN src || '|' || sport || '|' || dst || '|' || dport
      ELSE dst || '|' || dport || '|' || src || '|' || sport END || '|' || proto AS flow_key
  FROM packets),
opened AS (
  SELECT *, CASE WHEN sec - lag(sec) OVER f < {stale}::DOUBLE THEN 0 ELSE 1 END AS opens
  FROM oriented WINDOW f AS (PARTITION BY capture_id, flow_key ORDER BY packet_number)),
numbered AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY capture_id, flow_key ORDER BY packet_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM opened),
in_sessions AS (
  SELECT *, first_value(src) OVER s AS c_src, first_value(sport) OVER s AS c_sport,
    first_value(dst) OVER s AS c_dst, first_value(dport) OVER s AS c_dport
  FROM numbered
  WINDOW s AS (PARTITION BY capture_id, flow_key, session ORDER BY packet_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sessions AS (
  SELECT capture_id, flow_key, session, min(packet_number) AS first_packet,
    min(sec) AS first_seconds, max(sec) AS last_seconds, count(*) AS packet_count,
    any_value(c_src) AS src, any_value(c_sport) AS sport, any_value(c_dst) AS dst,
    any_value(c_dport) AS dport, any_value(proto) AS proto
  FROM in_sessions GROUP BY capture_id, flow_key, session)"""


SESSIONS_SQL = sessions_sql(STALE)
CLOCK_SESSIONS_SQL = sessions_sql(CLOCK_STALE)
