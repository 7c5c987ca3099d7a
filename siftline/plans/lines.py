"""Raw device lines derived from the ``events`` table, in Spark and in SQL.

Both dialects share one text; only the string type and two date formats differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.operators.parse import ParseRule

TEMPLATE = """
  SELECT line_id, ingest_time, source_addr, shape,
    CASE shape
     WHEN 0 THEN concat('<134>', t, ' fw Sangfor: src=', s, ' dst=', d, ' sport=', sp, ' dport=', dp, ' proto=', pr, ' action=', ac, ' severity=info')
     WHEN 1 THEN concat(t, ' localhost nat: 日志类型:NAT日志, NAT类型:', ac, ', 源IP:', s, ', 源端口:', sp, ', 目的IP:', d, ', 目的端口:', dp, ', 协议:', pr)
     WHEN 2 THEN concat('src=', s, ' dst=', d, ' sport=', sp, ' dport=', dp, ' proto=', pr, ' action=', ac)
     WHEN 3 THEN concat(dy, 'T10:00:00Z dev-3 [firewall] ', s, ' -> ', d, ' DROP')
     WHEN 4 THEN concat('src=', s, ' dst=', d, ' actName=', ac)
     WHEN 5 THEN concat('src=', s, ' proto=', pr)
     WHEN 6 THEN concat('this is not a valid firewall log ', sp)
     ELSE concat('date=', dy, ' src="', s, '" dst="', d, '" sport=99999 proto="', pr, '" action="', ac, '"')
    END AS raw
  FROM (
    SELECT event_id AS line_id, ts AS ingest_time,
      CASE WHEN event_id % 16 = 15 THEN 'not a uri'
           WHEN user_id % 2 = 0 THEN concat('udp://10.0.0.', CAST(user_id % 8 + 1 AS {S}), ':514')
           ELSE concat('tcp://10.0.0.', CAST(user_id % 8 + 1 AS {S}), ':1514') END AS source_addr,
      concat('192.168.', CAST(user_id % 256 AS {S}), '.', CAST(event_id % 250 + 1 AS {S})) AS s,
      CASE event_id % 4 WHEN 0 THEN '8.8.8.8'
           WHEN 1 THEN concat('172.18.', CAST(event_id % 128 AS {S}), '.9')
           WHEN 2 THEN concat('2.61.44.', CAST(event_id % 200 + 1 AS {S}))
           ELSE concat('211.120.49.', CAST(event_id % 200 + 1 AS {S})) END AS d,
      CAST(1024 + event_id % 60000 AS {S}) AS sp,
      CASE event_id % 4 WHEN 0 THEN '53' WHEN 1 THEN '443' WHEN 2 THEN '80' ELSE '22' END AS dp,
      CASE event_id % 5 WHEN 0 THEN '17' WHEN 1 THEN '6' WHEN 2 THEN 'TCP' WHEN 3 THEN 'udp' ELSE '1' END AS pr,
      CASE event_type WHEN 'error' THEN 'deny' WHEN 'purchase' THEN 'snat' WHEN 'signup' THEN 'dnat' ELSE 'allow' END AS ac,
      {syslog} AS t, {iso} AS dy, event_id % 8 AS shape
    FROM {events})
"""
DUCKDB_LINES = TEMPLATE.format(S="VARCHAR", syslog="strftime(ts, '%b %d %H:%M:%S')", iso="strftime(ts, '%Y-%m-%d')", events="events")
#: lines that a task parses
TASK_LINES = 100_000
ARROW_PATTERN = r"^[^ ]+ ([^ ]+) \[firewall\] ([0-9.]+) -> ([0-9.]+) ([A-Z]+)"
ARROW = ParseRule(
    "ArrowLine",
    10,
    r"^[^ ]+ (?P<dev>[^ ]+) \[firewall\] (?P<src>[0-9.]+) -> (?P<dst>[0-9.]+) (?P<act>[A-Z]+)",
    [("device_id", "dev", None), ("src_ip", "src", None), ("dst_ip", "dst", None), ("action", "act", None)],
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, ingest_time, source_addr, shape, raw."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    # parsing is all the work there is: a table of few files goes to all cores, a large one
    # in tasks that stay short however large it is; the rows are counted from its footers
    tasks = max(spark.sparkContext.defaultParallelism, -(-table.count() // TASK_LINES))
    if table.rdd.getNumPartitions() < tasks:
        table = table.repartition(tasks)
    table.createOrReplaceTempView("_siftline_events")
    sql = TEMPLATE.format(S="STRING", syslog="date_format(ts, 'MMM dd HH:mm:ss')", iso="date_format(ts, 'yyyy-MM-dd')", events="_siftline_events")
    found = spark.sql(sql)
    return found.withColumn("ingest_time", found["ingest_time"].cast("timestamp"))
