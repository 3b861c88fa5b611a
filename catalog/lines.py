"""Log lines derived from the ``events`` table, once per SQL dialect.

The given tables hold no log text. One SELECT turns every event into a line of one of five
layouts; only the date function differs between the engines.
"""

_TEMPLATE = """
SELECT event_id AS seq, ts AS event_ts, ip, event_type, CASE event_id % 5
 WHEN 0 THEN {S} || ' web01 sshd[' || CAST(event_id AS STRING) || ']: ' || msg
 WHEN 1 THEN ip || ' - - [' || {A} || ' +0000] "GET /' || event_type || ' HTTP/1.1" ' || st || ' ' || CAST(user_id AS STRING)
 WHEN 2 THEN {W} || ' EventID=' || eid
   || CASE WHEN user_id % 3 = 0 THEN '' ELSE ' User=CORP' || chr(92) || 'u' || CAST(user_id AS STRING) END
   || CASE WHEN user_id % 4 = 0 THEN '' ELSE ' Source=' || ip END || ' Message=' || msg
 WHEN 3 THEN '{{"' || CASE WHEN user_id % 2 = 0 THEN 'timestamp' ELSE '@timestamp' END || '":"' || {I}
   || '","level":"' || lvl || '","src_ip":"' || ip || '","msg":"' || msg || '"}}'
 ELSE 'free text ' || msg END AS line
FROM (SELECT *,
   CASE event_type WHEN 'error' THEN 'Failed password for invalid user admin from ' || ip || ' port 22 ssh2'
     WHEN 'purchase' THEN 'SQL injection attempt union select from ' || ip
     WHEN 'signup' THEN 'Accepted password for root from ' || ip
     WHEN 'click' THEN 'powershell.exe -enc SQBFAFgA on ' || ip ELSE 'session opened for ' || ip END AS msg,
   CASE event_type WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4688' WHEN 'signup' THEN '4698' WHEN 'click' THEN '1102' ELSE '5156' END AS eid,
   CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '403' WHEN 'signup' THEN '401' WHEN 'click' THEN '404' ELSE '200' END AS st,
   CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'critical' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'info' END AS lvl
  FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN '195.178.55.' WHEN user_id % 7 = 0 THEN '185.220.101.'
                       ELSE '10.0.0.' END || CAST(user_id % 250 + 1 AS STRING) AS ip FROM {events}) e1) e2
"""


def spark_lines_sql(events: str, *kept: str) -> str:
    """The SELECT in Spark SQL over a table or view name; columns of it that are ``kept`` come first."""
    return _TEMPLATE.replace("SELECT ", "".join(["SELECT ", *[f"{name}, " for name in kept]]), 1).format(
        S="date_format(ts,'MMM d HH:mm:ss')",
        A="date_format(ts,'dd/MMM/yyyy:HH:mm:ss')",
        W="date_format(ts,'yyyy-MM-dd HH:mm:ss')",
        I="date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
        events=events,
    )


def duck_lines_sql(events: str = "events") -> str:
    """The SELECT in DuckDB SQL."""
    return _TEMPLATE.format(
        S="strftime(ts,'%b %-d %H:%M:%S')",
        A="strftime(ts,'%d/%b/%Y:%H:%M:%S')",
        W="strftime(ts,'%Y-%m-%d %H:%M:%S')",
        I="strftime(ts,'%Y-%m-%dT%H:%M:%SZ')",
        events=events,
    )
