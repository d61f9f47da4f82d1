"""Queries of problems 1, 2, 3 and 5, with their SQL where SQL can say it."""

from __future__ import annotations

from skyledger.operators.regular_grid import telemetry_grid, unobserved_cells
from skyledger.operators.rejects import loaded_lines, rejected_lines
from skyledger.operators.schema_drift import consistent_records, migration_steps, schema_changes, schema_registry
from skyledger.operators.spikes import implausible_telemetry
from skyledger.tables import table

QUERIES = {
    "p1_found": lambda s, d: implausible_telemetry(table(s, d, "telemetry"), table(s, d, "fused_pose")),
    "p2_found": lambda s, d: unobserved_cells(table(s, d, "telemetry"), table(s, d, "log_formats")),
    "p2_grid": lambda s, d: telemetry_grid(table(s, d, "telemetry"), table(s, d, "log_formats")),
    "p3_found": lambda s, d: rejected_lines(table(s, d, "raw_lines")),
    "p3_loaded": lambda s, d: loaded_lines(table(s, d, "raw_lines")),
    "p5_found": lambda s, d: schema_changes(table(s, d, "log_files"), table(s, d, "log_records")),
    "p5_records": lambda s, d: consistent_records(table(s, d, "log_files"), table(s, d, "log_records")),
    "p5_steps": lambda s, d: migration_steps(table(s, d, "log_files"), table(s, d, "log_records")),
    "p5_registry": lambda s, d: schema_registry(table(s, d, "log_files"), table(s, d, "log_records")),
}

# What each name in the test files means. The operator has no such list; it is the SQL's own.
_NAMES = """
  ('t_sec', 't_sec'), ('elapsed_s', 't_sec'), ('seconds', 't_sec'), ('time_sec', 't_sec'), ('time_s', 't_sec'),
  ('lat', 'lat'), ('latitude', 'lat'), ('gps_lat', 'lat'), ('OSD.latitude', 'lat'),
  ('lon', 'lon'), ('longitude', 'lon'), ('gps_lon', 'lon'), ('OSD.longitude', 'lon'),
  ('height_m', 'height_m'), ('rel_alt', 'height_m'), ('OSD.height [m]', 'height_m'), ('height_above_takeoff(meters)', 'height_m'),
  ('yaw_deg', 'yaw_deg'), ('yaw', 'yaw_deg'), ('heading', 'yaw_deg'), ('GIMBAL.yaw', 'yaw_deg'), ('gimbal_heading(degrees)', 'yaw_deg'),
  ('pitch_deg', 'pitch_deg'), ('pitch', 'pitch_deg'), ('GIMBAL.pitch', 'pitch_deg'), ('gimbal_pitch(degrees)', 'pitch_deg'),
  ('roll_deg', 'roll_deg'), ('roll', 'roll_deg'), ('GIMBAL.roll', 'roll_deg'), ('gimbal_roll(degrees)', 'roll_deg'),
  ('is_video', 'is_video'), ('isVideo', 'is_video'), ('recording', 'is_video'), ('CUSTOM.isVideo', 'is_video'),
  ('format_detected', 'format_detected'), ('detected_format', 'format_detected'), ('log_format', 'format_detected'),
  ('focal_len_mm', 'focal_len_mm'), ('focal_len', 'focal_len_mm'), ('focal_length', 'focal_len_mm'), ('FOCAL [mm]', 'focal_len_mm'),
  ('battery_pct', 'battery_pct'),
  ('satellites', 'satellites'),
  ('iso', 'iso'),
  ('fnum', 'fnum'),
  ('shutter_s', 'shutter_s')"""

_LINES = r"""
WITH l AS (SELECT DISTINCT file_id, line_no, regexp_replace(replace(coalesce(line_text, ''), chr(0), ''), '\r$', '') AS txt FROM raw_lines),
c AS (SELECT *, regexp_full_match(txt, '(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)(?:,(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*))*') AS quoted,
      list_transform(regexp_extract_all(',' || txt, ',([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)', 1),
        lambda x: CASE WHEN trim(x, ' ' || chr(9)) LIKE '"%' THEN trim(replace(substr(trim(x, ' ' || chr(9)), 2, length(trim(x, ' ' || chr(9))) - 2), '""', '"'), ' ' || chr(9)) ELSE trim(x, ' ' || chr(9)) END) AS cells FROM l),
h AS (SELECT file_id, cells AS names FROM c WHERE line_no = 1),
j AS (SELECT c.file_id, c.line_no, c.quoted, c.cells, h.names,
      c.cells[list_position(h.names, CASE WHEN list_contains(h.names, 'CUSTOM.updateTime') THEN 'CUSTOM.updateTime' ELSE 'datetime(utc)' END)] AS tm,
      c.cells[list_position(h.names, CASE WHEN list_contains(h.names, 'CUSTOM.updateTime') THEN 'OSD.latitude' ELSE 'latitude' END)] AS lat,
      c.cells[list_position(h.names, CASE WHEN list_contains(h.names, 'CUSTOM.updateTime') THEN 'CUSTOM.isVideo' ELSE 'isVideo' END)] AS vid,
      list_contains(h.names, 'CUSTOM.updateTime') AS a
      FROM c JOIN h USING (file_id) WHERE c.line_no > 1),
f AS (SELECT file_id, line_no, CASE
      WHEN NOT quoted THEN 'quoting'
      WHEN len(cells) <> len(names) THEN 'column_count'
      WHEN a AND NOT (regexp_full_match(tm, '\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?') AND try_strptime(substr(tm, 1, 19), '%Y/%m/%d %H:%M:%S') IS NOT NULL) THEN 't_sec'
      WHEN NOT a AND NOT (regexp_full_match(tm, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') AND try_strptime(tm, '%Y-%m-%d %H:%M:%S') IS NOT NULL) THEN 't_sec'
      WHEN NOT coalesce(regexp_full_match(lat, '[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?') AND try_cast(ltrim(lat, '+') AS DOUBLE) BETWEEN -90 AND 90, false) THEN 'lat'
      WHEN a AND NOT (vid IN ('', '0', '1', 'True', 'False', 'true', 'false')) THEN 'is_video'
      WHEN NOT a AND NOT (vid IN ('0', '1')) THEN 'is_video' END AS fault FROM j)
"""

LOADED = _LINES + """, bad AS (SELECT DISTINCT file_id, line_no FROM f WHERE fault IS NOT NULL),
g AS (SELECT DISTINCT j.* FROM j ANTI JOIN bad USING (file_id, line_no)),
n AS (SELECT *, CASE WHEN a THEN ['CUSTOM.updateTime', 'OSD.latitude', 'OSD.longitude', 'OSD.height [m]', 'GIMBAL.yaw', 'GIMBAL.pitch', 'GIMBAL.roll'] ELSE ['datetime(utc)', 'latitude', 'longitude', 'height_above_takeoff(meters)', 'gimbal_heading(degrees)', 'gimbal_pitch(degrees)', 'gimbal_roll(degrees)'] END AS w FROM g)
SELECT file_id, line_no, CASE WHEN a THEN 'A' ELSE 'B' END AS format, try_cast(substr(replace(tm, '/', '-'), 1, 26) AS TIMESTAMP) AS sampled_at, try_cast(cells[list_position(names, w[2])] AS DOUBLE) AS lat, try_cast(cells[list_position(names, w[3])] AS DOUBLE) AS lon, try_cast(cells[list_position(names, w[4])] AS DOUBLE) AS height_m,
CASE WHEN a THEN vid NOT IN ('', '0', 'False', 'false') ELSE vid = '1' END AS is_video, try_cast(cells[list_position(names, w[5])] AS DOUBLE) AS yaw_deg, try_cast(cells[list_position(names, w[6])] AS DOUBLE) AS pitch_deg, try_cast(cells[list_position(names, w[7])] AS DOUBLE) AS roll_deg FROM n
"""

SQL = {
    "p5_found": f"""
WITH q(key, q) AS (VALUES {_NAMES}),
f AS (SELECT file_id, min(aircraft_id) AS a, min(exported_at) AS t FROM log_files WHERE file_kind = 'json' GROUP BY 1),
o AS (SELECT file_id, lag(file_id) OVER (PARTITION BY a ORDER BY t, file_id) AS p FROM f WHERE a IS NOT NULL AND t IS NOT NULL),
r AS (SELECT DISTINCT file_id, rec_no, payload FROM log_records),
k AS (SELECT r.file_id, e.key, CASE e.type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, count(*) AS n FROM r, json_each(r.payload) e GROUP BY ALL),
ty AS (SELECT file_id, k.key, coalesce(any_value(q.q), k.key) AS q, arg_max(kind, n * 10 + CASE kind WHEN 'number' THEN 3 WHEN 'boolean' THEN 2 ELSE 1 END) FILTER (WHERE kind IS NOT NULL) AS kind FROM k LEFT JOIN q ON k.key = q.key GROUP BY 1, 2),
nw AS (SELECT o.file_id, ty.key, ty.q, ty.kind FROM o JOIN ty ON ty.file_id = o.file_id WHERE p IS NOT NULL),
od AS (SELECT o.file_id, ty.key, ty.q, ty.kind FROM o JOIN ty ON ty.file_id = o.p WHERE p IS NOT NULL),
come AS (SELECT *, row_number() OVER (PARTITION BY file_id, q ORDER BY key) AS i FROM nw ANTI JOIN od USING (file_id, key)),
gone AS (SELECT *, row_number() OVER (PARTITION BY file_id, q ORDER BY key) AS i FROM od ANTI JOIN nw USING (file_id, key)),
b AS (SELECT coalesce(come.file_id, gone.file_id) AS file_id, gone.key AS g, come.key AS c, gone.kind AS gk, come.kind AS ck FROM come FULL JOIN gone ON come.file_id = gone.file_id AND come.q = gone.q AND come.i = gone.i)
SELECT file_id, CASE WHEN g IS NULL THEN 'added' WHEN c IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind, coalesce(g, '') AS old_name, coalesce(c, '') AS new_name FROM b
UNION ALL SELECT file_id, 'retyped', c, c FROM b WHERE gk <> ck
UNION ALL SELECT file_id, 'retyped', nw.key, nw.key FROM nw JOIN od USING (file_id, key) WHERE nw.kind <> od.kind
""",
    "p2_found": """
WITH s AS (SELECT DISTINCT flight_id, seq, t_sec, lat, lon, height_m, grid_s AS g, CAST(FLOOR(t_sec / grid_s) AS BIGINT) AS c
           FROM telemetry JOIN log_formats USING (format_detected) WHERE t_sec IS NOT NULL),
r AS (SELECT *, SUM(CASE WHEN t_sec - p > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY t_sec) AS run
      FROM (SELECT *, LAG(t_sec) OVER (PARTITION BY flight_id ORDER BY t_sec) AS p FROM s)),
span AS (SELECT flight_id, run, MIN(c) AS a, MAX(c) AS b FROM r GROUP BY ALL),
cells AS (SELECT DISTINCT flight_id, UNNEST(range(a, b + 1)) AS cell_no FROM span),
f AS (SELECT flight_id, cell_no, field_name FROM cells CROSS JOIN (VALUES ('lat'), ('lon'), ('height_m')) AS n(field_name)),
v AS (SELECT flight_id, c AS cell_no, 'lat' AS field_name, lat AS v FROM s UNION ALL SELECT flight_id, c, 'lon', lon FROM s
      UNION ALL SELECT flight_id, c, 'height_m', height_m FROM s),
seen AS (SELECT DISTINCT flight_id, cell_no, field_name FROM v WHERE v IS NOT NULL AND NOT isnan(v))
SELECT flight_id, CAST(cell_no AS BIGINT) AS cell_no, field_name FROM f ANTI JOIN seen USING (flight_id, cell_no, field_name)
""",
    "p3_found": _LINES + """SELECT file_id, line_no, min(fault) AS fault FROM f WHERE fault IS NOT NULL GROUP BY file_id, line_no
""",
    "p2_grid": """
WITH s AS (SELECT DISTINCT flight_id, seq, t_sec, lat, lon, height_m, grid_s AS g, CAST(FLOOR(t_sec / grid_s) AS BIGINT) AS c
           FROM telemetry JOIN log_formats USING (format_detected) WHERE t_sec IS NOT NULL),
r AS (SELECT *, SUM(CASE WHEN t_sec - p > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY t_sec) AS run
      FROM (SELECT *, LAG(t_sec) OVER (PARTITION BY flight_id ORDER BY t_sec) AS p FROM s)),
span AS (SELECT flight_id, run, any_value(g) AS g, MIN(c) AS a, MAX(c) AS b FROM r GROUP BY flight_id, run),
cells AS (SELECT DISTINCT flight_id, g, UNNEST(range(a, b + 1)) AS k FROM span),
v AS (SELECT flight_id, c, 'lat' AS n, t_sec AS t, lat AS v FROM s WHERE lat IS NOT NULL AND NOT isnan(lat) UNION ALL SELECT flight_id, c, 'lon', t_sec, lon FROM s WHERE lon IS NOT NULL AND NOT isnan(lon)
      UNION ALL SELECT flight_id, c, 'height_m', t_sec, height_m FROM s WHERE height_m IS NOT NULL AND NOT isnan(height_m)),
o AS (SELECT flight_id, c, n, arg_min(v, t) AS v FROM v GROUP BY ALL),
f AS (SELECT flight_id, g, k, n, k * g AS g0, (k + 1) * g AS till FROM cells CROSS JOIN (VALUES ('lat'), ('lon'), ('height_m')) AS x(n)),
p AS (SELECT f.*, v.t AS pt, v.v AS pv FROM f ASOF LEFT JOIN v ON f.flight_id = v.flight_id AND f.n = v.n AND f.g0 > v.t),
m AS (SELECT p.*, v.t AS nt, v.v AS nv FROM p ASOF LEFT JOIN v ON p.flight_id = v.flight_id AND p.n = v.n AND p.till <= v.t),
z AS (SELECT m.*, o.v AS ov, coalesce(nt - pt <= 10 * g, false) AS inside, coalesce(nt - pt > 900, true) AS alone, coalesce(g0 - pt <= 10 * g, false) AS near_p, coalesce(nt - g0 <= 10 * g, false) AS near_n
      FROM m LEFT JOIN o ON m.flight_id = o.flight_id AND m.k = o.c AND m.n = o.n)
SELECT flight_id, CAST(k AS BIGINT) AS cell_no, n AS field_name,
  CASE WHEN ov IS NOT NULL THEN ov WHEN inside THEN pv + (nv - pv) * (g0 - pt) / (nt - pt) WHEN alone AND near_p THEN pv WHEN alone AND near_n THEN nv END AS value,
  CASE WHEN ov IS NOT NULL THEN 'observed' WHEN inside THEN 'interpolated' WHEN alone AND (near_p OR near_n) THEN 'held' ELSE 'gap' END AS status FROM z
""",
    "p3_loaded": LOADED,
}
