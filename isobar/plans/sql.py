"""Shared common table expressions of the SQL equivalents (DuckDB dialect)."""

from __future__ import annotations

STATE = """ranked AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx FROM embeddings),
nt AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)),
state AS (SELECT CAST(t_idx AS BIGINT) AS t_idx, CAST(label AS INTEGER) AS channel_idx, CAST((p - 1) // 8 AS INTEGER) AS lat_idx, CAST((p - 1) % 8 AS INTEGER) AS lon_idx,
  CAST(embedding[p] AS DOUBLE) AS value FROM ranked, nt, range(1, 57) g(p) WHERE t_idx < n)"""

SPLIT = """cut AS (SELECT (n * 6) // 10 AS a, (n * 8) // 10 AS b, n FROM nt),
train AS (SELECT s.* FROM state s, cut WHERE t_idx < a)"""

LAT = """lat AS (SELECT CAST(i AS INTEGER) AS lat_idx, CAST(90.0 - 30.0 * i AS DOUBLE) AS latitude FROM range(7) r(i)),
edge AS (SELECT *, coalesce((latitude + lag(latitude) OVER o) / 2, latitude + (latitude - lead(latitude) OVER o) / 2) AS up,
  coalesce((latitude + lead(latitude) OVER o) / 2, latitude - (lag(latitude) OVER o - latitude) / 2) AS dn FROM lat WINDOW o AS (ORDER BY lat_idx)),
area AS (SELECT lat_idx, latitude, abs(sin(radians(greatest(-90, least(90, up)))) - sin(radians(greatest(-90, least(90, dn))))) AS w FROM edge),
dlat AS (SELECT lat_idx, latitude, w / avg(w) OVER () AS aw FROM area)"""

STATS = """mean AS (SELECT channel_idx, sum(value * aw) / sum(aw) AS m FROM train JOIN dlat USING (lat_idx) GROUP BY 1),
st AS (SELECT channel_idx, max(m) AS m, sqrt(sum((value - m) * (value - m) * aw) / sum(aw)) AS sd FROM train JOIN dlat USING (lat_idx) JOIN mean USING (channel_idx) GROUP BY 1)"""


def diff(step: int, source: str = "train") -> str:
    return f"""d{step} AS (SELECT a.t_idx, a.channel_idx, a.lat_idx, a.lon_idx, b.value - a.value AS value FROM {source} a
  JOIN {source} b ON b.t_idx = a.t_idx + {step} AND b.channel_idx = a.channel_idx AND b.lat_idx = a.lat_idx AND b.lon_idx = a.lon_idx),
dm{step} AS (SELECT channel_idx, sum(value * aw) / sum(aw) AS m FROM d{step} JOIN dlat USING (lat_idx) GROUP BY 1),
ds{step} AS (SELECT channel_idx, max(m) AS m, sqrt(sum((value - m) * (value - m) * aw) / sum(aw)) AS sd FROM d{step} JOIN dlat USING (lat_idx) JOIN dm{step} USING (channel_idx) GROUP BY 1)"""


NORM = """z AS (SELECT t_idx, channel_idx, lat_idx, lon_idx, (value - m) / sd AS value FROM state JOIN st USING (channel_idx)),
clim AS (SELECT channel_idx, lat_idx, lon_idx, avg(value) AS clim FROM train GROUP BY 1, 2, 3),
zclim AS (SELECT channel_idx, lat_idx, lon_idx, (clim - m) / sd AS clim FROM clim JOIN st USING (channel_idx))"""

LEADS = 3

FORECAST = f"""base AS (SELECT CAST(g AS BIGINT) AS base_t, CAST(g - b AS BIGINT) AS sample_idx FROM cut, range(0, 100000) r(g) WHERE g >= b AND g + {LEADS} < n),
init AS (SELECT sample_idx, base_t, x.channel_idx, x.lat_idx, x.lon_idx, x.value AS now, y.value AS before FROM base JOIN z x ON x.t_idx = base_t
  LEFT JOIN z y ON y.t_idx = base_t - 1 AND y.channel_idx = x.channel_idx AND y.lat_idx = x.lat_idx AND y.lon_idx = x.lon_idx),
fc AS (SELECT 'persistence' AS model, sample_idx, base_t, k AS lead, channel_idx, lat_idx, lon_idx, now AS prediction FROM init, range(1, {LEADS + 1}) l(k)
  UNION ALL SELECT 'linear_tendency', sample_idx, base_t, k, channel_idx, lat_idx, lon_idx, now + k * (now - before) FROM init, range(1, {LEADS + 1}) l(k)
  UNION ALL SELECT 'climatology', sample_idx, base_t, k, channel_idx, lat_idx, lon_idx, clim FROM init JOIN zclim USING (channel_idx, lat_idx, lon_idx), range(1, {LEADS + 1}) l(k)),
pair AS (SELECT f.*, t.value AS target FROM fc f JOIN z t ON t.t_idx = f.base_t + f.lead AND t.channel_idx = f.channel_idx AND t.lat_idx = f.lat_idx AND t.lon_idx = f.lon_idx)"""

SUMS = """s1 AS (SELECT model, sample_idx, lead, channel_idx, sum(aw) AS sw, sum(aw * (prediction - target) ** 2) AS se2, sum(aw * abs(prediction - target)) AS sae, sum(aw * (prediction - target)) AS se,
  sum(aw * (prediction - clim) * (target - clim)) AS sab, sum(aw * (prediction - clim) ** 2) AS saa, sum(aw * (target - clim) ** 2) AS sbb,
  sum(aw * prediction * prediction) - sum(aw * prediction) ** 2 / sum(aw) AS svp, sum(aw * target * target) - sum(aw * target) ** 2 / sum(aw) AS svy
  FROM pair JOIN dlat USING (lat_idx) JOIN zclim USING (channel_idx, lat_idx, lon_idx) GROUP BY 1, 2, 3, 4),
s1a AS (SELECT *, CASE WHEN sqrt(saa * sbb) > 1e-12 THEN sab / sqrt(saa * sbb) END AS acc FROM s1),
s2 AS (SELECT model, lead, channel_idx, sum(sw) AS sw, sum(se2) AS se2, sum(sae) AS sae, sum(se) AS se, sum(svp) AS svp, sum(svy) AS svy, coalesce(sum(acc), 0) AS sacc, count(acc) AS n_acc, count(*) AS n_samples FROM s1a GROUP BY 1, 2, 3),
chan AS (SELECT model, lead, CAST(lead * 6.0 AS DOUBLE) AS lead_hours, channel_idx, sqrt(se2 / sw) * sd AS physical_rmse, sacc / nullif(n_acc, 0) AS normalized_acc, n_acc AS acc_valid_initializations, se / sw * sd AS physical_bias,
  CASE WHEN svy > 0 THEN svp / svy END AS spatial_variance_ratio FROM s2 JOIN st USING (channel_idx)),
leads AS (SELECT model, lead, CAST(lead * 6.0 AS DOUBLE) AS lead_hours, sqrt(sum(se2) / sum(sw)) AS rmse, sum(sae) / sum(sw) AS mae, avg(sacc / nullif(n_acc, 0)) AS acc, count(sacc / nullif(n_acc, 0)) AS valid_channels, count(*) AS channels, max(n_samples) AS samples FROM s2 GROUP BY 1, 2)"""

CHANNELS = """ch AS (SELECT CAST(i AS INTEGER) AS channel_idx, (['10m_u_component_of_wind', '10m_v_component_of_wind', '2m_temperature', 'surface_pressure', 'total_column_water_vapour',
  'temperature@500hPa', 'temperature@850hPa', 'temperature@1000hPa', 'geopotential@500hPa', 'geopotential@1000hPa'])[i + 1] AS channel FROM range(10) r(i)),
chp AS (SELECT channel_idx, channel, split_part(channel, '@', 1) AS variable, TRY_CAST(nullif(regexp_extract(channel, '@([0-9.]+)hPa$', 1), '') AS DOUBLE) AS p FROM ch),
surf AS (SELECT * FROM (VALUES ('10m_u_component_of_wind', 0.1), ('10m_v_component_of_wind', 0.1), ('2m_temperature', 1.0), ('surface_pressure', 0.1), ('mean_sea_level_pressure', 0.1), ('total_column_water_vapour', 0.1)) v(channel, sw)),
bal AS (SELECT channel_idx, coalesce(CAST(sw AS DOUBLE), p / sum(p) OVER (PARTITION BY variable)) AS w FROM chp LEFT JOIN surf USING (channel)),
balw AS (SELECT channel_idx, w / sum(w) OVER () AS weight FROM bal)"""

BASE = ", ".join([STATE, SPLIT, LAT, STATS])
FULL = ", ".join([BASE, NORM, FORECAST, SUMS])

# Bytes of a float32, little-endian, as hex digits: sign, exponent and fraction by arithmetic.
_FLOAT = """(SELECT *, abs(value) AS a, CASE WHEN value = 0 THEN 0 ELSE CAST(floor(log2(abs(value))) AS INTEGER) END AS e0 FROM state)"""
DIGESTS = f"""exponent AS (SELECT *, CASE WHEN value = 0 THEN 0 WHEN a < pow(2.0, e0) THEN e0 - 1 WHEN a >= pow(2.0, e0 + 1) THEN e0 + 1 ELSE e0 END AS e FROM {_FLOAT}),
bits AS (SELECT *, CASE WHEN value = 0 THEN 0 ELSE (CASE WHEN value < 0 THEN 2147483648 ELSE 0 END) + (CAST(e AS BIGINT) + 127) * 8388608 + CAST(round((a / pow(2.0, e) - 1) * 8388608) AS BIGINT) END AS b FROM exponent),
hexed AS (SELECT t_idx, channel_idx, lat_idx, lon_idx, printf('%02x%02x%02x%02x', b & 255, (b >> 8) & 255, (b >> 16) & 255, (b >> 24) & 255) AS h FROM bits),
slice AS (SELECT t_idx, channel_idx, sha256(unhex(string_agg(h, '' ORDER BY lat_idx, lon_idx))) AS x FROM hexed GROUP BY 1, 2)"""

# All pairs of cells and waves of a field's error, and the mean modulus of its orthonormal transform.
SPECTRUM = """wave AS (SELECT lead, sample_idx, channel_idx, u, v, sum((prediction - target) * cos(2 * pi() * (u * lat_idx / 7.0 + v * lon_idx / 8.0))) / sqrt(56) AS re, sum((prediction - target) * sin(2 * pi() * (u * lat_idx / 7.0 + v * lon_idx / 8.0))) / sqrt(56) AS im
  FROM pp, range(7) r(u), range(8) q(v) GROUP BY ALL),
l1 AS (SELECT lead, sum(sqrt(re * re + im * im)) / 56 / count(DISTINCT (sample_idx, channel_idx)) AS s FROM wave GROUP BY 1)"""

# Normalised Legendre functions of every order at the latitudes, by the recurrence in the degree.
LEGENDRE = """node AS (SELECT CAST(i AS INTEGER) AS lat_idx, pi() * i / 6 AS theta, CASE WHEN i IN (0, 6) THEN 1 ELSE 2 END / 6.0 * (1 - 2.0 / 3 * cos(pi() * i / 3) - 2.0 / 15 * cos(2 * pi() * i / 3) - 1.0 / 35 * cos(pi() * i)) AS w FROM range(7) r(i)),
leg(lat_idx, theta, w, m, l, p, q) AS (
  SELECT lat_idx, theta, w, m, m, CASE m % 2 WHEN 0 THEN 1 ELSE -1 END * sqrt((2 * m + 1) / (4 * pi()) * c) * pow(sin(theta), m), CAST(0 AS DOUBLE)
  FROM node, (VALUES (0, 1.0::DOUBLE), (1, 1 / 2.0::DOUBLE), (2, 3 / 8.0::DOUBLE), (3, 5 / 16.0::DOUBLE), (4, 35 / 128.0::DOUBLE)) o(m, c)
  UNION ALL SELECT lat_idx, theta, w, m, l + 1, sqrt((4.0 * (l + 1) * (l + 1) - 1) / ((l + 1) * (l + 1) - m * m)) * (cos(theta) * p - sqrt((l * l - m * m) / (4.0 * l * l - 1)) * q), p FROM leg WHERE l < 6)"""

# --- the whole of the vectors: 8 x 8 cells, no time left out -----------------

WHOLE = """ranked AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx FROM embeddings),
nt AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)),
state AS (SELECT CAST(t_idx AS BIGINT) AS t_idx, CAST(label AS INTEGER) AS channel_idx, CAST((p - 1) // 8 AS INTEGER) AS lat_idx, CAST((p - 1) % 8 AS INTEGER) AS lon_idx,
  CAST(embedding[p] AS DOUBLE) AS value FROM ranked, range(1, 65) g(p))"""

WHOLE_LAT = LAT.replace("90.0 - 30.0 * i", "90.0 - 180.0 / 7 * i").replace("range(7)", "range(8)")
WHOLE_BASE = ", ".join([WHOLE, SPLIT, WHOLE_LAT, STATS])
WHOLE_FULL = ", ".join([WHOLE_BASE, NORM, FORECAST, SUMS])
