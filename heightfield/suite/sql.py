"""SQL fragments shared by the reference queries."""

PX = """
v AS (SELECT CAST(label AS BIGINT) AS dataset_id,
             CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y, embedding FROM embeddings),
px AS MATERIALIZED (SELECT dataset_id, y, CAST(unnest(range(len(embedding))) AS INT) AS x, unnest(embedding) AS z FROM v),
dims AS (SELECT dataset_id, CAST(max(x) + 1 AS INT) AS w, CAST(max(y) + 1 AS INT) AS h FROM px GROUP BY 1)"""

EM = """
cv AS MATERIALIZED (SELECT vec_id AS dataset_id, CAST(unnest(range(len(embedding))) AS INT) AS i, unnest(embedding) AS z FROM embeddings),
len AS (SELECT dataset_id, CAST(max(i) + 1 AS INT) AS n FROM cv GROUP BY 1)"""


def ev(gaps: int = 0) -> str:
    z = "CAST(value AS FLOAT)"
    if gaps:
        z = f"CASE WHEN event_id % {gaps} = 0 THEN CAST('nan' AS FLOAT) ELSE {z} END"
    return f"""
cv AS MATERIALIZED (SELECT user_id AS dataset_id,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i, {z} AS z FROM events),
len AS (SELECT dataset_id, CAST(max(i) + 1 AS INT) AS n FROM cv GROUP BY 1)"""


def r(expr: str, name: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 1e6, 0) / 1e6 + 0.0 AS {name}"


def b(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def moments(rows: str, keys: str = "dataset_id") -> str:
    """CTEs ending in ``m``: n, lo, hi, mean, sa, sq, skew, kurt per key of the relation ``rows``(keys, z)."""
    on = " AND ".join(f"d.{k} = f.{k}" for k in keys.split(", "))
    ks = ", ".join(f"d.{k}" for k in keys.split(", "))
    return f"""
f AS (SELECT {keys}, count(*) AS n, avg(CAST(z AS DOUBLE)) AS mean, min(CAST(z AS DOUBLE)) AS lo, max(CAST(z AS DOUBLE)) AS hi
      FROM {rows} GROUP BY {keys}),
g AS (SELECT {ks}, any_value(n) AS n, any_value(f.mean) AS mean, any_value(lo) AS lo, any_value(hi) AS hi,
             avg(abs(d.z - f.mean)) AS sa, avg(pow(d.z - f.mean, 2)) AS m2, avg(pow(d.z - f.mean, 3)) AS m3, avg(pow(d.z - f.mean, 4)) AS m4
      FROM {rows} d JOIN f ON {on} GROUP BY {ks}),
m AS (SELECT *, sqrt(m2) AS sq, CASE WHEN m2 = 0 THEN CAST('nan' AS DOUBLE) ELSE m3 / pow(m2, 1.5) END AS skew,
             CASE WHEN m2 = 0 THEN CAST('nan' AS DOUBLE) ELSE m4 / (m2 * m2) END AS kurt FROM g)"""


AREAL = ", ".join([r("sq", "Sq"), r("sa", "Sa"), r("hi - mean", "Sp"), r("mean - lo", "Sv"), r("hi - lo", "Sz"), r("skew", "Ssk"), r("kurt", "Sku")])
LINE = ", ".join([r("sa", "Ra"), r("sq", "Rq"), r("hi - mean", "Rp"), r("mean - lo", "Rv"), r("hi - lo", "Rz"), r("skew", "Rsk"), r("kurt", "Rku")])
PIX = f"SELECT dataset_id, {b('y')}, {b('x')}, {r('z', 'z')} FROM "
SAM = f"SELECT dataset_id, {b('i')}, {r('z', 'z')} FROM "
NAN = "CAST('nan' AS DOUBLE)"


def point_average(order: str = "y, x") -> str:
    """CTEs ending in ``bp``(dataset_id, rz_points) from px and m."""
    return f"""
sg AS (SELECT d.dataset_id, row_number() OVER (PARTITION BY d.dataset_id ORDER BY {order}) AS p, d.z - m.mean AS d,
              (d.z - m.mean) > 0 AS up FROM px d JOIN m ON d.dataset_id = m.dataset_id),
tr AS (SELECT *, CASE WHEN up <> lag(up) OVER (PARTITION BY dataset_id ORDER BY p) THEN 1 ELSE 0 END AS t FROM sg),
rn AS (SELECT *, sum(t) OVER (PARTITION BY dataset_id ORDER BY p) AS run FROM tr),
ex AS (SELECT dataset_id, run, up, CASE WHEN up THEN max(d) ELSE min(d) END AS ext FROM rn GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, up ORDER BY CASE WHEN up THEN -ext ELSE ext END) AS k FROM ex),
bp AS (SELECT dataset_id, CASE WHEN count(*) = 10 THEN sum(CASE WHEN up THEN ext ELSE -ext END) / 5 ELSE {NAN} END AS rz_points
       FROM rk WHERE k <= 5 GROUP BY 1)"""
