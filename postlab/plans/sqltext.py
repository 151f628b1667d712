"""ANSI SQL (DuckDB dialect) text of the posts view and silver layer, used by the oracles.

Each oracle query is ``WITH <these CTEs> SELECT ...`` over the pre-registered driver tables.
"""

from __future__ import annotations

# silver columns by kind (bronze layout minus timestamp, plus year/month/day/event_ts)
SILVER_INTEGRAL = ["post_id", "follower_count", "following_count", "account_age_days", "verified_flag",
                   "likes", "shares", "comments", "impressions_estimate", "reach_estimate", "is_share",
                   "parent_post_id", "cascade_depth", "year"]
SILVER_DOUBLE = ["sentiment_score", "engagement_velocity", "misinformation_probability", "credibility_score",
                 "uncertainty_index", "subjectivity_score", "toxicity_score"]
SILVER_TEXT = ["source_type", "platform", "crisis_phase", "topic", "sentiment_label", "emotion", "stance_label",
               "claim_type", "region", "language", "month", "day"]
INT32 = {"verified_flag", "is_share", "cascade_depth", "year"}

POSTS_CTE = """
li AS (
  SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax,
         sum(l_extendedprice) AS ext, count(*) FILTER (WHERE l_returnflag = 'R') AS ret
  FROM lineitem GROUP BY l_orderkey),
posts AS (
  SELECT o.o_orderkey AS post_id,
         o.o_orderdate AS "timestamp",
         CAST(floor((c.c_acctbal + 1000) * 10) AS BIGINT) AS follower_count,
         CAST(c.c_custkey % 997 AS BIGINT) AS following_count,
         CAST(30 + (c.c_custkey * 37) % 3000 AS BIGINT) AS account_age_days,
         CAST(CASE WHEN c.c_custkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS verified_flag,
         c.c_mktsegment AS source_type,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderstatus END AS platform,
         o.o_orderpriority AS crisis_phase,
         'topic_' || CAST((o.o_orderkey * 31) % 7 AS VARCHAR) AS topic,
         CASE CAST(floor(o.o_orderkey / 5.0) AS BIGINT) % 3 WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Negative'
              ELSE 'Positive' END AS sentiment_label,
         CAST((o.o_orderkey * 101) % 2001 - 1000 AS DOUBLE) / 1000 AS sentiment_score,
         'emotion_' || CAST(CAST(floor(o.o_orderkey / 12.0) AS BIGINT) % 6 AS VARCHAR) AS emotion,
         'stance_' || CAST((o.o_orderkey * 11) % 4 AS VARCHAR) AS stance_label,
         'claim_' || CAST(CAST(floor(o.o_orderkey / 16.0) AS BIGINT) % 4 AS VARCHAR) AS claim_type,
         CAST(li.qty AS BIGINT) AS likes,
         CAST(li.n AS BIGINT) AS shares,
         CAST(li.ret AS BIGINT) AS comments,
         CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(li.ext / 100) AS BIGINT) END
           AS impressions_estimate,
         CAST(floor(o.o_totalprice / 100) AS BIGINT) AS reach_estimate,
         li.qty * 1.7 AS engagement_velocity,
         CASE WHEN li.disc IS NULL THEN NULL
              ELSE least(CAST(1.0 AS DOUBLE), 5.0 * li.disc + 0.0005 * CAST((o.o_orderkey * 211) % 1000 AS DOUBLE))
         END AS misinformation_probability,
         1.0 - 10.0 * li.tax AS credibility_score,
         CAST((o.o_orderkey * 401) % 1000 AS DOUBLE) / 1000 AS uncertainty_index,
         CAST((o.o_orderkey * 503) % 1000 AS DOUBLE) / 1000 AS subjectivity_score,
         CAST((o.o_orderkey * 307) % 1000 AS DOUBLE) / 1000 AS toxicity_score,
         r.r_name AS region,
         'English' AS language,
         CAST(CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_share,
         CAST(CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderkey - 1 END AS BIGINT) AS parent_post_id,
         CAST(o.o_orderkey % 6 AS INTEGER) AS cascade_depth
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey)"""

BRONZE_CTE = POSTS_CTE + """,
bronze AS (SELECT * FROM posts UNION ALL SELECT * FROM posts WHERE post_id % 50 = 0)"""


def silver_cte(source: str = "posts") -> str:
    """Dedup -> date parts -> parent 0 -> exact median fill -> mode fill, as CTEs ending in ``silver``."""
    med = ",\n         ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}"
                             for c in SILVER_INTEGRAL + SILVER_DOUBLE)
    mode = ",\n         ".join(
        f"(SELECT {c} FROM dated WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
        for c in SILVER_TEXT)
    cols = []
    for c in SILVER_INTEGRAL:
        t = "INTEGER" if c in INT32 else "BIGINT"
        cols.append(f"coalesce(d.{c}, CAST(round_even(med.{c}, 0) AS {t})) AS {c}")
    for c in SILVER_DOUBLE:
        cols.append(f"coalesce(d.{c}, med.{c}) AS {c}")
    for c in SILVER_TEXT:
        cols.append(f"coalesce(d.{c}, mo.{c}) AS {c}")
    cols.append("d.event_ts AS event_ts")
    body = ",\n         ".join(cols)
    return f""",
dedup AS (SELECT DISTINCT * FROM {source}),
dated0 AS (
  SELECT * EXCLUDE ("timestamp", parent_post_id), coalesce(parent_post_id, 0) AS parent_post_id,
         CAST(year("timestamp") AS INTEGER) AS year, monthname("timestamp") AS month,
         dayname("timestamp") AS day, "timestamp" AS event_ts
  FROM dedup),
dated AS (SELECT * FROM dated0),
med AS (SELECT {med} FROM dated),
mo AS (SELECT {mode}),
silver AS (
  SELECT {body}
  FROM dated d, med, mo)"""


def with_silver(select_sql: str, source: str = "posts") -> str:
    pre = BRONZE_CTE if source == "bronze" else POSTS_CTE
    return "WITH " + pre + silver_cte(source) + "\n" + select_sql


def with_posts(select_sql: str) -> str:
    return "WITH " + POSTS_CTE + "\n" + select_sql


def scaled_cte(cols: list[str]) -> str:
    """MLP-05 in SQL: exact-median imputation, then (x - mean) / population std (0 -> 1)."""
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM silver)) AS {c}"
                    for c in cols)
    mom = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(f"(imp.{c} - mom.m_{c}) / (CASE WHEN mom.s_{c} > 0 THEN mom.s_{c} ELSE 1 END) AS z_{c}" for c in cols)
    return f""",
imp AS (SELECT post_id, {imp} FROM silver),
mom AS (SELECT {mom} FROM imp),
scaled AS (SELECT imp.*, {z} FROM imp, mom)"""


def cluster_metrics_cte(cols: list[str], source: str, label: str) -> str:
    """CLU-05..08 in SQL over ``source`` with label column ``label``; ends in CTE ``cm``."""
    zs = [f"z_{c}" for c in cols]
    cents = ", ".join(f"avg({z}) AS c{i}" for i, z in enumerate(zs))
    g = ", ".join(f"avg({z}) AS g{i}" for i, z in enumerate(zs))
    d2 = " + ".join(f"(l.{z} - c.c{i}) * (l.{z} - c.c{i})" for i, z in enumerate(zs))
    b2 = " + ".join(f"(c{i} - g{i}) * (c{i} - g{i})" for i in range(len(zs)))
    dist = "sqrt(" + " + ".join(f"(a.c{i} - b.c{i}) * (a.c{i} - b.c{i})" for i in range(len(zs))) + ")"
    return f""",
cents AS (SELECT {label} AS lab, count(*) AS n, {cents} FROM {source} GROUP BY {label}),
gm AS (SELECT {g} FROM {source}),
within AS (SELECT lab, sum(d2) AS w, avg(sqrt(d2)) AS s FROM
  (SELECT c.lab, {d2} AS d2 FROM {source} l JOIN cents c ON l.{label} = c.lab) GROUP BY lab),
per AS (SELECT c.*, w.w, w.s FROM cents c JOIN within w ON c.lab = w.lab),
tot AS (SELECT sum(n) AS n, count(*) AS k, sum(w) AS inertia, sum(n * ({b2})) AS b FROM per, gm),
dbx AS (SELECT avg(r) AS dbi FROM (SELECT a.lab, max(CASE WHEN {dist} = 0 THEN 0 ELSE (a.s + b.s) / {dist} END) AS r
        FROM per a JOIN per b ON a.lab <> b.lab GROUP BY a.lab)),
cm AS (SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k,
  CASE WHEN k >= 2 AND n >= 4 THEN round(inertia, 3) END AS inertia,
  CASE WHEN k >= 2 AND n >= 4 THEN round(CASE WHEN inertia = 0 THEN 1.0 ELSE (b / (k - 1)) / (inertia / (n - k)) END, 4) END
    AS calinski_harabasz_score,
  CASE WHEN k >= 2 AND n >= 4 THEN dbi END AS davies_bouldin_index
  FROM tot, dbx)"""
