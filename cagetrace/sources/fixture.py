"""Fixture views over the driver tables (FIXTURES.md section 4).

The driver tables hold no positions, so ``frames`` is derived from
``events`` by integer arithmetic, exactly as the fixture SQL does:
500 frames per session 0.5 s apart, four subjects per frame, built-in
gaps, spikes and duplicate times.  Built with DataFrame expressions so
the work is a narrow projection of the ``events`` scan (one column read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture view (FIXTURES.md section 4).
FRAMES_PER_SESSION = 500
FRAME_MS = 500
SESSION_MS = 3_600_000
IDS = (1, 2, 3, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int_div(a: Column, b: int) -> Column:
    return ((a - a % b) / b).cast("bigint")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long positions: session, frame_no, time, id, x, y (nullable doubles)."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"))
    cores = spark.sparkContext.defaultParallelism
    if len(ev.inputFiles()) < cores:   # a few small files make fewer tasks than there are cores
        ev = ev.repartition(cores, "n")
    n = F.col("n")
    s = _int_div(n, FRAMES_PER_SESSION)
    fr = n % FRAMES_PER_SESSION
    k = F.col("id").cast("bigint")
    base = ev.select(n, s.alias("s"), fr.alias("fr"),
                     F.explode(F.array(*[F.lit(i) for i in IDS])).alias("id"))
    s, fr = F.col("s"), F.col("fr")
    px = F.abs((fr * (k * 2 + 3) + s * 31 * k) % 760 - 380)
    py = F.abs((fr * (k * 3 + 2) + s * 17 * k) % 450 - 225)
    dup = F.when(fr % 50 == 49, 1).otherwise(0)
    ms = s * SESSION_MS + (fr - dup) * FRAME_MS
    lead_in = fr < k
    x = (F.when(lead_in | ((n * 5 + k) % 23 == 0) | ((n * 3 + k) % 41 == 0), F.lit(None))
         .when((n * 7 + k) % 97 == 0, px + 2000).otherwise(px)).cast("double")
    y = F.when(lead_in | ((n * 5 + k) % 23 == 0), F.lit(None)).otherwise(py).cast("double")
    return base.select(
        s.alias("session"),
        n.alias("frame_no"),
        F.timestamp_millis(ms).alias("time"),
        F.col("id").cast("int").alias("id"),
        x.alias("x"),
        y.alias("y"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject facts per (session, id): line (unpaired), drug + mouse (paired)."""
    ev = table(spark, sf_dir, "events").select("event_id")
    sess = ev.select(_int_div(F.col("event_id"), FRAMES_PER_SESSION).alias("session")).distinct()
    s = F.col("session")
    out = sess.select(s, F.explode(F.array(*[F.lit(i) for i in IDS])).alias("id"))
    k = F.col("id")
    return out.select(
        s,
        k.cast("int").alias("id"),
        k.cast("string").alias("marker_id"),
        F.when((s + k) % 2 == 0, "A").otherwise("B").alias("line"),
        F.when(s % 2 == 0, "SAL").otherwise("CNO").alias("drug"),
        (_int_div(s, 2) * 10 + k).cast("bigint").alias("mouse"),
    )


# The same views as SQL text, exactly as FIXTURES.md gives them; the
# oracle queries build on these.
FRAMES_SQL = """
WITH n AS (SELECT event_id AS n, CAST((event_id - event_id % 500) / 500 AS BIGINT) AS s, event_id % 500 AS fr FROM events),
k AS (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4),
p AS (SELECT n.n, n.s, n.fr, k.k,
        ABS((fr * (3 + 2 * k) + s * 31 * k) % 760 - 380) AS px,
        ABS((fr * (2 + 3 * k) + s * 17 * k) % 450 - 225) AS py FROM n CROSS JOIN k)
SELECT s AS session_no, n AS frame_no,
       s * 3600000 + (fr - CASE WHEN fr % 50 = 49 THEN 1 ELSE 0 END) * 500 AS ms, k AS id,
       CAST(CASE WHEN fr < k OR (n * 5 + k) % 23 = 0 OR (n * 3 + k) % 41 = 0 THEN NULL
                 WHEN (n * 7 + k) % 97 = 0 THEN px + 2000 ELSE px END AS DOUBLE) AS x,
       CAST(CASE WHEN fr < k OR (n * 5 + k) % 23 = 0 THEN NULL ELSE py END AS DOUBLE) AS y
FROM p
"""

SUBJECTS_SQL = """
WITH s AS (SELECT DISTINCT CAST((event_id - event_id % 500) / 500 AS BIGINT) AS s FROM events),
k AS (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)
SELECT s AS session_no, k AS id, CAST(k AS VARCHAR(10)) AS marker_id,
       CASE WHEN (s + k) % 2 = 0 THEN 'A' ELSE 'B' END AS line,
       CASE WHEN s % 2 = 0 THEN 'SAL' ELSE 'CNO' END AS drug,
       CAST((s - s % 2) / 2 AS BIGINT) * 10 + k AS mouse
FROM s CROSS JOIN k
"""
