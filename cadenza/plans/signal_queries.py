"""Queries of sample, frame and event operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.functions.arrays import squared_sum
from cadenza.operators import segment as V
from cadenza.plans.registry import CELLS, FRAMES, STREAMS, cells, frames, register, rounded, streams, table


@register(f"WITH {STREAMS} SELECT stream, seq, trunc(x * 1.5) + 0.0 AS x FROM st")
def level_scale(spark, d):
    return S.scale_level(streams(spark, d), 1.5).select("stream", "seq", (F.col("x") + 0.0).alias("x"))


@register(f"""WITH {STREAMS}, s AS (SELECT stream, seq, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE x END AS x FROM st),
m AS (SELECT *, x = 0 AS bad FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) - row_number() OVER (PARTITION BY stream, bad ORDER BY seq) AS island FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY stream, bad, island) AS n FROM i)
SELECT stream, seq, x FROM n WHERE NOT bad OR n < 3""")
def strip_runs(spark, d):
    s = streams(spark, d).select("stream", "seq", F.when(F.col("event_type").isin("view", "click"), 0.0).otherwise(F.col("x")).alias("x"))
    return S.strip_runs(s, 3)


@register(f"""WITH {STREAMS}, k AS (SELECT *, seq // 10 AS k FROM st),
c AS (SELECT stream, k, sum(x) FILTER (WHERE k < 4) AS s, count(x) FILTER (WHERE k < 4) AS n FROM k GROUP BY ALL),
m AS (SELECT stream, k, sum(s) OVER w / sum(n) OVER w AS m FROM c WINDOW w AS (PARTITION BY stream ORDER BY k)),
y AS (SELECT stream, seq, x - m AS y FROM k JOIN m USING (stream, k))
SELECT stream, seq, greatest(-32768.0, least(32767.0, CASE WHEN y < 0 THEN ceil(round(y, 9) - 0.5) ELSE floor(round(y, 9) + 0.5) END)) + 0.0 AS x FROM y""")
def dc_removal(spark, d):
    return S.remove_dc(streams(spark, d).select("stream", "seq", "x"), 10, 40).select("stream", "seq", (F.col("x") + 0.0).alias("x"))


@register(f"""WITH {STREAMS}, f AS (SELECT a.stream, a.seq // 4 AS t, list(b.x ORDER BY b.seq) AS v FROM st a JOIN st b ON a.stream = b.stream AND b.seq BETWEEN a.seq AND a.seq + 7
WHERE a.seq % 4 = 0 GROUP BY ALL HAVING count(*) = 8)
SELECT stream, t, round(list_sum(v), 6) + 0.0 AS total, v[1] AS first, v[8] AS last FROM f""")
def framing(spark, d):
    f = S.frames(streams(spark, d), 8, 4)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return f.select("stream", "t", rounded(total).alias("total"), F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(7)).alias("last"))


@register(f"WITH {CELLS}, m AS (SELECT stream, t, avg(x) AS m FROM ce GROUP BY ALL) SELECT stream, t, i, round(x - m, 6) + 0.0 AS v FROM ce JOIN m USING (stream, t)")
def frame_zero_mean(spark, d):
    return cells(frames(spark, d).withColumn("vec", S.zero_mean(F.col("vec"))))


@register(f"WITH {CELLS} SELECT stream, t, i, round(CASE WHEN i = 0 THEN x * 0.03 ELSE x - 0.97 * lag(x) OVER (PARTITION BY stream, t ORDER BY i) END, 6) + 0.0 AS v FROM ce")
def preemphasis(spark, d):
    return cells(frames(spark, d).withColumn("vec", S.preemphasis(F.col("vec"))))


@register(f"WITH {CELLS} SELECT stream, t, round(ln(sum(pow(x * (0.54 - 0.46 * cos(2 * pi() * i / 63)), 2))), 6) + 0.0 AS energy FROM ce GROUP BY stream, t")
def hamming_energy(spark, d):
    return frames(spark, d).select("stream", "t", rounded(S.log_energy(S.hamming(F.col("vec")))).alias("energy"))


@register(f"""WITH {CELLS}, e AS (SELECT stream, t, ln(sum(x * x)) AS e FROM ce GROUP BY ALL), m AS (SELECT *, max(e) OVER (PARTITION BY stream) AS top FROM e)
SELECT stream, t, round(1 - (top - greatest(e, top - 0.1 * ln(10) / 10)) * 0.5, 6) + 0.0 AS energy FROM m""")
def energy_norm(spark, d):
    e = frames(spark, d).select("stream", "t", F.log(squared_sum("vec")).alias("energy"))
    return S.energy_normalize(e, sil_floor=0.1, escale=0.5).select("stream", "t", rounded("energy").alias("energy"))


_DELTA = """d AS (SELECT stream, t, i, (1 * (coalesce(lead(x, 1) OVER w, last_value(x) OVER f) - coalesce(lag(x, 1) OVER w, first_value(x) OVER f))
 + 2 * (coalesce(lead(x, 2) OVER w, last_value(x) OVER f) - coalesce(lag(x, 2) OVER w, first_value(x) OVER f))) / 10 AS x FROM {src}
 WINDOW w AS (PARTITION BY stream, i ORDER BY t), f AS (PARTITION BY stream, i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@register(f"WITH {CELLS}, {_DELTA.format(src='ce')} SELECT stream, t, i, round(x, 6) + 0.0 AS v FROM d")
def delta(spark, d):
    return cells(S.delta(frames(spark, d)), "delta")


@register(f"WITH {CELLS}, {_DELTA.format(src='ce')}, {_DELTA.format(src='d').replace('d AS', 'a AS', 1)} SELECT stream, t, i, round(x, 6) + 0.0 AS v FROM a")
def accel(spark, d):
    return cells(S.delta(S.delta(frames(spark, d)), "delta", "accel"), "accel")


@register(f"WITH {CELLS}, m AS (SELECT stream, i, avg(x) AS m FROM ce GROUP BY ALL) SELECT stream, t, i, round(x - m, 6) + 0.0 AS v FROM ce JOIN m USING (stream, i)")
def cmn(spark, d):
    return cells(S.cmn(frames(spark, d)))


@register(f"WITH {CELLS}, m AS (SELECT stream, i, avg(x) AS m, stddev_pop(x) AS s FROM ce GROUP BY ALL) SELECT stream, t, i, round((CASE WHEN i < 32 THEN x - m ELSE x END) / s, 6) + 0.0 AS v FROM ce JOIN m USING (stream, i)")
def mvn(spark, d):
    return cells(S.mvn(frames(spark, d), 32))


@register(f"WITH {STREAMS} SELECT stream, seq AS t, round(x - (sum(x) OVER w + 100.0 * 50.0) / (count(x) OVER w + 100.0), 9) + 0.0 AS x FROM st WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def map_cmn(spark, d):
    return S.map_cmn(streams(spark, d).select("stream", F.col("seq").alias("t"), "x"), prior=50.0).withColumn("x", rounded("x", 9))


@register(f"""WITH {STREAMS}, s AS (SELECT stream, event_type AS segment, count(*) AS n, sum(x) AS total FROM st GROUP BY ALL),
p AS (SELECT a.stream, a.segment AS cur, b.segment, b.n, b.total, coalesce(sum(b.n) OVER (PARTITION BY a.stream, a.segment ORDER BY b.segment DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM s a JOIN s b ON a.stream = b.stream AND b.segment <= a.segment)
SELECT stream, cur AS segment, round(sum(total) / sum(n), 6) + 0.0 AS prior, sum(n)::BIGINT AS frames FROM p WHERE held < 30 GROUP BY ALL""")
def cmn_prior(spark, d):
    seg = streams(spark, d).groupBy("stream", F.col("event_type").alias("segment")).agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    return S.cmn_prior_of_segments(seg, 30).withColumn("prior", rounded("prior"))


@register(f"""WITH {FRAMES}, s AS (SELECT stream, t, count(*) OVER w AS n, flatten(list(vec) OVER w) AS v FROM fr WINDOW w AS (PARTITION BY stream ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT stream, t, len(v)::INT AS n, round(v[1], 6) + 0.0 AS first, round(v[65], 6) + 0.0 AS middle, round(v[192], 6) + 0.0 AS last FROM s WHERE n = 3""")
def splice(spark, d):
    s = S.splice(frames(spark, d), 3)
    at = lambda i: rounded(F.get("vec", F.lit(i)))
    return s.select("stream", "t", F.size("vec").alias("n"), at(0).alias("first"), at(64).alias("middle"), at(191).alias("last"))


@register(f"WITH {CELLS} SELECT stream, t, (k - 1)::INT AS i, round(sqrt(2.0 / 64) * sum(x * cos(pi() * k * (i + 0.5) / 64)), 6) + 0.0 AS v FROM ce, range(1, 13) r(k) GROUP BY stream, t, k")
def dct(spark, d):
    return cells(frames(spark, d).withColumn("vec", S.dct(F.col("vec"))))


@register(f"WITH {CELLS} SELECT stream, t, i, round(x * (1 + 11 * sin((i + 1) * pi() / 22)), 6) + 0.0 AS v FROM ce WHERE i < 12")
def lifter(spark, d):
    return cells(frames(spark, d).withColumn("vec", S.lifter(F.slice("vec", 1, 12))))


@register(f"WITH {CELLS} SELECT stream, t, CASE i WHEN 3 THEN 0 WHEN 10 THEN 1 ELSE 2 END AS i, round(x, 6) + 0.0 AS v FROM ce WHERE i IN (3, 10, 40)")
def select_dims(spark, d):
    return cells(frames(spark, d).withColumn("vec", S.select_dims(F.col("vec"), [3, 10, 40])))


@register(f"WITH {CELLS}, n AS (SELECT i AS bin, avg(abs(x)) AS magnitude FROM ce WHERE stream = 0 GROUP BY i) SELECT stream, t, i, round(CASE WHEN x * x - 2 * magnitude * magnitude < 0 OR x = 0 THEN 0.5 ELSE sqrt(x * x - 2 * magnitude * magnitude) / abs(x) END, 6) + 0.0 AS v FROM ce JOIN n ON i = bin")
def spectral_subtraction(spark, d):
    f = frames(spark, d).withColumn("vec", F.transform("vec", F.abs))
    noise = S.noise_spectrum(f.where("stream = 0"))
    cell = f.select("stream", "t", F.posexplode("vec").alias("i", "x")).join(noise.withColumnRenamed("bin", "i"), "i")
    return cell.select("stream", "t", "i", rounded(S.spectral_subtraction(F.col("x"), F.col("magnitude"))).alias("v"))


@register("SELECT DISTINCT f, round(1127 * ln(1 + f / 700.0), 6) + 0.0 AS mel, round(CASE WHEN f > 7000 * 2 / (1 + 1 / 1.1) AND f < 8000 THEN (8000 - (7000 * 2 / (1 + 1 / 1.1)) / 1.1) / (8000 - 7000 * 2 / (1 + 1 / 1.1)) * (f - 7000 * 2 / (1 + 1 / 1.1)) + (7000 * 2 / (1 + 1 / 1.1)) / 1.1 WHEN f > 0 AND f < 100 * 2 / (1 + 1 / 1.1) THEN ((100 * 2 / (1 + 1 / 1.1)) / 1.1) / (100 * 2 / (1 + 1 / 1.1)) * f ELSE f / 1.1 END, 6) + 0.0 AS warped FROM (SELECT floor(value * 20)::DOUBLE AS f FROM events)")
def mel_and_warp(spark, d):
    f = streams(spark, d).select(F.floor(F.col("x") * 20).cast("double").alias("f")).distinct()
    a, b, r = 100 * 2 / (1 + 1 / 1.1), 7000 * 2 / (1 + 1 / 1.1), 1.1
    x = F.col("f")
    warped = F.when((x > b) & (x < 8000), (8000 - b / r) / (8000 - b) * (x - b) + b / r).when((x > 0) & (x < a), (a / r) / a * x).otherwise(x / r)
    return f.select("f", rounded(S.mel(x)).alias("mel"), rounded(warped).alias("warped"))


@register()
def mfcc(spark, d):
    return cells(S.mfcc(S.frames(streams(spark, d), 16, 8), 16_000.0, 8, 5))


@register("WITH m AS (SELECT user_id AS stream, avg(value) AS mean FROM events GROUP BY ALL), g AS (SELECT stream, round(0.8 + i * 0.02, 6)::DOUBLE AS alpha, -abs(mean - round(0.8 + i * 0.02, 6)::DOUBLE * 50) AS s FROM m, range(21) r(i)) SELECT stream, arg_min(alpha, (-s, alpha)) AS alpha, round(max(s), 6) + 0.0 AS score FROM g GROUP BY stream")
def warp_search(spark, d):
    # added up in the table's order: half-way scores turn on the last bit of the mean
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), "event_id", F.avg("value").over(w).alias("mean"))
    f = e.groupBy("stream").agg(F.max_by("mean", "event_id").alias("mean"))
    return S.warp_grid(f, lambda alpha: -F.abs(F.col("mean") - alpha * 50)).withColumn("score", rounded("score"))


# --- events and segments ------------------------------------------------------------------------------------------
@register(f"""WITH RECURSIVE {STREAMS}, s AS (SELECT stream, seq, x - 50 AS x FROM st),
r AS (SELECT stream, seq, abs(x) > 30 AS armed, CASE WHEN x > 0 THEN 1 ELSE -1 END AS sign, 0 AS mark FROM s WHERE seq = 0
UNION ALL SELECT s.stream, s.seq, CASE WHEN r.armed AND (CASE WHEN s.x > 0 THEN 1 ELSE -1 END) <> r.sign THEN abs(s.x) > 30 ELSE r.armed OR abs(s.x) > 30 END,
 CASE WHEN s.x > 0 THEN 1 ELSE -1 END, CASE WHEN r.armed AND (CASE WHEN s.x > 0 THEN 1 ELSE -1 END) <> r.sign THEN 1 ELSE 0 END FROM r JOIN s ON s.stream = r.stream AND s.seq = r.seq + 1)
SELECT stream, seq, mark, sum(mark) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS zc FROM r""")
def zero_cross(spark, d):
    s = streams(spark, d).select("stream", "seq", (F.col("x") - 50).alias("x"))
    return V.zero_cross_count(s, 10, 30).select("stream", "seq", "mark", "zc")


@register(f"""WITH {STREAMS}, a AS (SELECT stream, seq AS chunk, event_type IN ('purchase', 'signup') AS active FROM st),
h AS (SELECT *, chunk - lag(chunk) OVER (PARTITION BY stream ORDER BY chunk) AS gap FROM a WHERE active),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY chunk) AS segment FROM h),
g AS (SELECT stream, segment, min(chunk) AS f, max(chunk) AS l, count(*) AS active FROM i GROUP BY ALL),
e AS (SELECT stream, max(chunk) AS last, min(chunk) AS first FROM a GROUP BY ALL)
SELECT stream, segment::BIGINT AS segment, greatest(f - 1, first, coalesce(lag(l) OVER (PARTITION BY stream ORDER BY segment) + 1, first)) AS first_chunk, least(l + 2, last) AS last_chunk, active FROM g JOIN e USING (stream)""")
def endpoint_segments(spark, d):
    s = streams(spark, d).select("stream", F.col("seq").alias("chunk"), F.col("event_type").isin("purchase", "signup").alias("active"))
    return V.endpoints(s, 2, 1).select("stream", F.col("segment").cast("long").alias("segment"), "first_chunk", "last_chunk", "active")


@register(f"WITH {STREAMS} SELECT stream, seq AS t, avg(CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY stream ORDER BY seq ROWS 4 PRECEDING) >= 0.5 AS trigger FROM st")
def vad_smooth(spark, d):
    s = streams(spark, d).select("stream", F.col("seq").alias("t"), (F.col("x") > 50).cast("int").alias("voiced"))
    return V.smooth_decisions(s).select("stream", "t", "trigger")


@register(f"""WITH {STREAMS}, m AS (SELECT stream, seq AS t, x / 100 - 0.4 AS s FROM st),
r AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(s) OVER w END AS ring FROM m WINDOW w AS (PARTITION BY stream ORDER BY t ROWS 4 PRECEDING)),
k AS (SELECT *, CASE WHEN ring >= 0.2 THEN 1 WHEN ring <= 0.0 THEN 0 END AS mark FROM r)
SELECT stream, t, round(ring, 6) + 0.0 AS ring_mean, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t ROWS UNBOUNDED PRECEDING), 0)::INT AS state FROM k""")
def vad_hysteresis(spark, d):
    s = streams(spark, d).select("stream", F.col("seq").alias("t"), (F.col("x") / 100 - 0.4).alias("score"))
    return V.hysteresis(s, up=0.2, down=0.0, ring=5).select("stream", "t", rounded("ring_mean").alias("ring_mean"), "state")


_PAUSE = f"""WITH {STREAMS}, q AS (SELECT stream, seq AS t, event_type AS unit, event_type = 'view' AS q FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t) - row_number() OVER (PARTITION BY stream, q ORDER BY t) AS run FROM q),
n AS (SELECT *, q AND count(*) OVER (PARTITION BY stream, q, run) >= 2 AS cut FROM r),
s AS (SELECT *, CASE WHEN NOT cut AND coalesce(lag(cut) OVER (PARTITION BY stream ORDER BY t), true) THEN 1 ELSE 0 END AS new FROM n),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY t) AS segment FROM s),
z AS (SELECT stream, segment::BIGINT AS segment, min(t) AS first_t, max(t) AS last_t, count(*) AS frames, arg_max(unit, t) FILTER (WHERE NOT q) AS last_unit FROM g WHERE NOT cut GROUP BY ALL)
"""


def _segments(spark, d):
    s = streams(spark, d).select("stream", F.col("seq").alias("t"), F.col("event_type").alias("unit"))
    return V.pause_segments(s, "view", 2)


@register(_PAUSE + "SELECT * FROM z")
def pause_segments(spark, d):
    return _segments(spark, d).select("stream", F.col("segment").cast("long").alias("segment"), "first_t", "last_t", "frames", "last_unit")


@register(_PAUSE + "SELECT stream, segment, frames, CASE WHEN frames * 10.0 < 30 THEN 'too_short' WHEN frames * 10.0 > 80 THEN 'too_long' ELSE 'accepted' END AS status FROM z")
def reject_length(spark, d):
    return V.reject_by_length(_segments(spark, d), least_ms=30, most_ms=80).select("stream", F.col("segment").cast("long").alias("segment"), "frames", "status")


@register(_PAUSE + "SELECT st.stream, st.seq AS t, segment, st.seq < first_t AS rewound FROM st JOIN z ON st.stream = z.stream AND st.seq BETWEEN first_t - 2 AND last_t")
def rewind(spark, d):
    s = streams(spark, d).select("stream", F.col("seq").alias("t"))
    return V.rewind(s, _segments(spark, d), 2).select("stream", "t", F.col("segment").cast("long").alias("segment"), "rewound")


@register(f"WITH {STREAMS} SELECT stream, round(avg(x), 6) + 0.0 AS mean_power, count(*) AS frames FROM st GROUP BY stream HAVING avg(x) >= 50")
def power_reject(spark, d):
    return V.reject_by_power(streams(spark, d), "x", 50).withColumn("mean_power", rounded("mean_power"))


@register(f"WITH {STREAMS} SELECT stream, event_type AS segment, seq, ((row_number() OVER (PARTITION BY stream, event_type ORDER BY seq) - 1) // 7)::BIGINT AS piece FROM st")
def force_cut(spark, d):
    s = streams(spark, d).select("stream", F.col("event_type").alias("segment"), "seq")
    return V.force_cut(s, 7).select("stream", "segment", "seq", F.col("piece").cast("long").alias("piece"))


@register(f"""WITH {STREAMS}, g AS (SELECT stream, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY stream ORDER BY ts)),
s AS (SELECT stream, ts, sum(new) OVER (PARTITION BY stream ORDER BY ts) AS k FROM g) SELECT stream, min(ts) AS "start", max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY stream, k""")
def event_sessions(spark, d):
    from cadenza.streaming.live import sessions

    return sessions(streams(spark, d), "ts", "12 hours")
