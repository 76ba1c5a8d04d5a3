"""Every registered query beside its DuckDB SQL.

Doubles are compared as integers of a fixed number of digits (``rounded``).
`events` is read as a word stream: user_id is the recording, event_type the
speaker, t the time in microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import intervals as I
from ..operators import series as S
from ..operators import stats as A
from ..operators.stats import rounded as r

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import measures, models  # noqa: F401  (measures registers its queries)

    return _QUERIES | models.queries()


def oracle_sql() -> dict[str, str]:
    from . import measures  # noqa: F401

    return dict(_SQL)


def R(x: str, digits: int) -> str:
    """SQL twin of ``rounded``."""
    return f"CAST(floor(({x}) * 1e{digits} + 0.5) AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BY, ORDER = ["user_id"], ["t", "event_id"]


def words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", S.micros("ts").alias("t"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


W = "w AS (SELECT user_id, event_id, event_type, epoch_us(ts) t, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) k FROM events)"
P = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
TURNS = f"""{W}, l AS (SELECT *, lag(t) {P} pt, lag(event_type) {P} pe FROM w),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) turn_id,
 CASE WHEN pe = event_type THEN t - pt END pus FROM l)"""

# -- speech: pauses and turns ---------------------------------------------


@query(f"WITH {W} SELECT user_id, event_id, t - lag(t) {P} AS pause_us FROM w")
def pause_calculation(spark, sf_dir):
    return S.with_pause(words(spark, sf_dir), BY, ORDER, "t", "t", "pause_us").select("user_id", "event_id", "pause_us")


@query(f"WITH {TURNS} SELECT user_id, event_id, CAST(turn_id AS BIGINT) turn_id FROM i")
def turn_islands(spark, sf_dir):
    return S.with_islands(words(spark, sf_dir), BY, ORDER, "event_type").select("user_id", "event_id", "turn_id")


def _turn_words(spark, sf_dir):
    w = S.with_islands(S.with_pause(words(spark, sf_dir), BY, ORDER, "t", "t", "_p"), BY, ORDER, "event_type")
    first = F.lag("turn_id").over(S.in_order(BY, ORDER)).eqNullSafe(F.col("turn_id"))
    return w.withColumn("pus", F.when(first, F.col("_p")))


@query(f"""WITH {TURNS} SELECT user_id, CAST(turn_id AS BIGINT) turn_id, min(event_type) speaker, count(*) turn_words,
 {R('(max(t) - min(t)) / 6e7', 4)} turn_minutes, {R('CAST(sum(pus) AS DOUBLE) / nullif(count(pus) * 1e6, 0)', 4)} mean_pause,
 {R('(1 - CAST(coalesce(sum(pus), 0) AS DOUBLE) / nullif(max(t) - min(t), 0)) * 100', 3)} speech_percentage, {R('count(*) * 6e7 / nullif(max(t) - min(t), 0)', 6)} words_per_min
 FROM i GROUP BY user_id, turn_id""")
def turn_features(spark, sf_dir):
    span = F.max("t") - F.min("t")
    return _turn_words(spark, sf_dir).groupBy("user_id", "turn_id").agg(
        F.min("event_type").alias("speaker"), F.count("*").alias("turn_words"), r(span / F.lit(6e7), 4).alias("turn_minutes"),
        r(F.sum("pus").cast("double") / F.nullif(F.count("pus") * F.lit(1e6), F.lit(0.0)), 4).alias("mean_pause"),
        r((1 - F.coalesce(F.sum("pus"), F.lit(0)).cast("double") / F.nullif(span, F.lit(0))) * 100, 3).alias("speech_percentage"),
        r(F.count("*") * F.lit(6e7) / F.nullif(span, F.lit(0)), 6).alias("words_per_min"),
    )


@query(f"""WITH {TURNS}, f AS (SELECT user_id, turn_id, count(*) n, max(t) - min(t) us, sum(pus) p, count(pus) np FROM i GROUP BY user_id, turn_id)
 SELECT user_id, count(*) num_turns, count(*) FILTER (n = 1) num_one_word_turns, CAST(sum(n) AS BIGINT) speech_length_words, CAST(sum(us) AS BIGINT) speech_us,
 {R('sum(n) * 6e7 / nullif(sum(us), 0)', 5)} words_per_min, {R('CAST(sum(p) AS DOUBLE) / nullif(sum(np) * 1e6, 0)', 3)} mean_pre_word_pause, {R('avg(n)', 6)} mean_turn_length_words FROM f GROUP BY user_id""")
def speech_summary(spark, sf_dir):
    f = _turn_words(spark, sf_dir).groupBy("user_id", "turn_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("us"), F.sum("pus").alias("p"), F.count("pus").alias("np"))
    return f.groupBy("user_id").agg(
        F.count("*").alias("num_turns"), F.count_if(F.col("n") == 1).alias("num_one_word_turns"), F.sum("n").alias("speech_length_words"), F.sum("us").alias("speech_us"),
        r(F.sum("n") * F.lit(6e7) / F.nullif(F.sum("us"), F.lit(0)), 5).alias("words_per_min"), r(F.sum("p").cast("double") / F.nullif(F.sum("np") * F.lit(1e6), F.lit(0.0)), 3).alias("mean_pre_word_pause"),
        r(F.avg("n"), 6).alias("mean_turn_length_words"),
    )


@query(f"""WITH {W}, l AS (SELECT *, t - lag(t) {P} - 3600000000 p, lag(event_type) {P} pe FROM w)
 SELECT user_id, event_id, CASE WHEN p < 0 THEN 0 ELSE p END pre_turn_pause, p <= 0 interrupt_flag FROM l WHERE pe IS DISTINCT FROM event_type""")
def interrupt_flag(spark, sf_dir):
    w = S.with_pause(words(spark, sf_dir), BY, ORDER, "t", "t", "_p").withColumn("_p", F.col("_p") - HOUR).withColumn("_pe", F.lag("event_type").over(S.in_order(BY, ORDER)))
    return w.where(~F.col("_pe").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", F.when(F.col("_p") < 0, F.lit(0)).otherwise(F.col("_p")).cast("long").alias("pre_turn_pause"), (F.col("_p") <= 0).alias("interrupt_flag"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def speaker_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'user' OR len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 20")
def min_turn_length(spark, sf_dir):
    n = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "conversations").where((F.col("role") != "user") | (n >= 20)).select("conv_id", "turn", "role")


@query("SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) content FROM conversations GROUP BY conv_id, role")
def speaker_text(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("content"))


@query(f"""WITH {TURNS}, g AS (SELECT user_id, turn_id, min(event_type) speaker, min(t) start_us, max(t) end_us, avg(value) c, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY t, event_id) words FROM i GROUP BY user_id, turn_id)
 SELECT user_id, CAST(turn_id AS BIGINT) turn_id, speaker, start_us, end_us, {R('c', 3)} confidence, words FROM g""")
def combine_turns(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("word", F.col("event_id").cast("string")).withColumns({"start_us": F.col("t"), "end_us": F.col("t")})
    got = S.combine_turns(w, BY, ORDER, "event_type", "word", "start_us", "end_us", "value")
    return got.select("user_id", "turn_id", F.col("event_type").alias("speaker"), "start_us", "end_us", r(F.col("value"), 3).alias("confidence"), F.col("word").alias("words"))


@query(f"WITH {W} SELECT user_id, count(DISTINCT event_type) speakers, {R('max(t) / 6e7', 2)} file_length_minutes FROM w GROUP BY user_id")
def file_facts(spark, sf_dir):
    return words(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("speakers"), r(F.max("t") / F.lit(6e7), 2).alias("file_length_minutes"))


# -- location -------------------------------------------------------------


def _segments(spark, sf_dir):
    w = S.in_order(BY, ORDER)
    e = I.spread(words(spark, sf_dir), BY)
    home = e.groupBy("user_id").agg(F.avg(F.col("value") / 1000).alias("hlat"), F.avg(F.col("k") / 1000).alias("hlon"))
    s = e.select(
        "user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), 1).otherwise(2).alias("status"), F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"),
        (F.col("value") / 1000).alias("lat0"), (F.col("k") / 1000).alias("lon0"), F.lead(F.col("value") / 1000).over(w).alias("lat1"), F.lead(F.col("k") / 1000).over(w).alias("lon1"),
    )
    return s.where("t1 > t0").join(home, "user_id")


def _window_stats(spark, sf_dir, width):
    p = I.split_by_window(_segments(spark, sf_dir), "t0", "t1", width)
    at = lambda a, b, share: F.col(a) + (F.col(b) - F.col(a)) * F.col(share)
    p = p.withColumns({"la": at("lat0", "lat1", "share_start"), "lo": at("lon0", "lon1", "share_start"), "lb": at("lat0", "lat1", "share_end"), "lp": at("lon0", "lon1", "share_end")})
    p = p.withColumns({"metres": I.great_circle(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), "home0": I.great_circle(F.col("la"), F.col("lo"), F.col("hlat"), F.col("hlon")), "home1": I.great_circle(F.col("lb"), F.col("lp"), F.col("hlat"), F.col("hlon"))})
    return I.with_empty_windows(I.window_stats(p, BY), BY, width)


def GC(a, b, c, d):
    return f"2 * 6.371e6 * asin(least(1e0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _stats_sql(width):
    return f"""{W}, home AS (SELECT user_id, avg(value / 1000) hlat, avg(k / 1000) hlon FROM w GROUP BY user_id),
 s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END status, t t0, lead(t) {P} t1, value / 1000 lat0, k / 1000 lon0, lead(value / 1000) {P} lat1, lead(k / 1000) {P} lon1 FROM w),
 b AS (SELECT s.*, unnest(range(t0 // {width}, (t1 - 1) // {width} + 1)) * {width} ws FROM s WHERE t1 > t0),
 c AS (SELECT *, greatest(t0, ws) c0, least(t1, ws + {width}) c1 FROM b),
 d AS (SELECT c.*, hlat, hlon, lat0 + (lat1 - lat0) * ((c0 - t0) / CAST(t1 - t0 AS DOUBLE)) la, lon0 + (lon1 - lon0) * ((c0 - t0) / CAST(t1 - t0 AS DOUBLE)) lo, lat0 + (lat1 - lat0) * ((c1 - t0) / CAST(t1 - t0 AS DOUBLE)) lb, lon0 + (lon1 - lon0) * ((c1 - t0) / CAST(t1 - t0 AS DOUBLE)) lp FROM c JOIN home USING (user_id)),
 e AS (SELECT *, {GC('la', 'lo', 'lb', 'lp')} metres, {GC('la', 'lo', 'hlat', 'hlon')} h0, {GC('lb', 'lp', 'hlat', 'hlon')} h1, (c1 - c0) / 3.6e9 hrs FROM d),
 g AS (SELECT user_id, ws, sum(hrs) ob, sum(CASE WHEN status = 1 THEN hrs ELSE 0 END) mo, sum(CASE WHEN status = 2 THEN hrs ELSE 0 END) pa, sum(round_even(metres, 0)) / 1000 di, sum(CASE WHEN (h0 + h1) / 2 <= 50 THEN hrs ELSE 0 END) ho, max(greatest(h0, h1)) hx, (sum(h0) + sum(h1)) / (2 * count(*)) hm FROM e GROUP BY user_id, ws),
 sp AS (SELECT user_id, unnest(range(min(ws), max(ws) + 1, {width})) ws FROM g GROUP BY user_id),
 st AS (SELECT sp.user_id, sp.ws window_start, ob, mo, pa, di, ho, hx, hm FROM sp LEFT JOIN g ON sp.user_id = g.user_id AND sp.ws = g.ws)"""


_STATS = [("ob", "observed_time", 5), ("mo", "move_time", 5), ("pa", "pause_time", 5), ("di", "dist_travelled", 2), ("ho", "home_time", 5), ("hx", "home_max_dist", 1), ("hm", "home_mean_dist", 1)]
_STATS_SQL = ", ".join(f"{R(a, d)} {b}" for a, b, d in _STATS)


@query(f"WITH {_stats_sql(HOUR)} SELECT user_id, window_start, {_STATS_SQL} FROM st")
def hourly_stats(spark, sf_dir):
    return _window_stats(spark, sf_dir, HOUR).select("user_id", "window_start", *[r(F.col(b), d).alias(b) for _, b, d in _STATS])


@query(f"WITH {_stats_sql(DAY)} SELECT user_id, window_start, {_STATS_SQL} FROM st")
def daily_stats(spark, sf_dir):
    return _window_stats(spark, sf_dir, DAY).select("user_id", "window_start", *[r(F.col(b), d).alias(b) for _, b, d in _STATS])


@query(f"WITH {_stats_sql(DAY)} SELECT user_id, count(*) no_days, {R('CASE WHEN count(ob) = count(*) THEN sum(ob) END', 4)} total_observed_time, {', '.join(f'{R(f"avg({a})", d - 1)} mean_{b}, {R(f"stddev_pop({a})", d - 1)} sd_{b}' for a, b, d in _STATS[1:4])} FROM st GROUP BY user_id")
def gps_summary(spark, sf_dir):
    got = A.day_summary(_window_stats(spark, sf_dir, DAY), BY, [b for _, b, _ in _STATS[1:4]])
    return got.select("user_id", "no_days", r(F.col("total_observed_time"), 4).alias("total_observed_time"), *[r(F.col(f"{m}_{b}"), d - 1).alias(f"{m}_{b}") for _, b, d in _STATS[1:4] for m in ("mean", "sd")])


@query(f"""WITH {W}, f AS (SELECT user_id, min(t) f, max(t) l FROM w GROUP BY user_id), h AS (SELECT user_id, (t - f) // {DAY} h, count(*) n, max((l - f) // {DAY} + 1) span FROM w JOIN f USING (user_id) GROUP BY ALL)
 SELECT user_id, count(*) FILTER (n > 2) good_windows, max(span) span_windows, count(*) FILTER (n > 2) >= 0.05 * max(span) passes FROM h GROUP BY user_id""")
def quality_gate(spark, sf_dir):
    got = I.quality_gate(words(spark, sf_dir), BY, "t", 2, 0.05, DAY)
    return got.select("user_id", F.col("good").alias("good_windows"), F.col("span").alias("span_windows"), "passes")


@query("SELECT event_id, hour(ts) BETWEEN 8 AND 19 AS is_day FROM events")
def day_night_split(spark, sf_dir):
    return words(spark, sf_dir).select("event_id", I.is_day(F.col("t")).alias("is_day"))


@query(f"WITH {W}, l AS (SELECT user_id, event_id, value / 1000 a, k / 1000 b, lag(value / 1000) {P} c, lag(k / 1000) {P} d FROM w) SELECT user_id, event_id, {R(GC('a', 'b', 'c', 'd'), 3)} metres_e3 FROM l")
def great_circle(spark, sf_dir):
    w, e = S.in_order(BY, ORDER), words(spark, sf_dir)
    d = I.great_circle(F.col("value") / 1000, F.col("k") / 1000, F.lag(F.col("value") / 1000).over(w), F.lag(F.col("k") / 1000).over(w))
    return e.select("user_id", "event_id", r(d, 3).alias("metres_e3"))


@query(f"WITH {W} SELECT user_id, count(*) FILTER (abs(value) > 90 OR abs(k) > 180) = 0 AS valid FROM w GROUP BY user_id")
def trajectory_range(spark, sf_dir):
    return words(spark, sf_dir).groupBy("user_id").agg(I.in_range("value", "k").alias("valid"))


# -- intervals, sessions, windows -----------------------------------------


@query(f"""WITH {W}, l AS (SELECT *, t - lag(t) {P} g FROM w), s AS (SELECT *, sum(CASE WHEN g <= {6 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) sid FROM l)
 SELECT user_id, CAST(sid AS BIGINT) session_id, count(*) n, min(t) first_us, max(t) last_us FROM s GROUP BY user_id, sid""")
def presence_sessions(spark, sf_dir):
    s = S.with_sessions(words(spark, sf_dir), BY, ORDER, "t", 6 * HOUR)
    return s.groupBy("user_id", "session_id").agg(F.count("*").alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))


@query("SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) ship_us FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def interval_containment_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.micros("l_shipdate").alias("start"), S.micros("l_shipdate").alias("end"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), S.micros("o_orderdate").alias("start_time"), (S.micros("o_orderdate") + 30 * DAY).alias("end_time"))
    return I.containment_join(items, spans, ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("start").alias("ship_us"))


@query("""SELECT a.c_custkey, a.o_orderkey, b.o_orderkey other_key FROM (SELECT o_custkey c_custkey, * FROM orders) a JOIN orders b ON a.o_custkey = b.o_custkey
 WHERE epoch_us(b.o_orderdate) BETWEEN epoch_us(a.o_orderdate) AND epoch_us(a.o_orderdate) + 86400000000 * 90""")
def range_join_bucketed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", S.micros("o_orderdate").alias("start_time"))
    inner = o.select("c_custkey", F.col("o_orderkey").alias("other_key"), F.col("start_time").alias("start"), F.col("start_time").alias("end"))
    return I.containment_join(inner, o.withColumn("end_time", F.col("start_time") + 90 * DAY), ["c_custkey"], 30 * DAY).select("c_custkey", "o_orderkey", "other_key")


_ROLL = "stddev_samp(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"WITH {W} SELECT user_id, event_id, {R(_ROLL.format(2), 3)} std3_e3, {R(_ROLL.format(9), 3)} std10_e3 FROM w")
def rolling_std(spark, sf_dir):
    got = S.with_rolling_std(S.with_rolling_std(words(spark, sf_dir), BY, ORDER, "value", 3, "s3"), BY, ORDER, "value", 10, "s10")
    return got.select("user_id", "event_id", r(F.col("s3"), 3).alias("std3_e3"), r(F.col("s10"), 3).alias("std10_e3"))


@query(f"WITH {W} SELECT user_id, event_id, {R(f'abs(value - lag(value) {P})', 4)} step_e4 FROM w")
def angle_delta(spark, sf_dir):
    return S.with_step(words(spark, sf_dir), BY, ORDER, "value").select("user_id", "event_id", r(F.col("step"), 4).alias("step_e4"))


@query(f"SELECT l_orderkey, l_linenumber, {R('(l_quantity - avg(l_quantity) OVER p) / stddev_samp(l_quantity) OVER p', 5)} z_e5 FROM lineitem WINDOW p AS (PARTITION BY l_returnflag)")
def zscore(spark, sf_dir):
    """The few groups are aggregated, partly on the map side, and joined back: no group has to fit into one task."""
    items = table(spark, sf_dir, "lineitem")
    got = A.zscore(items, ["l_returnflag"], "l_quantity")
    return got.select("l_orderkey", "l_linenumber", r(F.col("z"), 5).alias("z_e5"))


@query(f"WITH {W}, l AS (SELECT *, lag(value) {P} a, lead(value) {P} b FROM w) SELECT user_id, event_id FROM l WHERE value > a AND value > b")
def local_extrema(spark, sf_dir):
    return S.with_extremum(words(spark, sf_dir), BY, ORDER, "value").where("is_peak").select("user_id", "event_id")


_KNOWN = f"{W}, v AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END x, row_number() {P} n FROM w)"


@query(f"WITH {_KNOWN} SELECT user_id, event_id, {R('last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)', 4)} filled_e4 FROM v")
def ffill(spark, sf_dir):
    e = words(spark, sf_dir).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return S.with_ffill(e, BY, ORDER, "x").select("user_id", "event_id", r(F.col("filled"), 4).alias("filled_e4"))


_BACK, _AHEAD = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"""WITH {_KNOWN}, f AS (SELECT *, last_value(x IGNORE NULLS) {_BACK} v0, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) {_BACK} p0, first_value(x IGNORE NULLS) {_AHEAD} v1, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) {_AHEAD} p1 FROM v)
 SELECT user_id, event_id, {R('CASE WHEN x IS NOT NULL THEN x WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (n - p0) / (p1 - p0) END', 4)} filled_e4 FROM f""")
def interpolate_bbox(spark, sf_dir):
    e = words(spark, sf_dir).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return S.with_interpolation(e, BY, ORDER, "x").select("user_id", "event_id", r(F.col("filled"), 4).alias("filled_e4"))


# -- statistics -----------------------------------------------------------

_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(f"SELECT l_returnflag, {', '.join(f'{R(f"avg({c})", 3)} {c}_mean, {R(f"stddev_samp({c})", 3)} {c}_std' for c in _COLS)} FROM lineitem GROUP BY 1")
def framewise_summary(spark, sf_dir):
    got = A.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], _COLS)
    return got.select("l_returnflag", *[r(F.col(c), 3).alias(c) for c in got.columns[1:]])


@query(f"SELECT l_returnflag, {', '.join(f'{R(f"avg(nullif({c}, 0))", 3)} {c}_mean, {R(f"stddev_samp(nullif({c}, 0))", 3)} {c}_stddev, {R(f"max(nullif({c}, 0)) - min(nullif({c}, 0))", 3)} {c}_range' for c in _COLS)} FROM lineitem GROUP BY 1")
def nonzero_summary(spark, sf_dir):
    got = A.nonzero_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], _COLS)
    return got.select("l_returnflag", *[r(F.col(c), 3).alias(c) for c in got.columns[1:]])


@query(f"SELECT l_orderkey, l_linenumber, {R("(l_quantity + 1) / ((SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'R') + 1) - 1", 5)} ratio_e5 FROM lineitem")
def baseline_ratio(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    got = A.baseline_ratio(items, items.where("l_returnflag = 'R'"), ["l_quantity"])
    return got.select("l_orderkey", "l_linenumber", r(F.col("l_quantity"), 5).alias("ratio_e5"))


@query(f"""WITH {W}, l AS (SELECT user_id, CAST(t - lag(t) {P} AS DOUBLE) p FROM w), m AS (SELECT user_id, median(p) m FROM l GROUP BY 1)
 SELECT user_id, {R('any_value(m)', 0)} median_us, {R('median(abs(p - m))', 0)} mad_us FROM l JOIN m USING (user_id) GROUP BY 1""")
def silence_summary_mad(spark, sf_dir):
    p = S.with_pause(words(spark, sf_dir), BY, ORDER, "t", "t", "p").withColumn("p", F.col("p").cast("double"))
    return A.mad(p, BY, "p").select("user_id", r(F.col("median"), 0).alias("median_us"), r(F.col("mad"), 0).alias("mad_us"))


@query(f"""WITH m AS (SELECT l_returnflag, avg(l_quantity) m, stddev_pop(l_quantity) s FROM lineitem GROUP BY 1)
 SELECT l_returnflag, {R('avg(pow((l_quantity - m) / s, 3))', 5)} skewness_e5, {R('kurtosis_pop(l_quantity)', 5)} kurtosis_e5 FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def moments(spark, sf_dir):
    got = A.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return got.select("l_returnflag", r(F.col("skewness"), 5).alias("skewness_e5"), r(F.col("kurtosis"), 5).alias("kurtosis_e5"))


@query(f"SELECT l_returnflag, {R('stddev_pop(l_quantity) / nullif(avg(l_quantity), 0)', 5)} cv_e5 FROM lineitem GROUP BY 1")
def coef_variation(spark, sf_dir):
    return A.coefficient_of_variation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", r(F.col("cv"), 5).alias("cv_e5"))


@query(f"WITH {W} SELECT user_id, {R('100 * (1 - count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE))', 4)} unvoiced_e4 FROM w GROUP BY 1")
def unvoiced_pct(spark, sf_dir):
    return words(spark, sf_dir).groupBy("user_id").agg(r(A.unvoiced_share(F.col("value") - 50), 4).alias("unvoiced_e4"))


@query(f"WITH {W} SELECT user_id, {R('avg(value) FILTER (k > 50)', 4)} mean_speaking, {R('avg(value) FILTER (k <= 50)', 4)} mean_not_speaking, {R('stddev_samp(value) FILTER (k > 50)', 3)} std_speaking FROM w GROUP BY 1")
def speaking_split(spark, sf_dir):
    got = A.speaking_split(A.in_sequence(words(spark, sf_dir), BY, ORDER).withColumn("p", F.col("k") / 100), BY, "p", ["value"])
    return got.select("user_id", r(F.col("value_mean_speaking"), 4).alias("mean_speaking"), r(F.col("value_mean_not_speaking"), 4).alias("mean_not_speaking"), r(F.col("value_std_speaking"), 3).alias("std_speaking"))


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings)
 SELECT vec_id, {R('list_sum(e) / 64', 6)} overall_e6, {R('(e[2] + e[5] + e[5] + e[9]) / 4', 6)} lower_e6, {R('(list_sum(e) - e[2] - e[5] - e[9]) / 61', 6)} upper_e6 FROM v""")
def region_means(spark, sf_dir):
    e, low = F.col("embedding"), [1, 4, 4, 8]
    rest = [i for i in range(64) if i not in low]
    return table(spark, sf_dir, "embeddings").select("vec_id", r(A.region_mean(e, list(range(64))), 6).alias("overall_e6"), r(A.region_mean(e, low), 6).alias("lower_e6"), r(A.region_mean(e, rest), 6).alias("upper_e6"))


# -- text -----------------------------------------------------------------

_PUNCT = T.PUNCTUATION.replace("'", "''")
_TOK = f"list_filter(string_split_regex(lower(translate(text, '{_PUNCT}', '')), '\\s+'), lambda w: w <> '')"


def _mattr_sql(w, k):
    m = f"least({k}, len({w}))"
    return f"CAST(list_sum(list_transform(range(1, len({w}) - {m} + 2), lambda i: len(list_distinct({w}[i:i + {m} - 1])))) AS DOUBLE) / CAST({m} * (len({w}) - {m} + 1) AS DOUBLE)"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))


@query(f"WITH d AS (SELECT doc_id, {_TOK} w FROM documents) SELECT doc_id, {R('CASE WHEN len(w) >= 10 THEN pow(len(w), pow(len(list_distinct(w)), -0.172e0)) END', 5)} brunet_e5 FROM d")
def brunet(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", r(T.brunet(F.col("w")), 5).alias("brunet_e5"))


@query(f"""WITH d AS (SELECT doc_id, {_TOK} w FROM documents), u AS (SELECT doc_id, unnest(w) x FROM d), c AS (SELECT doc_id, x, count(*) n FROM u GROUP BY ALL),
 s AS (SELECT doc_id, CAST(sum(n) AS DOUBLE) n, CAST(count(*) AS DOUBLE) v, count(*) FILTER (n = 1) o FROM c GROUP BY 1)
 SELECT doc_id, {R('CASE WHEN n >= 10 AND o < v THEN 100 * ln(n) / (1 - o / v) END', 4)} honore_e4 FROM documents LEFT JOIN s USING (doc_id)""")
def honore(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", r(T.honore(F.col("w")), 4).alias("honore_e4"))


@query(f"WITH d AS (SELECT conv_id, turn, {_TOK} w FROM conversations) SELECT conv_id, turn, {', '.join(f'{R(_mattr_sql("w", k), 6)} mattr_{k}' for k in (5, 10, 25, 50, 100))} FROM d")
def mattr(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    d = d.select("conv_id", "turn", T.occurrences(F.col("w")).alias("o"))
    return d.select("conv_id", "turn", *[r(T.mattr_of(F.col("o"), k), 6).alias(f"mattr_{k}") for k in (5, 10, 25, 50, 100)])


_PHR = f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda p: trim(lower(translate(p, '{_PUNCT}', '')))), lambda p: p <> '')"


def _rep_sql(w, k, none="0e0"):
    return f"CASE WHEN len({w}) = 0 THEN {none} ELSE 100 * (1 - {_mattr_sql(w, k)}) END"


@query(f"WITH d AS (SELECT conv_id, turn, {_TOK} w, {_PHR} p FROM conversations) SELECT conv_id, turn, {R(_rep_sql('w', 10), 4)} word_repeat_e4, {R(_rep_sql('p', 3, 'NULL'), 4)} phrase_repeat_e4 FROM d")
def repetition(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"), T.phrases(F.col("text")).alias("p"))
    return d.select("conv_id", "turn", r(F.coalesce(T.repetition(F.col("w"), 10), F.lit(0.0)), 4).alias("word_repeat_e4"), r(T.repetition(F.col("p"), 3), 4).alias("phrase_repeat_e4"))


_IN = lambda lex: f"len(list_filter(w, lambda x: x IN ({', '.join(map(repr, lex))})))"


_WRITTEN = _TOK.replace("lower(translate", "(translate")


@query(f"WITH d AS (SELECT doc_id, {_WRITTEN} w FROM documents) SELECT doc_id, {R(f'100 * {_IN(T.FIRST_PERSON)} / CAST(nullif({_IN(T.PRONOUNS).replace("x IN", "lower(x) IN")}, 0) AS DOUBLE)', 4)} first_person_e4 FROM d")
def first_person_pct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_words(F.col("text")).alias("w")).select("doc_id", r(T.first_person_share(F.col("w")), 4).alias("first_person_e4"))


@query("""WITH w AS (SELECT conv_id, turn, role, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') ws FROM conversations)
 SELECT conv_id, string_agg('<spk:' || role || '> ' || array_to_string(ws, ' '), ' ' ORDER BY turn) diarized FROM w GROUP BY 1""")
def diarized_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " ").alias("ws"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "ws")))
    one = c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.flatten(F.transform("t", lambda t: t["ws"])).alias("words"), F.flatten(F.transform("t", lambda t: F.transform(t["ws"], lambda _: t["role"]))).alias("spk"))
    return one.select("conv_id", T.diarized(F.col("words"), F.col("spk")).alias("diarized"))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') ws FROM documents),
 c AS (SELECT doc_id, ws, list_reduce(list_transform(ws, lambda w: {'used': length(w) + 1, 'seen': 1, 'starts': CAST([0] AS INT[])}),
  lambda a, x: CASE WHEN a.used + x.used > 2250 THEN {'used': x.used, 'seen': a.seen + 1, 'starts': list_append(a.starts, a.seen)} ELSE {'used': a.used + x.used, 'seen': a.seen + 1, 'starts': a.starts} END).starts s FROM d WHERE len(ws) > 0),
 e AS (SELECT doc_id, ws, unnest(s) a, unnest(list_append(s[2:], len(ws))) b, unnest(range(0, len(s))) chunk FROM c)
 SELECT doc_id, CAST(chunk AS INT) chunk, CAST(b - a AS INT) n_words, CAST(length(array_to_string(ws[a + 1:b], ' ')) AS INT) n_chars FROM e""")
def prompt_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\\s+"), lambda w: w != "").alias("w"))
    c = d.select("doc_id", "w", T.chunk_starts(F.col("w")).alias("at"))
    end = F.coalesce(F.get("at", F.col("chunk") + 1), F.size("w"))
    each = c.select("doc_id", "w", "at", F.posexplode("at").alias("chunk", "start"))
    return each.select("doc_id", "chunk", (end - F.col("start")).alias("n_words"), F.length(F.array_join(F.slice("w", F.col("start") + 1, end - F.col("start")), " ")).alias("n_chars"))


@query("SELECT event_id, replace(replace(event_type, 'click', 'speaker0'), 'view', 'speaker1') AS label, regexp_replace(lower(event_type), '[^a-z]', '', 'g') AS plain FROM events")
def label_rewrite(spark, sf_dir):
    raw = F.when(F.col("event_type") == "click", "spk_0").when(F.col("event_type") == "view", "SPEAKER_01").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.speaker_label(raw).alias("label"), T.plain(F.col("event_type")).alias("plain"))


# -- vectors --------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v, row_number() OVER (PARTITION BY label ORDER BY vec_id) n, count(*) OVER (PARTITION BY label) c FROM embeddings)"
_COS = lambda a, b: f"list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _lag_sims(df: DataFrame, lags: range, by="label", order="vec_id") -> DataFrame:
    """Cosine with the k-th next vector of the recording, for each k; one sort for all."""
    w = S.in_order([by], [order])
    ahead = df.withColumns({f"_v{k}": F.lead("v", k).over(w) for k in lags})
    return ahead.withColumns({f"s{k}": V.cosine(F.col("v"), F.col(f"_v{k}")) for k in lags}).drop(*[f"_v{k}" for k in lags])


@query(f"""WITH {_E}, p AS (SELECT a.vec_id, a.label, a.n, a.c, b.n - a.n k, {_COS('a.v', 'b.v')} s FROM e a JOIN e b ON a.label = b.label AND b.n - a.n BETWEEN -10 AND 10)
 SELECT label, vec_id, {R('max(s) FILTER (k = -1)', 6)} coherence, {R('CASE WHEN any_value(c) > 5 AND count(*) FILTER (abs(k) <= 2) = 5 THEN avg(s) FILTER (abs(k) <= 2) END', 6)} coherence_5,
 {R('CASE WHEN any_value(c) > 10 AND count(*) FILTER (abs(k) <= 5) = 11 THEN avg(s) FILTER (abs(k) <= 5) END', 6)} coherence_10, {', '.join(f'{R(f"max(s) FILTER (k = {k})", 6)} variability_{k}' for k in range(2, 11))} FROM p GROUP BY 1, 2""")
def word_coherence(spark, sf_dir):
    b = S.with_coherence(_vectors(spark, sf_dir), ["label"], ["vec_id"], "v")
    return b.select("label", "vec_id", *[r(F.col(c), 6).alias(c) for c in ("coherence", "coherence_5", "coherence_10", *[f"variability_{k}" for k in range(2, 11)])])


@query(f"""WITH {_E}, p AS (SELECT a.label, a.n, {_COS('a.v', 'b.v')} s FROM e a JOIN e b ON a.label = b.label AND b.n - a.n = -1)
 SELECT label, {R('avg(s)', 6)} mean_e6, {R('var_samp(s)', 6)} var_e6, {R('regr_slope(s, CAST(n AS DOUBLE))', 7)} slope_e7 FROM p GROUP BY 1""")
def coherence_summary(spark, sf_dir):
    s = _lag_sims(_vectors(spark, sf_dir), range(1, 2)).where("s1 is not null")
    slope = A.slope(s, ["label"], ["vec_id"], "s1")
    return s.groupBy("label").agg(r(F.avg("s1"), 6).alias("mean_e6"), r(F.var_samp("s1"), 6).alias("var_e6")).join(slope, "label").select("label", "mean_e6", "var_e6", r(F.col("slope"), 7).alias("slope_e7"))


@query(f"""WITH {_E}, p AS (SELECT a.label, b.n - a.n k, {_COS('a.v', 'b.v')} s FROM e a JOIN e b ON a.label = b.label AND b.n - a.n IN (1, 2))
 SELECT label, {R('avg(s) FILTER (k = 1)', 6)} first_order_e6, {R('avg(s) FILTER (k = 2)', 6)} second_order_e6 FROM p GROUP BY 1""")
def phrase_tangentiality(spark, sf_dir):
    return _lag_sims(_vectors(spark, sf_dir), range(1, 3)).groupBy("label").agg(r(F.avg("s1"), 6).alias("first_order_e6"), r(F.avg("s2"), 6).alias("second_order_e6"))


@query(f"WITH {_E} SELECT a.label, a.vec_id, {R('sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))', 5)} displacement_e5 FROM e a LEFT JOIN e b ON a.label = b.label AND b.n = a.n - 1")
def displacement(spark, sf_dir):
    return S.with_displacement(_vectors(spark, sf_dir), ["label"], ["vec_id"], "v").select("label", "vec_id", r(F.col("displacement"), 5).alias("displacement_e5"))


@query(f"""WITH {_E}, t AS (SELECT v tv, n tn FROM e WHERE label = 0 AND n <= 16), s AS (SELECT vec_id, label, {_COS('v', 'tv')} s, row_number() OVER (PARTITION BY vec_id ORDER BY {_COS('v', 'tv')} DESC, tn) k FROM e, t),
 m AS (SELECT vec_id, label, avg(s) s FROM s WHERE k <= 5 GROUP BY 1, 2) SELECT label, {R('avg(s)', 6)} score_e6 FROM m GROUP BY 1""")
def top5_match(spark, sf_dir):
    """Mean of each vector's five best similarities with a script of 16 sentences, a table of bounded size that is broadcast."""
    v = _vectors(spark, sf_dir)
    script = v.where("label = 0").orderBy("vec_id").limit(16).agg(F.collect_list("v").alias("script"))
    best = v.join(F.broadcast(script)).withColumn("sims", F.sort_array(F.transform("script", lambda t: V.cosine(F.col("v"), t)), False))
    return best.withColumn("s", F.aggregate(F.slice("sims", 1, 5), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(5), F.size("sims"))).groupBy("label").agg(r(F.avg("s"), 6).alias("score_e6"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings)"
_ROT = "(cos(y) * cos(r) + (cos(p) * cos(r) - sin(p) * sin(y) * sin(r)) + cos(p) * cos(y) - 1) / 2"


@query(f"WITH {_V}, a AS (SELECT vec_id, radians(e[1] * 90) p, radians(e[2] * 90) y, radians(e[3] * 90) r FROM v) SELECT vec_id, {R(f'degrees(acos(greatest(-1e0, least(1e0, {_ROT}))))', 3)} angle_e3 FROM a")
def rotation_angle(spark, sf_dir):
    e = lambda i: F.get(F.col("v"), F.lit(i)) * 90
    return _vectors(spark, sf_dir).select("vec_id", r(V.rotation_angle(e(0), e(1), e(2)), 3).alias("angle_e3"))


_D = lambda i, j: f"sqrt(pow(e[{2 * i - 1}] - e[{2 * j - 1}], 2) + pow(e[{2 * i}] - e[{2 * j}], 2))"


@query(f"WITH {_V} SELECT vec_id, {R(f'({_D(2, 6)} + {_D(3, 5)}) / nullif(2 * {_D(1, 4)}, 0)', 4)} ear_e4 FROM v")
def eye_aspect_ratio(spark, sf_dir):
    p = [(F.get(F.col("v"), F.lit(2 * i)), F.get(F.col("v"), F.lit(2 * i + 1))) for i in range(6)]
    return _vectors(spark, sf_dir).select("vec_id", r(V.eye_aspect_ratio(p), 4).alias("ear_e4"))


@query(f"WITH {_V} SELECT vec_id, {R('abs(e[1]) / nullif(least(abs(e[2]), abs(e[3])), 0)', 2)} openness_e2 FROM v")
def mouth_openness(spark, sf_dir):
    e = lambda i: F.abs(F.get(F.col("v"), F.lit(i)))
    return _vectors(spark, sf_dir).select("vec_id", r(V.mouth_openness(e(0), e(1), e(2)), 2).alias("openness_e2"))


# -- JSON, set operations, sampling ---------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.where("p.k > 50").select("event_id", "p.k")


@query("SELECT event_id, CASE WHEN json_extract(props, '$.jobName') IS NOT NULL AND json_extract(props, '$.results') IS NOT NULL THEN 'aws' WHEN json_extract(props, '$.segments[0].words') IS NOT NULL THEN 'whisper' ELSE 'vosk' END dialect FROM events")
def transcript_dialect(spark, sf_dir):
    from ..sources.transcripts import dialect

    return table(spark, sf_dir, "events").select("event_id", dialect(F.col("props")).alias("dialect"))


@query("SELECT n_name AS name, 'nation' AS file FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def union_files(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("file")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("file")))


@query("(SELECT c_nationkey AS nationkey, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'no_customer' FROM nation EXCEPT SELECT c_nationkey, 'no_customer' FROM customer)")
def set_ops(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("nationkey")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(n.subtract(c).withColumn("kind", F.lit("no_customer")))


@query("SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def semi_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return table(spark, sf_dir, "labels").join(d.where("n_chars > 500").select("doc_id"), "doc_id", "left_semi").join(d.where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select("doc_id", "toxic")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 n FROM events) WHERE n % 11 = 0")
def frame_sampling(spark, sf_dir):
    w = words(spark, sf_dir)
    n = w.withColumn("frame", F.row_number().over(S.in_order(BY, ORDER)) - 1)
    return S.sampled_frames(n, "frame", 30, 3, "landmarks").select("user_id", "event_id")


@query(f"WITH {W}, l AS (SELECT user_id, event_id, value, row_number() {P} n FROM w) SELECT user_id, any_value(1) AS tie, {R('regr_slope(value, CAST(n AS DOUBLE))', 3)} slope_e3 FROM l GROUP BY user_id")
def trend_slope(spark, sf_dir):
    return A.slope(words(spark, sf_dir), BY, ORDER, "value").select("user_id", F.lit(1).alias("tie"), r(F.col("slope"), 3).alias("slope_e3"))


@query(f"WITH {W}, h AS (SELECT DISTINCT user_id, t // {HOUR} h FROM w) SELECT user_id, count(*) AS n_hours, min(h) AS first_hour FROM h GROUP BY 1")
def rollup_hours(spark, sf_dir):
    return words(spark, sf_dir).select("user_id", F.expr(f"t div {HOUR}").alias("h")).distinct().groupBy("user_id").agg(F.count("*").alias("n_hours"), F.min("h").alias("first_hour"))
