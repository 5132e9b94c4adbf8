"""The queries over the driver's tables, and their SQL.

Stand-ins: hourly means of ``events.value`` are the stimulus, ``embeddings`` the 64-channel
response (time is vec_id), labels or event types the subjects and phones.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import BANDS, Config
from tideline.functions import signal
from tideline.functions.text import normalize_text
from tideline.functions.trf import Options
from tideline.operators import analysis as A
from tideline.operators import events as E
from tideline.operators import model as M
from tideline.operators import reduce as R
from tideline.operators import series as S
from tideline.plans.scratch import new_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = " ".join(sql.split())
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n) + F.lit(0.0)


def hours(spark: SparkSession, d: str) -> DataFrame:
    """(t, x): the mean of each hour up to the last event's, 0 where there is none."""
    t = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    rows = _read(spark, d, "events").select(t.alias("t"), "value")
    last = rows.agg(F.max("t")).first()[0]
    return S.dense(rows.groupBy("t").agg(F.avg("value").alias("x")), 0 if last is None else last + 1, "x")


def channels(spark: SparkSession, d: str) -> DataFrame:
    """(t, channel, y): the response, a row for each channel."""
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("channel", "y"))
    return e.select("t", "channel", F.col("y").cast("double").alias("y"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(series, t, x, y array): stimulus and response on their common times."""
    y = _read(spark, d, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("y"))
    return M.joined(hours(spark, d).withColumn("series", F.lit(0)), y.withColumn("series", F.lit(0)), ["series"])


_T0 = "(select unnest(range(cast((select max(floor(epoch(ts - timestamp '2024-01-01') / 3600)) + 1 from events) as bigint))) as t)"
_H = f"""with g as {_T0},
m as (select cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as t, avg(value) as v from events group by 1),
s as (select g.t, coalesce(m.v, 0) as x from g left join m using (t))"""
_C = "c as (select vec_id as t, generate_subscripts(embedding, 1) - 1 as channel, cast(unnest(embedding) as double) as y from embeddings)"


@_query(_H + """ select s.t, d.d, round(coalesce(p.x, 0), 6) + 0 as x from s cross join (select unnest([-2, -1, 0, 1, 2, 3]) as d) d left join s p on p.t = s.t - d.d""")
def lag_design(spark, d):
    return S.lag_window(hours(spark, d), "x", [-2, -1, 0, 1, 2, 3], []).select("t", "d", _r("x").alias("x"))


@_query(_H + """ select s.t, round(coalesce(a.x, 0), 6) + 0 as back, round(s.x, 6) + 0 as now, round(coalesce(b.x, 0), 6) + 0 as ahead from s left join s a on a.t = s.t - 70 left join s b on b.t = s.t + 25""")
def lag_features_arrow(spark, d):
    one = S.lag_features(hours(spark, d), "x", [int(k) for k in Config().delays], [])
    at = lambda k: _r(F.col("x")[k + 26])
    return one.select("t", at(70).alias("back"), at(0).alias("now"), at(-25).alias("ahead"))


@_query(_H + " select t, cast(ntile(5) over (order by t) - 1 as integer) as fold from s")
def kfold_assign(spark, d):
    return S.kfold(hours(spark, d), 5, []).select("t", "fold")


@_query(_H + """, f as (select *, ntile(5) over (order by t) - 1 as fold from s), k as (select unnest(range(5)) as k),
r as (select k, t, x, row_number() over (partition by k order by t) as n, count(*) over (partition by k) as c from f join k on fold <> k)
select cast(k as integer) as test_fold, t, case when n <= floor(c * 0.8) then 'train' else 'validate' end as part from r""")
def inner_split(spark, d):
    rows = S.kfold(hours(spark, d), 5, []).withColumn("live", F.lit(True))
    return S.inner_split(rows, [], 5).select("test_fold", "t", "part")


@_query(_H + " select t, round((x - avg(x) over ()) / (stddev_pop(x) over () + 1e-12), 6) + 0 as x from s")
def standardize_series(spark, d):
    return S.standardize(hours(spark, d), "x", []).select("t", _r("x").alias("x"))


@_query(_H + """, f as (select *, ntile(5) over (order by t) - 1 as fold from s), k as (select unnest(range(5)) as k),
st as (select k, avg(x) as m, stddev_pop(x) as sd from f join k on fold <> k group by k)
select cast(fold as integer) as fold, t, round((x - m) / (sd + 1e-12), 6) + 0 as x from f join st on fold = k""")
def standardize_by_fold(spark, d):
    return S.standardize_by_fold(S.kfold(hours(spark, d), 5, []), "x", []).select("fold", "t", _r("x").alias("x"))


@_query(_H + " select t, round(2 * (x - min(x) over ()) / (max(x) over () - min(x) over () + 1e-12) - 1, 6) + 0 as x from s")
def normalize_series(spark, d):
    return S.normalize(hours(spark, d), "x", [], to="2").select("t", _r("x").alias("x"))


@_query(_H + """, n as (select cast(floor((5 * count(*) - 1) / 100) as bigint) as n, count(*) as c from s),
o as (select x, row_number() over (order by x) as i from s),
b as (select max(case when i = n + 1 then x end) as lo, max(case when i = c - n then x end) as hi from o cross join n)
select t, round((x - lo) / (hi - lo + 1e-12), 6) + 0 as x from s cross join b""")
def normalize_percent(spark, d):
    return S.normalize_percent(hours(spark, d), "x", []).select("t", _r("x").alias("x"))


@_query(_H + """, l as (select t, ntile(5) over (order by t) - 1 as fold, coalesce(lead(x) over (order by t), 0) as x0, x as x1, coalesce(lag(x) over (order by t), 0) as x2 from s),
u as (select fold, unnest([0, 1, 2]) as i, unnest([x0, x1, x2]) as v, t from l)
select cast(a.fold as integer) as fold, a.i as i, b.i as j, round(sum(a.v * b.v), 4) + 0 as xx from u a join u b on a.t = b.t and a.fold = b.fold group by 1, 2, 3""")
def gram_blocks(spark, d):
    lags = S.lag_features(hours(spark, d), "x", [-1, 0, 1], [])
    v = lambda i: F.col("x")[i]
    sums = S.kfold(lags, 5, []).groupBy("fold").agg(*(F.sum(v(i) * v(j)).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)))
    flat = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), _r(f"s{min(i, j)}{max(i, j)}", 4).alias("xx")) for i in range(3) for j in range(3)))
    return sums.select("fold", F.inline(flat))


_ONE = _H + ", " + _C + """, l as (select t, coalesce(lag(x) over (order by t), 0) as x from s),
j as (select c.t, channel, l.x, y, ntile(5) over (partition by channel order by c.t) - 1 as fold from c join l using (t)),
k as (select unnest(range(5)) as k),
tr as (select k, channel, avg(x) as mx, stddev_pop(x) + 1e-12 as sx, avg(y) as my, stddev_pop(y) + 1e-12 as sy, count(*) as n, covar_pop(x, y) as cxy, var_pop(x) as vx from j join k on fold <> k where x <> 0 group by 1, 2),
w as (select *, (n * cxy / (sx * sy)) / (n * vx / (sx * sx) + 1.0) as w from tr)"""


@_query(_ONE + " select cast(k as integer) as fold, cast(channel as integer) as channel, round(w, 6) + 0 as w from w")
def ridge_1lag(spark, d):
    return M.fit(pairs(spark, d), ["series"], 1.0, Options((1,))).select("fold", "channel", _r(F.col("w")[0]).alias("w"))


@_query(_ONE + """, p as (select k, j.channel, (x - mx) / sx * w as p, (y - my) / sy as y from j join w on fold = k and j.channel = w.channel),
r as (select k, channel, covar_pop(p, y) / (stddev_samp(p) * stddev_samp(y)) as r from p group by 1, 2)
select cast(channel as integer) as channel, round(avg(r), 6) + 0 as r_mean, round(stddev_pop(r), 6) + 0 as r_std from r group by 1""")
def trf_correlation_1lag(spark, d):
    fits = M.fit(pairs(spark, d), ["series"], 1.0, Options((1,)))
    return R.fold_mean(fits, ["channel"], "r", fill=True).select("channel", _r("r_mean").alias("r_mean"), _r("r_std").alias("r_std"))


@_query(_H + ", " + _C + """, l as (select t, x as x1, coalesce(lag(x) over (order by t), 0) as x2 from s),
j as (select c.t, channel, x1, x2, y, ntile(5) over (partition by channel order by c.t) - 1 as fold from c join l using (t)), k as (select unnest(range(5)) as k),
z as (select k, channel, stddev_pop(x1) + 1e-12 as s1, stddev_pop(x2) + 1e-12 as s2, stddev_pop(y) + 1e-12 as sy, count(*) as n, var_pop(x1) as a, var_pop(x2) as b, covar_pop(x1, x2) as c, covar_pop(x1, y) as u, covar_pop(x2, y) as v from j join k on fold <> k where x1 <> 0 or x2 <> 0 group by 1, 2),
q as (select k, channel, n * a / (s1 * s1) + 10 as a, n * b / (s2 * s2) + 10 as b, n * c / (s1 * s2) as c, n * u / (s1 * sy) as u, n * v / (s2 * sy) as v from z)
select cast(k as integer) as fold, cast(channel as integer) as channel, round((u * b - v * c) / (a * b - c * c), 6) + 0 as w0, round((v * a - u * c) / (a * b - c * c), 6) + 0 as w1 from q""")
def ridge_2lag(spark, d):
    return M.fit(pairs(spark, d), ["series"], 10.0, Options((0, 1))).select("fold", "channel", _r(F.col("w")[0]).alias("w0"), _r(F.col("w")[1]).alias("w1"))


@_query()
def trf_fit_full(spark, d):
    o = Options(tuple(range(-2, 6)))
    _, trfs = M.run_analysis(pairs(spark, d), ["series"], None, o)
    return trfs.select("channel", "feature", "delay", _r("w_mean").alias("w"))


@_query()
def ridge_laplacian(spark, d):
    o = Options(tuple(range(-2, 6)), solver="ridge-laplacian")
    return R.fold_mean(M.fit(pairs(spark, d), ["series"], 1.0, o), ["channel"], "r", fill=True).select("channel", _r("r_mean").alias("r_mean"), _r("r_std").alias("r_std"))


@_query()
def alpha_sweep(spark, d):
    out = M.sweep(pairs(spark, d), ["series"], [float(a) for a in Config().alphas], Options(tuple(range(-2, 6))))
    return out.select(_r("alpha").alias("alpha"), *(_r(c).alias(c) for c in ("r", "r_std", "r_train")))


@_query()
def alpha_chosen(spark, d):
    return M.select(pairs(spark, d), ["series"], [float(a) for a in Config().alphas], Options(tuple(range(-2, 6)))).select(_r("alpha").alias("alpha"))


@_query()
def permutation_null(spark, d):
    o = Options((0, 1))
    null = M.null_scores(pairs(spark, d), ["series"], 1.0, o, times=100)
    return M.p_values(M.fit(pairs(spark, d), ["series"], 1.0, o), null, ["fold", "channel"])


def curve(spark, d):
    """(subject, alpha, r, r_train): a curve over 12 penalties for each event type."""
    e = _read(spark, d, "events")
    k = F.col("user_id") % 12
    return e.groupBy(F.col("event_type").alias("subject"), F.pow(F.lit(10.0), k - 4.0).alias("alpha")).agg((F.avg("value") / 100).alias("r"), (F.max("value") / 200).alias("r_train"))


_K = "with q as (select event_type as subject, pow(10.0, user_id % 12 - 4.0) as alpha, avg(value) / 100 as r, max(value) / 200 as r_train from events group by 1, 2)"


@_query(_K + """, b as (select *, max(r) over (partition by subject) as best from q)
select subject, round(coalesce(max(case when abs((best - r) / nullif(best, 0)) < 0.05 then alpha end), 1.0), 6) as alpha from b group by 1""")
def alpha_select(spark, d):
    return M.select_alpha(curve(spark, d), ["subject"], 0.05).select("subject", _r("alpha").alias("alpha"))


@_query(_K + " select subject, round(pow(10.0, median(log10(alpha))), 6) as alpha from q where r > 0 group by 1")
def median_alpha(spark, d):
    return M.median_alpha(curve(spark, d).where("r > 0"), ["subject"]).select("subject", _r("alpha").alias("alpha"))


@_query(_K + """, g as (select *, greatest(0.0, r_train - r) as gap from q)
select subject, round(alpha, 6) as alpha, round(100 * (r - r_train) / nullif(r_train, 0), 5) + 0 as gap_percent, round(r - 1.5 * gap, 6) + 0 as penalised,
round((r - min(r) over w) / nullif(max(r) over w - min(r) over w, 0) - 1.5 * gap / (max(gap) over w + 1e-10), 6) + 0 as normalised from g window w as (partition by subject)""")
def selection_curves(spark, d):
    out = M.selection_curves(curve(spark, d), ["subject"])
    return out.select("subject", _r("alpha").alias("alpha"), _r("gap_percent", 5).alias("gap_percent"), _r("penalised").alias("penalised"), _r("normalised").alias("normalised"))


@_query(_K + " , n as (select subject, alpha, row_number() over (partition by subject order by alpha) - 1 as i from q), o as (select *, row_number() over (partition by subject order by abs(alpha - 3.0), i) as k from n) select subject, round(alpha, 6) as alpha, i from o where k = 1")
def nearest_alpha(spark, d):
    grid = curve(spark, d).select("subject", F.expr("row_number() over (partition by subject order by alpha) - 1").alias("i"), "alpha")
    return M.nearest_alpha(grid, F.lit(3.0), ["subject"]).select("subject", _r("alpha").alias("alpha"), F.col("i").cast("long").alias("i"))


@_query("""select event_type, cast(user_id % 5 as integer) as cell, round(coalesce(avg(case when user_id % 7 <> 0 then value end), 0), 6) + 0 as r_mean,
round(coalesce(stddev_pop(case when user_id % 7 <> 0 then value end), 0), 6) + 0 as r_std from events group by 1, 2""")
def fold_aggregate_nan(spark, d):
    e = _read(spark, d, "events").select("event_type", (F.col("user_id") % 5).cast("int").alias("cell"), F.when(F.col("user_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("r"))
    return R.fold_mean(e, ["event_type", "cell"], "r", fill=True).select("event_type", "cell", _r("r_mean").alias("r_mean"), _r("r_std").alias("r_std"))


def responses(spark, d):
    """(channel, subject, delay, w): mean response of each label at ten places."""
    e = _read(spark, d, "embeddings").select(F.col("label").alias("subject"), (F.col("vec_id") % 10).alias("delay"), F.posexplode("embedding").alias("channel", "w"))
    return e.groupBy("channel", "subject", "delay").agg(F.avg(F.col("w").cast("double")).alias("w"))


_T = """with c as (select label as subject, vec_id % 10 as delay, generate_subscripts(embedding, 1) - 1 as channel, cast(unnest(embedding) as double) as w from embeddings),
a as (select channel, subject, delay, avg(w) as w from c group by 1, 2, 3)"""


@_query(_T + """, p as (select x.channel, abs(covar_pop(x.w, y.w) / nullif(stddev_pop(x.w) * stddev_pop(y.w), 0)) as r from a x join a y on x.channel = y.channel and x.delay = y.delay and x.subject > y.subject group by x.channel, x.subject, y.subject)
select cast(channel as integer) as channel, round(avg(r), 6) + 0 as similarity from p group by 1""")
def subject_similarity(spark, d):
    return R.similarity(responses(spark, d), ["channel"], "subject", "delay", "w").select("channel", _r("similarity").alias("similarity"))


@_query("with " + _C + " select t, round(stddev_pop(y), 6) + 0 as gfp from c group by t")
def gfp(spark, d):
    return R.field_power(channels(spark, d), ["t"], "y").select("t", _r("gfp").alias("gfp"))


@_query("with " + _C + " select t, round(avg(y), 6) + 0 as mean, round(stddev_samp(y) / sqrt(count(*)), 6) + 0 as sem from c group by t")
def sem_curve(spark, d):
    return R.mean_error(channels(spark, d), ["t"], "y").select("t", _r("mean").alias("mean"), _r("sem").alias("sem"))


@_query("with " + _C + """, g as (select t, stddev_pop(y) as gfp from c group by t), w as (select *, lag(gfp) over (order by t) as b, lead(gfp) over (order by t) as a, max(gfp) over () as top from g)
select t, round(gfp, 6) as gfp from w where gfp > b and gfp > a and gfp >= 0.1 * top""")
def gfp_maxima(spark, d):
    g = R.field_power(channels(spark, d), ["t"], "y").withColumn("series", F.lit(0))
    return R.find_peaks(g, ["series"], "gfp", gap_s=0.0, flat=False).select("t", _r("gfp").alias("gfp"))


@_query()
def gfp_peaks(spark, d):
    g = R.field_power(channels(spark, d), ["t"], "y").withColumn("series", F.lit(0))
    return R.find_peaks(g, ["series"], "gfp").select("t", _r("gfp").alias("gfp"))


@_query()
def cluster_order(spark, d):
    rows = responses(spark, d).groupBy("channel", "subject").agg(F.map_from_entries(F.collect_list(F.struct("delay", "w"))).alias("m"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))
    rows = rows.withColumn("w", F.transform(places, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))))
    return R.cluster_order(rows, ["channel"], "subject", "w")


@_query("with " + _C + " select cast(channel as integer) as channel, coalesce(stddev_pop(y), 0) = 0 or avg(case when abs(y) < 0.001 then 1 else 0 end) > 0.5 as skip from c group by 1")
def map_rule(spark, d):
    return R.map_rule(channels(spark, d), ["channel"], "y")


@_query("""select event_id from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where event_type = 'click' and b <> 'click'""")
def rising_edges(spark, d):
    return E.rising_edges(_read(spark, d, "events"), F.col("event_type") == "click", ["user_id"], ["ts", "event_id"]).select("event_id")


@_query(f"""with s as {_T0}, k as (select range * 50 + 5 as a, range * 50 + 30 as b from range(14)),
m as (select t, coalesce(bool_or(t >= a and t < b), false) as busy from s cross join k group by t), w as (select *, lag(t) over (order by t) as p, case when busy <> lag(busy) over (order by t) then 1 else 0 end as f from m),
r as (select *, sum(f) over (order by t) as run from w) select coalesce(arg_min(p, t), min(t)) as onset, max(t) as "offset" from r where not busy group by run""")
def gap_intervals(spark, d):
    samples = hours(spark, d).select(F.col("t").alias("time"))
    tasks = spark.range(14).select((F.col("id") * 50 + 5).alias("onset"), (F.col("id") * 50 + 30).alias("offset"))
    return E.gaps(samples, tasks, [])


@_query("""with i as (select range as segment, range * 37.0 as onset, 20.0 as dur from range(13)) select vec_id as t, segment from embeddings join i on vec_id >= onset and vec_id < onset + dur""")
def interval_crop(spark, d):
    i = spark.range(13).select(F.col("id").alias("segment"), (F.col("id") * 37.0).alias("onset"), F.lit(20.0).alias("duration"))
    return E.crop(_read(spark, d, "embeddings").select(F.col("vec_id").alias("t")), i, [], width=64.0).select("t", "segment")


@_query("""with w as (select event_id, epoch(ts - timestamp '2024-01-01') / 3600.0 as b, epoch(ts - timestamp '2024-01-01') / 3600.0 + user_id % 4 as e from events)
select event_id, cast(floor(b / 3.5) as bigint) as win from w where e <= (floor(b / 3.5) + 1) * 3.5 union all
select event_id, cast(floor(b / 3.5) as bigint) - 1 from w where b = e and b > 0 and b = floor(b / 3.5) * 3.5""")
def contained_words(spark, d):
    hour = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6 / 3600.0
    words = _read(spark, d, "events").select("event_id", hour.alias("start"), (hour + F.col("user_id") % 4).alias("end"))
    return E.contained(words, [], 3.5).select("event_id", F.col("window").alias("win"))


@_query("""with g as (select distinct n_nationkey from nation), h as (select distinct c_mktsegment as seg from customer), s as (select c_nationkey, c_mktsegment as seg, count(*) as n from customer where c_acctbal > 9000 group by 1, 2)
select n_nationkey, h.seg as seg, coalesce(n, 0) as n from g cross join h left join s on c_nationkey = n_nationkey and s.seg = h.seg""")
def grid_fill_default(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    grid = _read(spark, d, "nation").select("n_nationkey").crossJoin(c.select("seg").distinct())
    return S.fill_default(grid, c.where("c_acctbal > 9000").groupBy("n_nationkey", "seg").agg(F.count("*").alias("n")), ["n_nationkey", "seg"], "n", 0)


@_query("""select g.n_nationkey as n_nationkey, h.seg as seg from nation g cross join (select distinct c_mktsegment as seg from customer) h where not exists (select 1 from customer where c_nationkey = g.n_nationkey and c_mktsegment = h.seg and c_acctbal > 9000)""")
def pending_work(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    grid = _read(spark, d, "nation").select("n_nationkey").crossJoin(c.select("seg").distinct())
    return S.pending(grid, c.where("c_acctbal > 9000"), ["n_nationkey", "seg"])


@_query("""with r as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as t from embeddings), n as (select min(c) as n from (select count(*) as c from embeddings group by label))
select label, t, vec_id from r cross join n where t < n""")
def min_length_align(spark, d):
    rows = _read(spark, d, "embeddings").select("label", "vec_id", F.expr("row_number() over (partition by label order by vec_id) - 1").alias("t").cast("long")).withColumn("all", F.lit(0))
    return S.align(rows, ["all"], "label").select("label", "t", "vec_id")


@_query("select role, conv_id, turn, row_number() over (partition by role order by conv_id, turn) - 1 as pos from conversations")
def segment_concat(spark, d):
    out = S.concat_segments(_read(spark, d, "conversations").select("role", "conv_id", "turn"), ["role"], "conv_id", "turn")
    return out.select("role", "conv_id", "turn", F.col("index").cast("long").alias("pos"))


@_query("select role, conv_id, turn, row_number() over (partition by role order by conv_id, turn) - 1 as pos from (select *, dense_rank() over (partition by role order by conv_id) as k from conversations) where k <= 2")
def segment_limit(spark, d):
    out = S.concat_segments(_read(spark, d, "conversations").select("role", "conv_id", "turn"), ["role"], "conv_id", "turn", first=2)
    return out.select("role", "conv_id", "turn", F.col("index").cast("long").alias("pos"))


@_query("with g as (select range as t from range(1000)), o as (select distinct cast(floor(vec_id * 1.37 * 1.28) as bigint) as t from embeddings where label = 3) select g.t, cast(case when o.t is null then 0 else 1 end as double) as mask from g left join o using (t)")
def onset_mask(spark, d):
    on = _read(spark, d, "embeddings").where("label = 3").select((F.col("vec_id") * 1.37).alias("onset"))
    return E.onset_mask(spark.range(1000).withColumnRenamed("id", "t"), on, [], 1.28)


def _phones(spark):
    return spark.createDataFrame([("click", "A"), ("view", "A"), ("purchase", "B"), ("signup", "C"), ("error", "/sil/")], "phone string, phoneme string")


def posteriors(spark, d):
    h = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    n = _read(spark, d, "events").groupBy(h.alias("t"), F.col("event_type").alias("phone")).agg(F.count("*").alias("n"))
    return n.select("t", "phone", (F.col("n") / F.sum("n").over(S._over(["t"]))).alias("p"))


@_query("""with n as (select cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as t, event_type as phone, count(*) as n from events group by 1, 2), p as (select t, phone, n / sum(n) over (partition by t) as p from n),
d as (select * from (values ('click', 'A'), ('view', 'A'), ('purchase', 'B'), ('signup', 'C'), ('error', '/sil/')) v(phone, phoneme)),
q as (select t, phoneme, sum(least(greatest(p, 1e-6), 1 - 1e-6)) as p from p join d using (phone) group by 1, 2),
l as (select t, phoneme, log10(greatest(p / nullif(1 - p + 1e-8, 0), 1e-8)) as l from q), c as (select t, phoneme, coalesce(l, 0) - avg(coalesce(l, 0)) over (partition by t) as l from l)
select t, phoneme, round(l, 6) + 0 as llr from c where phoneme <> '/sil/'""")
def phone_to_phoneme_llr(spark, d):
    return E.phoneme_ratios(posteriors(spark, d), _phones(spark), []).select("t", "phoneme", _r("llr").alias("llr"))


@_query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as channel from embeddings")
def greedy_label(spark, d):
    name = E.greedy_label(F.col("embedding"), [str(i) for i in range(64)])
    return _read(spark, d, "embeddings").select("vec_id", name.cast("int").alias("channel"))


@_query(_H + " select t, round(0.25 * x + 0.5 * coalesce(lag(x, 1) over (order by t), 0) + 0.25 * coalesce(lag(x, 2) over (order by t), 0), 6) + 0 as x from s")
def fir_smooth(spark, d):
    return S.fir(hours(spark, d), "x", [0.25, 0.5, 0.25], []).select("t", _r("x").alias("x"))


@_query("select * from (values ('Delta', 1.0::double, 4.0::double), ('Theta', 4.0, 8.0), ('Alpha', 8.0, 12.0), ('Beta', 12.0, 30.0), ('Broad', 1.0, 15.0), ('FullBand', null, null)) v(band, l_freq, h_freq)")
def band_lookup(spark, d):
    return spark.createDataFrame([(b, lo, hi) for b, (lo, hi) in BANDS.items()], "band string, l_freq double, h_freq double")


@_query(_H + " select t // 7 as t, round(avg(x), 6) + 0 as x from s group by 1 having count(*) = 7")
def resample_bucket(spark, d):
    return S.decimate(hours(spark, d), "x", [], 7).select("t", _r("x").alias("x"))


def _kernel(name: str, run):
    def f(spark, d):
        out = S.by_series(hours(spark, d).withColumn("series", F.lit(0)), ["series"], "x", run)
        return out.select("t", _r("x").alias("x")) if dict(out.dtypes)["x"] == "double" else out.select("t", F.posexplode("x").alias("band", "x")).select("t", "band", _r("x").alias("x"))

    f.__name__ = name
    QUERIES[name] = f


_kernel("fir_bandpass", partial(lambda x: signal.fir_filter(x, 128, 4.0, 8.0)[0]))
_kernel("polyphase_resample", partial(signal.resample, rate=128, target=48))
_kernel("hilbert_envelope", signal.envelope)
_kernel("mel_spectrogram", partial(signal.spectrogram, rate=1024, target=64))
_kernel("fourier_resample", partial(signal.fourier_resample, size=500))


@_query(r"""select conv_id, turn, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as text from conversations""")
def normalized_text(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", normalize_text(F.col("text")).alias("text"))


@_query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def props_json(spark, d):
    return _read(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@_query("""with o as (select event_type as cell, avg(value) as r from events group by 1), n as (select event_type as cell, user_id, avg(value) as r from events group by 1, 2)
select o.cell as cell, round((count(*) filter (n.r > o.r) + 1) / (count(*) + 1), 6) as p from o join n using (cell) group by 1""")
def permutation_pvalue(spark, d):
    e = _read(spark, d, "events").withColumnRenamed("event_type", "cell")
    return M.p_values(e.groupBy("cell").agg(F.avg("value").alias("r")), e.groupBy("cell", "user_id").agg(F.avg("value").alias("r")), ["cell"]).select("cell", _r("p").alias("p"))


@_query("select vec_id, round((embedding[1]::double + embedding[2]::double) / 2, 6) + 0 as mono, round(embedding[2]::double, 6) + 0 as side from embeddings")
def side_selection(spark, d):
    s = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    return _read(spark, d, "embeddings").select("vec_id", _r(S.select_side(s, "mono")).alias("mono"), _r(S.select_side(s, "right")).alias("side"))


@_query("select label, t, vec_id from (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as t, count(*) over (partition by label) as n from embeddings) where t < n - 5")
def delay_trim(spark, d):
    rows = _read(spark, d, "embeddings").select("label", "vec_id", F.expr("row_number() over (partition by label order by vec_id) - 1").cast("long").alias("t"))
    return S.trim_tail(rows, ["label"], 5).select("label", "t", "vec_id")


_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(A.CHANNELS))


@_query("with " + _C + f", n as (select * from (values {_NAMES}) v(channel, name)) select t, name, round(y, 6) + 0 as y from c join n using (channel) where name in ('Cz', 'Fz', 'Pz', 'Oz')")
def channel_selection(spark, d):
    return A.select_channels(channels(spark, d), ["Cz", "Fz", "Pz", "Oz"]).select("t", "name", _r("y").alias("y"))


@_query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def filecode_join(spark, d):
    orders = _read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return A.complete_join(orders, _read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], "customer").select("o_orderkey", "c_name")


def weights(spark, d):
    """(subject, channel, feature, delay, w_mean): stand-in weights, the mean response of each label."""
    e = _read(spark, d, "embeddings").select(F.col("label").alias("subject"), (F.col("vec_id") % 12).cast("int").alias("delay"), (F.col("vec_id") % 3).cast("int").alias("feature"), F.posexplode("embedding").alias("channel", "w"))
    return e.groupBy("subject", "channel", "feature", "delay").agg(F.avg(F.col("w").cast("double")).alias("w_mean"))


_W = """with c as (select label as subject, cast(vec_id % 12 as integer) as delay, cast(vec_id % 3 as integer) as feature, generate_subscripts(embedding, 1) - 1 as channel, cast(unnest(embedding) as double) as w from embeddings),
a as (select subject, channel, feature, delay, avg(w) as w from c group by 1, 2, 3, 4)"""


@_query(_W + """, m as (select channel, delay, avg(w) as w from a group by 1, 2),
e as (select delay, avg(w) as mean, stddev_samp(w) / sqrt(count(*)) as sem, stddev_pop(w) as gfp from m group by 1),
p as (select *, lag(gfp) over (order by delay) as b, lead(gfp) over (order by delay) as n, max(gfp) over () as top from e)
select delay, round(mean, 6) + 0 as mean, round(sem, 6) + 0 as sem, round(gfp, 6) + 0 as gfp, coalesce(gfp > b and gfp > n and gfp >= 0.1 * top, false) as peak from p""")
def evoked_table(spark, d):
    # At 40 samples a second the least distance of peaks is one sample.
    out = A.evoked(weights(spark, d), [], rate=40.0)
    return out.select("delay", *(_r(c).alias(c) for c in ("mean", "sem", "gfp")), "peak")


@_query(_W + """, m as (select subject, feature, delay, avg(w) as w from a group by 1, 2, 3),
e as (select subject, delay, avg(w) as mean, stddev_samp(w) / sqrt(count(*)) as sem from m group by 1, 2)
select subject, feature, feature as position, delay, round(w, 6) + 0 as w, round(mean, 6) + 0 as mean, round(sem, 6) + 0 as sem from m join e using (subject, delay)""")
def heat_map_by_subject(spark, d):
    out = A.heat_map(weights(spark, d), ["subject"])
    return out.select("subject", "feature", "position", "delay", *(_r(c).alias(c) for c in ("w", "mean", "sem")))


@_query()
def heat_map_clustered(spark, d):
    out = A.heat_map(weights(spark, d), [], cluster=True)
    return out.select("feature", "position", "delay", *(_r(c).alias(c) for c in ("w", "mean", "sem")))


def _grid(spark):
    return S.param_grid(spark, band=["Theta"], attribute=["Envelope"], side=["left", "mono"], subject=["s0", "s1"])


def _cells(spark, d):
    """The one-lag pairs as the data of two cells; the other two have none."""
    return pairs(spark, d).drop("series").withColumns({"band": F.lit("Theta"), "attribute": F.lit("Envelope"), "side": F.lit("mono")}).withColumn("subject", F.explode(F.array(F.lit("s0"), F.lit("s1"))))


@_query(_ONE.replace("/ (n * vx / (sx * sx) + 1.0) as w from tr", "/ (n * vx / (sx * sx) + alpha) as w, subject from tr, (values ('s0', 100.0), ('s1', 1.0)) v(subject, alpha)") + """, p as (select subject, k, j.channel, (x - mx) / sx * w as p, (y - my) / sy as y from j join w on fold = k and j.channel = w.channel),
r as (select subject, k, channel, covar_pop(p, y) / (stddev_samp(p) * stddev_samp(y)) as r from p group by 1, 2, 3),
o as (select subject, 'mono' as side, cast(channel as integer) as channel, avg(r) as r_mean from r group by 1, 3)
select g.side as side, g.subject as subject, channel, round(r_mean, 6) + 0 as r_mean from (select * from (values ('left'), ('mono')) a(side), (values ('s0'), ('s1')) b(subject)) g left join o on g.side = o.side and g.subject = o.subject""")
def whole_analysis(spark, d):
    """Run over the grid with a stored penalty for one subject, written and read again."""
    alphas = spark.createDataFrame([("Theta", "Envelope", "mono", "s0", 100.0)], "band string, attribute string, side string, subject string, alpha double")
    out = A.run(_cells(spark, d), _grid(spark), new_path(spark, "analysis"), Options((1,)), alphas)
    return out.select("side", "subject", "channel", _r("r_mean").alias("r_mean"))
