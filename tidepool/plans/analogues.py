"""Each operator over a driver table of like shape: vectors as point lists, conversations as sequences, events as shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import paths, shots
from ..operators import frames, grid, raster
from ..sources import photos
from ..sources.store import stored
from ..streaming import sessions
from . import photos as batch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A homography of the sort that calibration gives.
H = [1.637347774, 0.284442712, -180.49249248, 0.251938609, 1.517821153, -311.667761702, 0.000694952, 0.000613741, 1.0]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vec(n: int, scale: float = 100.0) -> Column:
    return g.points(F.col("embedding"), n, scale)


def r6(c: Column) -> Column:
    return F.round(c, 6)


PTS = "SELECT vec_id, i, 100.0 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 100.0 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range({n})) AS i)"
SHIFTED = "SELECT vec_id, i, 300 + 500.0 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 300 + 500.0 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range({n})) AS i)"


def shifted(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """vec_id, i, x, y in a 600-pixel frame."""
    p = t(spark, sf_dir, "embeddings").select("vec_id", F.explode(g.points(F.col("embedding"), n, 500.0)).alias("p"))
    return p.select("vec_id", "p.i", (F.col("p.x") + 300).alias("x"), (F.col("p.y") + 300).alias("y"))


@query(f"""
WITH p AS ({SHIFTED.format(n=10)}),
q AS (SELECT vec_id, i, {H[6]} * x + {H[7]} * y + {H[8]} AS w, {H[0]} * x + {H[1]} * y + {H[2]} AS a, {H[3]} * x + {H[4]} * y + {H[5]} AS b FROM p),
m AS (SELECT vec_id, i, a / w - 300 AS dx, b / w - 300 AS dy FROM q)
SELECT vec_id, i, round(sqrt(dx * dx + dy * dy) / 298, 6) AS r_norm,
       round(CASE WHEN atan2(dy, dx) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END, 6) AS theta_deg FROM m""")
def shot_features(spark, sf_dir):
    x, y = g.project([F.lit(v) for v in H], F.col("x"), F.col("y"))
    r, theta = g.polar(x, y)
    return shifted(spark, sf_dir).select("vec_id", "i", r6(r).alias("r_norm"), r6(theta).alias("theta_deg"))


def kept_pairs(spark, sf_dir) -> DataFrame:
    """vec_id, p: the first ``vec_id % 13`` pairs. Each array is a column of its own, so that it is made once."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("flat"))
    return e.select("vec_id", F.slice(shots.pairs(F.col("flat")), 1, F.col("vec_id") % 13).alias("p"))


@query("""
SELECT vec_id, i, CASE WHEN i // 2 < least(vec_id % 13, 10) THEN round(CAST(embedding[i + 1] AS DOUBLE), 4) ELSE -100.0 END AS v
FROM embeddings, (SELECT unnest(range(20)) AS i)""")
def padded_tensor(spark, sf_dir):
    return kept_pairs(spark, sf_dir).select("vec_id", F.posexplode(shots.padded(F.col("p"))).alias("i", "v"))


@query("""
SELECT vec_id, CAST(least(vec_id % 13, 10) AS INT) AS n, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE round(CAST(embedding[2 * least(vec_id % 13, 10)] AS DOUBLE), 4) END AS last_theta FROM embeddings""")
def unpad_tensor(spark, sf_dir):
    flat = kept_pairs(spark, sf_dir).select("vec_id", shots.padded(F.col("p")).alias("flat"))
    back = flat.select("vec_id", shots.without_misses(shots.pairs(F.col("flat"))).alias("back"))
    return back.select("vec_id", F.size("back").alias("n"), F.get(F.get("back", F.size("back") - 1), F.lit(1)).alias("last_theta"))


HISTORY = """
WITH u AS (SELECT conv_id, turn, length(text) AS v FROM conversations WHERE role = 'user' AND turn >= 1)
SELECT c.conv_id, c.turn, CAST(count(u.v) AS INT) AS n, coalesce(string_agg(CAST(u.v AS VARCHAR), ',' ORDER BY u.turn), '') AS history
FROM conversations c LEFT JOIN u ON c.conv_id = u.conv_id AND u.turn <= c.turn GROUP BY ALL"""


def history(spark, sf_dir, how):
    c = t(spark, sf_dir, "conversations")
    notes = c.where("role = 'user'").select("conv_id", "turn", F.char_length("text").alias("v"))
    h = how(c.select("conv_id", "turn"), notes, "conv_id", "turn", "v")
    return h.select("conv_id", "turn", F.size("history").alias("n"), F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query(HISTORY)
def cumulative_history_join(spark, sf_dir):
    return history(spark, sf_dir, frames.history_join)


@query(HISTORY)
def cumulative_history_window(spark, sf_dir):
    return history(spark, sf_dir, frames.history_window)


def four(spark, sf_dir, chosen):
    e = t(spark, sf_dir, "embeddings").select("vec_id", *[c["i"].alias(k) for k, c in chosen(vec(4)).items()])
    return e


@query(f"""
SELECT vec_id, CAST(arg_min(i, (y, i <> 0, i)) AS INT) AS top, CAST(arg_min(i, (-y, i <> 1, i)) AS INT) AS bottom,
       CAST(arg_min(i, (x, i <> 2, i)) AS INT) AS "left", CAST(arg_min(i, (-x, i <> 3, i)) AS INT) AS "right" FROM ({PTS.format(n=4)}) GROUP BY vec_id""")
def extremes_loop(spark, sf_dir):
    return four(spark, sf_dir, g.extremes)


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y, i) AS ry, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS rx FROM ({PTS.format(n=4)}))
SELECT vec_id, CAST(arg_min(i, (x, ry)) FILTER (ry <= 2) AS INT) AS top, CAST(arg_min(i, (-x, ry)) FILTER (ry > 2) AS INT) AS bottom,
       CAST(arg_min(i, (y, rx)) FILTER (rx <= 2) AS INT) AS "left", CAST(arg_min(i, (-y, rx)) FILTER (rx > 2) AS INT) AS "right" FROM r GROUP BY vec_id""")
def extremes_sort(spark, sf_dir):
    return four(spark, sf_dir, g.extremes_of_sorted)


@query(f"""
SELECT vec_id, CAST(arg_min(i, (x + y, i)) AS INT) AS tl, CAST(arg_min(i, (y - x, i)) AS INT) AS tr,
       CAST(arg_min(i, (-(x + y), i)) AS INT) AS br, CAST(arg_min(i, (x - y, i)) AS INT) AS bl FROM ({PTS.format(n=4)}) GROUP BY vec_id""")
def order_corners(spark, sf_dir):
    return four(spark, sf_dir, g.corners)


#: Tables p (four points and a length d of each row) and the eight equations of a homography's unknowns, solved by elimination: g has them as m[1][9] to m[8][9].
ELIMINATION = """
-- one row of coefficients and the right side per equation
a AS (SELECT vec_id, d, CAST(k AS INT) AS k,
             [CASE WHEN k < 4 THEN p[k % 4 + 1][1] ELSE 0 END, CASE WHEN k < 4 THEN p[k % 4 + 1][2] ELSE 0 END, CASE WHEN k < 4 THEN 1.0 ELSE 0 END,
              CASE WHEN k < 4 THEN 0 ELSE p[k % 4 + 1][1] END, CASE WHEN k < 4 THEN 0 ELSE p[k % 4 + 1][2] END, CASE WHEN k < 4 THEN 0.0 ELSE 1.0 END,
              -p[k % 4 + 1][1] * q, -p[k % 4 + 1][2] * q, q] AS c
      FROM (SELECT vec_id, d, p, k, {target}[k + 1] AS q FROM d, (SELECT unnest(range(8)) AS k))),
m AS (SELECT vec_id, d, list(c ORDER BY k) AS m FROM a GROUP BY vec_id, d),
g AS (WITH RECURSIVE g AS (
        SELECT vec_id, d, m, 1 AS j, false AS bad FROM m
        UNION ALL
        SELECT vec_id, d, CASE WHEN abs(best) < 1e-9 THEN m ELSE
               list_transform(range(1, 9), lambda i: CASE WHEN i = j THEN list_transform(lead, lambda v: v / best)
                 ELSE list_transform(range(1, 10), lambda n: swapped[i][n] - swapped[i][j] * lead[n] / best) END) END, j + 1, bad OR abs(best) < 1e-9
        FROM (SELECT *, swapped[j] AS lead, swapped[j][j] AS best FROM (
                SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN i = j THEN m[best_row] WHEN i = best_row THEN m[j] ELSE m[i] END) AS swapped FROM (
                  SELECT *, j - 1 + list_position(list_transform(range(j, 9), lambda i: abs(m[i][j])), list_max(list_transform(range(j, 9), lambda i: abs(m[i][j])))) AS best_row FROM g WHERE j <= 8))))
      SELECT vec_id, d, m, bad FROM g WHERE j = 9)"""
#: The four extremes of each row's points, and the diameter.
EXTREMES = f"""
e AS (SELECT vec_id, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y, arg_min(i, (y, i <> 0, i)) + 1 AS t, arg_min(i, (-y, i <> 1, i)) + 1 AS b,
           arg_min(i, (x, i <> 2, i)) + 1 AS l, arg_min(i, (-x, i <> 3, i)) + 1 AS r FROM ({PTS.format(n=4)}) GROUP BY vec_id),
d AS (SELECT vec_id, len(list_distinct([t, b, l, r])) = 4 AS apart, [[x[t], y[t]], [x[b], y[b]], [x[l], y[l]], [x[r], y[r]]] AS p,
             greatest(sqrt((x[r] - x[l]) ** 2 + (y[r] - y[l]) ** 2), sqrt((x[b] - x[t]) ** 2 + (y[b] - y[t]) ** 2)) AS d FROM e),"""
DIAMOND = "[d / 2, d / 2, 0, d, 0, d, d / 2, d / 2]"


@query(f"""
WITH {EXTREMES} {ELIMINATION.format(target=DIAMOND)}
SELECT vec_id, round(d, 6) AS d, CAST(i AS INT) AS i, CASE WHEN bad THEN NULL WHEN i = 9 THEN 1.0 ELSE round(m[i][9] / CASE WHEN i IN (3, 6) THEN d WHEN i IN (7, 8) THEN 1 / d ELSE 1 END, 4) + 0.0 END AS h
FROM g, (SELECT unnest(range(1, 10)) AS i)""")
def homography_solve(spark, sf_dir):
    """The nine entries for every row, in units of the diameter; null where three extremes are in line or one point is two of them."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(k) for k, c in g.extremes(vec(4)).items()])
    names = ["top", "bottom", "left", "right"]
    e = e.withColumn("d", g.diameter(*[F.col(k) for k in names]))
    e = g.with_homography(e, [(F.col(f"{k}.x"), F.col(f"{k}.y")) for k in names], g.diamond(F.col("d")))
    h = [F.get("matrix", F.lit(k)) for k in range(9)]
    unit = [1, 1, F.col("d"), 1, 1, F.col("d"), 1 / F.col("d"), 1 / F.col("d"), 1]
    apart = F.size(F.array_distinct(F.array("top.i", "bottom.i", "left.i", "right.i"))) == 4
    out = F.array(*[F.when(apart, F.round(F.try_divide(v, F.lit(1) * u), 4) + 0.0) for v, u in zip(h, unit, strict=True)])
    e = e.select("vec_id", r6(F.col("d")).alias("d"), F.posexplode(out).alias("i", "h"))
    return e.select("vec_id", "d", (F.col("i") + 1).alias("i"), "h")


@query(f"""
WITH p AS ({PTS.format(n=4)}), a AS (SELECT *, radians(vec_id % 360) AS a FROM p), c AS (SELECT *, cos(a) AS c, sin(a) AS s, 600 AS w, 400 AS h FROM a),
n AS (SELECT *, CAST(trunc(h * abs(s) + w * abs(c)) AS INT) AS nw, CAST(trunc(h * abs(c) + w * abs(s)) AS INT) AS nh FROM c)
SELECT vec_id, i, round(c * x + s * y + (1 - c) * 300 - s * 200 + nw / 2 - 300, 6) AS x, round(-s * x + c * y + s * 300 + (1 - c) * 200 + nh / 2 - 200, 6) AS y, nw AS w, nh AS h FROM n""")
def rotate_points(spark, sf_dir):
    p = t(spark, sf_dir, "embeddings").select("vec_id", F.explode(vec(4)).alias("p"))
    r = g.rotated(F.col("p.x"), F.col("p.y"), (F.col("vec_id") % 360).cast("double"), F.lit(600), F.lit(400))
    return p.select("vec_id", "p.i", r6(r["x"]).alias("x"), r6(r["y"]).alias("y"), r["w"].alias("w"), r["h"].alias("h"))


@query(f"SELECT vec_id, i, 0.5 * round_even(x, 0) AS x, 0.5 * round_even(y, 0) AS y FROM ({PTS.format(n=4)})")
def scale_points(spark, sf_dir):
    p = t(spark, sf_dir, "embeddings").select("vec_id", F.explode(vec(4)).alias("p"))
    return p.select("vec_id", "p.i", (g.half_even(F.col("p.x")) * 0.5).cast("double").alias("x"), (g.half_even(F.col("p.y")) * 0.5).cast("double").alias("y"))


@query(f"SELECT vec_id, i, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y FROM ({PTS.format(n=4)})")
def trunc_points(spark, sf_dir):
    p = t(spark, sf_dir, "embeddings").select("vec_id", F.explode(vec(4)).alias("p"))
    return p.select("vec_id", "p.i", g.truncated(F.col("p.x")).alias("x"), g.truncated(F.col("p.y")).alias("y"))


@query(f"""
WITH p AS ({SHIFTED.format(n=4)}), a AS (SELECT vec_id, i, degrees(atan2(y - 300, x - 300)) AS d, vec_id % 61 - 30 AS k FROM p), b AS (SELECT *, CASE WHEN d < 0 THEN d + 360 ELSE d END AS u FROM a)
SELECT vec_id, i, round(fmod(u - k + 360, 360), 6) AS theta, CAST(fmod(260 - k, 360) AS DOUBLE) AS miss_turned, -100.0 AS miss_kept FROM b""")
def angle_shift(spark, sf_dir):
    p = shifted(spark, sf_dir, 4)
    r, theta = g.polar(F.col("x"), F.col("y"))
    k = (F.col("vec_id") % 61 - 30).cast("double")
    miss = F.lit(g.MISS)
    return p.select("vec_id", "i", r6(g.turned(theta, k, r)).alias("theta"), g.turned(miss, k).alias("miss_turned"), g.turned(miss, k, miss).alias("miss_kept"))


@query(f"""
WITH p AS ({SHIFTED.format(n=10)}), q AS (SELECT vec_id, i, sqrt((x - 300) ** 2 + (y - 300) ** 2) / 298 AS r, atan2(y - 300, x - 300) AS a FROM p)
SELECT vec_id, i, CAST(trunc(round(300 + r * 298 * cos(a), 6)) AS INT) AS px, CAST(trunc(round(300 + r * 298 * sin(a), 6)) AS INT) AS py FROM q""")
def polar_round_trip(spark, sf_dir):
    p = shifted(spark, sf_dir)
    r, theta = g.polar(F.col("x"), F.col("y"))
    x, y = (F.round(300 + r * 298 * f(F.radians(theta)), 6).cast("int") for f in (F.cos, F.sin))
    return p.select("vec_id", "i", x.alias("px"), y.alias("py"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(round_even(value, 0) AS INT) AS v FROM events")
def json_extract(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.bround("value").cast("int").alias("v"))


NAMES = "concat('seq/', doc_id % 120, ['.png', '.JPG', '.jpeg', '.txt'][1 + doc_id % 4])"


def names(spark, sf_dir) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".png", ".JPG", ".jpeg", ".txt"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("seq/"), (F.col("doc_id") % 120).cast("string"), ext).alias("path"))


@query("""SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS folder, list_reverse(string_split(url, '/'))[2] AS seq, list_reverse(string_split(url, '/'))[1] AS name, try_cast(replace(string_split(list_reverse(string_split(url, '/'))[1], '.')[1], '_', '') AS INT) AS n FROM pages""")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", paths.parent(u).alias("folder"), paths.parent_name(u).alias("seq"), paths.base(u).alias("name"), paths.int_stem(u).alias("n"))


@query(f"SELECT doc_id, regexp_matches(p, '(?i)\\.(png|jpe?g)$') AS any_case, regexp_matches(p, '\\.(png|jpe?g)$') AS exact, regexp_replace(p, '(?i)\\.(png|jpe?g)$', '.json') AS sidecar, replace(replace(p, '.png', '.json'), '.jpg', '.json') AS sidecar_a FROM (SELECT doc_id, {NAMES} AS p FROM documents)")
def ext_filter(spark, sf_dir):
    p = F.col("path")
    return names(spark, sf_dir).select("doc_id", paths.is_photo(p).alias("any_case"), paths.is_photo(p, any_case=False).alias("exact"), paths.sidecar(p).alias("sidecar"), paths.sidecar_anywhere(p).alias("sidecar_a"))


@query(f"SELECT doc_id, printf('%02d', doc_id % 120) AS padded, CAST(doc_id % 120 AS INT) AS n, concat(doc_id % 120, '_1.png') AS variant FROM documents")
def zero_pad(spark, sf_dir):
    n = paths.int_stem(F.col("path"))
    return names(spark, sf_dir).select("doc_id", paths.zero_padded(n).alias("padded"), n.alias("n"), paths.variant_name(F.col("path"), F.lit(1)).alias("variant"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def sidecar_inner(spark, sf_dir):
    return frames.matched(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sidecar_missing(spark, sf_dir):
    return frames.pending(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def pending_groups(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return frames.pending(c.select("conv_id").distinct(), c.where("role = 'system'"), "conv_id")


@query("SELECT doc_id, CAST(quality AS INT) AS quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_if_missing(spark, sf_dir):
    new = t(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return frames.insert_missing(new, t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def calibration_broadcast(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return frames.with_calibration(t(spark, sf_dir, "customer"), n, "c_nationkey").select("c_custkey", "n_name")


HASHED = "(CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0)"


@query(f"""
SELECT p_partkey, CAST(k AS INT) AS variant, ([500, 700, 1300][k + 1] + floor({HASHED.format("concat(p_partkey, '/', k, '/42')")} * [200, 600, 200][k + 1])) / 1000 AS coefficient
FROM part, (SELECT unnest(range(3)) AS k)""")
def variant_fanout(spark, sf_dir):
    return frames.variants(t(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query(f"""
WITH u AS (SELECT event_id, {", ".join(HASHED.format(f"concat(event_id, '/3/42/{k}')") + f" AS u{k}" for k in range(4))} FROM events)
SELECT event_id, round(CASE WHEN u0 < 0.5 THEN 0.7 + 0.6 * u1 ELSE 1.0 END, 6) AS brightness, round(CASE WHEN u2 < 0.5 THEN -30 + 60 * u3 ELSE 0.0 END, 6) AS angle FROM u""")
def train_jitter(spark, sf_dir):
    j = frames.jitter(t(spark, sf_dir, "events").select("event_id"), "event_id", 3)
    return j.select("event_id", r6(F.col("brightness")).alias("brightness"), r6(F.col("angle")).alias("angle"))


@query("""
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(concat(event_id, '/42')), event_id) <= ceil(0.8 * (SELECT count(*) FROM events)) THEN 'test' ELSE 'train' END AS split FROM events""")
def seeded_split(spark, sf_dir):
    return frames.exact_split(t(spark, sf_dir, "events").select("event_id"), "event_id")


@query("""
WITH r AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 7 AS b, (value - 1.5) ** 2 AS e FROM events)
SELECT round(avg(m), 6) AS loss FROM (SELECT avg(e) AS m FROM r GROUP BY b)""")
def batch_mean_loss(spark, sf_dir):
    rows = frames.numbered(t(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return frames.mean_of_batch_means(rows, F.pow(F.col("value") - 1.5, 2), "idx", 7).select(r6(F.col("loss")).alias("loss"))


@query("""
SELECT event_id, idx FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events) WHERE event_type = 'purchase' ORDER BY idx LIMIT 25""")
def limit_successes(spark, sf_dir):
    """The first 25 successes; numbers count all rows, so failures leave gaps."""
    rows = frames.numbered(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return rows.where("event_type = 'purchase'").orderBy("idx").limit(25).select("event_id", F.col("idx").cast("long").alias("idx"))


@query("""
SELECT event_id, idx FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events) WHERE event_type = 'purchase' ORDER BY idx LIMIT 25""")
def adaptive_limit(spark, sf_dir):
    """The same, without judging rows far beyond the last success."""
    rows = stored(frames.numbered(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"), "numbered")
    found = frames.first_successes(rows, lambda part: part.where("event_type = 'purchase'"), 25)
    return found.select("event_id", F.col("idx").cast("long").alias("idx"))


@query("""
SELECT event_id, user_id, idx FROM (
  SELECT event_id, user_id, event_type, idx, row_number() OVER (PARTITION BY user_id, event_type ORDER BY idx) AS k FROM (
    SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events))
WHERE event_type = 'click' AND k <= 2""")
def adaptive_limit_by_group(spark, sf_dir):
    """The first two clicks of each user."""
    rows = frames.numbered(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", out="at")
    start = rows.groupBy("user_id").agg(F.min("at").alias("first")).withColumnRenamed("user_id", "u2")
    rows = stored(rows.join(start, F.expr("user_id = u2")).select("event_id", "user_id", "event_type", (F.col("at") - F.col("first")).alias("idx")), "numbered")
    found = frames.first_successes(rows, lambda part: part.where("event_type = 'click'"), 2, by="user_id", first=8)
    return found.select("event_id", "user_id", F.col("idx").cast("long").alias("idx"))


@query("""
WITH u AS (SELECT conv_id, turn, length(text) AS v FROM conversations WHERE role = 'user' AND turn >= 1),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM u)
SELECT c.conv_id, c.turn, CAST(count(n.v) AS BIGINT) AS upto, arg_max(n.v, n.place) AS last_v FROM conversations c LEFT JOIN n ON c.conv_id = n.conv_id AND n.turn <= c.turn GROUP BY ALL""")
def history_offsets(spark, sf_dir):
    """How many notes each turn has behind it, and the last of them, by its place."""
    c = t(spark, sf_dir, "conversations")
    notes = c.where("role = 'user'").select("conv_id", "turn", F.char_length("text").cast("long").alias("v"))
    turns, placed = frames.history_offsets(c.select("conv_id", "turn"), notes, "conv_id", "turn")
    placed = placed.select(F.col("conv_id").alias("c2"), "place", F.col("v").alias("last_v"))
    return turns.join(placed, F.expr("conv_id = c2 and upto = place"), "left").select("conv_id", "turn", "upto", "last_v")


@query(f"""
WITH p AS ({SHIFTED.format(n=10)}), q AS (SELECT 10 * vec_id + i AS k, x, y FROM p),
c AS (SELECT event_id, event_id * 7919 % 60000 / 100.0 AS x, event_id * 104729 % 60000 / 100.0 AS y FROM events)
SELECT event_id, min(k) AS box, min(k) FILTER ((c.x - q.x) ** 2 + (c.y - q.y) ** 2 <= 36) AS disc
FROM c LEFT JOIN q ON abs(c.x - q.x) < 10 AND abs(c.y - q.y) < 10 GROUP BY event_id""")
def grid_hits(spark, sf_dir):
    """For each of many clicks the first of many points under it."""
    points = shifted(spark, sf_dir).select((10 * F.col("vec_id") + F.col("i")).alias("k"), "x", "y")
    at = lambda m: (F.col("event_id") * m % 60000) / F.lit(100.0)
    clicks = t(spark, sf_dir, "events").select("event_id", at(7919).alias("x"), at(104729).alias("y"))
    box = grid.hits(clicks, points, "event_id", "k", 10.0).withColumnRenamed("k", "box")
    disc = grid.hits(clicks, points, "event_id", "k", 6.0, disc=True).groupBy(F.col("event_id").alias("e2")).agg(F.min("k").alias("disc"))
    return box.join(disc, F.expr("event_id = e2"), "left").select("event_id", "box", "disc")


@query(f"""
WITH {EXTREMES} {ELIMINATION.format(target=DIAMOND)},
w AS (SELECT event_id, event_id % 500 AS vec_id, [1 + event_id * 3 % 7, 1 + event_id * 5 % 7, 1 + event_id * 4 % 7, 1 + event_id * 6 % 7] AS w FROM events),
h AS (SELECT event_id, vec_id, list_sum(list_transform(range(1, 5), lambda i: w[i] * p[i][1])) / list_sum(w) AS x, list_sum(list_transform(range(1, 5), lambda i: w[i] * p[i][2])) / list_sum(w) AS y, m, g.d
      FROM w JOIN d USING (vec_id) JOIN g USING (vec_id) WHERE apart AND NOT bad)
SELECT event_id, CAST(trunc(d) AS INT) AS side, round((m[1][9] * x + m[2][9] * y + m[3][9]) / (m[7][9] * x + m[8][9] * y + 1) / d, 4) AS u, round((m[4][9] * x + m[5][9] * y + m[6][9]) / (m[7][9] * x + m[8][9] * y + 1) / d, 4) AS v FROM h""")
def calibrated_points(spark, sf_dir):
    """Places within the four keypoints of a calibration, moved by its map, which is solved once for each calibration."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", vec(4).alias("pts"))
    keys = F.transform("pts", lambda p: F.array(p["x"], p["y"]))
    solved = batch.solved(e.select(F.col("vec_id").alias("folder"), keys.alias("keypoints"), F.lit(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y")))
    e = e.select("vec_id", *[c.alias(k) for k, c in g.extremes(F.col("pts")).items()])
    names = ["top", "bottom", "left", "right"]
    e = e.where(F.size(F.array_distinct(F.array(*[F.col(f"{k}.i") for k in names]))) == 4).withColumn("d", g.diameter(*[F.col(k) for k in names]))
    marks = t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).alias("at"), *[(1 + F.col("event_id") * k % 7).alias(f"w_{n}") for n, k in zip(names, (3, 5, 4, 6), strict=True)])
    weight = sum((F.col(f"w_{n}") for n in names[1:]), F.col("w_top"))
    mean = lambda a: sum((F.col(f"w_{n}") * F.col(f"{n}.{a}") for n in names[1:]), F.col("w_top") * F.col(f"top.{a}")) / weight
    rows = frames.with_calibration(marks.join(e, F.expr("at = vec_id")).withColumn("folder", F.col("vec_id")), solved, "folder")
    u, v = g.project([F.get("matrix", F.lit(k)) for k in range(9)], mean("x"), mean("y"))
    return rows.select("event_id", "side", F.round(u / F.col("d"), 4).alias("u"), F.round(v / F.col("d"), 4).alias("v"))


@query("""
WITH n AS (SELECT DISTINCT l_orderkey AS n FROM lineitem WHERE l_orderkey <> 57)
SELECT min(k) AS gap FROM (SELECT 0 AS k UNION SELECT n + 1 FROM n) WHERE k NOT IN (SELECT n FROM n)""")
def first_gap(spark, sf_dir):
    return frames.first_gap(t(spark, sf_dir, "lineitem").where("l_orderkey <> 57"), "l_orderkey")


@query("""
SELECT g / 10.0 AS gamma, CAST(i AS INT) AS level, CAST(trunc(pow(i / 255.0, 1 / (g / 10.0)) * 255.0) AS INT) AS v FROM (SELECT unnest([5, 10, 11, 14]) AS g), (SELECT unnest(range(256)) AS i)""")
def gamma_lut(spark, sf_dir):
    gs = spark.createDataFrame([(x / 10.0,) for x in (5, 10, 11, 14)], "gamma double")
    return gs.select("gamma", F.posexplode(g.gamma_table(F.col("gamma"))).alias("level", "v"))


@query("SELECT * FROM (VALUES ('black', CAST(164460 AS BIGINT)), ('blue', 53300), ('red', 32580), ('white', 99208), ('yellow', 10452)) AS v(colour, n)")
def target_raster_counts(spark, sf_dir):
    return raster.target(spark).groupBy("colour").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(d AS INT) AS degrees, round(300 + 298 * cos(radians(d)), 6) AS x, round(300 + 298 * sin(radians(d)), 6) AS y FROM (SELECT unnest(range(0, 360, 30)) AS d)")
def spokes(spark, sf_dir):
    s = raster.spokes(spark)
    return s.select("degrees", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("""
WITH g AS (SELECT DISTINCT p_size / 10.0 AS gamma FROM part)
SELECT gamma, CAST(i AS INT) AS level, CAST(trunc(pow(i / 255.0, 1 / gamma) * 255.0) AS INT) AS v FROM g, (SELECT unnest(range(256)) AS i)""")
def gamma_tables(spark, sf_dir):
    """The 256 levels of each brightness that the rows ask for, made once for each."""
    gs = t(spark, sf_dir, "part").select((F.col("p_size") / F.lit(10.0)).alias("gamma")).distinct()
    return gs.select("gamma", F.posexplode(g.gamma_table(F.col("gamma"))).alias("level", "v"))


@query("""
SELECT n_nationkey, CAST(60 + 4 * n_nationkey AS INT) AS size, CAST(d AS INT) AS degrees,
       round((60 + 4 * n_nationkey) / 2 + ((60 + 4 * n_nationkey) // 2 - 2) * cos(radians(d)), 6) AS x, round((60 + 4 * n_nationkey) / 2 + ((60 + 4 * n_nationkey) // 2 - 2) * sin(radians(d)), 6) AS y
FROM nation, (SELECT unnest(range(0, 360, 30)) AS d)""")
def spokes_by_size(spark, sf_dir):
    s = raster.spokes_of(t(spark, sf_dir, "nation").select("n_nationkey", (60 + 4 * F.col("n_nationkey")).cast("int").alias("size")))
    return s.select("n_nationkey", "size", "degrees", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("""
WITH s AS (SELECT n_nationkey, CAST(60 + 4 * n_nationkey AS INT) AS size FROM nation),
b AS (SELECT *, size // 2 AS c, (size // 2 - 2) / CAST(10 AS DOUBLE) AS step FROM s),
p AS (SELECT *, unnest(range(size)) AS x FROM b), q AS (SELECT *, unnest(range(size)) AS y FROM p),
d AS (SELECT *, (x - c) ** 2 + (y - c) ** 2 AS d FROM q),
r AS (SELECT *, len(list_filter(range(1, 10), lambda k: trunc(k * step) ** 2 < d)) AS ring FROM d),
n AS (SELECT n_nationkey, size, CASE WHEN d <= 0 OR d > (c - 2) ** 2 THEN 'black' WHEN d > trunc(step / 2 - 1.5) ** 2 AND d <= trunc(step / 2 + 1.5) ** 2 THEN 'black'
  WHEN ring >= 1 AND ring <> 6 AND d <= trunc(trunc(ring * step) + 1.5) ** 2 THEN CASE WHEN ring = 7 THEN 'white' ELSE 'black' END
  ELSE ['yellow', 'red', 'blue', 'black', 'white'][CAST(ring // 2 AS INT) + 1] END AS colour FROM r)
SELECT n_nationkey, size, colour, count(*) AS n FROM n GROUP BY ALL""")
def target_rasters(spark, sf_dir):
    """Pixels of each colour in targets of many sizes."""
    sizes = t(spark, sf_dir, "nation").select("n_nationkey", (60 + 4 * F.col("n_nationkey")).cast("int").alias("size"))
    return raster.targets(sizes).groupBy("n_nationkey", "size", "colour").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CAST(round_even(w * least(800.0 / w, 600.0 / h), 0) AS INT) AS fit_w, CAST(round_even(h * least(800.0 / w, 600.0 / h), 0) AS INT) AS fit_h,
       CAST(greatest(1, trunc(p_size * 0.05)) AS INT) AS small FROM (SELECT *, 100.0 + p_partkey % 977 AS w, 90.0 + p_partkey % 653 AS h FROM part)""")
def fit_box(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_size", (F.lit(100.0) + F.col("p_partkey") % 977).alias("w"), (F.lit(90.0) + F.col("p_partkey") % 653).alias("h"))
    w, h = g.fit_box(F.col("w"), F.col("h"), F.lit(800.0), F.lit(600.0))
    return p.select("p_partkey", w.alias("fit_w"), h.alias("fit_h"), g.scaled_size(F.col("p_size"), 0.05).alias("small"))


@query("SELECT page_id AS id, url AS name FROM pages UNION ALL SELECT conv_id, role FROM conversations")
def glob_union(spark, sf_dir):
    """Rows of two sources, repeats and all."""
    a, b = t(spark, sf_dir, "pages"), t(spark, sf_dir, "conversations")
    return frames.union_all(a.select(F.col("page_id").alias("id"), F.col("url").alias("name")), b.select(F.col("role").alias("name"), F.col("conv_id").alias("id")))


@query(f"""
SELECT vec_id, CAST(min(i) FILTER (abs(x) < 10 AND abs(y) < 10) AS INT) AS box, CAST(min(i) FILTER (x * x + y * y <= 36) AS INT) AS disc,
       round(min(x), 6) AS x0, round(max(y), 6) AS y1 FROM ({PTS.format(n=10)}) GROUP BY vec_id""")
def hit_tests(spark, sf_dir):
    p, zero = vec(10), F.lit(0.0)
    b = g.bounds(p)
    return t(spark, sf_dir, "embeddings").select("vec_id", g.hit_box(p, zero, zero).alias("box"), g.hit_disc(p, zero, zero).alias("disc"), r6(b["x0"]).alias("x0"), r6(b["y1"]).alias("y1"))


@query("""
SELECT conv_id, CAST(count(*) FILTER (lower(role) = 'user') * 2 AS INT) AS n,
       coalesce(string_agg(concat(turn + 1, ',', -turn, ' ', turn * 3, ',', -2), ' ' ORDER BY turn) FILTER (lower(role) = 'user'), '') AS points
FROM conversations GROUP BY conv_id""")
def impact_labels(spark, sf_dir):
    """Points of shapes with a label, in any case, cut toward zero, from documents as text."""
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    shape = F.struct(F.upper("role").alias("label"), F.array(point(F.col("turn") + 1.9, -F.col("turn") - 0.5), point(F.col("turn") * 3, F.lit(-2.7))).alias("points"))
    docs = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", shape.alias("s")))).alias("x"))
    shapes = F.from_json(F.to_json(F.struct(F.transform("x", lambda x: x["s"]).alias("shapes"))), photos.ORIGINAL)["shapes"]
    points = photos.impact_points(shapes, "user")
    return docs.select("conv_id", F.size(points).alias("n"), F.array_join(F.transform(points, lambda p: F.array_join(p.cast("array<string>"), ",")), " ").alias("points"))


@query("""
WITH u AS (SELECT conv_id, turn, concat(turn, ',', length(text), ' ', -turn, ',', 7) AS p FROM conversations WHERE role = 'user' AND turn >= 1)
SELECT c.conv_id, c.turn, CAST(2 * count(u.p) AS INT) AS n, coalesce(string_agg(u.p, ' ' ORDER BY u.turn), '') AS points
FROM conversations c LEFT JOIN u ON c.conv_id = u.conv_id AND u.turn <= c.turn GROUP BY ALL""")
def cumulative_points(spark, sf_dir):
    """Lists of points of all notes so far, put together in order."""
    c = t(spark, sf_dir, "conversations")
    notes = c.where("role = 'user'").select("conv_id", "turn", F.array(F.array(F.col("turn"), F.char_length("text").cast("long")), F.array(-F.col("turn"), F.lit(7).cast("long"))).alias("v"))
    h = frames.history_window(c.select("conv_id", "turn"), notes, "conv_id", "turn", "v").select("conv_id", "turn", F.flatten("history").alias("p"))
    return h.select("conv_id", "turn", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: F.array_join(x.cast("array<string>"), ",")), " ").alias("points"))


SESSION_FOLD = """
WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value AS x, value * 3 AS y,
         CASE event_type WHEN 'click' THEN 'down' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'reset' ELSE 'other' END AS kind FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS p, 0 AS held FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, k, CASE WHEN kind = 'down' AND near IS NULL AND len(p) < 4 THEN list_append(p, {'x': x, 'y': y})
                          WHEN kind = 'move' AND held > 0 THEN list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = held THEN {'x': x, 'y': y} ELSE p[i] END)
                          WHEN kind = 'reset' THEN p[1:0] ELSE p END,
         CASE WHEN kind = 'down' AND near IS NOT NULL THEN near WHEN kind IN ('up', 'reset') THEN 0 ELSE held END
  FROM (SELECT e.*, f.p, f.held, CAST(list_min(list_filter(range(1, len(f.p) + 1), lambda i: abs(f.p[i].x - e.x) < 10 AND abs(f.p[i].y - e.y) < 10)) AS INT) AS near
        FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)),
l AS (SELECT user_id, arg_max(p, k) AS p FROM f GROUP BY user_id)
SELECT user_id, CAST(len(p) AS INT) AS n, array_to_string(list_transform(p, lambda q: printf('%.3f/%.3f', q.x, q.y)), ' ') AS points FROM l"""


@query(SESSION_FOLD)
def session_fold(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "down").when(F.col("event_type") == "view", "move").when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "reset").otherwise("other")
    e = e.select("user_id", F.struct("ts", "event_id").alias("ts"), kind.alias("kind"), "value", (F.col("value") * 3).alias("y"))
    text = F.array_join(F.transform("points", lambda p: F.format_string("%.3f/%.3f", p["x"], p["y"])), " ")
    return frames.fold_points(e, "user_id", "ts", "kind", "value", "y", most=4).select("user_id", F.size("points").alias("n"), text.alias("points"))


@query(SESSION_FOLD)
def session_fold_sorted(spark, sf_dir):
    """The same by rows in order, for sessions of any length."""
    kinds = {"click": "down", "view": "move", "purchase": "up", "error": "reset"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("other"))
    e = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), "value", (F.col("value") * 3).alias("y"))
    text = F.array_join(F.transform("points", lambda p: F.format_string("%.3f/%.3f", p["x"], p["y"])), " ")
    return sessions.fold_sorted(e, "user_id", "kind", "value", "y", "ts", "event_id", most=4).select("user_id", F.size("points").alias("n"), text.alias("points"))


@query(f"""
WITH p AS ({SHIFTED.format(n=10)}), q AS (SELECT vec_id, i, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y FROM p), d AS (SELECT *, (x - 300) ** 2 + (y - 300) ** 2 AS d FROM q),
r AS (SELECT *, (SELECT max(CAST(trunc(k * 29.8) AS INT)) FROM (SELECT unnest(range(1, 10)) AS k) WHERE trunc(k * 29.8) ** 2 < d.d) AS edge FROM d),
n AS (SELECT *, CASE WHEN d <= 0 OR d > 298 ** 2 THEN -1 ELSE (SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS k) WHERE trunc(k * 29.8) ** 2 < r.d) END AS ring FROM r)
SELECT vec_id, i, x >= 0 AND x < 600 AND y >= 0 AND y < 600 AS inside,
  CASE WHEN ring < 0 THEN 'black' WHEN d > 13 ** 2 AND d <= 16 ** 2 THEN 'black'
       WHEN ring >= 1 AND ring <> 6 AND d <= trunc(edge + 1.5) ** 2 THEN CASE WHEN ring = 7 THEN 'white' ELSE 'black' END
       ELSE ['yellow', 'red', 'blue', 'black', 'white'][CAST(ring // 2 AS INT) + 1] END AS colour FROM n""")
def ring_of_shots(spark, sf_dir):
    """Colour under each shot, and whether it is on the canvas."""
    p = shifted(spark, sf_dir).select("vec_id", "i", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return p.select("vec_id", "i", g.inside(F.col("x"), F.col("y"), 600).alias("inside"), raster.ring_colour(F.col("x"), F.col("y")).alias("colour"))


@query(f"""
WITH p AS ({SHIFTED.format(n=10)}), q AS (SELECT vec_id, i, round(sqrt((x - 300) ** 2 + (y - 300) ** 2) / 298, 3) AS r, round(degrees(atan2(y - 300, x - 300)), 3) AS a FROM p)
SELECT vec_id, i, CAST(trunc(300 + r * 298 * cos(radians(CASE WHEN a < 0 THEN a + 360 ELSE a END))) AS INT) AS px, CAST(trunc(300 + r * 298 * sin(radians(CASE WHEN a < 0 THEN a + 360 ELSE a END))) AS INT) AS py FROM q""")
def pixel_of_shot(spark, sf_dir):
    r, theta = g.polar(F.col("x"), F.col("y"))
    a = F.round(F.when(theta > 180, theta - 360).otherwise(theta), 3)
    p = shifted(spark, sf_dir).select("vec_id", "i", F.round(r, 3).alias("r"), F.when(a < 0, a + 360).otherwise(a).alias("a"))
    x, y = g.to_pixel(F.col("r"), F.col("a"))
    return p.select("vec_id", "i", x.alias("px"), y.alias("py"))


@query(f"""
WITH c AS (SELECT vec_id, [arg_min([x, y], (x + y, i)), arg_min([x, y], (x - y, -i)), arg_min([x, y], (-(x + y), i)), arg_min([x, y], (x - y, i))] AS p,
             len(list_distinct([arg_min(i, (x + y, i)), arg_min(i, (y - x, i)), arg_min(i, (-(x + y), i)), arg_min(i, (x - y, i))])) AS apart,
             arg_min([x, y], (y - x, i)) AS tr FROM ({PTS.format(n=4)}) GROUP BY vec_id),
d AS (SELECT vec_id, [p[1], tr, p[3], p[4]] AS p, 600.0 AS d FROM c WHERE apart = 4),
{ELIMINATION.format(target="[0, d, d, 0, 0, 0, d, d]")}
SELECT c.vec_id, c.apart = 4 AS apart, CAST(i AS INT) AS i, CASE WHEN bad THEN NULL WHEN i = 9 THEN 1.0 ELSE round(m[i][9] / CASE WHEN i IN (3, 6) THEN 600 WHEN i IN (7, 8) THEN 0.1 ELSE 10 END, 4) + 0.0 END AS h
FROM c LEFT JOIN g ON g.vec_id = c.vec_id, (SELECT unnest(range(1, 10)) AS i) WHERE i = 1 OR c.apart = 4""")
def square_corners(spark, sf_dir):
    """The map from the ordered corners to those of a square of 600; one row without it where one point is two corners."""
    names = ["tl", "tr", "br", "bl"]
    e = t(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(k) for k, c in g.corners(vec(4)).items()])
    e = e.withColumn("apart", F.size(F.array_distinct(F.array(*[F.col(f"{k}.i") for k in names]))) == 4)
    e = g.with_homography(e, [(F.col(f"{k}.x"), F.col(f"{k}.y")) for k in names], g.square())
    unit = [10, 10, 600, 10, 10, 600, 0.1, 0.1, 1]
    h = F.array(*[F.round(F.get("matrix", F.lit(k)) / u, 4) + 0.0 for k, u in enumerate(unit)])
    rows = e.select("vec_id", "apart", F.posexplode(F.when(F.col("apart"), h).otherwise(F.array(F.lit(None).cast("double")))).alias("i", "h"))
    return rows.select("vec_id", "apart", (F.col("i") + 1).alias("i"), "h")


@query(f"""
WITH e AS (SELECT vec_id, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y, arg_min(i, (y, i <> 0, i)) + 1 AS t, arg_min(i, (-y, i <> 1, i)) + 1 AS b,
           arg_min(i, (x, i <> 2, i)) + 1 AS l, arg_min(i, (-x, i <> 3, i)) + 1 AS r FROM ({PTS.format(n=4)}) GROUP BY vec_id)
SELECT vec_id, round(x[l], 6) AS x1, round(y[t], 6) AS y1, round((x[l] + x[r]) / 2, 6) AS cx, round((y[t] + y[b]) / 2, 6) AS cy, round(x[b], 6) AS chord_x2, round(y[r], 6) AS chord_y2,
       round((100 + vec_id % 7) / 50.0, 6) AS ratio_x, round((200 + vec_id % 5) / 40.0, 6) AS ratio_y FROM e""")
def guide_lines(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(k) for k, c in g.extremes(vec(4)).items()])
    four_of = [F.col(k) for k in ("top", "bottom", "left", "right")]
    level, upright = g.midlines(g.rectangle(*four_of))
    down, across = g.chords(*four_of)
    rx, ry = g.display_ratio(100 + F.col("vec_id") % 7, 200 + F.col("vec_id") % 5, F.lit(50.0), F.lit(40.0))
    at = lambda a, k: r6(F.get(a, F.lit(k)))
    return e.select("vec_id", at(level, 0).alias("x1"), at(upright, 1).alias("y1"), at(upright, 0).alias("cx"), at(level, 1).alias("cy"), at(down, 2).alias("chord_x2"), at(across, 3).alias("chord_y2"), r6(rx).alias("ratio_x"), r6(ry).alias("ratio_y"))


@query(f"SELECT vec_id, CAST(min(i) FILTER (abs(x) <= 6 AND abs(y) <= 6) AS INT) AS marker FROM ({PTS.format(n=10)}) GROUP BY vec_id")
def marker_hits(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", g.hit_marker(vec(10), F.lit(0.0), F.lit(0.0)).alias("marker"))


@query("""
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY md5(concat(event_id, '/3/42')), event_id) - 1 AS i FROM events)
SELECT i // 64 AS batch, CAST(count(*) AS INT) AS n, array_to_string(list(event_id ORDER BY i), ',') AS ids FROM r GROUP BY i // 64""")
def epoch_batches(spark, sf_dir):
    """Batches of an epoch's own order, stacked."""
    rows = frames.epoch_order(t(spark, sf_dir, "events").select("event_id", "value"), "event_id", 3)
    b = frames.stack_batches(rows, "idx", 64, "event_id", "value")
    return b.select("batch", F.size("value").alias("n"), F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


@query("""
WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, CAST(5 * least(i, floor(i * 20 / n)) AS INT) AS percent, printf('%d/%d | %d', i + 1, n, event_id % 11) AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM r JOIN events USING (event_id), n""")
def progress_and_status(spark, sf_dir):
    rows = frames.numbered(t(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    rows, n = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))), F.col("n")  # one row
    return rows.select("event_id", frames.progress(F.col("idx"), n).alias("percent"), paths.status(F.col("idx"), n, F.col("event_id") % 11).alias("status"), paths.iso_seconds(F.col("ts")).alias("at"))


@query("""
SELECT conv_id, concat('{"image":"', conv_id, '.png","created":"', max(turn), '","target":{"size":600,"rings":2,"ring_colors":["white","black"]},"shots":[',
  string_agg(concat('{"image":null,"timestamp":"', turn, '","r_norm":', turn, '.5}'), ',' ORDER BY turn), ']}') AS document FROM conversations GROUP BY conv_id""")
def series_documents(spark, sf_dir):
    shot = F.struct(F.lit(None).cast("string").alias("image"), F.col("turn").cast("string").alias("timestamp"), (F.col("turn") + 0.5).cast("double").alias("r_norm"))
    own = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", shot.alias("s")))).alias("x"))
    return own.select("conv_id", photos.series_document(F.concat(F.col("conv_id").cast("string"), F.lit(".png")), F.col("last").cast("string"), F.transform("x", lambda x: x["s"]), 600, ["white", "black"]).alias("document"))


@query("SELECT page_id, row_number() OVER (ORDER BY try_cast(page_id * 7 % 100 AS INT), page_id) - 1 AS place FROM pages")
def stem_order(spark, sf_dir):
    """Order by integer stem, then path; the place of each row."""
    rows = t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s/"), (F.col("page_id") * 7 % 100).cast("string"), F.lit("."), F.format_string("%012d", "page_id"), F.lit(".png")).alias("path"))
    placed = frames.numbered(rows.withColumn("stem", paths.int_stem(F.col("path"))), "stem", "path", out="place")
    return photos.by_int_stem(placed).select("page_id", F.col("place").cast("long").alias("place"))


@query("SELECT event_id // 1000 AS epoch, event_type AS split, round(avg(value), 6) AS loss FROM events GROUP BY ALL")
def loss_history(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("epoch"), F.col("event_type").alias("split"), F.col("value").alias("loss"))
    return frames.history_of_losses(e, "epoch", "split", "loss").select("epoch", "split", r6(F.col("loss")).alias("loss"))


@query(f"""
SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN i // 2 < 4 THEN CAST(embedding[i + 1] AS FLOAT) ELSE CAST(-100 AS FLOAT) END AS v FROM embeddings, (SELECT unnest(range(20)) AS i)""")
def label_tensors(spark, sf_dir):
    """Shots of a series document, read back and padded, in single precision."""
    shot = lambda k: F.struct(F.get("embedding", F.lit(2 * k)).alias("r_norm"), F.get("embedding", F.lit(2 * k + 1)).alias("theta_deg"))
    doc = F.to_json(F.struct(F.array(*[shot(k) for k in range(4)]).alias("shots")))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(shots.label_tensor(photos.shots(doc))).alias("i", "v"))
