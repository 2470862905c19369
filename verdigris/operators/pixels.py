"""Image measures as aggregates over a pixel table px(img, r, c, b, g, rr, gray, h, s, v, fg): one row per pixel.

Each measure is one SQL statement that reads {px} once. Pixels are dealt by image, so images of any number are spread over
the cluster. Colour and texture measures see the mask's pixels, or all where the mask is below 5 % of the image; measures of
form have defined values for an empty mask. pixels_sql.py says the same in another way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """Rounded luma of 8-bit channels, in integers."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def with_colour_spaces(px: DataFrame) -> DataFrame:
    """Adds gray and 8-bit h (0..179), s, v to pixels with b, g, rr."""
    b, g, r = F.col("b"), F.col("g"), F.col("rr")
    px = px.withColumn("gray", gray_of(r, g, b)).withColumn("v", F.greatest(b, g, r)).withColumn("d", F.col("v") - F.least(b, g, r))
    v, d = F.col("v"), F.col("d")
    part = F.when(d == 0, F.lit(0.0)).when(v == r, 60.0 * (g - b) / d).when(v == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    px = px.withColumn("deg", part).withColumn("deg", F.when(F.col("deg") < 0, F.col("deg") + 360.0).otherwise(F.col("deg")))
    px = px.withColumn("h", (F.floor(F.col("deg") / 2 + 0.5) % 180).cast("int")).withColumn("s", F.when(v == 0, 0).otherwise(F.floor((510 * d + v) / (2 * v))).cast("int"))
    return px.drop("d", "deg")


def raster(embeddings: DataFrame, side: int = 8, gain: int = 400, threshold: int = 128, blank: tuple[int, int] = (50, 7)) -> DataFrame:
    """Vectors seen as side x side images: channel values 128 + gain * x, the other two channels from the next two ids.
    Images with blank[1] = img mod blank[0] have no foreground."""
    n = embeddings.agg(F.count("*").alias("n"))
    cell = embeddings.select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("pos", "x"))
    cell = cell.select("img", "pos", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + gain * F.col("x").cast("double")))).cast("int").alias("b"))
    ring = cell.crossJoin(F.broadcast(n))  # one row
    g = ring.select(((F.col("img") - 1 + F.col("n")) % F.col("n")).alias("img"), "pos", F.col("b").alias("g"))
    r = ring.select(((F.col("img") - 2 + F.col("n")) % F.col("n")).alias("img"), "pos", F.col("b").alias("rr"))
    px = cell.join(g, ["img", "pos"]).join(r, ["img", "pos"])
    px = px.select("img", F.floor(F.col("pos") / side).cast("int").alias("r"), (F.col("pos") % side).alias("c"), "b", "g", "rr")
    return with_colour_spaces(px).withColumn("fg", (F.col("gray") >= threshold) & (F.col("img") % blank[0] != blank[1]))


#: Colour, texture and canopy measures use the whole image where the mask is below this share.
_USED = "select *, fg or avg(case when fg then 1.0e0 else 0.0e0 end) over (partition by img) < 0.05 as used from {px}"
_ROW, _COLUMN = "(partition by img, r order by c)", "(partition by img, c order by r)"
# values beside each pixel; null beyond a border
_AROUND = f"""
select img, used, x, w, e, lag(x) over k as n, lead(x) over k as s, lag(w) over k as nw, lag(e) over k as ne, lead(w) over k as sw, lead(e) over k as se
from (select img, r, c, used, gray as x, lag(gray) over {_ROW} as w, lead(gray) over {_ROW} as e from ({_USED}) u_) near_ window k as {_COLUMN}
"""
# Borders are completed by reflection without repeating the edge: each pixel knows the image's size and becomes one to nine rows.
_REFLECTED = f"""
select img, y as r, x as c, cast(gray as double) as x, used, y = r and x = c as own from (
  select *, explode(filter(array(r, case when r between 1 and 2 then -r end, case when r between mr - 2 and mr - 1 then 2 * mr - r end), q -> q is not null)) as y from (
    select *, explode(filter(array(c, case when c between 1 and 2 then -c end, case when c between mc - 2 and mc - 1 then 2 * mc - c end), q -> q is not null)) as x from (
      select *, max(r) over (partition by img) as mr, max(c) over (partition by img) as mc from ({_USED}) u_) z_) x_) y_
"""

MEASURES: dict[str, str] = {
    "px_gray": "select img, r, c, gray from {px}",
    "px_hsv": "select img, r, c, h, s, v from {px}",
    # hue histogram: 8 bins of 22.5 units, min-max scaled over the bins
    "px_hue_hist": f"""
with n as (select img, array({', '.join(f'count_if(used and floor(8 * h / 180) = {i})' for i in range(8))}) as n from ({_USED}) u_ group by img)
select img, bin, round(case when array_max(n) = array_min(n) then 0.0 else cast(k - array_min(n) as double) / (array_max(n) - array_min(n)) end, 6) as share from (select img, n, posexplode(n) as (bin, k) from n) b_""",
    "px_hsv_stats": f"""
with a as (select img, avg(cos(radians(cast(2 * h as double)))) as cx, avg(sin(radians(cast(2 * h as double)))) as sx, avg(cast(s as double)) as s_mean, stddev_pop(cast(s as double)) as s_std, avg(cast(v as double)) as v_mean, stddev_pop(cast(v as double)) as v_std from ({_USED}) u_ where used group by img),
q as (select img, degrees(atan2(sx, cx)) as t, sqrt(cx * cx + sx * sx) as u, s_mean, s_std, v_mean, v_std from a)
select img, round(case when t < 0 then t + 360 else t end / 2, 4) as h_mean, round(sqrt(greatest(-2 * ln(u + 1e-9), 0)) * 90 / pi(), 4) as h_std, round(s_mean, 4) as s_mean, round(s_std, 4) as s_std, round(v_mean, 4) as v_mean, round(v_std, 4) as v_std from q""",
    "px_green_ratio": f"select img, round(avg(case when h between 17 and 42 and s between 40 and 255 and v between 40 and 255 then 1.0e0 else 0.0e0 end), 6) as green_ratio from ({_USED}) u_ where used group by img",
    "px_otsu_threshold": """
with hist as (select img, gray, count(*) as k from {px} group by img, gray),
t as (select img, gray, sum(k) over w as n0, sum(k * gray) over w as s0, sum(k) over (partition by img) as n, sum(k * gray) over (partition by img) as s from hist window w as (partition by img order by gray rows between unbounded preceding and current row)),
q as (select img, gray, case when n > n0 then round(cast(n0 as double) * (n - n0) * power(cast(s0 as double) / n0 - cast(s - s0 as double) / (n - n0), 2) / n / n, 3) else 0.0 end as score from t),
o as (select img, gray, row_number() over (partition by img order by score desc, gray) as place from q)
select img, gray as threshold from o where place = 1""",
    "px_mask_guard": """
with a as (select img, avg(case when fg then 1.0e0 else 0.0e0 end) as share from {px} group by img)
select img, round(share, 6) as share, share >= 0.01 as alpha_ok, share < 0.05 as drop_mask from a""",
    "px_centroid": "select img, coalesce(round(avg(case when fg then cast(r as double) end) / (max(r) + 1), 6), 0.5) as centroid_y, coalesce(round(avg(case when fg then cast(c as double) end) / (max(c) + 1), 6), 0.5) as centroid_x from {px} group by img",
    # both halves beside the centre column, folded onto it
    "px_symmetry": """
with a as (select img, r, c, fg, max(c) over (partition by img) + 1 as w, greatest(1, least(max(c) over (partition by img) - 1, cast(floor(avg(case when fg then cast(c as double) end) over (partition by img)) as int))) as cx from {px}),
m as (select img, r, c, fg, cx, least(cx, w - cx) as m from a),
f as (select img, r, explode(filter(array(case when c < m then struct(c as k, fg as l, false as g) end, case when c >= cx and c < cx + m then struct(m - 1 - (c - cx) as k, false as l, fg as g) end), q -> q is not null)) as x from m),
y as (select img, r, x.k as k, bool_or(x.l) as l, bool_or(x.g) as g from f group by img, r, x.k)
select img, coalesce(round(cast(count_if(l and g) as double) / nullif(count_if(l or g), 0), 6), 0.0) as symmetry from y group by img""",
    "px_crown_ratio": "select img, coalesce(round(avg(case when fg then case when r < floor(hh / 2) then 1.0e0 else 0.0e0 end end), 6), 0.5) as crown_ratio from (select *, max(r) over (partition by img) + 1 as hh from {px}) z_ group by img",
    "px_vertical_profile": f"""
with n as (select img, r, count_if(used) as k from ({_USED}) u_ group by img, r),
q as (select img, r, k, max(r) over (partition by img) + 1 as hh from n)
select img, round(cast(min_by(r, struct(-k, r)) as double) / max(hh), 6) as peak_row, round(cast(sum(case when r < floor(hh / 4) then k else 0 end) as double) / sum(k), 6) as top25, round(cast(sum(case when r >= floor(3 * hh / 4) then k else 0 end) as double) / sum(k), 6) as bottom25 from q group by img""",
    "px_horizontal_distribution": f"""
with n as (select img, r, count_if(used) as k, count(*) as w from ({_USED}) u_ group by img, r)
select img, round(avg(cast(k as double) / w), 6) as width_mean, round(stddev_pop(cast(k as double) / w), 6) as width_std, round(max(cast(k as double) / w), 6) as width_max from n where k > 0 group by img""",
    # codes of the 8 neighbours, bits from the upper right against the clock; borders have no code and are left out
    "px_lbp_hist": f"""
with k as (select img, used, (case when ne >= x then 1 else 0 end + case when n >= x then 2 else 0 end + case when nw >= x then 4 else 0 end + case when w >= x then 8 else 0 end + case when sw >= x then 16 else 0 end + case when s >= x then 32 else 0 end + case when se >= x then 64 else 0 end + case when e >= x then 128 else 0 end) as code
  from ({_AROUND}) around_ where nw is not null and ne is not null and sw is not null and se is not null),
n as (select img, array({', '.join(f'count_if(used and floor(10 * code / 256) = {i})' for i in range(10))}) as own, array({', '.join(f'count_if(floor(10 * code / 256) = {i})' for i in range(10))}) as all_, count_if(used) as k, count(*) as total from k group by img)
select img, bin, round(cast(m as double) / case when k > 0 then k else total end, 6) as share from (select img, k, total, posexplode(case when k > 0 then own else all_ end) as (bin, m) from n) b_""",
    # levels 0..63, background at the mean; pairs at 0, 45, 90 and 135 degrees, counted both ways, averaged over the four
    "px_glcm_stats": f"""
with m as (select img, r, c, case when used then gray else cast(floor(avg(case when fg then cast(gray as double) end) over (partition by img)) as int) end as flat from ({_USED}) u_),
lv as (select img, r, c, cast(floor(63 * flat / 255) as int) as lv from m),
h as (select img, r, c, lv, lead(lv) over {_ROW} as e, lag(lv) over {_ROW} as w from lv),
d as (select img, lv, e, lag(lv) over k as n, lag(e) over k as ne, lag(w) over k as nw from h window k as {_COLUMN}),
pr as (select img, stack(8, 0, lv, e, 0, e, lv, 1, lv, ne, 1, ne, lv, 2, lv, n, 2, n, lv, 3, lv, nw, 3, nw, lv) as (k, i, j) from d),
ct as (select img, k, i, j, count(*) as n from pr where i is not null and j is not null group by img, k, i, j),
p as (select img, k, i, j, cast(n as double) / sum(n) over (partition by img, k) as p from ct),
mu as (select img, k, i, j, p, sum(i * p) over (partition by img, k) as mu from p),
st as (select img, k, sum(p * (i - j) * (i - j)) as contrast, sum(p / (1.0 + abs(i - j) + 1e-9)) as homogeneity, sum(p * p) as energy, sum(p * (i - mu) * (j - mu)) / (sqrt(sum(p * (i - mu) * (i - mu)) + 1e-9) * sqrt(sum(p * (j - mu) * (j - mu)) + 1e-9)) as correlation from mu group by img, k)
select img, round(sum(contrast) / 4, 5) as contrast, round(sum(homogeneity) / 4, 5) as homogeneity, round(sum(energy) / 4, 5) as energy, round(sum(correlation) / 4, 5) as correlation from st group by img""",
    "px_gradient_stats": f"""
with q as (select img, r, c, x, used, own, lag(x) over hr as w, lead(x) over hr as e from ({_REFLECTED}) refl_ window hr as {_ROW}),
v as (select img, r, c, used, own, e - w as dx, w + 2 * x + e as sm from q),
t as (select img, used, own, lag(dx) over hc + 2 * dx + lead(dx) over hc as gx, lead(sm) over hc - lag(sm) over hc as gy from v window hc as {_COLUMN})
select img, round(avg(sqrt(gx * gx + gy * gy)), 5) as grad_mean, round(stddev_pop(sqrt(gx * gx + gy * gy)), 5) as grad_std from t where own and used group by img""",
    "px_roughness": f"""
with q as (select img, r, c, used, own, avg(x) over hr as a, avg(x * x) over hr as a2 from ({_REFLECTED}) refl_ window hr as (partition by img, r order by c rows between 2 preceding and 2 following)),
t as (select img, used, own, avg(a) over hc as a, avg(a2) over hc as a2 from q window hc as (partition by img, c order by r rows between 2 preceding and 2 following))
select img, round(avg(sqrt(greatest(a2 - a * a, 0))), 5) as roughness from t where own and used group by img""",
    # an empty mask has the whole image as its box
    "px_bbox": "select img, coalesce(min(case when fg then c end), 0) as x, coalesce(min(case when fg then r end), 0) as y, coalesce(max(case when fg then c end) - min(case when fg then c end), max(c) + 1) as w, coalesce(max(case when fg then r end) - min(case when fg then r end), max(r) + 1) as h, count_if(fg) as area from {px} group by img",
    "px_unique_colours": "select img, count(distinct rr * 65536 + g * 256 + b) as colours from {px} group by img",
    # thresholds of the verdict are parameters; these fit 8 x 8 rasters
    "px_validate_verdict": """
with a as (select img, max(r) + 1 as hh, max(c) + 1 as w, avg(case when h between 25 and 85 and s >= 40 and v >= 30 then 1.0e0 else 0.0e0 end) as green, count(distinct rr * 65536 + g * 256 + b) as colours from {px} group by img),
f as (select img, least(hh, w) < 4 as small, greatest(hh, w) > 8000 as large, green < 0.04 as no_green, colours < 64 as few_colours, cast(greatest(hh, w) as double) / greatest(least(hh, w), 1) > 5 as long_ from a)
select img, not small and not (no_green and few_colours) as is_valid,
  case when small then 'too small' when no_green and few_colours then 'low green; few colours' when large or no_green or few_colours or long_ then concat_ws('; ', case when large then 'very large' end, case when no_green then 'low green' end, case when few_colours then 'few colours' end, case when long_ then 'long' end) else 'OK' end as reason from f""",
}


def measure(px: DataFrame, name: str) -> DataFrame:
    """One of MEASURES over a pixel table. Pixels are dealt by image once; the statement's windows and groups of an image, its
    rows or its columns then need no other exchange."""
    return px.sparkSession.sql(MEASURES[name], px=px.repartition("img"))
