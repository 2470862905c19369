"""The pixel measures once more, in DuckDB's SQL and by another way: each image is one list of cells, neighbours are list
positions, borders are reflected places, and nothing is a window or a join of pixels. For 8 x 8 rasters of embeddings."""

from __future__ import annotations

SIDE = 8

_CELLS = """cell as (select vec_id as img, list_transform(embedding, lambda x: least(255, greatest(0, floor(128 + 400 * x::DOUBLE)))::INT) as b, count(*) over () as n from embeddings),
tri as (select a.img, a.b, y.b as g, z.b as rr from cell a join cell y on y.img = (a.img + 1) % a.n join cell z on z.img = (a.img + 2) % a.n),
one as (select img, list_transform(generate_series(1, 64), lambda p: {'b': b[p], 'g': g[p], 'rr': rr[p], 'v': greatest(b[p], g[p], rr[p]), 'd': greatest(b[p], g[p], rr[p]) - least(b[p], g[p], rr[p]), 'gray': ((299 * rr[p] + 587 * g[p] + 114 * b[p] + 500) // 1000)::INT}) as px from tri),
deg as (select img, px, list_transform(px, lambda x: case when x.d = 0 then 0.0::DOUBLE when x.v = x.rr then 60.0::DOUBLE * (x.g - x.b) / x.d when x.v = x.g then 120.0::DOUBLE + 60.0::DOUBLE * (x.b - x.rr) / x.d else 240.0::DOUBLE + 60.0::DOUBLE * (x.rr - x.g) / x.d end) as t from one),
im as (select img, list_transform(px, lambda x: x.gray) as gray, list_transform(px, lambda x: x.v) as v, list_transform(px, lambda x: case when x.v = 0 then 0 else ((510 * x.d + x.v) // (2 * x.v))::INT end) as s,
  list_transform(t, lambda x: (floor((case when x < 0 then x + 360 else x end) / 2 + 0.5)::INT % 180)::INT) as h,
  list_transform(px, lambda x: x.gray >= 128 and img % 50 <> 7) as fg, list_transform(px, lambda x: x.rr * 65536 + x.g * 256 + x.b) as colour from deg),
us as (select *, len(list_filter(fg, lambda f: f)) as k, list_filter(generate_series(1, 64), lambda p: fg[p]) as ins from im),
ud as (select *, case when k / 64.0 < 0.05 then generate_series(1, 64) else ins end as used from us)"""
_STD = "sqrt(greatest(list_avg(list_transform({x}, lambda q: q * q)) - list_avg({x}) * list_avg({x}), 0))"


def _reflected(place: str) -> str:
    return f"(case when {place} < 0 then -({place}) when {place} > 7 then 14 - ({place}) else {place} end)"


def _at(dr: int, dc: int) -> str:
    """Gray value beside place p (1-based) with reflected borders."""
    return f"gray[8 * {_reflected(f'((p - 1) // 8 + {dr})')} + {_reflected(f'((p - 1) % 8 + {dc})')} + 1]"


_SOBEL_X = " + ".join(f"{w} * ({_at(dr, 1)} - {_at(dr, -1)})" for dr, w in ((-1, 1), (0, 2), (1, 1)))
_SOBEL_Y = " + ".join(f"{w} * ({_at(1, dc)} - {_at(-1, dc)})" for dc, w in ((-1, 1), (0, 2), (1, 1)))
_BOX = ", ".join(_at(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3))
_CODE = " + ".join(f"(gray[p + {8 * dr + dc}] >= gray[p])::INT * {1 << bit}" for bit, (dr, dc) in enumerate(((-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1))))
_INNER = "list_filter(generate_series(1, 64), lambda p: (p - 1) // 8 between 1 and 6 and (p - 1) % 8 between 1 and 6)"

SQL: dict[str, str] = {
    "px_gray": f"with {_CELLS} select img, (p - 1) // 8 as r, (p - 1) % 8 as c, gray[p] as gray from (select *, unnest(generate_series(1, 64))::INT as p from im)",
    "px_hsv": f"with {_CELLS} select img, (p - 1) // 8 as r, (p - 1) % 8 as c, h[p] as h, s[p] as s, v[p] as v from (select *, unnest(generate_series(1, 64))::INT as p from im)",
    "px_hue_hist": f"""with {_CELLS}, q as (select img, list_transform(generate_series(0, 7), lambda bin: len(list_filter(used, lambda p: 8 * h[p] // 180 = bin))) as n from ud)
select img, bin::INT as bin, round(case when list_max(n) = list_min(n) then 0.0 else (n[bin + 1] - list_min(n))::DOUBLE / (list_max(n) - list_min(n)) end, 6) as share from (select *, unnest(generate_series(0, 7)) as bin from q)""",
    "px_hsv_stats": f"""with {_CELLS}, q as (select img, list_transform(used, lambda p: s[p]::DOUBLE) as ss, list_transform(used, lambda p: v[p]::DOUBLE) as vv, list_avg(list_transform(used, lambda p: cos(radians(2.0 * h[p])))) as cx, list_avg(list_transform(used, lambda p: sin(radians(2.0 * h[p])))) as sx from ud)
select img, round((case when degrees(atan2(sx, cx)) < 0 then 360 else 0 end + degrees(atan2(sx, cx))) / 2, 4) as h_mean, round(sqrt(greatest(-2 * ln(sqrt(cx * cx + sx * sx) + 1e-9), 0)) * 90 / pi(), 4) as h_std,
  round(list_avg(ss), 4) as s_mean, round({_STD.format(x='ss')}, 4) as s_std, round(list_avg(vv), 4) as v_mean, round({_STD.format(x='vv')}, 4) as v_std from q""",
    "px_green_ratio": f"with {_CELLS} select img, round(len(list_filter(used, lambda p: h[p] between 17 and 42 and s[p] >= 40 and v[p] >= 40))::DOUBLE / len(used), 6) as green_ratio from ud",
    "px_otsu_threshold": f"""with {_CELLS}, t as (select img, gray, unnest(list_distinct(gray)) as g from im),
q as (select img, g, list_transform(list_filter(gray, lambda x: x <= g), lambda x: x::BIGINT) as lo, list_transform(list_filter(gray, lambda x: x > g), lambda x: x::BIGINT) as hi from t),
o as (select img, g, case when len(hi) > 0 then round(len(lo)::DOUBLE * len(hi) * power(list_sum(lo)::DOUBLE / len(lo) - list_sum(hi)::DOUBLE / len(hi), 2) / 4096, 3) else 0.0 end as score from q)
select img, arg_max(g, score * 1000 - g)::INT as threshold from (select img, g, score, max(score) over (partition by img) as top from o) where score = top group by img""",
    "px_mask_guard": f"with {_CELLS} select img, round(k / 64.0, 6) as share, k / 64.0 >= 0.01 as alpha_ok, k / 64.0 < 0.05 as drop_mask from us",
    "px_centroid": f"with {_CELLS} select img, case when k = 0 then 0.5 else round(list_avg(list_transform(ins, lambda p: (p - 1) // 8)) / 8, 6) end as centroid_y, case when k = 0 then 0.5 else round(list_avg(list_transform(ins, lambda p: (p - 1) % 8)) / 8, 6) end as centroid_x from us",
    "px_symmetry": f"""with {_CELLS}, q as (select *, case when k > 0 then greatest(1, least(6, floor(list_avg(list_transform(ins, lambda p: (p - 1) % 8)))::INT)) else 1 end as cx from us), m as (select *, least(cx, 8 - cx) as m from q),
x as (select img, k, list_filter(generate_series(0, 63), lambda j: j % 8 < m and fg[j + 1]) as l, list_filter(generate_series(0, 63), lambda j: j % 8 < m and fg[8 * (j // 8) + cx + m - 1 - j % 8 + 1]) as g from m)
select img, case when len(list_distinct(l || g)) = 0 then 0.0 else round(len(list_intersect(l, g))::DOUBLE / len(list_distinct(l || g)), 6) end as symmetry from x""",
    "px_crown_ratio": f"with {_CELLS} select img, case when k = 0 then 0.5 else round(len(list_filter(ins, lambda p: p <= 32))::DOUBLE / k, 6) end as crown_ratio from us",
    "px_vertical_profile": f"""with {_CELLS}, q as (select img, list_transform(generate_series(0, 7), lambda r: len(list_filter(used, lambda p: (p - 1) // 8 = r))) as n, len(used) as k from ud)
select img, round((list_position(n, list_max(n)) - 1) / 8.0, 6) as peak_row, round((n[1] + n[2])::DOUBLE / k, 6) as top25, round((n[7] + n[8])::DOUBLE / k, 6) as bottom25 from q""",
    "px_horizontal_distribution": f"""with {_CELLS}, q as (select img, list_filter(list_transform(generate_series(0, 7), lambda r: len(list_filter(used, lambda p: (p - 1) // 8 = r)) / 8.0::DOUBLE), lambda x: x > 0) as n from ud)
select img, round(list_avg(n), 6) as width_mean, round({_STD.format(x='n')}, 6) as width_std, round(list_max(n), 6) as width_max from q""",
    "px_lbp_hist": f"""with {_CELLS}, q as (select *, {_INNER} as inner_ from ud), w as (select *, case when len(list_intersect(inner_, used)) > 0 then list_intersect(inner_, used) else inner_ end as spots from q),
c as (select img, list_transform(spots, lambda p: 10 * ({_CODE}) // 256) as bins from w)
select img, bin::INT as bin, round(len(list_filter(bins, lambda x: x = bin))::DOUBLE / len(bins), 6) as share from (select *, unnest(generate_series(0, 9)) as bin from c)""",
    "px_glcm_stats": f"""with {_CELLS}, f as (select img, case when k / 64.0 < 0.05 then gray else list_transform(generate_series(1, 64), lambda p: case when fg[p] then gray[p] else floor(list_avg(list_transform(ins, lambda j: gray[j])))::INT end) end as flat from us),
l as (select img, list_transform(flat, lambda x: 63 * x // 255) as lv from f),
e as (select img, d, unnest(list_filter(generate_series(1, 64), lambda p: (p - 1) // 8 + d.r between 0 and 7 and (p - 1) % 8 + d.c between 0 and 7)) as p, lv from (select *, unnest([{{'r': 0, 'c': 1}}, {{'r': -1, 'c': 1}}, {{'r': -1, 'c': 0}}, {{'r': -1, 'c': -1}}]) as d from l)),
y as (select img, d, unnest([[lv[p], lv[p + 8 * d.r + d.c]], [lv[p + 8 * d.r + d.c], lv[p]]]) as ij from e), n as (select img, d, ij[1] as i, ij[2] as j, count(*)::DOUBLE as n from y group by all),
t as (select img, d, sum(n) as total, sum(n * i) / sum(n) as mu, sum(n * i * i) / sum(n) as m2, sum(n * i * j) / sum(n) as mij, sum(n * (i - j) * (i - j)) / sum(n) as contrast, sum(n / (1 + abs(i - j) + 1e-9)) / sum(n) as homogeneity, sum(n * n) as nn from n group by all)
select img, round(avg(contrast), 5) as contrast, round(avg(homogeneity), 5) as homogeneity, round(avg(nn / total / total), 5) as energy, round(avg((mij - mu * mu) / (m2 - mu * mu + 1e-9)), 5) as correlation from t group by img""",
    "px_gradient_stats": f"with {_CELLS}, q as (select img, list_transform(used, lambda p: sqrt((({_SOBEL_X}) * ({_SOBEL_X}) + ({_SOBEL_Y}) * ({_SOBEL_Y}))::DOUBLE)) as m from ud) select img, round(list_avg(m), 5) as grad_mean, round({_STD.format(x='m')}, 5) as grad_std from q",
    "px_roughness": f"with {_CELLS}, q as (select img, list_transform(used, lambda p: list_transform([{_BOX}], lambda x: x::DOUBLE)) as b from ud) select img, round(list_avg(list_transform(b, lambda y: {_STD.format(x='y')})), 5) as roughness from q",
    "px_bbox": f"""with {_CELLS}, q as (select img, k, list_transform(ins, lambda p: (p - 1) // 8) as r, list_transform(ins, lambda p: (p - 1) % 8) as c from us)
select img, case when k = 0 then 0 else list_min(c) end::INT as x, case when k = 0 then 0 else list_min(r) end::INT as y, case when k = 0 then 8 else list_max(c) - list_min(c) end::INT as w, case when k = 0 then 8 else list_max(r) - list_min(r) end::INT as h, k as area from q""",
    "px_unique_colours": f"with {_CELLS} select img, len(list_distinct(colour)) as colours from im",
    "px_validate_verdict": f"""with {_CELLS}, q as (select img, len(list_filter(generate_series(1, 64), lambda p: h[p] between 25 and 85 and s[p] >= 40 and v[p] >= 30)) / 64.0 < 0.04 as no_green, len(list_distinct(colour)) < 64 as few from im)
select img, not (no_green and few) as is_valid, case when no_green and few then 'low green; few colours' when no_green then 'low green' when few then 'few colours' else 'OK' end as reason from q""",
}

#: Feature -> measure and column, for features that are the same on pixels and on blocks of equal pixels.
FEATURES = {
    **{f"color_{c}": ("px_hsv_stats", c) for c in ("h_mean", "h_std", "s_mean", "s_std", "v_mean", "v_std")}, "color_green_ratio": ("px_green_ratio", "green_ratio"),
    "canopy_peak_row_norm": ("px_vertical_profile", "peak_row"), "canopy_top25_ratio": ("px_vertical_profile", "top25"), "canopy_bottom25_ratio": ("px_vertical_profile", "bottom25"),
    "canopy_width_mean": ("px_horizontal_distribution", "width_mean"), "canopy_width_std": ("px_horizontal_distribution", "width_std"), "canopy_max_width_norm": ("px_horizontal_distribution", "width_max"),
}
FEATURES_SQL = " union all ".join(f"select img, '{name}' as feature, {column} as value from ({SQL[measure]})" for name, (measure, column) in FEATURES.items())

#: Foreground components of neighbours on all eight sides: every cell's smallest reachable cell, by recursion.
COMPONENTS_SQL = f"""with recursive {_CELLS}, on_ as (select img, unnest(ins) - 1 as p from us),
near as (select a.img, a.p, b.p as q from on_ a join on_ b on a.img = b.img and abs(a.p // 8 - b.p // 8) <= 1 and abs(a.p % 8 - b.p % 8) <= 1),
reach as (select img, p, p as q from on_ union select r.img, r.p, n.q from reach r join near n on n.img = r.img and n.p = r.q),
root as (select img, p, min(q) as root from reach group by img, p), size as (select img, root, count(*) as n from root group by img, root)
select us.img, count(size.n) as n_components, coalesce(64 * max(size.n), 0)::BIGINT as largest from us left join size on us.img = size.img group by us.img"""
