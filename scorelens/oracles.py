"""DuckDB-runnable SQL for the registered queries (the correctness oracle).

Each statement carries the `sample` view as a CTE.  Ratios are rounded to 10
digits and counts cast to bigint on both sides, so equal values hash equally.
"""

from __future__ import annotations

from scorelens.sources.tables import SAMPLE_SQL


def rnd(expr: str, digits: int = 6) -> str:
    """Correctly rounded decimal of a double, parsed back (printf rounds the exact
    binary value, as Python's round does; DuckDB's round(x, d) is off by an ulp
    for large x)."""
    return f"cast(printf('%.{digits}f', {expr}) as double)"


def with_sample(body: str, extra_ctes: str = "") -> str:
    extra = f", {extra_ctes}" if extra_ctes else ""
    return f"with sample as ({SAMPLE_SQL}){extra} {body}"


def _by(by):
    sel = "".join(f"{c}, " for c in by)
    part = f"partition by {', '.join(by)}" if by else ""
    grp = ", ".join(by)
    return sel, part, grp


def gains_sql(bins: int = 20, by=("sample",), where: str = "", balance: bool = False) -> str:
    sel, part, grp = _by(by)
    g_by = f"group by {grp}" if by else ""
    join_on = f"using ({grp}, bin)" if by else "using (bin)"
    bal_t = (", sum(case when target = 1 then balance else 0 end) as tot_bbal, "
             "sum(case when target = 0 then balance else 0 end) as tot_gbal") if balance else ""
    bal_a = (", sum(case when target = 1 then balance else 0 end) as bbal, "
             "sum(case when target = 0 then balance else 0 end) as gbal") if balance else ""
    ctes = f"""
src as (select * from sample {where}),
r as (select {sel} score, target, balance,
        row_number() over ({part} order by score desc, row_id) - 1 as pos,
        count(*) over ({part}) as n
      from src),
t as (select {sel} count(*) filter (where target = 1) as tot_bad,
        count(*) filter (where target = 0) as tot_good {bal_t}
      from src {g_by}),
b as (select *, n // {bins} as bin_len from r),
bb as (select *, case when bin_len > 0 and pos < bin_len * {bins} then pos // bin_len + 1 end as bin from b),
a as (select {sel} bin, count(*) filter (where target = 1) as bad,
        count(*) filter (where target = 0) as good, avg(score) as avg_score {bal_a}
      from bb where bin is not null group by {sel} bin),
g as (select t.*, s.bin from t cross join range(1, {bins} + 1) s(bin)),
j as (select g.*, coalesce(a.bad, 0) as bad, coalesce(a.good, 0) as good, a.avg_score
        {", coalesce(a.bbal, 0) as bbal, coalesce(a.gbal, 0) as gbal" if balance else ""}
      from g left join a {join_on}),
c as (select *, sum(bad) over w as cbad, sum(good) over w as cgood
        {", sum(bbal) over w as cbbal, sum(gbal) over w as cgbal" if balance else ""}
      from j window w as ({part} order by bin rows between unbounded preceding and current row))
"""
    bad_pct = "round(cbad / nullif(tot_bad, 0), 10)"
    good_pct = "round(cgood / nullif(tot_good, 0), 10)"
    if not balance:
        body = f"""select {sel} cast(bin as int) as bin, cast(cbad as bigint) as cum_bad_num,
  cast(cgood as bigint) as cum_good_num, {bad_pct} as cum_bad_pct, {good_pct} as cum_good_pct,
  round(avg_score, 10) as avg_score, round(abs({bad_pct} - {good_pct}), 10) as ks_value from c"""
    else:
        body = f"""select {sel} cast(bin as int) as bin, cast(cbad as bigint) as cum_bad_num,
  cast(tot_bad as bigint) as tot_bad_num, {bad_pct} as cum_bad_pct,
  cast(cgood as bigint) as cum_good_num, cast(tot_good as bigint) as tot_good_num,
  {good_pct} as cum_good_pct, round(abs({bad_pct} - {good_pct}), 10) as ks_value,
  {rnd('cast(cbbal as double)', 2)} as cum_bad_bal, {rnd('cast(tot_bbal as double)', 2)} as tot_bad_bal,
  round(cast(cbbal as double) / nullif(cast(tot_bbal as double), 0), 10) as cum_bad_bal_pct,
  {rnd('cast(cgbal as double)', 2)} as cum_good_bal, {rnd('cast(tot_gbal as double)', 2)} as tot_good_bal,
  round(cast(cgbal as double) / nullif(cast(tot_gbal as double), 0), 10) as cum_good_bal_pct from c"""
    return with_sample(body, ctes)


def roc_ctes(by=("sample",), where: str = "") -> str:
    sel, part, grp = _by(by)
    return f"""
d as (select {sel} score, count(*) filter (where target = 1) as pos,
        count(*) filter (where target = 0) as neg
      from sample {where} group by {sel} score),
c as (select *, sum(pos) over w as tp, sum(neg) over w as fp,
        sum(pos) over ({part}) as "P", sum(neg) over ({part}) as "N"
      from d window w as ({part} order by score desc rows between unbounded preceding and current row))
"""


def roc_summary_sql(by=("sample",), where: str = "", cols=("ks", "auc")) -> str:
    sel, part, grp = _by(by)
    exprs = {
        "ks": 'round(cast(max(abs(tp * "N" - fp * "P")) as double) / (cast("P" as double) * "N"), 10) as ks',
        "auc": 'round(cast(sum(neg * (2 * tp - pos)) as double) / (2 * cast("P" as double) * "N"), 10) as auc',
    }
    body = f"select {sel} {', '.join(exprs[c] for c in cols)} from c group by {sel} \"P\", \"N\""
    return with_sample(body, roc_ctes(by, where))


def roc_points_sql(by=("sample",), where: str = "") -> str:
    sel, _, _ = _by(by)
    body = (f"select {sel} score as threshold, round(tp / \"P\", 10) as tpr, "
            f"round(fp / \"N\", 10) as fpr from c")
    return with_sample(body, roc_ctes(by, where))


def roc_points_thin_sql(by=("sample",), where: str = "") -> str:
    sel, _, part = _by(by)
    over = f"partition by {', '.join(by)} " if by else ""
    body = (f"select {sel} threshold, tpr, fpr from (select {sel} score as threshold, round(tp / \"P\", 10) as tpr, round(fp / \"N\", 10) as fpr, "
            f"tp, fp, lag(tp) over w as t0, lag(fp) over w as f0, lead(tp) over w as t2, lead(fp) over w as f2 from c window w as ({over}order by score desc)) "
            f"where t0 is null or t2 is null or t2 - 2 * tp + t0 <> 0 or f2 - 2 * fp + f0 <> 0")
    return with_sample(body, roc_ctes(by, where))


SAMPLES = ("dev", "val", "oft1", "oft2", "oft3")


def band_sql(n_bands: int) -> str:
    """Label of the score's band, by the number of edges below it (written apart from the library's CASE)."""
    step = 100 // n_bands
    texts = [f"{i * step // 100}.{i * step % 100:02d}" for i in range(n_bands + 1)]
    edges = "[" + ", ".join(f"'{t}'::double" for t in texts) + "]"
    labels = "[" + ", ".join(f"'{a}~{b}'" for a, b in zip(texts, texts[1:])) + "]"
    return f"case when score > 0 and score <= 1 then {labels}[len([e for e in {edges} if e < score])] end"


def band_rows_sql(n_bands: int) -> str:
    return with_sample(f"select row_id, score, {band_sql(n_bands)} as band from sample")


def score_distribution_sql(n_bands: int = 20) -> str:
    cnt = ", ".join(f"count(*) filter (where sample = '{s}') as n_{s}" for s in SAMPLES)
    ncols = ", ".join(f"cast(n_{s} as bigint) as n_{s}" for s in SAMPLES)
    pcts = ", ".join(f"round(n_{s} / sum(n_{s}) over (), 10) as pct_{s}" for s in SAMPLES)
    ctes = (f"b as (select {band_sql(n_bands)} as band, sample from sample), "
            f"c as (select band, {cnt} from b where band is not null group by band)")
    return with_sample(f"select band, {ncols}, {pcts} from c", ctes)


def band_counts_sql(n_bands: int = 20, where: str = "") -> str:
    ctes = f"b as (select {band_sql(n_bands)} as band from sample {where})"
    return with_sample("select band, count(*) as n from b where band is not null group by band", ctes)


def psi_sql(k: int, others=("val",), base: str = "dev") -> str:
    ins = ", ".join(f"'{s}'" for s in others)
    ctes = f"""
dev as (select score, row_number() over (order by score desc, row_id) - 1 as pos
        from sample where sample = '{base}'),
mm as (select count(*) // {k} as m, count(*) as n_dev from dev),
inner_e as (select t.j, d.score as e from range(1, {k}) t(j) cross join mm join dev d on d.pos = mm.m * t.j),
ext as (select sample, max(score) as mx, min(score) as mn, count(*) as n_cmp
        from sample where sample in ({ins}) group by sample),
bands as (select x.sample, b.band,
            case when b.band = 0 then x.mx else hi_e.e end as hi,
            case when b.band = {k - 1} then x.mn else lo_e.e end as lo, x.n_cmp
          from ext x cross join range(0, {k}) b(band)
          left join inner_e hi_e on hi_e.j = b.band
          left join inner_e lo_e on lo_e.j = b.band + 1),
cmpc as (select b.sample, b.band, count(s.score) as c from bands b
         left join sample s on s.sample = b.sample and s.score <= b.hi
           and (s.score > b.lo or (b.band = {k - 1} and s.score >= b.lo))
         group by b.sample, b.band),
devc as (select b.sample, b.band, count(d.score) as c from bands b
         left join dev d on d.score <= b.hi and (d.score > b.lo or (b.band = {k - 1} and d.score >= b.lo))
         group by b.sample, b.band),
g as (select b.sample, b.band, b.hi, b.lo, devc.c / mm.n_dev as ds, cmpc.c / b.n_cmp as vs
      from bands b join cmpc using (sample, band) join devc using (sample, band) cross join mm),
t as (select *, case when ds = 0 or vs = 0 then 1.0 else (ds - vs) * ln(ds / vs) end as term from g)
"""
    body = """select sample, cast(band as int) as band, hi, lo, round(ds, 10) as dev_share,
  round(vs, 10) as cmp_share, round(term, 10) as term,
  round(sum(term) over (partition by sample), 10) as psi from t"""
    return with_sample(body, ctes)


def psi_monitor_sql(k: int = 20, others=("val", "oft1", "oft2", "oft3")) -> str:
    return f"select sample, max(psi) as psi from ({psi_sql(k, others)}) group by sample"


def histogram_sql(bins: int = 20) -> str:
    ctes = f"""
ext0 as (select sample, min(score) as mn0, max(score) as mx0, count(score) as n
         from sample where score is not null group by sample),
ext as (select sample, n, case when mn0 = mx0 then mn0 - 0.5 else mn0 end as mn,
          case when mn0 = mx0 then mx0 + 0.5 else mx0 end as mx from ext0),
e2 as (select *, (mx - mn) / {float(bins)} as step from ext),
r as (select s.sample, s.score as x, e.mn, e.mx, e.step,
        least(cast(trunc(((s.score - e.mn) / (e.mx - e.mn)) * {float(bins)}) as int), {bins - 1}) as i0
      from sample s join e2 e using (sample) where s.score is not null),
r1 as (select *, case when x < (case when i0 >= {bins} then mx else i0 * step + mn end)
                      then i0 - 1 else i0 end as i1 from r),
r2 as (select *, case when x >= (case when i1 + 1 >= {bins} then mx else (i1 + 1) * step + mn end)
                       and i1 != {bins - 1} then i1 + 1 else i1 end as i from r1),
c as (select sample, i, count(*) as cnt from r2 group by sample, i),
g as (select e2.*, t.i from e2 cross join range(0, {bins}) t(i)),
j as (select g.*, coalesce(c.cnt, 0) as cnt,
        case when g.i >= {bins} then g.mx else g.i * g.step + g.mn end as lo,
        case when g.i + 1 >= {bins} then g.mx else (g.i + 1) * g.step + g.mn end as hi
      from g left join c using (sample, i))
"""
    body = """select sample, cast(i + 1 as int) as bin, round(lo, 10) as lo, round(hi, 10) as hi,
  cast(cnt as bigint) as count, round(cnt / (hi - lo) / n, 10) as density from j"""
    return with_sample(body, ctes)


# Columns of the `sample` view and their kinds, for generated oracle SQL.
SAMPLE_COLUMNS = [
    ("row_id", "int"), ("sample", "str"), ("target", "int"), ("score", "dbl"), ("balance", "dec"),
    ("totalprice", "dbl"), ("acctbal", "dbl"), ("sparse_num", "dbl"), ("segment", "str"),
    ("priority", "str"), ("nation", "str"), ("location", "str"), ("segment_null", "str"), ("num_text", "str"),
]


def _sel(c, kind):
    return f"cast({c} as double) as {c}" if kind == "dec" else c


def split_x_y_sql() -> str:
    cols = ", ".join(_sel(c, k) for c, k in SAMPLE_COLUMNS if c != "target")
    return with_sample(f"select {cols} from sample")


def fill_constant_sql(value=0) -> str:
    out = []
    for c, k in SAMPLE_COLUMNS:
        if k == "str":
            out.append(f"coalesce({c}, '{value}') as {c}")
        elif k == "dbl":
            out.append(f"case when {c} is null or isnan({c}) then {float(value)} else {c} end as {c}")
        elif k == "dec":
            out.append(f"coalesce(cast({c} as double), {float(value)}) as {c}")
        else:
            out.append(f"coalesce({c}, {value}) as {c}")
    return with_sample(f"select {', '.join(out)} from sample")


def fill_mean_sql(cols=("totalprice", "acctbal", "sparse_num")) -> str:
    sel = ", ".join(f"{rnd(f'coalesce({c}, (select avg({c}) from sample))', 6)} as {c}" for c in cols)
    return with_sample(f"select row_id, {sel} from sample")


def sparse_report_sql(nan_ratio: float = 0.5) -> str:
    parts = [f"select '{c}' as column_name, count({c}) as non_null, count(*) as n_rows from sample"
             for c, _ in SAMPLE_COLUMNS]
    body = (f"select column_name, non_null, n_rows, not (non_null / n_rows < {1.0 - nan_ratio}::double) as kept "
            f"from ({' union all '.join(parts)})")
    return with_sample(body)


def stratified_sql(frac1=0.7, frac0=0.7, seed=1) -> str:
    ctes = f"""r as (select row_id, target, sample,
    row_number() over (partition by target order by md5(cast(row_id as varchar) || '#{seed}'), row_id) as rn,
    count(*) over (partition by target) as n from sample where target in (0, 1))"""
    body = (f"select row_id, target, sample from r where rn <= floor(case when target = 1 "
            f"then {float(frac1)}::double else {float(frac0)}::double end * n)")
    return with_sample(body, ctes)


def dev_val_split_sql(test_size=0.3, seed=1) -> str:
    ctes = f"""r as (select row_id,
    row_number() over (order by md5(cast(row_id as varchar) || '#{seed}'), row_id) as rn,
    count(*) over () as n from sample)"""
    body = (f"select row_id, case when rn <= n - ceil({float(test_size)}::double * n) then 'dev' else 'val' end "
            f"as split from r")
    return with_sample(body, ctes)


CHAR = ("segment", "priority", "nation", "segment_null")
BUILD = "sample in ('dev', 'val')"


def long_cte(features=CHAR) -> str:
    parts = [f"select row_id, sample, target, '{f}' as feature, cast({f} as varchar) as level from sample"
             for f in features]
    return "long as (" + " union all ".join(parts) + ")"


def woe_map_ctes(where: str = BUILD, features=CHAR) -> str:
    one = lambda x: f"(case when {x} = 0 then 1 else {x} end)"
    return f"""{long_cte(features)},
wc as (select feature, level, count(*) as n, count(*) filter (where target = 1) as bad,
         count(*) filter (where target = 0) as good0 from long where {where} group by feature, level),
ww as (select *, sum(bad) over (partition by feature) as "B", sum(good0) over (partition by feature) as "G" from wc),
wm as (select feature, level, n, bad, n - bad as good,
         round(ln(cast({one('bad')} as double) * {one('"G"')} / {one('"B"')} / {one('n - bad')}), 10) as woe
       from ww)"""


def woe_map_sql(where: str = BUILD) -> str:
    return with_sample("select feature, level, n, bad, good, woe from wm", woe_map_ctes(where))


def woe_apply_sql(fit_where: str, apply_where: str, fill=None, features=CHAR) -> str:
    joins, cols = [], []
    for i, f in enumerate(features):
        joins.append(f"left join (select level, woe from wm where feature = '{f}') m{i} "
                     f"on cast(s.{f} as varchar) is not distinct from m{i}.level")
        cols.append(f"coalesce(m{i}.woe, {fill}) as {f}" if fill is not None else f"m{i}.woe as {f}")
    body = f"select s.row_id, {', '.join(cols)} from sample s {' '.join(joins)} where {apply_where}"
    return with_sample(body, woe_map_ctes(fit_where, features))


def category_stats_ctes(where: str = BUILD, features=CHAR, name: str = "cs") -> str:
    return f"""{name}_c as (select feature, level, count(*) filter (where target = 0) as good,
        count(*) filter (where target = 1) as bad from long
        where {where} and target in (0, 1) and level is not null group by feature, level),
{name} as (select feature, level, good, bad, bad / (bad + good) as bad_ratio,
        row_number() over (partition by feature order by bad / (bad + good), level) - 1 as idx from {name}_c)"""


def category_stats_sql(where: str = BUILD) -> str:
    body = "select feature, level, good, bad, round(bad_ratio, 10) as bad_ratio, idx from cs"
    return with_sample(body, f"{long_cte()}, {category_stats_ctes(where)}")


def grouped_ks_sql(where: str = BUILD) -> str:
    ctes = f"""{long_cte()}, {category_stats_ctes(where)},
k as (select feature, abs(sum(good) over w / sum(good) over (partition by feature)
        - sum(bad) over w / sum(bad) over (partition by feature)) as k from cs
      window w as (partition by feature order by idx rows between unbounded preceding and current row))"""
    return with_sample("select feature, round(max(k), 10) as ks from k group by feature", ctes)


def grouped_iv_sql(where: str = BUILD) -> str:
    ctes = f"""{long_cte()}, {category_stats_ctes(where)},
s as (select feature, good / sum(good) over (partition by feature) as gp,
        bad / sum(bad) over (partition by feature) as bp from cs)"""
    body = ("select feature, round(coalesce(sum(case when gp != 0 and bp != 0 then ln(bp / gp) * (bp - gp) end), 0), 10)"
            " as iv from s group by feature")
    return with_sample(body, ctes)


def category_psi_sql(build: str = BUILD, off: str = "sample = 'oft1'") -> str:
    ctes = f"""{long_cte()}, {category_stats_ctes(build, name='b')}, {category_stats_ctes(off, name='o')},
j as (select b.feature, b.good + b.bad as bn, o.good + o.bad as on_ from b join o using (feature, level)),
t as (select feature, bn / sum(bn) over (partition by feature) as p, on_ / sum(on_) over (partition by feature) as q from j)"""
    return with_sample("select feature, round(sum(ln(p / q) * (p - q)), 10) as psi from t group by feature", ctes)


def group_woe_sql(where: str = BUILD) -> str:
    ctes = f"""{long_cte()}, {category_stats_ctes(where)},
s as (select feature, level, bad, good, sum(bad) over (partition by feature) as "B",
        sum(good) over (partition by feature) as "G" from cs)"""
    body = """select feature, level, round(case when bad = 0 and good = 0 then -99.0
  when bad = 0 then '-inf'::double when good = 0 then 'inf'::double
  else ln((bad / "B") / (good / "G")) end, 10) as woe from s"""
    return with_sample(body, ctes)


def cut_probs(n: int) -> list[float]:
    """k/n for k = 0 to n, by steps of 1/n."""
    return [k * (1.0 / n) * 100.0 / 100.0 for k in range(n)] + [1.0]


def autogroup_ctes(build=("dev", "val"), offs=("oft1", "oft2", "oft3"), attempts=(3, 4, 5, 6, 7),
                   min_levels: int = 7, features=CHAR) -> str:
    bl = ", ".join(f"'{s}'" for s in build)
    ol = ", ".join(f"'{s}'" for s in offs)
    probs = sorted({p for n in attempts for p in cut_probs(n)})
    pos = {p: i + 1 for i, p in enumerate(probs)}
    plist = "[" + ", ".join(f"{p!r}::double" for p in probs) + "]"
    case = "case n " + " ".join(
        f"when {n} then [" + ", ".join(f"q[{pos[p]}]" for p in cut_probs(n)) + "]" for n in attempts) + " end"
    nvals = ", ".join(f"({n})" for n in attempts)
    psi_new = []
    for i, p in enumerate(offs, start=1):
        psi_new.append(f"""pn{i} as (select feature, n, round(sum(ln(pp / qq) * (pp - qq)), 10) as psi from (
    select b.feature, b.n, (b.good + b.bad) / sum(b.good + b.bad) over (partition by b.feature, b.n) as pp,
      (o.good + o.bad) / sum(o.good + o.bad) over (partition by b.feature, b.n) as qq
    from ng b join og o on o.feature = b.feature and o.n = b.n and o.grp = b.grp and o.period = '{p}')
  group by feature, n)""")
    m = lambda c: f"case when a.ok then coalesce({c}, 0.0) else 0.0 end"
    k = len(offs)
    psi_cols_big = ", ".join(f"{m(f'pn{i}.psi')} as new_psi_{i}" for i in range(1, k + 1))
    psi_joins = " ".join(f"left join pn{i} on pn{i}.feature = a.feature and pn{i}.n = a.n" for i in range(1, k + 1))
    psi_zero = ", ".join(f"0.0 as new_psi_{i}" for i in range(1, k + 1))
    psi_sum = " + ".join(f"new_psi_{i}" for i in range(1, k + 1))
    return f"""{long_cte(features)},
st as (select case when sample in ({bl}) then 'build' else sample end as period, feature, level,
         count(*) filter (where target = 0) as good, count(*) filter (where target = 1) as bad
       from long where sample in ({bl}, {ol}) and target in (0, 1) and level is not null group by 1, 2, 3),
cs as (select *, bad / (bad + good) as bad_ratio,
         row_number() over (partition by period, feature order by bad / (bad + good), level) - 1 as idx from st),
bs as (select feature, level, good, bad, bad_ratio, idx from cs where period = 'build'),
nl as (select feature, count(*) as n_levels from bs group by feature),
qx as (select feature, quantile_cont(bad_ratio, {plist}) as q from (
         select b.feature, b.bad_ratio, unnest(range(b.good + b.bad)) as r
         from bs b join nl using (feature) where nl.n_levels >= {min_levels}) group by feature),
att0 as (select feature, n, list_sort(list_distinct({case})) as edges from qx cross join (values {nvals}) t(n)),
ex as (select feature, n, len(edges) as n_edges, unnest(edges) as edge, unnest(range(len(edges))) as j from att0),
fi as (select feature, bad_ratio, min(idx) as border from bs group by feature, bad_ratio),
bj as (select ex.feature, ex.n, ex.n_edges, ex.j, fi.border from ex
       left join fi on fi.feature = ex.feature and fi.bad_ratio = ex.edge where ex.j >= 1),
agg as (select feature, n, count(*) filter (where border is null) as missing from bj group by feature, n),
att as (select a.feature, a.n, coalesce(g.missing, 0) = 0 and len(a.edges) >= 2 as ok,
          cast(len(a.edges) - 1 as int) as n_groups
        from att0 a left join agg g using (feature, n)),
ib as (select feature, n, border from bj where j <= n_edges - 2),
lv as (select b.feature, a.n, b.level, b.idx, b.good, b.bad,
         cast((select count(*) from ib where ib.feature = b.feature and ib.n = a.n and ib.border < b.idx) as int) as grp
       from bs b join att a on a.feature = b.feature and a.ok),
ng as (select feature, n, grp, cast(sum(good) as bigint) as good, cast(sum(bad) as bigint) as bad from lv group by feature, n, grp),
og as (select o.period, o.feature, a.n, coalesce(m.grp, 0) as grp, cast(sum(o.good) as bigint) as good,
         cast(sum(o.bad) as bigint) as bad
       from cs o join att a on a.feature = o.feature and a.ok
       left join lv m on m.feature = o.feature and m.n = a.n and m.level = o.level
       where o.period != 'build' group by 1, 2, 3, 4),
ks_old as (select feature, round(max(abs(cg / gg - cb / bb)), 10) as ks from (
    select feature, sum(good) over w as cg, sum(bad) over w as cb, sum(good) over (partition by feature) as gg,
      sum(bad) over (partition by feature) as bb from bs
    window w as (partition by feature order by idx rows between unbounded preceding and current row)) group by feature),
ks_new as (select feature, n, round(max(abs(cg / gg - cb / bb)), 10) as ks from (
    select feature, n, sum(good) over w as cg, sum(bad) over w as cb,
      sum(good) over (partition by feature, n) as gg, sum(bad) over (partition by feature, n) as bb from ng
    window w as (partition by feature, n order by grp rows between unbounded preceding and current row))
  group by feature, n),
iv_old as (select feature, round(coalesce(sum(case when gp != 0 and bp != 0 then ln(bp / gp) * (bp - gp) end), 0), 10) as iv
  from (select feature, good / sum(good) over (partition by feature) as gp,
          bad / sum(bad) over (partition by feature) as bp from bs) group by feature),
iv_new as (select feature, n, round(coalesce(sum(case when gp != 0 and bp != 0 then ln(bp / gp) * (bp - gp) end), 0), 10) as iv
  from (select feature, n, good / sum(good) over (partition by feature, n) as gp,
          bad / sum(bad) over (partition by feature, n) as bp from ng) group by feature, n),
psi_old as (select feature, round(sum(ln(pp / qq) * (pp - qq)), 10) as psi from (
    select b.feature, (b.good + b.bad) / sum(b.good + b.bad) over (partition by b.feature) as pp,
      (o.good + o.bad) / sum(o.good + o.bad) over (partition by b.feature) as qq
    from bs b join cs o on o.feature = b.feature and o.level = b.level and o.period = '{offs[0]}') group by feature),
{", ".join(psi_new)},
rep_big as (select a.feature, cast(a.n as int) as n_bins, case when a.ok then a.n_groups else 0 end as n_groups,
    case when a.ok then 'regrouped' else 'failed' end as status,
    {m('ks_old.ks')} as old_build_ks, {m('ks_new.ks')} as new_build_ks,
    {m('iv_old.iv')} as old_build_iv, {m('iv_new.iv')} as new_build_iv,
    {m('psi_old.psi')} as old_psi_1, {psi_cols_big}
  from att a left join ks_new on ks_new.feature = a.feature and ks_new.n = a.n
  left join iv_new on iv_new.feature = a.feature and iv_new.n = a.n {psi_joins}
  left join ks_old on ks_old.feature = a.feature left join iv_old on iv_old.feature = a.feature
  left join psi_old on psi_old.feature = a.feature),
rep_small as (select nl.feature, 0 as n_bins, 0 as n_groups, 'unchanged' as status,
    coalesce(ks_old.ks, 0.0) as old_build_ks, 0.0 as new_build_ks, coalesce(iv_old.iv, 0.0) as old_build_iv,
    0.0 as new_build_iv, coalesce(psi_old.psi, 0.0) as old_psi_1, {psi_zero}
  from nl left join ks_old using (feature) left join iv_old using (feature) left join psi_old using (feature)
  where nl.n_levels < {min_levels}),
rep0 as (select * from rep_big union all select * from rep_small),
rep as (select *, round(({psi_sum}) / {float(k)}, 10) as psi_sum from rep0),
rep2 as (select *, round(new_build_iv - psi_sum, 10) as score from rep),
best as (select feature, n_bins as n, n_groups, score from (
    select *, row_number() over (partition by feature order by score desc, n_bins) as r
    from rep2 where status = 'regrouped') where r = 1),
gw as (select feature, grp, good, bad, sum(bad) over (partition by feature) as bb,
         sum(good) over (partition by feature) as gg from ng join best using (feature, n)),
kept as (select * from bs where feature not in (select feature from best)),
kw as (select feature, level, idx, good, bad, sum(bad) over (partition by feature) as bb,
         sum(good) over (partition by feature) as gg from kept),
final as (
  select lv.feature, lv.level, lv.grp, round(case when gw.bad = 0 and gw.good = 0 then -99.0
      when gw.bad = 0 then '-inf'::double when gw.good = 0 then 'inf'::double
      else ln((gw.bad / gw.bb) / (gw.good / gw.gg)) end, 10) as woe
  from lv join best using (feature, n) join gw using (feature, grp)
  union all
  select feature, level, cast(idx as int) as grp, round(case when bad = 0 and good = 0 then -99.0
      when bad = 0 then '-inf'::double when good = 0 then 'inf'::double
      else ln((bad / bb) / (good / gg)) end, 10) as woe from kw)"""


def autogroup_sql(select: str) -> str:
    return with_sample(select, autogroup_ctes())


NUMS = ("totalprice", "acctbal", "sparse_num", "score")


def describe_sql(cols=NUMS, probs=(0.01, 0.25, 0.5, 0.75, 0.99), where: str = "") -> str:
    from scorelens.operators.profile import _pname

    parts = []
    for c in cols:
        qs = ", ".join(f"{rnd(f'quantile_cont({c}, {p}::double)', 6)} as {_pname(p)}" for p in probs)
        parts.append(f"select '{c}' as column_name, 'double' as dtype, count({c}) as count, "
                     f"round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c}) as min, {qs}, "
                     f"max({c}) as max from sample {where}")
    return with_sample(" union all ".join(parts))


def class_balance_sql() -> str:
    return with_sample("""select sample, count(*) filter (where target = 0) as num_good,
  count(*) filter (where target = 1) as num_bad,
  round(count(*) filter (where target = 1) / (count(*) filter (where target in (0, 1))), 10) as bad_rate
from sample group by sample""")


def crosstab_sql(features=CHAR) -> str:
    ctes = f"{long_cte(features)}, lv as (select * from long where level is not null)"
    body = """select feature, level, count(*) filter (where target = 0) as n_0, count(*) filter (where target = 1) as n_1,
  count(*) as n_all, round(count(*) filter (where target = 1) / count(*), 10) as ratio from lv group by feature, level
union all
select feature, 'All' as level, count(*) filter (where target = 0), count(*) filter (where target = 1), count(*),
  round(count(*) filter (where target = 1) / count(*), 10) from lv group by feature"""
    return with_sample(body, ctes)


def bivar_numeric_sql(cols=("totalprice", "acctbal", "sparse_num"), by=(), where: str = "", bins: int = 10) -> str:
    sel, _, _ = _by(by)
    parts = [f"select {sel} target, '{c}' as column_name, cast({c} as double) as x from sample {where}" for c in cols]
    bys = "".join(f"{c}, " for c in by)
    on = " and ".join([f"l.{c} = e.{c}" for c in by] + ["l.column_name = e.column_name"])
    step = f"((e.mx - e.mn) / {float(bins)})"
    edge = lambda i: f"({float(i)} * {step} + e.mn)" if i < bins else "e.mx"
    bin_expr = "1 + " + " + ".join(f"(case when l.x > {edge(i)} then 1 else 0 end)" for i in range(1, bins))
    lo = " ".join(f"when {i} then {edge(i - 1) if i > 1 else '(e.mn - (e.mx - e.mn) * 0.001)'}"
                  for i in range(1, bins + 1))
    hi = " ".join(f"when {i} then {edge(i)}" for i in range(1, bins + 1))
    lsel = "".join(f"l.{c}, " for c in by)
    ctes = f"""nl as ({' union all '.join(parts)}),
l0 as (select * from nl where x is not null and not isnan(x)),
e as (select {bys} column_name, min(x) as mn, max(x) as mx from l0 group by {bys} column_name
      having count(distinct x) >= 5),
j as (select {lsel} l.column_name, l.target, e.mn, e.mx, {bin_expr} as bin from l0 l join e e on {on}),
a as (select {bys} column_name, bin, mn, mx, count(*) as count, avg(cast(target as double)) as bad_rate
      from j group by {bys} column_name, bin, mn, mx)"""
    lo_a, hi_a = lo.replace("e.", ""), hi.replace("e.", "")
    body = (f"select {bys} column_name, cast(bin as int) as bin, "
            f"{rnd(f'case bin {lo_a} end', 6)} as lo, {rnd(f'case bin {hi_a} end', 6)} as hi, "
            f"count, round(bad_rate, 10) as bad_rate from a")
    return with_sample(body, ctes)


def bivar_categorical_sql(features=CHAR, by=(), where: str = "") -> str:
    bys = "".join(f"{c}, " for c in by)
    ctes = f"{long_cte(features)}, lv as (select * from long where level is not null {where.replace('where', 'and')})"
    body = (f"select {bys} feature as column_name, level, count(*) as count, "
            f"round(avg(cast(target as double)), 10) as bad_rate from lv group by {bys} feature, level")
    return with_sample(body, ctes)


def bivar_sql(char, num, few: str, few_sql: str) -> str:
    """Every feature by sample: char columns and ``few`` (a number with few values) by value, the rest in bins."""
    names = [*char, *num, few]
    place = "case column_name " + " ".join(f"when '{c}' then {i + 1}" for i, c in enumerate(names)) + " end"
    few_rows = (f"select sample, '{few}' as column_name, cast({few_sql} as varchar) as level, count(*) as count, "
                f"round(avg(cast(target as double)), 10) as bad_rate from sample group by all")
    return f"""select {place} as position, * from (
select sample, column_name, 'bins' as kind, bin, lo, hi, cast(null as varchar) as level, count, bad_rate from ({bivar_numeric_sql(num, ("sample",))})
union all select sample, column_name, 'values', 0, null, null, level, count, bad_rate from ({bivar_categorical_sql(char, ("sample",))})
union all select sample, column_name, 'values', 0, null, null, level, count, bad_rate from ({with_sample(few_rows)}))"""


def iv_ranking_sql(char=CHAR, num=("totalprice", "acctbal", "sparse_num"), bins: int = 10) -> str:
    probs = ", ".join(f"{i / bins!r}::double" for i in range(1, bins))
    parts = [f"select target, '{c}' as feature, cast({c} as varchar) as level from sample" for c in char]
    eds = []
    for i, c in enumerate(num):
        eds.append(f"e{i} as (select list_distinct(quantile_cont({c}, [{probs}])) as es from sample)")
        parts.append(f"select target, '{c}' as feature, case when {c} is null or isnan({c}) then 'null' "
                     f"else cast(1 + len(list_filter(e{i}.es, lambda e: {c} > e)) as varchar) end as level "
                     f"from sample cross join e{i}")
    types = " union all ".join([f"select '{c}' as name, 'string' as var_type" for c in char] +
                               [f"select '{c}', 'number'" for c in num])
    ctes = f"""{', '.join(eds)},
lg as ({' union all '.join(parts)}),
c as (select feature, level, count(*) filter (where target = 0) as good, count(*) filter (where target = 1) as bad
      from lg group by feature, level),
s as (select feature, good / sum(good) over (partition by feature) as gp,
        bad / sum(bad) over (partition by feature) as bp from c),
iv as (select feature as name,
         round(coalesce(sum(case when gp != 0 and bp != 0 then ln(bp / gp) * (bp - gp) end), 0), 10) as iv
       from s group by feature),
t as ({types})"""
    return with_sample("select name, var_type, iv from iv join t using (name)", ctes)


def sample_dbl_sql() -> str:
    """The whole `sample` view with balance as double."""
    return with_sample(f"select {', '.join(_sel(c, k) for c, k in SAMPLE_COLUMNS)} from sample")


def band_counts_by_sample_sql(n_bands: int = 20) -> str:
    ctes = f"b as (select sample, {band_sql(n_bands)} as band from sample)"
    return with_sample("select sample, band, count(*) as n from b where band is not null group by sample, band", ctes)


def neighbours_sql(num, k: int) -> str:
    """All pairs of the different minority vectors, and the k nearest of each."""
    cols = ", ".join(f"cast(coalesce({c}, 0) as double) as {c}" for c in num)
    d = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in num)
    return with_sample(
        "select pid, cid, round(d, 6) as d, cast(r as int) as r from (select *, row_number() over (partition by pid order by d, cid) as r from pairs) "
        f"where r <= {k}",
        f"rows as (select row_id, {cols} from sample where sample = 'dev' and target = 1), "
        f"points as (select {', '.join(num)}, min(row_id) as pid from rows group by all), "
        f"pairs as (select a.pid, b.pid as cid, sqrt({d}) as d from points a join points b on a.pid <> b.pid)")


def first_split_sql(char, num, alpha: float, lam: float, bins: int) -> str:
    """The best cut of all features at their quantiles, from gradients p - y at p = 1/2 and curvatures p (1 - p)."""
    joins, cols = [], []
    for i, f in enumerate(char):
        joins.append(f"left join (select level, woe from wm where feature = '{f}') m{i} on cast(s.{f} as varchar) is not distinct from m{i}.level")
        cols.append(f"coalesce(m{i}.woe, 0.0) as {f}")
    cols += [f"coalesce(cast({c} as double), 0.0) as {c}" for c in num]
    names = [*char, *num]
    probs = "[" + ", ".join(f"{k / bins!r}::double" for k in range(1, bins)) + "]"
    values = " union all ".join(f"select {i} as place, '{c}' as feature, {c} as x, target from inputs" for i, c in enumerate(names))
    score = lambda g, h: f"(greatest(abs({g}) - {alpha}, 0.0) ** 2 / ({h} + {lam}))"
    leaf = lambda g, h: f"(-sign({g}) * greatest(abs({g}) - {alpha}, 0.0) / ({h} + {lam}))"
    ctes = f"""{woe_map_ctes("sample = 'dev'", char)},
inputs as (select {", ".join(cols)}, s.target from sample s {" ".join(joins)} where s.sample = 'dev'),
v as ({values}),
edges as (select distinct place, feature, unnest(quantile_cont(x, {probs})) as e from v group by place, feature),
sums as (select e.place, e.feature, e.e, sum(0.5 - target) filter (where x <= e) as gl, 0.25 * count(*) filter (where x <= e) as hl,
  sum(0.5 - target) as g, 0.25 * count(*) as h from edges e join v using (place, feature) group by all),
gains as (select *, ({score("gl", "hl")} + {score("(g - gl)", "(h - hl)")} - {score("g", "h")}) / 2 as gain from sums where hl >= 1 and h - hl >= 1)"""
    return with_sample(f"""select feature, round(gain, 6) as gain, round(hl, 6) as curvature_left, round(h - hl, 6) as curvature_right,
  round({leaf("gl", "hl")}, 6) as leaf_left, round({leaf("(g - gl)", "(h - hl)")}, 6) as leaf_right from gains order by gain desc, place, e limit 1""", ctes)


#: Key columns of each sheet of the score report.
SHEET_KEYS = {
    "samples": ("sample",), "class_balance": ("sample",), "score_dist": ("band",), "gains": ("sample", "bin"), "metrics": ("sample",),
    "histogram": ("sample", "bin"), "psi": ("sample",), "describe": ("column_name", "dtype"), "bivar": ("sample", "column_name", "bin"),
    "bivar_levels": ("sample", "column_name", "level"), "params": ("name",),
}


def report_bundle_sql() -> str:
    """Every number of every sheet the score report writes (each sheet by its own oracle)."""
    from scorelens.operators.model import DEFAULTS

    nums = ("totalprice", "acctbal", "sparse_num")
    params = " union all ".join(f"select '{k}' as name, {v}::double as value" for k, v in DEFAULTS.items())
    sheets = {
        "samples": with_sample("select sample, count(*) as rows, count(target) as labelled, count(*) filter (where target = 1) as bad from sample group by sample"),
        "class_balance": class_balance_sql(),
        "score_dist": score_distribution_sql(20),
        "gains": gains_sql(20, by=("sample",)),
        "metrics": roc_summary_sql(by=("sample",)),
        "histogram": histogram_sql(20),
        "psi": psi_monitor_sql(20),
        "describe": describe_sql(nums, (0.25, 0.5, 0.75), "where sample = 'dev'"),
        "bivar": bivar_numeric_sql(nums, ("sample",)),
        "bivar_levels": bivar_categorical_sql(CHAR, ("sample",)),
        "params": params,
    }
    parts = []
    for k, v in sheets.items():
        key = "concat_ws('|', " + ", ".join(SHEET_KEYS[k]) + ")"
        rest = ", ".join(SHEET_KEYS[k])
        parts.append(f"select '{k}' as sheet, key, name, value from (unpivot (select {key} as key, "
                     f"columns(* exclude ({rest}))::double from ({v})) on columns(* exclude (key)) into name name value value)")
    return " union all ".join(parts)
