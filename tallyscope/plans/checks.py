"""Checking SQL for the registered queries, in the dialect of DuckDB.

Each function writes the statement from the definitions alone: bins from the
extent, counts by plain grouping, no step shared with the Spark code.
"""

from __future__ import annotations

_STEP = """
st as (select min(c) lo, max(c) hi from src where isfinite(c)),
p1 as (select lo, hi - lo span,
              case when hi > lo then power(1E1, round(log10(hi - lo)) - 1) end p from st),
p2 as (select lo, span, case when ceil(span / p) <= 18 then p else 1E1 * p end p from p1),
p3 as (select lo, span, case when span / (p / 5E0) <= 18 then p / 5E0 else p end p from p2),
sp as (select case when span = 0 then lo else 0E0 end o,
              case when span = 0 then 1E0
                   when span / (p / 2E0) <= 18 then p / 2E0 else p end step from p3)
"""

_NUMBER_BINS = (
    "with src as (select cast({x} as double) c, coalesce({keep}, false) keep from {t}),"
    + _STEP
    + """,
b as (select case when c is null then 'null' when isfinite(c) then 'value' else 'nonfinite' end kind,
             case when isfinite(c) then floor((c - o) / step) end k, o, step, keep
      from src cross join sp)
"""
)

_DATE_BINS = """
with b as (select case when c is null then 'null' else 'value' end kind,
                  time_bucket(interval '{width}', c, timestamp '1970-01-01') x1, keep
           from (select cast({x} as timestamp) c, coalesce({keep}, false) keep from {t}))
"""


def number_histogram(t: str, x: str, keep: str = "true") -> str:
    return _NUMBER_BINS.format(t=t, x=x, keep=keep) + """
select kind, o + k * step x1, o + (k + 1) * step x2, count(*) n from b where keep group by all
union all
select 'null', null, null, 0 where not exists (select 1 from b where keep and kind = 'null')
"""


def number_compare(t: str, x: str, keep: str) -> str:
    return _NUMBER_BINS.format(t=t, x=x, keep=keep) + """
select kind, o + k * step x1, o + (k + 1) * step x2, count(*) n,
       cast(count(*) filter (where keep) as bigint) f from b group by kind, o, k, step
union all
select 'null', null, null, 0, 0 where not exists (select 1 from b where kind = 'null')
"""


def date_histogram(t: str, x: str, width: str, keep: str = "true") -> str:
    return _DATE_BINS.format(t=t, x=x, width=width, keep=keep) + f"""
select kind, x1, x1 + interval '{width}' x2, count(*) n from b where keep group by kind, x1
union all
select 'null', null, null, 0 where not exists (select 1 from b where keep and kind = 'null')
"""


def date_compare(t: str, x: str, width: str, keep: str) -> str:
    return _DATE_BINS.format(t=t, x=x, width=width, keep=keep) + f"""
select kind, x1, x1 + interval '{width}' x2, count(*) n,
       cast(count(*) filter (where keep) as bigint) f from b group by kind, x1
union all
select 'null', null, null, 0, 0 where not exists (select 1 from b where kind = 'null')
"""


def value_counts(t: str, x: str, keep: str = "true") -> str:
    return f"""
with c as (select cast({x} as varchar) v, count(*) n from {t} where {keep} group by 1)
select case when v is null then 'null' when n = 1 then 'unique' else 'value' end kind,
       case when n > 1 then v end "key", cast(sum(n) as bigint) total
from c group by 1, 2
"""


def value_counts_compare(t: str, x: str, keep: str) -> str:
    return f"""
with c as (select cast({x} as varchar) v, count(*) n, count(*) filter (where {keep}) f
           from {t} group by 1),
g as (select case when v is null then 'null' when n = 1 then 'unique' else 'value' end kind,
             case when n > 1 then v end "key", cast(sum(n) as bigint) total,
             cast(sum(f) as bigint) filtered
      from c group by 1, 2)
select *, cast(filtered as double) / cast(total as double) fraction from g
"""


def top_values(t: str, x: str, keep: str = "true", top: int = 20) -> str:
    return f"""
with c as (select cast({x} as varchar) v, count(*) n,
                  cast(count(*) filter (where {keep}) as bigint) f from {t} group by 1),
r as (select *, row_number() over (order by n desc, v) rn from c where v is not null and n > 1)
select 'value' kind, cast(rn as int) "rank", v "key", cast(1 as bigint) n_values,
       n total, f filtered from r where rn <= {top}
union all
select 'rest', null, null, count(*), cast(sum(n) as bigint), cast(sum(f) as bigint)
from r where rn > {top} having count(*) > 0
union all
select 'unique', null, null, count(*), cast(sum(n) as bigint), cast(sum(f) as bigint)
from c where v is not null and n = 1 having count(*) > 0
union all
select 'null', null, null, 1, n, f from c where v is null
"""


def bar_totals(t: str, x: str, keep: str = "true") -> str:
    return f"""
select cast(count(*) filter (where kind = 'value') as bigint) n_values,
       cast(coalesce(sum(total) filter (where kind = 'null'), 0) as bigint) null_count,
       cast(coalesce(sum(total) filter (where kind = 'unique'), 0) as bigint) unique_count,
       cast(coalesce(sum(total), 0) as bigint) total
from ({value_counts(t, x, keep)})
"""


def category_label(t: str, x: str, keep: str = "true") -> str:
    return f"""
with v as ({value_counts(t, x, keep)})
select count(*) n_rows,
       (select count(distinct cast({x} as varchar)) from {t} where {keep}) n_distinct,
       format('{{:,}}', count(*)) || case when count(*) = 1 then ' category' else ' categories' end
       as label
from v
"""


def status(t: str, keep: str) -> str:
    return f"""
with c as (select cast(count(*) filter (where {keep}) as bigint) "count", count(*) total from {t})
select "count", total,
       case when "count" = total then format('{{:,}} rows', total)
            else format('{{:,}} of {{:,}} rows', "count", total) end as label from c
"""


def profile(t: str, columns: list[tuple], keeps: dict[str, str]) -> str:
    """``columns``: (name, type name, role, date width); ``keeps``: column -> its clause."""
    nothing = "cast(null as double) x1, cast(null as double) x2"
    no_time = "cast(null as timestamp) t1, cast(null as timestamp) t2"
    parts = []
    for pos, (name, kind_name, role, width) in enumerate(columns):
        keep = " and ".join(f"({k})" for c, k in keeps.items() if c != name) or "true"
        lead = f"cast({pos} as int) pos, '{name}' as \"column\", '{kind_name}' type_name, '{role}' as role"
        empty = 'cast(null as int) "rank", cast(null as varchar) "key"'
        tail = "cast(null as bigint) n_values, n total, f filtered"
        if role == "number":
            inner = number_compare(t, name, keep)
            parts.append(f"select {lead}, kind, {empty}, x1, x2, {no_time}, {tail} from ({inner})")
        elif role == "date":
            inner = date_compare(t, name, width, keep)
            times = "x1 t1, x2 t2"
            parts.append(f"select {lead}, kind, {empty}, {nothing}, {times}, {tail} from ({inner})")
        else:
            inner = top_values(t, name, keep)
            parts.append(
                f'select {lead}, kind, "rank", "key", {nothing}, {no_time}, '
                f"n_values, total, filtered from ({inner})"
            )
    return "\nunion all\n".join(parts)


def overview(t: str, columns: list[tuple]) -> str:
    """``columns``: (name, type name, role, ...)."""
    parts = []
    for pos, (name, kind_name, role, *_) in enumerate(columns):
        lo = hi = "cast(null as double)"
        t_lo = t_hi = "cast(null as timestamp)"
        odd = "cast(0 as bigint)"
        if role == "number":
            x = f"cast({name} as double)"
            lo = f"min({x}) filter (where isfinite({x}))"
            hi = f"max({x}) filter (where isfinite({x}))"
            odd = f"cast(count(*) filter (where not isfinite({x})) as bigint)"
        elif role == "date":
            t_lo, t_hi = f"min({name})", f"max({name})"
        parts.append(
            f"select cast({pos} as int) pos, '{name}' as \"column\", '{kind_name}' type_name, "
            f"'{role}' as role, true as nullable, count(*) n_rows, "
            f"cast(count(*) filter (where {name} is null) as bigint) n_null, {odd} n_nonfinite, "
            f"{lo} lo, {hi} hi, {t_lo} t_lo, {t_hi} t_hi from {t}"
        )
    return "\nunion all\n".join(parts)
