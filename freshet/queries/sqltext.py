"""Shared pieces of the SQL twins, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions.constants import MEASURE_PREFIX, NA_TOKENS, WHITESPACE
from .inputs import RAW_READINGS, STATIONS, plain

TOKENS = ", ".join(f"'{token}'" for token in NA_TOKENS)
_CODES = ", ".join(str(ord(char)) for char in WHITESPACE)
WS = f"(select string_agg(chr(c), '') from unnest([{_CODES}]) as t(c))"


def na(column: str) -> str:
    return f"case when {column} in ({TOKENS}) then null else {column} end as {column}"


RAW = plain(RAW_READINGS)

# raw cells after missing-token normalisation
CELLS = f"""
select event_id, source, {na('measure')}, {na('dateTime')}, {na('date')}, {na('value')}, {na('period')},
  {na('quality')}, {na('qcode')}
from ({RAW}) r
"""


def value_columns(text: str, rows: str, keep: str) -> str:
    """Rows with ``f`` (value) and ``status`` of a text column."""
    return f"""
select {keep},
  case when status = 0 then f when status = 6 then lf end as f, status
from (
  select *,
    case when v is null then 1
         when lower(x) = 'nan' then 2
         when isnan(f) then 3
         when f is not null then 0
         when position('|' in v) = 0 then 5
         when lf is null then 8
         when isnan(lf) then 7
         when lf between -9999999 and 9999999 then 6
         else 7 end as status
  from (
    select *, try_cast(x as double) as f, try_cast(trim(split_part(x, '|', -1), ws) as double) as lf
    from (select *, {text} as v, trim({text}, ws) as x from (select *, {WS} as ws from ({rows}) r0) r1) r2
  ) r3
) r4
"""


def notation_columns(rows: str) -> str:
    """Rows with ``notation`` and its seven fields; needs ``measure``."""
    return f"""
select * exclude (p, n),
  case when n in (4, 5) then p[1] when n >= 10 then array_to_string(p[1:(case when n = 10 then 5 else n - 6 end)], '-') end as station_id,
  case when n in (4, 5) then p[2] when n = 10 then p[6] when n > 10 then p[n - 5] end as parameter,
  case when n = 10 and p[6] = 'gw' and p[7] = 'dipped' then p[7] when n > 10 then p[n - 4] end as qualifier,
  case when n in (4, 5) then p[3] when n = 10 and p[6] = 'gw' and p[7] = 'dipped' then p[8]
       when n = 10 then p[7] when n > 10 then p[n - 3] end as value_type,
  case when n in (4, 5) then p[4] when n = 10 and p[6] = 'gw' and p[7] = 'dipped' then null
       when n = 10 then p[8] when n > 10 then p[n - 2] end as period_name,
  case when n = 5 then p[5] when n = 10 then p[9] when n > 10 then p[n - 1] end as unit_name,
  case when n = 10 then p[10] when n > 10 then p[n] end as observation_type
from (
  select *, string_split(notation, '-') as p, len(string_split(notation, '-')) as n
  from (select *, trim(replace(measure, '{MEASURE_PREFIX}', '')) as notation from ({rows}) n0) n1
) n2
"""

# shaped readings with label, one row per raw row
SHAPED = f"""
select s.*, st.label from (
  select event_id, source, ts as r_datetime, cast(date_trunc('month', ts) as date) as r_month, cast(ts as date) as r_date,
    try_cast(date as date) as source_date, measure, notation, station_id, parameter, qualifier, value_type,
    period_name, case when pf is null or isnan(pf) or isinf(pf) then 0 else cast(trunc(pf) as integer) end as period,
    unit_name, observation_type, case when isinf(f) then null else cast(f as decimal(15, 3)) end as value,
    status as value_status, quality, qcode
  from ({notation_columns(value_columns('value',
        f"select *, try_cast(dateTime as timestamp) as ts, try_cast(period as double) as pf from ({CELLS}) c",
        "event_id, source, ts, date, measure, pf, quality, qcode"))}) z
) s left join ({plain(STATIONS)}) st on st.notation = s.station_id
"""


def winners(rows: str = SHAPED) -> str:
    """One row per key; of several the order of ``plans.readings.batch_order`` decides."""
    return f"""
select * from (select *, row_number() over (partition by notation, r_datetime order by source desc, value desc nulls last,
    quality desc nulls last, qcode desc nulls last, period desc nulls last, measure desc nulls last, source_date desc nulls last) as rn
  from ({rows}) s where notation is not null and r_datetime is not null) w where rn = 1
"""
