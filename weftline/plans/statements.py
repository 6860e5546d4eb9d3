"""Statements of many shapes and the tables that each reads and writes, in the order of their first mention.

``#`` stands for a number that makes the names of a statement its own; R, I, U, D and M: reads, inserts, updates, deletes, merges.
"""

from __future__ import annotations

RELATION = {"R": "READS_FROM", "I": "INSERTS", "U": "UPDATES", "D": "DELETES", "M": "MERGES"}
STATEMENTS: list[tuple[str, str]] = [
    ("select * from a#", "R:A#"),
    ("select x.id, y.id from a# x, b# y where x.id = y.id", "R:A# R:B#"),
    ("select * from app.a# x join hr.b# y on x.id = y.id", "R:APP.A# R:HR.B#"),
    ("select * from a# left outer join b# on a#.id = b#.id right join c# on c#.id = b#.id", "R:A# R:B# R:C#"),
    ("select * from a# natural join b#", "R:A# R:B#"),
    ("select * from a# cross join b#, c#", "R:A# R:B# R:C#"),
    ("select (select max(v) from b# where b#.k = a#.k) m from a#", "R:B# R:A#"),
    ("select * from (select id from a# where v > 1) q, b# where q.id = b#.id", "R:A# R:B#"),
    ("select * from a# where id in (select id from b#) and exists (select 1 from c# where c#.id = a#.id)", "R:A# R:B# R:C#"),
    ("select id from a# union all select id from b# minus select id from c#", "R:A# R:B# R:C#"),
    ("with q as (select * from a#) select * from q", "R:A#"),
    ("with q as (select * from a#), r as (select * from q, b#) select * from r join c# on 1 = 1", "R:A# R:B# R:C#"),
    ("with q (n) as (select 1 from dual union all select n + 1 from q where n < 9) select * from q, a#", "R:A#"),
    ("select * from a# where note = 'copied from b#' -- from c#", "R:A#"),
    ("select /* from x# join y# */ * from a#", "R:A#"),
    ("select q'[it's from b#]' from a#", "R:A#"),
    ("select q'!from c#!', 'it''s from d#' from a#", "R:A#"),
    ("select extract(year from d), trim(both ' ' from s) from a#", "R:A#"),
    ("select a#_seq.nextval from dual", ""),
    ("select * from a#@far", "R:A#@FAR"),
    ("select * from app.a#@far.world x", "R:APP.A#@FAR.WORLD"),
    ('select * from "Mixed#" m', 'R:"Mixed#"'),
    ('select * from app."Mixed#", b#', 'R:APP."Mixed#" R:B#'),
    ("select * from table(f(1)) t, a#", "R:A#"),
    ("select * from a# where id = 1 for update of v", "R:A#"),
    ("select k, count(*) from a# group by k having count(*) > (select n from b#) order by k", "R:A# R:B#"),
    ("select level from a# start with id = 1 connect by prior id = up", "R:A#"),
    ("select * from a# x where x.v > all (select v from a# y where y.k = x.k)", "R:A#"),
    ("insert into a# (x, y) values (1, 'from b#')", "I:A#"),
    ("insert into app.a# select * from b# join c# using (id)", "I:APP.A# R:B# R:C#"),
    ("insert into a# (x) select max(x) from a#", "I:A# R:A#"),
    ("insert all into a# (x) values (v) into b# (x) values (v) select v from c#", "I:A# I:B# R:C#"),
    ("insert first when v > 1 then into a# values (v) else into hr.b# values (v) select v from c# where v > 0", "I:A# I:HR.B# R:C#"),
    ("insert into a# values ((select max(v) from b#), 2)", "I:A# R:B#"),
    ("update a# set v = 1 where id = 2", "U:A#"),
    ("update app.a# x set x.v = (select max(v) from b# y where y.id = x.id), w = 0 where exists (select 1 from c#)", "U:APP.A# R:B# R:C#"),
    ("update a# set (v, w) = (select v, w from b# where b#.id = a#.id)", "U:A# R:B#"),
    ("delete from a# where id in (select id from b#)", "D:A# R:B#"),
    ("delete a# where v is null", "D:A#"),
    ("merge into a# t using b# s on (t.id = s.id) when matched then update set t.v = s.v when not matched then insert (id) values (s.id)", "M:A# R:B#"),
    ("merge into a# t using (select id, v from b# join c# on b#.id = c#.id) s on (t.id = s.id) when matched then update set t.v = s.v delete where t.v = 0", "M:A# R:B# R:C#"),
    ("begin insert into a# values (1); update b# set v = 1; delete from c#; commit; end;", "I:A# U:B# D:C#"),
    ("begin for r in (select * from a#) loop insert into b# values (r.id); end loop; end;", "R:A# I:B#"),
    ("begin select v into x from a# where id = 1; end;", "R:A#"),
    ("begin if x > 1 then update a# set v = 1; else delete from b#; end if; exception when others then insert into log# values (1); end;", "U:A# D:B# I:LOG#"),
    ("create or replace view v# as select * from a#, b#", "R:A# R:B#"),
    ("create table t# as select * from a#", "R:A#"),
    ("declare cursor c is select * from a# where d > sysdate; begin open c; end;", "R:A#"),
    ("select case when exists (select 1 from b#) then 1 else 0 end from a#", "R:B# R:A#"),
    ("select v, row_number() over (partition by k order by v) from a# where v between 1 and 2", "R:A#"),
    ("select *\nfrom a#\n-- , x#\n, b# -- from y#\nwhere 1 = 1", "R:A# R:B#"),
    ("select listagg(v, ',') within group (order by v) from a# having min(v) > 0 intersect select w from b#", "R:A# R:B#"),
]


def expected_sql(table: str, key: str) -> str:
    """SQL of (key, statement, refs) for every row of ``table``: its key modulo the number of statements picks one."""
    rows = ", ".join("({}, {})".format(k, "'" + ",".join(f"{RELATION[r[0]]}:{r[2:]}" for r in refs.split()).replace("'", "''") + "'") for k, (_, refs) in enumerate(STATEMENTS))
    return f"SELECT {key}, CAST(k AS BIGINT) AS statement, replace(refs, '#', CAST({key} AS VARCHAR)) AS refs FROM {table} JOIN (VALUES {rows}) s(k, refs) ON {key} % {len(STATEMENTS)} = k"
