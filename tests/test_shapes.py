"""Texts that differ in numbers only are worked on once, with the results of each."""

from __future__ import annotations

import itertools
import json

import pytest

from weftline.functions import behaviour, sqltext
from weftline.plans.statements import STATEMENTS

ROUTINES = [
    "create or replace procedure p_# (a in number) is\nbegin\n  if a > @ then\n    update app.t_# set v = 'x; end if;' where id = a;\n  else\n    delete from l_@;\n  end if;\nend;",
    "function f_# return varchar2 is\n  n varchar2(@) := nvl2(g_@(1), 2, #);\nbegin\n  for r in (select id from s_#) loop\n    exit when r.id > @;\n    insert into h_# values (r.id);\n  end loop;\n  return n;\nend f_#;",
    "begin\n  case a\n    when @ then log_#(a);\n    else raise bad_@;\n  end case;\nend;",
    "select * from t_@ where a = # and begin_# = q'1 from x1' union select * from t_#, t_@ -- " + "long " * 40 + "#",
    "begin select v into x from t_#, t_@, t_#a, ta, t_@_b; end;", "begin x_#(y_@, " + "z_#, " * 40 + "1); end;", "select q'1 from a# 1' from b@", "create package body app.pkg_#@ as procedure run_#(a in number default f(1, 2), b out varchar2) is begin execute immediate 'x#'; h_#(a); end; function c_# return number is begin return s_#.nextval; end; end;",
    "with q# as (select * from a#) select * from q#, q@ -- é#", "insert into t@ select * from t#, dual#",
]
TEXTS = [t.replace("#", str(a)).replace("@", str(b)) for t in [*ROUTINES, *(q for q, _ in STATEMENTS)] for a, b in ((1, 1), (7, 3), (3, 7), (12, 2), (2, 12), (1200034, 9), (10, 99), (99, 10), (0, 0))]


@pytest.mark.parametrize("name", ["analyze", "tables", "full", "summary", "tree"])
def test_each_text_has_its_own_result(name):
    plain, quick = {
        "analyze": (sqltext.analyze, sqltext._analyzed), "tables": (lambda t: [{"name": n, "relation": r, "offset": at} for n, r, at in sqltext.table_references(t)], sqltext._referenced),
        "full": (lambda t: json.dumps(behaviour.steps(t, detail="full"), ensure_ascii=False, separators=(",", ":")), behaviour._full),
        "summary": (lambda t: json.dumps(behaviour.steps(t), ensure_ascii=False, separators=(",", ":")), behaviour._short), "tree": (lambda t: "\n".join(behaviour.rendered(behaviour.steps(t, detail="full"))), behaviour._tree),
    }[name]
    for t in TEXTS:
        assert quick(t) == plain(t), t


def test_a_shape_is_worked_on_once():
    seen = []
    each = sqltext.by_shape(lambda t: seen.append(t) or t)
    texts = [f"select a{i} from t{j}, t{i} where x = '{j}' and y = varchar2" for i, j in itertools.product(range(10, 60), range(100, 150))]
    assert [each(t) for t in texts] == texts and len(seen) == 1
