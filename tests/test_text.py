"""Text, SQL text, identifiers and bags on examples whose answers are known."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import ids, jsonbag, names, routes, sqltext, text
from weftline.session import ship


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr("v")).collect()]


def test_routes(spark):
    got = col(spark, ["https://h.x/a//b/{id:int}/?q=1", "/", "", None, "a/:name/", "/x#y"], routes.route_path)
    assert got == ["/a/b/{id}", "/", None, None, "/a/{id}", "/x"]
    assert col(spark, ["get", " POST ", "g1", None], routes.verb) == ["GET", "POST", None, None]
    assert col(spark, ["/a/{id}/b/{n:int}"], routes.parameters) == [["id", "n"]]
    assert col(spark, ["/a/7"], lambda c: routes.template_matches(F.lit("/a/{id}"), c)) == [True]
    assert col(spark, ["/a/7/b"], lambda c: routes.template_matches(F.lit("/a/{id}"), c)) == [False]
    assert col(spark, ["api/x"], lambda c: routes.combined(F.lit("v1"), c)) == ["/v1/api/x"] and col(spark, ["~/x"], lambda c: routes.combined(F.lit("v1"), c)) == ["/x"]
    assert col(spark, ["HomeController"], lambda c: routes.conventional(c, F.lit("Index"))) == ["/Home"]
    assert [list(x) for x in col(spark, ["/a/b/c", "/"], lambda c: routes.suffixes(routes.parts(c)))] == [["a/b/c", "b/c", "c"], []]


def test_oracle_identifiers(spark):
    values = ["app.orders", '"Mixed"."Na""me"', ' x . "Y" ', "a..b", '"open', "", None, "APP"]
    assert col(spark, values, names.oracle_identifier) == ["APP.ORDERS", 'Mixed.Na"me', "X.Y", None, None, None, None, "APP"]


def test_paths_and_slugs(spark):
    assert col(spark, ["a\\b/./c", "../x", "/abs", "C:\\x", ""], names.repository_path) == ["a/b/c", None, None, None, None]
    assert col(spark, ["Hello, World!", "--", "a__b"], names.slug) == ["hello-world", "unnamed", "a__b"]
    assert col(spark, ["loadOrderItems"], names.display_from_method) == ["Load Order Items"]
    assert col(spark, ["C:\\bin\\Job.EXE"], names.executable_name) == ["job"]


def test_ids(spark):
    assert col(spark, ["db1"], lambda c: ids.column_id(c, F.lit("t"), F.lit("c"))) == ["column:DB1:T:C"]
    assert col(spark, ["a|b", "ok", None], lambda c: ids.stable_id("file", c)) == [None, "file:ok", None]
    good = ["table:DB:T", "x:", "table:http://h/x", "Table:x", "a:b\\c", "a:123e4567-e89b-12d3-a456-426614174000", None]
    assert col(spark, good, ids.stable_id_valid) == [True, False, False, False, False, False, False]
    d = col(spark, ["procedure:DB:PKG:RUN:NUMBER"], ids.decoded_id)[0]
    assert (d["kind"], d["database"], d["name"]) == ("PROCEDURE", "DB", "RUN")
    ship(spark)
    m = {r[0]: r[1] for r in ids.compact_map(spark.createDataFrame([(f"n:{i % 50}",) for i in range(100)], "k string"), "k", "node").collect()}
    assert len(m) == 50 and m["n:7"] == ids._compact("node", "n:7") and all(0 < v < 1 << 63 for v in m.values())


def test_positions_and_newlines(spark):
    t = "one\ntwo three\n\nend"
    assert col(spark, [t], lambda c: text.line_of(c, F.lit(8))) == [2] and col(spark, [t], lambda c: text.column_of(c, F.lit(8))) == [5]
    assert col(spark, [t], lambda c: text.offset_of(c, F.lit(2), F.lit(5))) == [8] and col(spark, [t], lambda c: text.line_text(c, F.lit(9))) == [""]
    assert col(spark, ["a\r\nb", "a\nb", "a\rb", "a\r\nb\n", "a"], text.newline_style) == ["CRLF", "LF", "CR", "mixed", "none"]


def test_comments(spark):
    ship(spark)
    src = "var a = '// no'; // yes\n/** doc\n * more\n */\nlet b; /* select x from y */ // これは業務\n"
    rows = spark.createDataFrame([(src, "typescript"), ("x -- c\n'-- no'", "sql"), ("<!-- a --><b/>", "html"), (None, "sql"), ("// x", "text")], "t string, lang string").select(text.comments("t", "lang").alias("c")).collect()
    first = [(c["raw"], c["start_line"], c["start_column"], c["end_line"]) for c in rows[0]["c"]]
    assert first[0] == ("// yes", 1, 18, 1) and first[1][1:] == (2, 1, 4) and len(first) == 4
    assert [[c["raw"] for c in r["c"]] for r in rows[1:]] == [["-- c"], ["<!-- a -->"], [], []]
    raws = [c["raw"] for c in rows[0]["c"]]
    assert col(spark, raws, text.comment_class) == ["ORDINARY", "DOCUMENTATION", "DISABLED_CODE", "BUSINESS"]
    assert col(spark, raws, text.comment_kind) == ["LINE", "DOCUMENTATION", "BLOCK", "LINE"]
    assert col(spark, ["/** doc\n * more\n */"], text.comment_text) == ["doc\nmore"]


def test_templates_and_scripts(spark):
    html = '<button class="x" (click)="save(1)"></button><a href="/x">y</a>'
    assert [tuple(e) for e in col(spark, [html], text.template_events)[0]] == [("button", "click", "save")]
    ts = "export class A {} this.http.get<X>('/api/a'); { path: 'home', component: Home }"
    assert [tuple(x) for x in col(spark, [ts], text.http_calls)[0]] == [("GET", "/api/a")]
    assert [tuple(x) for x in col(spark, [ts], text.router_paths)[0]] == [("home", "Home")] and [tuple(x) for x in col(spark, [ts], text.script_declarations)[0]] == [("class", "A")]


@pytest.mark.parametrize("raw, declared, want", [
    ("plain é".encode(), None, ("plain é", "utf-8", None)), (b"\xef\xbb\xbfx", None, ("x", "utf-8-sig", None)), (b"\xef\xbb\xbfx", "shift_jis", ("x", "utf-8-sig", "ENCODING_CONFLICT")),
    ("日本語テキスト".encode("cp932"), None, ("日本語テキスト", "cp932", None)), ("日本語".encode("euc_jp"), "euc-jp", ("日本語", "euc_jp", None)), ("some text".encode("utf-16-le"), None, ("some text", "utf-16-le", None)), (b"\xff\xff\xff", "utf-8", (None, None, "DECODE_ERROR")), (b"", None, ("", "utf-8", None)),
])
def test_decoding(raw, declared, want):
    assert text.decoded(raw, declared) == want


def test_masking_keeps_offsets():
    src = "a -- x\nb 'it''s' q'[ ] ' ]' /* c\nd */ \"Q''\" e"
    m = sqltext.masked(src)
    assert len(m) == len(src) and m.count("\n") == 2 and m.split() == ["a", "b", '"Q\'\'"', "e"]


@pytest.mark.parametrize("sql, want", [
    ("select * from a, b.c d join e@lnk on 1=1 where x in (select y from f)", [("A", "READS_FROM"), ("B.C", "READS_FROM"), ("E@LNK", "READS_FROM"), ("F", "READS_FROM")]),
    ("with q as (select 1 from t) select * from q", [("T", "READS_FROM")]),
    ("merge into m using s on (m.id = s.id) when matched then update set a = 1 when not matched then insert (a) values (1)", [("M", "MERGES"), ("S", "READS_FROM")]),
    ("delete from x where 1=1; delete y; update z set a=1; insert into w select * from v", [("X", "DELETES"), ("Y", "DELETES"), ("Z", "UPDATES"), ("W", "INSERTS"), ("V", "READS_FROM")]),
    ("select extract(year from d), trim(both from e) from dual", []), ('select * from "My Table"', [('"My Table"', "READS_FROM")]), ("", []), ("select ' from no'", []),
])
def test_tables(sql, want):
    assert [(n, r) for n, r, _ in sqltext.table_references(sql)] == want


PLSQL = """create or replace package body app.pkg is
  function f(p_id in number, p_x in out nocopy varchar2, p_d date := to_date('1','d')) return number is
    procedure inner is begin null; end inner;
  begin
    if p_id > 1 then other_pkg.call_it(p_id); end if;
    select seq.nextval into p_x from dual;
    execute immediate 'delete from t';
    return 1;
  end f;
  procedure g is begin f(1, x, y); tidy; end;
end;
/
create or replace trigger trg before insert on app.orders begin null; end;
create synonym s for other.tab@lnk;"""


def test_plsql():
    r = {x.name: x for x in sqltext.routines(PLSQL)}
    assert set(r) == {"F", "INNER", "G"} and r["F"].returns == "NUMBER" and r["F"].signature == "NUMBER,VARCHAR2,DATE"
    assert [p[:2] for p in r["F"].parameters] == [("P_ID", "IN"), ("P_X", "IN OUT"), ("P_D", "IN")] and r["F"].parameters[2][3]
    assert r["F"].start < r["INNER"].start and r["INNER"].end < r["F"].end < r["G"].start
    found = [n for n, _ in sqltext.calls(PLSQL)]
    assert "OTHER_PKG.CALL_IT" in found and "TIDY" in found and "F" in found
    assert [(n, k) for n, k, _ in sqltext.sequences(PLSQL)] == [("SEQ", "NEXTVAL")]
    assert [d[:3] for d in sqltext.declarations(PLSQL)] == [("PACKAGE", "APP.PKG", ""), ("TRIGGER", "TRG", "APP.ORDERS"), ("SYNONYM", "S", "OTHER.TAB@LNK")]
    assert len(sqltext.dynamic_sql(PLSQL)) == 1 and sqltext.classify(PLSQL) == "PLSQL" and sqltext.classify("select 1 from a") == "DML" and sqltext.classify("hello") == "UNKNOWN"
    assert not sqltext.balanced("select (1") and sqltext.balanced("select ')'")


def test_loader():
    got = sqltext.sql_loader("""load data infile 'a.dat' badfile 'a.bad' append into table app.t when (1) = 'x' fields terminated by ',' (id integer external, name char(20) "upper(:name)", d date "yyyy")\nbegindata\n1,into table z (q)""")
    assert got["files"] == [{"kind": "INFILE", "path": "a.dat"}, {"kind": "BADFILE", "path": "a.bad"}] and got["mode"] == "APPEND" and got["error"] is None
    (t,) = got["targets"]
    assert t["table"] == "APP.T" and [(f["name"], f["expression"]) for f in t["fields"]] == [("ID", None), ("NAME", "upper(:name)"), ("D", "yyyy")]
    assert sqltext.sql_loader("nothing")["error"] == "NOT_A_CONTROL_FILE" and sqltext.sql_loader("load data")["error"] == "NO_TARGET"


def test_bags(spark):
    assert jsonbag.merged({"a": [1, 2], "b": "", "c": {"x": 1}}, {"a": [2, 3], "b": "y", "c": {"x": 2, "z": 3}}) == {"a": [1, 2, 3], "b": "y", "c": {"x": 1, "z": 3}}
    assert col(spark, ['{"a":1}', "[1]", "{bad", None, ""], jsonbag.as_object) == ['{"a":1}', "{}", "{}", "{}", "{}"]
    ship(spark)
    bag = json.dumps({"x": {"ref_node_id": "n1"}, "y": [{"ref_node_ids": ["n2", "n1"]}]})
    assert col(spark, [bag, "bad"], jsonbag.node_references) == [["n1", "n2"], []]
    df = spark.createDataFrame([(bag, '{"n1":"m"}')], "b string, a string").select(jsonbag.rewritten("b", "a"))
    assert json.loads(df.first()[0])["x"] == {"ref_node_id": "m"}
