"""Mapper files (XML with SQL statements and fragments): which they are, what they define, their SQL with fragments filled in, and behaviour trees; project files and configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship, small, stored

_STATEMENTS = "select insert update delete procedure statement".split()


def local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def parsed(text: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(text) if text else None
    except ET.ParseError:
        return None


def is_mapper(text: Column) -> Column:
    """Whether a file is a mapper: its root element is mapper or sqlMap."""
    return text.rlike(r"(?i)^\s*(<\?[^>]*>\s*|<!--[\s\S]*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(mapper|sqlmap)\b")


def _line(text: str, element: ET.Element) -> int:
    """Line of the element with this id, as far as the text tells."""
    at = text.find(f'id="{element.get("id", "")}"')
    return text.count("\n", 0, at) + 1 if at >= 0 else 1


def expand(element: ET.Element, fragments: dict[str, ET.Element], path: tuple[str, ...] = ()) -> tuple[str, list[tuple[str, str]]]:
    """SQL of an element with its includes filled in, and issues (DYNAMIC_INCLUDE, UNKNOWN_INCLUDE, CYCLIC_INCLUDE; reference)."""
    words, issues = [element.text or ""], []
    for child in element:
        ref = (child.get("refid") or "").strip()
        if local(child.tag) != "include":
            sql, more = expand(child, fragments, path)
        elif "${" in ref or "#{" in ref:
            sql, more = "", [("DYNAMIC_INCLUDE", ref)]
        elif ref not in fragments:
            sql, more = "", [("UNKNOWN_INCLUDE", ref)]
        elif ref in path:
            sql, more = "", [("CYCLIC_INCLUDE", " -> ".join((*path, ref)))]
        else:
            sql, more = expand(fragments[ref], fragments, (*path, ref))
        words += [sql, child.tail or ""]
        issues += more
    return " ".join(words), issues


def steps(element: ET.Element, fragments: dict[str, ET.Element], path: tuple[str, ...] = ()) -> list[dict]:
    """Behaviour of a statement: text, branches, loops, scopes, assignments and includes, nested."""
    out: list[dict] = []

    def text(t: str | None) -> None:
        if t and t.strip():
            out.append({"type": "sql", "text": " ".join(t.split())})

    def inner(e: ET.Element) -> list[dict]:
        return steps(e, fragments, path)

    text(element.text)
    for e in element:
        tag, a = local(e.tag), dict(e.attrib)
        if tag == "if":
            out.append({"type": "branch", "label": tag, "condition": a.get("test", ""), "steps": inner(e)})
        elif tag == "choose":
            whens = [{"condition": c.get("test", ""), "steps": inner(c)} for c in e if local(c.tag) == "when"]
            out.append({"type": "branch", "label": tag, "cases": whens, "else_steps": [s for c in e if local(c.tag) == "otherwise" for s in inner(c)]})
        elif tag == "foreach":
            out.append({"type": "loop", "label": tag, "iterator": a.get("item", ""), "expression": a.get("collection", ""), "separator": a.get("separator", ""), "steps": inner(e)})
        elif tag in ("trim", "where", "set"):
            out.append({"type": "scope", "label": tag, "steps": inner(e)} | {k: v for k, v in a.items() if k not in ("type", "label", "steps")})
        elif tag == "bind":
            out.append({"type": "assignment", "target": a.get("name", ""), "expression": a.get("value", "")})
        elif tag == "include":
            ref = a.get("refid", "").strip()
            if ref in path:
                out.append({"type": "include", "target": ref, "resolution": "cycle", "steps": []})
            elif ref in fragments:
                out.append({"type": "include", "target": ref, "resolution": "resolved", "steps": steps(fragments[ref], fragments, (*path, ref))})
            else:
                out.append({"type": "include", "target": ref, "resolution": "unresolved", "steps": []})
        else:
            out.append({"type": "element", "label": tag, "steps": inner(e)})
        text(e.tail)
    return out


MAPPER = "relative_path string, namespace string, id string, kind string, line int, sql string, issues array<struct<type:string,reference:string>>, semantic_tree string"


def statements(files: DataFrame) -> DataFrame:
    """Every statement and fragment of mapper files (relative_path, text): namespace, id, kind, line, SQL with includes filled in, issues, and behaviour tree.

    Fragments are looked up in all files (by namespace.id, and by id in their own file); only fragment elements are shared, and they are small beside the files.
    """
    spark = files.sparkSession
    ship(spark)
    maps = files.where(is_mapper(F.col("text")))

    def frags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                root = parsed(t)
                if root is not None:
                    ns = root.get("namespace", "")
                    rows += [(f"{ns}.{e.get('id')}" if ns else e.get("id"), ET.tostring(e, encoding="unicode")) for e in root.iter() if local(e.tag) == "sql" and e.get("id")]
            yield pd.DataFrame(rows, columns=["ref", "xml"])

    found = stored(maps.select("text").mapInPandas(frags, "ref string, xml string").dropDuplicates(["ref"]))
    # a file gets the fragments it needs, and those that these need: few rounds of a join, however many files there are
    refs = lambda df, c: df.select("relative_path", F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"<include[^>]*?refid\s*=\s*\"([^\"]+)\""), 1))).alias("ref"))
    want = stored(refs(maps, "text").distinct())
    all_refs = want
    while not small(want, 0):
        nxt = refs(want.join(found, "ref"), "xml").distinct().join(all_refs, ["relative_path", "ref"], "left_anti")
        want = stored(nxt)
        all_refs = stored(all_refs.unionByName(want))
    given = all_refs.join(found, "ref").groupBy("relative_path").agg(F.map_from_entries(F.collect_list(F.struct("ref", "xml"))).alias("fragments"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for path, t, given_ in zip(b["relative_path"], b["text"], b["fragments"]):
                root = parsed(t)
                if root is None:
                    rows.append({"relative_path": path, "namespace": "", "id": "", "kind": "INVALID", "line": 1, "sql": "", "issues": [{"type": "PARSE_ERROR", "reference": ""}], "semantic_tree": "[]"})
                    continue
                ns = root.get("namespace", "")
                fragments = {k: ET.fromstring(v) for k, v in (given_ or [])} if not isinstance(given_, dict) else {k: ET.fromstring(v) for k, v in given_.items()}
                fragments |= {e.get("id", ""): e for e in root.iter() if local(e.tag) == "sql" and e.get("id")}
                for e in root.iter():
                    kind = local(e.tag)
                    if e.get("id") and (kind in _STATEMENTS or kind == "sql"):
                        sql, issues = expand(e, fragments)
                        rows.append({"relative_path": path, "namespace": ns, "id": e.get("id"), "kind": "FRAGMENT" if kind == "sql" else kind.upper(), "line": _line(t, e), "sql": " ".join(sql.split()), "issues": [{"type": a, "reference": r} for a, r in issues], "semantic_tree": json.dumps(steps(e, fragments), sort_keys=True)})
            yield pd.DataFrame(rows, columns=["relative_path", "namespace", "id", "kind", "line", "sql", "issues", "semantic_tree"])

    return maps.join(given, "relative_path", "left").select("relative_path", "text", "fragments").mapInPandas(work, MAPPER)


def query_ids(stmts: DataFrame) -> DataFrame:
    """query_id (namespace.id) of every statement that code can name."""
    return stmts.where("kind not in ('FRAGMENT', 'INVALID')").select(F.concat_ws(".", F.nullif("namespace", F.lit("")), "id").alias("query_id")).distinct()


def mapper_references(constants: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``constants`` (…, value) whose value is a query id."""
    return constants.join(ids, constants["value"] == ids["query_id"], "left_semi")


def project_references(files: DataFrame) -> DataFrame:
    """relative_path, reference: what solution and project files name, by a path relative to the repository."""
    t = F.col("text")
    raw = F.array_union(F.regexp_extract_all(t, F.lit(r"<(?:ProjectReference|Compile)\s+Include\s*=\s*\"([^\"]+)\""), 1), F.regexp_extract_all(t, F.lit(r"Project\([^)]*\)\s*=\s*\"[^\"]*\",\s*\"([^\"]+)\""), 1))
    each = files.select("relative_path", F.explode(raw).alias("r"))
    base = F.regexp_replace("relative_path", r"[^/]*$", "")
    joined = F.concat(base, F.replace("r", F.lit("\\"), F.lit("/")))
    # a/b/../c is a/c: parts are taken one by one, '..' drops the last
    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return each.select("relative_path", F.array_join(parts, "/").alias("reference")).distinct()


def project_closure(files: DataFrame, selected: DataFrame) -> DataFrame:
    """relative_path of the selected files and all that they refer to, over any number of steps."""
    from weftline.operators.traverse import reachable

    e = project_references(files).select(F.col("relative_path").alias("source_node_id"), F.col("reference").alias("target_node_id"))
    return reachable(e, selected.select(F.col("relative_path").alias("node_id"))).withColumnRenamed("node_id", "relative_path")


def _flat(value: object, at: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{at}.{i}")
    else:
        yield at, "" if value is None else str(value)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def config_keys(path: pd.Series, text: pd.Series) -> pd.Series:
    """Keys and values of configuration files: nested JSON by dotted keys; add/key, connection strings and packages of XML."""

    def one(p: str, t: str | None) -> list[dict]:
        if p.lower().endswith(".json"):
            try:
                return [{"key": k, "value": v} for k, v in _flat(json.loads(t or "{}"))]
            except ValueError:
                return []
        root = parsed(t)
        if root is None:
            return []
        out = []
        for e in root.iter():
            name = e.get("key") or (e.get("name") if local(e.tag) == "add" else None) or (e.get("id") if local(e.tag) == "package" else None)
            if name:
                out.append({"key": name, "value": e.get("value") or e.get("connectionString") or e.get("version") or ""})
        return out

    return pd.Series([one(p or "", t) for p, t in zip(path, text)])
