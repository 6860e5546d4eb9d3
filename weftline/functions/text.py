"""Text of source files: lines and positions, comments and their classes, markup, encodings."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def newline_style(text: Column | str) -> Column:
    """CRLF, LF, CR, mixed or none."""
    t = _c(text)
    crlf = F.regexp_count(t, F.lit("\r\n"))
    lf, cr = F.regexp_count(t, F.lit("\n")) - crlf, F.regexp_count(t, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "CRLF").when(lf > 0, "LF").otherwise("CR")


def line_of(text: Column | str, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.left(_c(text), offset), F.lit("\n")) + 1


def column_of(text: Column | str, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    return F.length(F.substring_index(F.left(_c(text), offset), "\n", -1)) + 1


def line_text(text: Column | str, line: Column) -> Column:
    return F.coalesce(F.get(F.split(_c(text), "\n"), line - 1), F.lit(""))


def offset_of(text: Column | str, line: Column, column: Column) -> Column:
    """0-based offset of a 1-based line and column."""
    before = F.slice(F.split(_c(text), "\n"), 1, line - 1)
    return F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1) + column - 1


LANGUAGES = {"sql": "sql", "pks": "sql", "pkb": "sql", "prc": "sql", "fnc": "sql", "trg": "sql", "ctl": "sql", "ts": "typescript", "js": "typescript", "cs": "csharp", "html": "html", "xml": "xml", "config": "xml"}


def language_of(path: Column | str) -> Column:
    """By suffix; 'text' if it isn't known."""
    suffix = F.lower(F.element_at(F.split(_c(path), r"\."), -1))
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, suffix), F.lit("text"))


_BLOCK, _LINE, _DASH, _MARKUP = r"/\*[\s\S]*?\*/", r"//[^\r\n]*", r"--[^\r\n]*", r"<!--[\s\S]*?-->"
#: How comments look in each language; strings go first so that what they hold is no comment.
PATTERNS = {"sql": rf"'(?:[^']|'')*'|({_BLOCK}|{_DASH})", "typescript": rf"\"(?:\\.|[^\"\\\r\n])*\"|'(?:\\.|[^'\\\r\n])*'|`(?:\\.|[^`\\])*`|({_BLOCK}|{_LINE})", "csharp": rf"@\"(?:[^\"]|\"\")*\"|\"(?:\\.|[^\"\\\r\n])*\"|'(?:\\.|[^'\\\r\n])*'|({_BLOCK}|{_LINE})", "html": rf"({_MARKUP})", "xml": rf"({_MARKUP})"}
COMMENT = T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), *(T.StructField(f"{a}_{b}", T.IntegerType()) for b in ("line", "column") for a in ("start", "end"))]))


@F.pandas_udf(COMMENT)
def comments(text: pd.Series, language: pd.Series) -> pd.Series:
    """Comments of each text with 1-based positions, in order.  Null text or an unknown language: none."""

    def one(t: str | None, lang: str | None) -> list[dict]:
        out = []
        pattern = PATTERNS.get(lang or "")
        if t is None or pattern is None:
            return out
        line, at = 1, 0
        for m in re.finditer(pattern, t):
            if m.group(1) is None:
                continue
            line += t.count("\n", at, m.start())
            at = m.start()
            column = m.start() - (t.rfind("\n", 0, m.start()) + 1) + 1
            last = line + m.group(1).count("\n")
            out.append({"raw": m.group(1), "start_line": line, "end_line": last, "start_column": column, "end_column": m.end() - (t.rfind("\n", 0, m.end()) + 1)})
        return out

    return pd.Series([one(t, lang) for t, lang in zip(text, language)])


def comment_kind(raw: Column | str) -> Column:
    r = _c(raw)
    return F.when(r.startswith("/**") | r.startswith("///"), "DOCUMENTATION").when(r.startswith("/*") | r.startswith("<!--"), "BLOCK").otherwise("LINE")


def comment_text(raw: Column | str) -> Column:
    """Without marks and leading stars, white space trimmed."""
    bare = F.regexp_replace(F.regexp_replace(_c(raw), r"^(/\*+|///?|--|<!--)", ""), r"(\*+/|-->)$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?m)^[ \t]*\*+[ \t]?", ""), r"^\s+|\s+$", ""))


def comment_class(raw: Column | str) -> Column:
    """DOCUMENTATION, DIRECTIVE, DISABLED_CODE, BUSINESS (long, or Japanese) or ORDINARY, the first that fits."""
    r, t = _c(raw), comment_text(raw)
    code = r"(?i)^\s*(select\b|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|merge\s+into\b|if\s*\(|for\s*\(|while\s*\(|return\b.*;|var\s+\w+|const\s+\w+|let\s+\w+|[\w.]+\s*\([^)]*\)\s*;|\w+\s*:?=\s*[^;]*;|<\w+[^>]*>)"
    return F.when(comment_kind(r) == "DOCUMENTATION", "DOCUMENTATION").when(t.rlike(r"(?i)^\s*(eslint|tslint|prettier|noinspection|pragma|region|endregion|@ts-|resharper|#)"), "DIRECTIVE").when(t.rlike(code), "DISABLED_CODE").when((F.length(t) >= 40) | t.rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]"), "BUSINESS").otherwise("ORDINARY")


def markup_comments(html: Column | str) -> Column:
    """Raw comments of a page, in the JVM; where offsets aren't needed."""
    return F.regexp_extract_all(_c(html), F.lit(f"({_MARKUP})"), 1)


EVENT = r"<([A-Za-z][\w-]*)\b[^>]*?\(([A-Za-z][\w.]*)\)\s*=\s*\"([A-Za-z_$][\w$]*)\s*\("


def template_events(html: Column | str) -> Column:
    """element, event, handler of each (event)="handler(…)" of a template, in order."""
    t = _c(html)
    return F.arrays_zip(*(F.regexp_extract_all(t, F.lit(EVENT), i).alias(n) for i, n in ((1, "element"), (2, "event"), (3, "handler"))))


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(r"<a\s[^>]*?(?:href|routerLink)=\"([^\"]*)\""), 1)


def script_declarations(text: Column | str) -> Column:
    """kind, name of classes, interfaces and enums that a script exports."""
    p = F.lit(r"\bexport\s+(?:default\s+)?(?:abstract\s+)?(class|interface|enum)\s+([A-Za-z_$][\w$]*)")
    return F.arrays_zip(F.regexp_extract_all(_c(text), p, 1).alias("kind"), F.regexp_extract_all(_c(text), p, 2).alias("name"))


def http_calls(text: Column | str) -> Column:
    """method, url of HTTP client calls with a literal URL."""
    p = F.lit(r"\.\s*(get|post|put|patch|delete)\s*(?:<[^(]*>)?\(\s*[`'\"]([^`'\"]+)[`'\"]")
    return F.arrays_zip(F.transform(F.regexp_extract_all(_c(text), p, 1), F.upper).alias("method"), F.regexp_extract_all(_c(text), p, 2).alias("url"))


def router_paths(text: Column | str) -> Column:
    """path, component of route tables."""
    p = F.lit(r"path\s*:\s*['\"]([^'\"]*)['\"]\s*,\s*component\s*:\s*([A-Za-z_$][\w$]*)")
    return F.arrays_zip(F.regexp_extract_all(_c(text), p, 1).alias("path"), F.regexp_extract_all(_c(text), p, 2).alias("component"))


def likely_sql(text: Column | str) -> Column:
    """Whether a string is probably SQL: a leading verb and the word that goes with it, ten characters at least."""
    t = F.lower(F.trim(_c(text)))
    return (F.length(t) >= 10) & t.rlike(r"^(select\b[\s\S]*\bfrom\b|insert\b[\s\S]*\binto\b|update\b[\s\S]*\bset\b|delete\b[\s\S]*\bfrom\b|merge\b[\s\S]*\binto\b|with\b[\s\S]*\bselect\b|begin\b[\s\S]*\bend\b|call\s+\w+)")


def sql_evidence_kind(window: Column | str) -> Column:
    """Which library runs SQL, by the code around it."""
    t = _c(window)
    return F.when(t.rlike(r"(?i)\bdapper\b|\.(query|execute)(async)?\s*<"), "DAPPER").when(t.rlike(r"(?i)fromsql|executesql(raw|interpolated)|dbcontext"), "EF").when(t.rlike(r"(?i)oracle(command|connection|parameter)"), "ORACLE").when(t.rlike(r"(?i)(sql|db)command|executereader|executenonquery|executescalar"), "ADO").otherwise("SQL")


#: Aliases of the encodings that files may be in.
ENCODINGS = {a: name for name, aliases in {"utf-8": "utf8 utf-8 utf_8", "utf-8-sig": "utf-8-sig utf8-sig utf-8-bom", "utf-16-le": "utf-16le utf-16-le utf16le", "utf-16-be": "utf-16be utf-16-be utf16be", "utf-16": "utf-16 utf16", "cp932": "cp932 shift_jis shift-jis sjis windows-31j ms932 x-sjis", "euc_jp": "euc-jp euc_jp eucjp"}.items() for a in aliases.split()}
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_DECLARED = (r"<\?xml[^>]*?encoding\s*=\s*[\"']([\w-]+)[\"']", r"(?i)<meta[^>]*?charset\s*=\s*[\"']?([\w-]+)", r"(?:^|\n).{0,80}?coding[:=]\s*([\w.-]+)")


def canonical_encoding(name: str | None) -> str | None:
    return ENCODINGS.get((name or "").strip().lower())


def declared_encoding(head: Column) -> Column:
    """What a file says of its encoding (XML prolog, meta charset, first two lines), from its first bytes; null if nothing."""
    text = F.decode(F.substring(head, 1, 4096), "ISO-8859-1")
    firsts = F.array_join(F.slice(F.split(text, "\n"), 1, 2), "\n")
    x, m, c = (F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for t, p in ((text, _DECLARED[0]), (text, _DECLARED[1]), (firsts, _DECLARED[2])))
    return F.lower(F.coalesce(x, m, c))


def bom(content: Column) -> Column:
    return F.when(F.startswith(content, F.lit(codecs.BOM_UTF8)), "utf-8-sig").when(F.startswith(content, F.lit(codecs.BOM_UTF16_LE)), "utf-16-le").when(F.startswith(content, F.lit(codecs.BOM_UTF16_BE)), "utf-16-be")


def _odd(text: str) -> int:
    """How unlikely a decoded Japanese text looks: half-width kana and rare signs count."""
    return sum(3 if "｡" <= c <= "ﾟ" else 5 if c == "�" or "" <= c <= "" else 0 for c in text)


def decoded(raw: bytes, declared: str | None = None) -> tuple[str | None, str | None, str | None]:
    """Text, encoding, issue (ENCODING_CONFLICT, DECODE_ERROR) of a file."""
    mark = next((name for b, name in _BOMS if raw.startswith(b)), None)
    wanted = canonical_encoding(declared)
    fits = {"utf-8-sig": {"utf-8", "utf-8-sig"}, "utf-16-le": {"utf-16", "utf-16-le"}, "utf-16-be": {"utf-16", "utf-16-be"}}
    conflict = "ENCODING_CONFLICT" if mark and wanted and wanted not in fits[mark] else None
    tried: list[str] = []
    if mark:
        tried = [mark]
    elif wanted:
        tried = [wanted]
    else:
        tried = ["utf-8"]
        even, odd = raw[0::2].count(0), raw[1::2].count(0)
        if len(raw) >= 4 and max(even, odd) > len(raw) // 8:
            tried.insert(0, "utf-16-be" if even > odd else "utf-16-le")
        good = []
        for name in ("cp932", "euc_jp"):
            try:
                good.append((_odd(raw.decode(name)), name))
            except UnicodeDecodeError:
                pass
        tried += [n for _, n in sorted(good, key=lambda x: x[0])]
    for name in tried:
        try:
            text = raw.decode(name)
            return text.lstrip("﻿") if mark else text, name, conflict
        except UnicodeDecodeError:
            continue
    return None, None, conflict or "DECODE_ERROR"


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "encoding", "issue")]))
def decode_file(content: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """Text, encoding and issue of each file; null content stays null."""
    return pd.DataFrame([(None, None, None) if c is None else decoded(bytes(c), d) for c, d in zip(content, declared)], columns=["text", "encoding", "issue"])
