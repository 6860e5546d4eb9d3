"""HTTP routes: normal form, parts, suffixes, template matches, parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMETER = r"\{([^/{}:]+)(:[^/{}]+)?\}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def verb(method: Column | str) -> Column:
    """Upper-case method; null unless it is letters only."""
    v = F.upper(F.trim(_c(method)))
    return F.when(v.rlike("^[A-Z]+$"), v)


def route_path(route: Column | str) -> Column:
    """Path of a route or URL: no host, query or fragment, single slashes, parameters as {id}, no slash at the end. Null for a blank one."""
    raw = F.trim(_c(route))
    path = F.regexp_replace(raw, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    path = F.regexp_replace(path, r"\{[^/{}]*\}|:[A-Za-z_][A-Za-z0-9_]*", "{id}")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(raw != "", path)


def parts(route: Column | str) -> Column:
    return F.filter(F.split(_c(route), "/"), lambda x: x != "")


def suffixes(route_parts: Column) -> Column:
    """Every tail of the parts as a path, the whole first; of no parts: none."""
    n = F.size(route_parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(route_parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))


def template_matches(template: Column | str, actual: Column | str) -> Column:
    """Same number of parts, each equal or {id} in the template."""
    a, b = parts(template), parts(actual)
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | (x == "{id}"), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda ok: ok)


def parameters(route: Column | str) -> Column:
    """Names of the parameters of a route, in order."""
    return F.regexp_extract_all(_c(route), F.lit(PARAMETER), 1)


def with_tokens(route: Column | str, controller: Column | str, action: Column | str) -> Column:
    """[controller] and [action] filled in."""
    return F.replace(F.replace(_c(route), F.lit("[controller]"), _c(controller)), F.lit("[action]"), _c(action))


def combined(prefix: Column | str, route: Column | str) -> Column:
    """A route under a prefix, unless it is absolute (~/ or /)."""
    p, r = F.regexp_replace(F.coalesce(_c(prefix), F.lit("")), "^/+|/+$", ""), F.coalesce(_c(route), F.lit(""))
    tail = F.regexp_replace(r, "^~?/+|/+$", "")
    return F.when(r.rlike("^~?/"), F.concat(F.lit("/"), tail)).otherwise(F.concat(F.lit("/"), F.concat_ws("/", F.nullif(p, F.lit("")), F.nullif(tail, F.lit("")))))


def conventional(controller: Column | str, action: Column | str) -> Column:
    """/controller/action, Index left out."""
    c, a = F.regexp_replace(_c(controller), "Controller$", ""), _c(action)
    return F.when(F.lower(a) == "index", F.concat(F.lit("/"), c)).otherwise(F.concat_ws("/", F.lit(""), c, a))
