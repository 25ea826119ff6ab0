"""Expanding the dialect's calls in SQL text, and the same for the DataFrame API."""

from __future__ import annotations

import re
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .macros import MACROS

_TOKEN = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)|([A-Za-z_][A-Za-z0-9_]*)(\s*\()|(.)", re.DOTALL)
_SERIES = re.compile(r"\btable\s*\(\s*generate_series\s*\(", re.IGNORECASE)


#: Aggregates whose expansion is more than one call, so that OVER belongs inside.
WRAPPED = {"bool_or", "boolor_agg"}
#: Aggregates that take the first of equal keys in their window's order, where Spark's take the last.
FIRST = {"max_by", "max_by_v2", "min_by", "min_by_v2"}


def _close(sql: str, at: int) -> int:
    """The place of the parenthesis that closes the one before at."""
    depth = 1
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m[2] or m[4] == "(":
            depth += 1
        elif m[4] == ")":
            depth -= 1
            if not depth:
                return at
        at = m.end()
    raise ValueError("a parenthesis isn't closed")


def arguments(inner: str) -> list[str]:
    out, depth, start, at = [], 0, 0, 0
    while at < len(inner):
        m = _TOKEN.match(inner, at)
        if m[2] or (m[4] and m[4] in "([{"):
            depth += 1
        elif m[4] and m[4] in ")]}":
            depth -= 1
        elif m[4] == "," and not depth:
            out.append(inner[start:at].strip())
            start = m.end()
        at = m.end()
    last = inner[start:].strip()
    return [*out, last] if last or out else []


def statements(script: str) -> list[str]:
    """The script's statements: what stands between semicolons outside of quotes and comments."""
    out, start, at = [], 0, 0
    while at < len(script):
        m = _TOKEN.match(script, at)
        if m[4] == ";":
            out.append(script[start:at].strip())
            start = m.end()
        at = m.end()
    return [s for s in [*out, script[start:].strip()] if s]


def _safe(arg: str) -> str:
    """An argument that stays one where a template puts it beside an operator."""
    return arg if re.fullmatch(r"[\w.`]+|'[^']*'|\*", arg) or "->" in arg or re.match(r"distinct\b", arg, re.IGNORECASE) else f"({arg})"


_TABLE_FUNCTION = re.compile(r"(,|\bjoin\b)\s*(?:lateral\s+)?(unnest|unnest_bitmap|subdivide_bitmap)\s*\(", re.IGNORECASE)
_ALIAS = re.compile(r"\s*(?:as\s+)?([A-Za-z_]\w*)(?!\s*\.)\s*(\([^()]*\))?", re.IGNORECASE)
_NO_ALIAS = {"on", "where", "group", "order", "limit", "join", "cross", "left", "inner", "right", "full", "having", "union", "window", "lateral"}


def _table_functions(sql: str) -> str:
    """unnest(), unnest_bitmap() and subdivide_bitmap() beside a table: lateral generators; their column's name is theirs."""
    at = 0
    while m := _TABLE_FUNCTION.search(sql, at):
        end = _close(sql, m.end())
        a, name = arguments(sql[m.end() : end]), m[2].lower()
        outer = bool(re.search(r"\bleft\s+(outer\s+)?$", sql[: m.start()], re.IGNORECASE)) and m[1].lower() == "join"
        if name == "subdivide_bitmap":
            call = f"explode(transform(sequence(0, cast(ceil(size({a[0]}) / {a[1]}) as int) - 1), j -> slice({a[0]}, j * {a[1]} + 1, {a[1]})))"
        elif len(a) > 1:
            call = f"inline(arrays_zip({', '.join(f'coalesce({x}, array())' for x in a)}))"
        else:
            call = f"explode({a[0]})"
        if outer:
            call = call.replace("inline(", "inline_outer(", 1).replace("explode(", "explode_outer(", 1)
        alias = _ALIAS.match(sql, end + 1)
        given = alias and alias[1].lower() not in _NO_ALIAS
        columns = (given and alias[2]) or f"({', '.join([name] if len(a) == 1 or name != 'unnest' else [f'{name}_{i}' for i in range(1, len(a) + 1)])})"
        put = f"{m[1]} LATERAL {call} AS {alias[1] if given else name}{columns}"
        sql = sql[: m.start()] + put + sql[alias.end() if given else end + 1 :]
        at = m.start() + len(put)
    return sql


_QUALIFY_END = {"order", "limit", "union", "intersect", "except", "minus"}


def _qualify(sql: str) -> str:
    """QUALIFY as a filter over the SELECT that it stands in, which may also use that SELECT's aliases."""
    words, depth = [], 0  # (word, start, end, depth)
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m[2]:
            words.append((m[2].lower(), at, at + len(m[2]), depth))
            depth += 1
        elif m[4] == "(":
            depth += 1
        elif m[4] == ")":
            depth -= 1
            words.append((")", at, at + 1, depth))
        elif m[4] and (w := re.match(r"[A-Za-z_]\w*", sql[at:])):
            words.append((w[0].lower(), at, at + w.end(), depth))
            at += w.end()
            continue
        at = m.end()
    i = max((i for i, w in enumerate(words) if w[0] == "qualify"), default=None)
    if i is None:
        return sql
    _, start, end, level = words[i]
    select = max(j for j in range(i) if words[j][0] == "select" and words[j][3] == level)
    source = min(j for j in range(select, i) if words[j][0] == "from" and words[j][3] == level)
    stop = next((w[1] for w in words[i + 1 :] if w[3] < level or w[3] == level and w[0] in _QUALIFY_END), len(sql))
    head, items, rest = sql[: words[select][1]], sql[words[select][2] : words[source][1]].strip(), sql[words[source][1] : start].strip()
    return _qualify(f"{head}SELECT * EXCEPT (__kept) FROM (SELECT {items}, ({sql[end:stop].strip()}) AS __kept {rest}) __qualified WHERE __kept {sql[stop:]}".rstrip())


_NAMED = re.compile(r"\s*over\s*(?:([A-Za-z_]\w*)|\(\s*([A-Za-z_]\w*)\s*\))", re.IGNORECASE)
_FRAME = re.compile(r"\b(?:rows|range)\s+(?:between|unbounded|current|interval|\d+)\b", re.IGNORECASE)


def _window(sql: str, at: int, name: str) -> str | None:
    """What WINDOW name AS (...) says in the SELECT around at, or one around that."""
    depth = low = 0
    while at < len(sql):
        if depth == low and (m := re.compile(rf"\b{name}\s+as\s*\(", re.IGNORECASE).match(sql, at)) and re.search(r"(\bwindow|,)\s*$", sql[:at], re.IGNORECASE):
            return sql[m.end() : _close(sql, m.end())]
        m = _TOKEN.match(sql, at)
        if m[2] or m[4] == "(":
            depth += 1
        elif m[4] == ")":
            depth -= 1
            low = min(low, depth)
        at = m.end()
    return None


def _named_windows(sql: str) -> str:
    """The windows that FIRST's calls name, in the place of their names."""
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        at = m.end()
        if not m[2] or m[2].lower() not in FIRST:
            continue
        end = _close(sql, at) + 1
        if (over := _NAMED.match(sql, end)) and (found := _window(sql, over.end(), over[1] or over[2])) is not None:
            sql = f"{sql[:end]} OVER ({found}){sql[over.end() :]}"
    return sql


def _first(name: str, args: list[str], window: str) -> str:
    """A call of FIRST over a window: rows of equal keys are told apart by their numbers in its order."""
    call, frame = MACROS[name](args), _FRAME.search(window)
    order = window[: frame.start()] if frame else window
    if not re.search(r"\border\s+by\b", order, re.IGNORECASE):
        return call
    kind = call[: call.index("(")]
    value, key = arguments(call[len(kind) + 1 : -1])
    return f"{kind}({value}, CASE WHEN ({key}) IS NOT NULL THEN struct(({key}), {'-' if kind == 'max_by' else ''}row_number() OVER ({order.strip()})) END)"


#: Characters that group_concat keeps; the engine's setting group_concat_max_len.
GROUP_CONCAT_MAX_LEN: ContextVar[int] = ContextVar("group_concat_max_len", default=1024)


def expand(sql: str) -> str:
    """SQL text with every call of a dialect function put as Spark's built-in expressions."""
    sql = _table_functions(sql)
    if re.search(r"\bqualify\b", sql, re.IGNORECASE):
        sql = _qualify(sql)
    sql = _named_windows(sql)
    while m := _SERIES.search(sql):
        inner_end = _close(sql, m.end())
        outer_end = _close(sql, inner_end + 1)
        a = arguments(sql[m.end() : inner_end])
        step = int(a[2]) if len(a) > 2 else 1
        if step == 0:
            raise ValueError("generate_series needs a step other than 0")
        rows = f" (SELECT id AS generate_series FROM range({a[0]}, {a[1]} + {1 if step > 0 else -1}, {step}))"
        sql = sql[: m.start()] + rows + sql[outer_end + 1 :]
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m[2]:
            out.append(m[0])
            at = m.end()
            continue
        name, end = m[2].lower(), _close(sql, m.end())
        inner = sql[m.end() : end]
        if name in MACROS and not (out and "".join(out[-2:]).rstrip().endswith(".")):
            args = [_safe(expand(x)) for x in arguments(inner)]
            if args and re.match(r"\(?\s*distinct\b", args[0], re.IGNORECASE) or re.search(r"\b(order\s+by|separator)\b", inner, re.IGNORECASE) and name in ("array_agg", "group_concat", "string_agg"):
                out.append(_aggregate(name, inner))
            elif name in WRAPPED and (over := re.match(r"\s*over\s*\(", sql[end + 1 :], re.IGNORECASE)):
                stop = _close(sql, end + 1 + over.end())
                out.append(MACROS[name](args).replace(f"({args[0]})", f"({args[0]}) {expand(sql[end + 1 : stop + 1]).strip()}", 1))
                at = stop + 1
                continue
            elif name in FIRST and (over := re.match(r"\s*over\s*\(", sql[end + 1 :], re.IGNORECASE)):
                start = end + 1 + over.end()
                stop = _close(sql, start)
                window = expand(sql[start:stop])
                out.append(f"{_first(name, args, window)} OVER ({window})")
                at = stop + 1
                continue
            else:
                out.append(MACROS[name](args))
        else:
            out.append(f"{m[2]}({expand(inner)})")
        at = end + 1
    return "".join(out)


def _aggregate(name: str, inner: str) -> str:
    """array_agg and group_concat with DISTINCT, ORDER BY and SEPARATOR; other aggregates with DISTINCT."""
    sep = re.search(r"\bseparator\s+('(?:[^']|'')*')", inner, re.IGNORECASE)
    inner = inner[: sep.start()] if sep else inner
    distinct = bool(re.match(r"\s*distinct\b", inner, re.IGNORECASE))
    body = re.sub(r"^\s*distinct\b", "", inner, flags=re.IGNORECASE)
    parts = re.split(r"\border\s+by\b", body, flags=re.IGNORECASE)
    args = [expand(x) for x in arguments(parts[0])]
    x = args[0]
    keys = [re.sub(r"\s+(asc|desc)\s*$", "", k, flags=re.IGNORECASE) for k in arguments(parts[1])] if len(parts) > 1 else []
    down = len(parts) > 1 and bool(re.search(r"\bdesc\s*$", parts[1].strip(), re.IGNORECASE))
    item = f"struct({', '.join(f'{expand(k)} AS k{i}' for i, k in enumerate(keys))}{', ' if keys else ''}({x}) AS x)"
    collected = f"{'collect_set' if distinct else 'collect_list'}({item})"
    if keys or distinct:
        collected = f"sort_array({collected}, {'false' if down else 'true'})"
    listed = f"transform({collected}, e -> e.x)"
    if name in ("group_concat", "string_agg"):
        text = f"transform(filter({listed}, z -> z IS NOT NULL), z -> cast(z as string))"
        mark = sep[1] if sep else args[1] if len(args) > 1 else "','"
        return f"left(array_join({text}, {mark}), {GROUP_CONCAT_MAX_LEN.get()})"
    if name == "array_agg":
        return listed
    return MACROS[name]([f"DISTINCT {args[0]}", *args[1:]])


def fx(call: str) -> Column:
    """A dialect expression as a column: fx("months_add(ts, 3)")."""
    return F.expr(expand(call))
