"""The dialect's functions as text over Spark's built-in expressions.

A macro turns a call's argument texts into a Spark SQL expression, so Catalyst
sees nothing but built-in functions: pushdown, pruning and code generation work
as if the expression had been written by hand. Names are those of the dialect,
in lower case; what isn't listed is Spark's own function of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .formats import JODA_FORMAT, MYSQL_FORMAT, MYSQL_PUT, TERADATA_FORMAT, spark_pattern

Macro = Callable[[list[str]], str]
MACROS: dict[str, Macro] = {}


def macro(*names: str):
    def put(f: Macro) -> Macro:
        MACROS.update(dict.fromkeys(names, f))
        return f

    return put


def text(spec: dict[str, str]) -> None:
    """Several names (separated by spaces) to a template of {0}, {1} ..."""
    for names, template in spec.items():
        for name in names.split():
            MACROS[name] = lambda a, t=template: t.format(*a)


def literal(arg: str) -> str:
    """The value of a string literal argument."""
    arg = arg.strip()
    while arg.startswith("(") and arg.endswith(")"):
        arg = arg[1:-1].strip()
    if len(arg) < 2 or arg[0] != arg[-1] or arg[0] not in "'\"":
        raise ValueError(f"a string literal is needed, not {arg}")
    return arg[1:-1].replace("''", "'")


def finite(expr: str) -> str:
    return f"CASE WHEN abs({expr}) < double('Infinity') THEN {expr} END"


# --- conditional -----------------------------------------------------------
text({
    "is_null_pred": "({0} IS NULL)",
    "is_not_null_pred": "({0} IS NOT NULL)",
    "null_or_empty": "({0} IS NULL OR {0} = '')",
})

# --- date and time ---------------------------------------------------------
ORIGIN = "timestamp_ntz'0001-01-01 00:00:00'"
text({
    "add_months months_add": "({0} + make_ym_interval(0, {1}))",
    "months_sub": "({0} - make_ym_interval(0, {1}))",
    "quarters_add": "({0} + make_ym_interval(0, 3 * {1}))",
    "quarters_sub": "({0} - make_ym_interval(0, 3 * {1}))",
    "years_add": "({0} + make_ym_interval({1}, 0))",
    "years_sub": "({0} - make_ym_interval({1}, 0))",
    "days_add date_add adddate": "({0} + make_dt_interval({1}))",
    "days_sub date_sub subdate": "({0} - make_dt_interval({1}))",
    "weeks_add": "({0} + make_dt_interval(7 * {1}))",
    "weeks_sub": "({0} - make_dt_interval(7 * {1}))",
    "hours_add": "({0} + make_dt_interval(0, {1}))",
    "hours_sub": "({0} - make_dt_interval(0, {1}))",
    "minutes_add": "({0} + make_dt_interval(0, 0, {1}))",
    "minutes_sub": "({0} - make_dt_interval(0, 0, {1}))",
    "seconds_add": "({0} + make_dt_interval(0, 0, 0, {1}))",
    "seconds_sub": "({0} - make_dt_interval(0, 0, 0, {1}))",
    "milliseconds_add": "({0} + make_dt_interval(0, 0, 0, cast({1} as decimal(18,6)) / 1000))",
    "milliseconds_sub": "({0} - make_dt_interval(0, 0, 0, cast({1} as decimal(18,6)) / 1000))",
    "microseconds_add": "({0} + make_dt_interval(0, 0, 0, cast({1} as decimal(18,6)) / 1000000))",
    "microseconds_sub": "({0} - make_dt_interval(0, 0, 0, cast({1} as decimal(18,6)) / 1000000))",
    "years_diff": "timestampdiff(YEAR, {1}, {0})",
    "quarters_diff": "timestampdiff(QUARTER, {1}, {0})",
    "months_diff": "timestampdiff(MONTH, {1}, {0})",
    "weeks_diff": "timestampdiff(WEEK, {1}, {0})",
    "days_diff": "timestampdiff(DAY, {1}, {0})",
    "hours_diff": "timestampdiff(HOUR, {1}, {0})",
    "minutes_diff": "timestampdiff(MINUTE, {1}, {0})",
    "seconds_diff": "timestampdiff(SECOND, {1}, {0})",
    "milliseconds_diff": "timestampdiff(MILLISECOND, {1}, {0})",
    "datediff": "datediff({0}, {1})",
    "dayname": "date_format({0}, 'EEEE')",
    "monthname": "date_format({0}, 'MMMM')",
    "dayofweek_iso day_of_week_iso": "(weekday({0}) + 1)",
    "week_day": "weekday({0})",
    "week week_iso": "weekofyear({0})",
    "yearweek": "(extract(YEAROFWEEK FROM {0}) * 100 + weekofyear({0}))",
    "from_days": "date_from_unix_date({0} - 719528)",
    "to_days": "(unix_date(cast({0} as date)) + 719528)",
    "makedate": "CASE WHEN {1} > 0 THEN date_add(make_date({0}, 1, 1), {1} - 1) END",
    "hour_from_unixtime": "hour(timestamp_seconds({0}))",
    "from_unixtime_ms": "from_unixtime({0} div 1000, 'yyyy-MM-dd HH:mm:ss')",
    "previous_day": "next_day(date_sub(cast({0} as date), 8), {1})",
    "substitute": "({0})",
    "time_to_sec": "(hour({0}) * 3600 + minute({0}) * 60 + second({0}))",
    "sec_to_time": "concat(CASE WHEN {0} < 0 THEN '-' ELSE '' END, CASE WHEN abs({0}) < 360000 THEN lpad(cast(abs({0}) div 3600 as string), 2, '0') ELSE cast(abs({0}) div 3600 as string) END, ':', lpad(cast(abs({0}) div 60 % 60 as string), 2, '0'), ':', lpad(cast(abs({0}) % 60 as string), 2, '0'))",
    "timestamp": "cast({0} as timestamp_ntz)",
    "to_iso8601 datetime_to_iso8601": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "date_to_iso8601": "date_format({0}, 'yyyy-MM-dd')",
    "curdate": "current_date()",
    "curtime current_time utc_time": "date_format(localtimestamp(), 'HH:mm:ss')",
    "now localtime utc_timestamp": "localtimestamp()",
    "alignment_timestamp date_floor": "cast(date_trunc({0}, {1}) as timestamp_ntz)",
})
MACROS["timediff"] = lambda a: MACROS["sec_to_time"]([f"timestampdiff(SECOND, {a[1]}, {a[0]})"])
UNITS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond"}


@macro("date_trunc")
def _date_trunc(a):
    if literal(a[0]).lower() not in UNITS:
        raise ValueError(f"date_trunc has no unit {a[0]}")
    return f"cast(date_trunc({a[0]}, {a[1]}) as timestamp_ntz)"


@macro("date_diff")
def _date_diff(a):
    return f"timestampdiff({literal(a[0]).upper()}, {a[2]}, {a[1]})"


@macro("time_slice")
def _time_slice(a):
    """time_slice(ts, n, 'unit'[, 'floor' | 'ceil']) or (ts, INTERVAL n unit[, floor | ceil]): slices of n units from 0001-01-01.

    Counts are BIGINT, and added as days and what is left of a day; NULL beyond year 9999.
    """
    if m := re.match(r"\(?\s*interval\s+'?(\d+)'?\s+(\w+?)s?\s*\)?$", a[1], re.IGNORECASE):
        a = [a[0], m[1], f"'{m[2]}'", *a[2:]]
    unit, ts = literal(a[2]).upper(), f"cast({a[0]} as timestamp_ntz)"
    add = 1 if len(a) > 3 and a[3].lower().strip("()' ") == "ceil" else 0
    if unit in PARTS_OF_A_DAY:
        days, parts = PARTS_OF_A_DAY[unit]
        small = "MICROSECOND" if unit == "MICROSECOND" else "MILLISECOND" if unit == "MILLISECOND" else "SECOND"
        a_day = {"SECOND": 86400, "MILLISECOND": 86400 * 10**3, "MICROSECOND": 86400 * 10**6}[small]
        size = f"({a[1]} * {days * a_day // parts}L)"
        # Whole days and the time of day, as a difference in microseconds overflows.
        whole = f"(datediff({ts}, {ORIGIN}) * {a_day}L + timestampdiff({small}, date_trunc('DAY', {ts}), {ts}))"
        total = f"(({whole} div {size} + {add}) * {size})"
        rest = f"timestampadd(DAY, cast({total} div {a_day}L as int), {ORIGIN})"
        left = f"{total} % {a_day}L"
        if small == "SECOND":
            got = f"timestampadd(SECOND, cast({left} as int), {rest})"
        else:
            per = a_day // 86400
            got = f"timestampadd(MICROSECOND, cast({left} % {per}L * {10**6 // per} as int), timestampadd(SECOND, cast({left} div {per}L as int), {rest}))"
        good = f"{total} div {a_day}L < 3652059"
    else:
        months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
        size = f"({a[1]} * {months}L)"
        total = f"((cast(timestampdiff(MONTH, {ORIGIN}, {ts}) as bigint) div {size} + {add}) * {size})"
        got, good = f"timestampadd(MONTH, cast({total} as int), {ORIGIN})", f"{total} < 119988"
    return f"CASE WHEN {good} THEN cast({got} as timestamp_ntz) END"


#: Days and the parts that a day has, by unit: 7 / 1 for a week, 1 / 24 for an hour.
PARTS_OF_A_DAY = {"WEEK": (7, 1), "DAY": (1, 1), "HOUR": (1, 24), "MINUTE": (1, 1440), "SECOND": (1, 86400), "MILLISECOND": (1, 86400 * 10**3), "MICROSECOND": (1, 86400 * 10**6)}


@macro("date_slice")
def _date_slice(a):
    return f"cast({_time_slice(a)} as date)"


@macro("last_day")
def _last_day(a):
    unit = literal(a[1]).lower() if len(a) > 1 else "month"
    if unit == "month":
        return f"last_day({a[0]})"
    months = {"quarter": 3, "year": 12}[unit]
    return f"date_sub(cast(date_trunc('{unit}', {a[0]}) + make_ym_interval(0, {months}) as date), 1)"


@macro("date_format", "strftime")
def _date_format(a):
    return f"date_format({a[0]}, '{spark_pattern(literal(a[1]), MYSQL_PUT)}')"


MACROS["time_format"] = _date_format
MACROS["jodatime_format"] = MACROS["format_datetime"] = lambda a: f"date_format({a[0]}, '{spark_pattern(literal(a[1]), JODA_FORMAT)}')"
MACROS["str_to_date"] = MACROS["str2date"] = lambda a: f"cast(try_to_timestamp({a[0]}, '{spark_pattern(literal(a[1]), MYSQL_FORMAT)}') as timestamp_ntz)"
MACROS["str_to_jodatime"] = MACROS["parse_datetime"] = lambda a: f"cast(try_to_timestamp({a[0]}, '{spark_pattern(literal(a[1]), JODA_FORMAT)}') as timestamp_ntz)"
MACROS["to_tera_date"] = lambda a: f"try_to_date({a[0]}, '{spark_pattern(literal(a[1]), TERADATA_FORMAT) if len(a) > 1 else 'yyyy/MM/dd'}')"
MACROS["to_tera_timestamp"] = lambda a: f"cast(try_to_timestamp({a[0]}, '{spark_pattern(literal(a[1]), TERADATA_FORMAT) if len(a) > 1 else 'yyyy/MM/dd HH:mm:ss'}') as timestamp_ntz)"
MACROS["to_date"] = lambda a: f"try_to_date({', '.join(a)})"


@macro("from_unixtime")
def _from_unixtime(a):
    pattern = spark_pattern(literal(a[1]), MYSQL_FORMAT) if len(a) > 1 else "yyyy-MM-dd HH:mm:ss"
    at = f"timestamp_seconds({a[0]})" if len(a) < 3 else f"convert_timezone('UTC', {a[2]}, cast(timestamp_seconds({a[0]}) as timestamp_ntz))"
    return f"date_format({at}, '{pattern}')"


@macro("convert_tz")
def _convert_tz(a):
    return f"convert_timezone({a[1]}, {a[2]}, {a[0]})"


@macro("to_datetime", "to_datetime_ntz")
def _to_datetime(a):
    make = {"0": "seconds", "3": "millis", "6": "micros"}[a[1].strip() if len(a) > 1 else "0"]
    return f"cast(timestamp_{make}({a[0]}) as timestamp_ntz)"


# --- math and vectors ------------------------------------------------------
for _name, _of in {"acos": "acos", "asin": "asin", "cot": "cot", "dlog1": "log1p", "exp": "exp", "dexp": "exp", "ln": "ln", "log10": "log10", "dlog10": "log10", "log2": "log2", "sqrt": "sqrt", "dsqrt": "sqrt"}.items():
    MACROS[_name] = lambda a, f=_of: finite(f"{f}({a[0]})")
for _name in ("pow", "dpow", "fpow", "power"):
    MACROS[_name] = lambda a: finite(f"power({a[0]}, {a[1]})")
text({
    "ceiling dceil": "ceil({0})",
    "dfloor": "floor({0})",
    "degress": "degrees({0})",
    "fmod mod": "try_mod({0}, {1})",
    "pmod": "pmod({0}, nullif({1}, 0))",
    "square": "({0} * {0})",
    "random": "rand()",
    "equiwidth_bucket": "CASE WHEN {0} BETWEEN {1} AND {2} THEN ({0} - {1}) div greatest(({2} - {1}) div {3}, 1) END",
    "sign": "coalesce(sign(nanvl({0}, 0)), NULL)",
    "cosine_similarity_norm approx_cosine_similarity_norm": "aggregate(zip_with({0}, {1}, (p, r) -> double(p) * double(r)), double(0), (acc, z) -> acc + z)",
    "l2_distance approx_l2_distance": "aggregate(zip_with({0}, {1}, (p, r) -> (double(p) - double(r)) * (double(p) - double(r))), double(0), (acc, z) -> acc + z)",
})
MACROS["cosine_similarity"] = MACROS["approx_cosine_similarity"] = lambda a: (
    f"try_divide({MACROS['cosine_similarity_norm'](a)}, sqrt({MACROS['cosine_similarity_norm']([a[0], a[0]])}) * sqrt({MACROS['cosine_similarity_norm']([a[1], a[1]])}))"
)
MACROS["log"] = lambda a: f"CASE WHEN {a[0]} > 0 AND {a[0]} <> 1 AND {a[1]} > 0 THEN ln({a[1]}) / ln({a[0]}) END" if len(a) > 1 else finite(f"ln({a[0]})")
for _name in ("greatest", "least"):
    MACROS[_name] = lambda a, f=_name: f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in a)} THEN {f}({', '.join(a)}) END" if len(a) > 1 else a[0]


@macro("truncate")
def _truncate(a):
    n = a[1] if len(a) > 1 else "0"
    return f"CASE WHEN {a[0]} >= 0 THEN floor({a[0]} * power(10, {n})) ELSE ceil({a[0]} * power(10, {n})) END / power(10, {n})"


MACROS["dround"] = lambda a: _truncate(a) if len(a) > 1 else f"round({a[0]}, 0)"

# --- strings ---------------------------------------------------------------
text({
    "length": "octet_length({0})",
    "append_trailing_char_if_absent": "CASE WHEN octet_length({1}) = 1 THEN CASE WHEN endswith({0}, {1}) THEN {0} ELSE concat({0}, {1}) END END",
    "bar": "repeat('▓', cast(floor(({0} - {1}) / double({2} - {1}) * {3}) as int))",
    "ends_with": "endswith({0}, {1})",
    "starts_with": "startswith({0}, {1})",
    "format_bytes": "CASE WHEN {0} < 0 THEN NULL WHEN {0} < 1024 THEN concat({0}, ' B') WHEN {0} < 1048576 THEN format_string('%.2f KB', {0} / 1024D) WHEN {0} < 1073741824 THEN format_string('%.2f MB', {0} / 1048576D) WHEN {0} < 1099511627776 THEN format_string('%.2f GB', {0} / 1073741824D) WHEN {0} < 1125899906842624 THEN format_string('%.2f TB', {0} / 1099511627776D) WHEN {0} < 1152921504606846976 THEN format_string('%.2f PB', {0} / 1125899906842624D) ELSE format_string('%.2f EB', {0} / 1152921504606846976D) END",
    "strleft": "left({0}, {1})",
    "strright": "right({0}, {1})",
    "lpad": "CASE WHEN {1} >= 0 THEN lpad({0}, {1}, {2}) END",
    "rpad": "CASE WHEN {1} >= 0 THEN rpad({0}, {1}, {2}) END",
    "money_format": "format_number({0}, 2)",
    "parse_url": "try_parse_url({0}, {1})",
    "regexp_position": "CASE WHEN regexp_instr({0}, {1}) = 0 THEN -1 ELSE regexp_instr({0}, {1}) END",
    "split_part": "coalesce(CASE WHEN {2} = 0 THEN '' ELSE split_part({0}, {1}, {2}) END, '')",
    "str_to_map": "str_to_map({0}, concat('\\\\Q', {1}, '\\\\E'), concat('\\\\Q', {2}, '\\\\E'))",
    "split": "CASE WHEN {1} = '' THEN split({0}, '') ELSE split({0}, concat('\\\\Q', {1}, '\\\\E')) END",
    "unhex": "cast(unhex({0}) as string)",
    "url_decode": "try_url_decode({0})",
    "url_extract_host url_extract_": "try_parse_url({0}, 'HOST')",
    "initcap": "array_join(transform(regexp_extract_all(lower({0}), '([a-z0-9]+|[^a-z0-9]+)', 1), w -> concat(upper(left(w, 1)), substr(w, 2))), '')",
    "lcase": "lower({0})",
})
MACROS["field"] = lambda a: f"coalesce(array_position(array({', '.join(a[1:])}), {a[0]}), 0)"


@macro("substring", "substr")
def _substring(a):
    rest = ", ".join(a)
    short = f" OR {a[2]} <= 0" if len(a) > 2 else ""
    return f"CASE WHEN {a[1]} = 0 OR {a[1]} < -char_length({a[0]}){short} THEN CASE WHEN {a[0]} IS NOT NULL THEN '' END ELSE substring({rest}) END"


@macro("strpos", "strpos_instance")
def _strpos(a):
    if len(a) < 3:
        return f"instr({a[0]}, {a[1]})"
    front = f"CASE WHEN size(split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))) > {a[2]} THEN char_length(substring_index({a[0]}, {a[1]}, {a[2]})) + 1 ELSE 0 END"
    back = f"CASE WHEN size(split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))) > -({a[2]}) THEN char_length({a[0]}) - char_length(substring_index({a[0]}, {a[1]}, {a[2]})) - char_length({a[1]}) + 1 ELSE 0 END"
    return f"CASE WHEN {a[2]} > 0 THEN {front} ELSE {back} END"


# --- arrays ----------------------------------------------------------------
_SOLID = "filter({0}, z -> z IS NOT NULL)"
text({
    "all_match": "forall({0}, z -> z)",
    "any_match": "exists({0}, z -> z)",
    "array_avg": f"aggregate({_SOLID}, double(0), (acc, z) -> acc + z) / nullif(size({_SOLID}), 0)",
    "array_sum": f"aggregate({_SOLID}, cast(0 as bigint), (acc, z) -> acc + z)",
    "array_contains": "exists({0}, z -> z <=> {1})",
    "array_contains_all": "(size(array_except({1}, {0})) = 0)",
    "array_contains_seq": "CASE WHEN size({1}) = 0 THEN true ELSE exists(sequence(1, greatest(size({0}) - size({1}) + 1, 1)), p -> slice({0}, p, size({1})) <=> {1}) END",
    "array_cum_sum": "aggregate({0}, cast(array() as array<bigint>), (acc, z) -> array_append(acc, coalesce(try_element_at(acc, -1), 0) + z))",
    "array_difference": "transform({0}, (z, p) -> CASE WHEN p = 0 THEN z - z ELSE z - get({0}, p - 1) END)",
    "array_flatten": "flatten({0})",
    "array_length": "size({0})",
    "array_position": "CASE WHEN {0} IS NOT NULL THEN coalesce(array_min(transform({0}, (z, p) -> CASE WHEN z <=> {1} THEN p + 1 END)), 0) END",
    "array_remove": "filter({0}, z -> NOT (z <=> {1}))",
    "array_sort": "sort_array({0})",
    "array_sort_lambda": "array_sort({0}, {1})",
    "array_top_n": "slice(sort_array({0}, false), 1, {1})",
    "arrays_overlap": "exists({0}, z -> array_contains(filter({1}, w -> w IS NOT NULL), z) OR (z IS NULL AND exists({1}, w -> w IS NULL)))",
    "element_at": "try_element_at({0}, {1})",
    "map_size": "size({0})",
    "distinct_map_keys": "({0})",
})
MACROS["array_concat"] = lambda a: f"concat({', '.join(a)})"
MACROS["array_filter"] = lambda a: f"transform(filter(zip_with({a[0]}, {a[1]}, (p, r) -> struct(p AS p, r AS r)), z -> z.r), z -> z.p)"
MACROS["array_slice"] = lambda a: f"CASE WHEN {a[1]} = 0 THEN slice({a[0]}, 1, 0) ELSE slice({a[0]}, {a[1]}, {a[2] if len(a) > 2 else f'greatest(size({a[0]}), 0)'}) END"
MACROS["array_join"] = lambda a: f"array_join({', '.join(a)})"


@macro("array_intersect")
def _array_intersect(a):
    out = a[0]
    for x in a[1:]:
        out = f"array_intersect({out}, {x})"
    return out


@macro("array_generate")
def _array_generate(a):
    start, end = (a[0], a[1]) if len(a) > 1 else ("1", a[0])
    if len(a) > 3:
        return f"sequence({start}, {end}, make_interval({', '.join(a[2] if u == literal(a[3]).lower() else '0' for u in ('year', 'month', 'week', 'day', 'hour', 'minute', 'second'))}))"
    step = f"cast({a[2]} as bigint)" if len(a) > 2 else f"cast(CASE WHEN {start} <= {end} THEN 1 ELSE -1 END as bigint)"
    return f"CASE WHEN ({end} - {start}) * {step} >= 0 THEN sequence(cast({start} as bigint), cast({end} as bigint), {step}) ELSE cast(array() as array<bigint>) END"


@macro("array_map")
def _array_map(a):
    """array_map(lambda, array, ...) or, as the lambda may come last, array_map(array, ..., lambda); several arrays are zipped."""
    f = next(x for x in a if "->" in x)
    arrays = [x for x in a if x is not f]
    if len(arrays) < 3:
        return f"transform({arrays[0]}, {f})" if len(arrays) == 1 else f"zip_with({arrays[0]}, {arrays[1]}, {f})"
    names, body = (x.strip() for x in f.split("->", 1))
    names = [x.strip() for x in names.strip("() ").split(",")]
    zipped = f"transform({arrays[0]}, v -> struct(v AS v0))"
    for i, x in enumerate(arrays[1:], 1):
        zipped = f"zip_with({zipped}, {x}, (s, v) -> struct({', '.join(f's.v{j} AS v{j}' for j in range(i))}, v AS v{i}))"
    for i, name in enumerate(names):
        body = re.sub(rf"(?<![\w.`']){name}(?![\w`'(])", f"zipped.v{i}", body)
    return f"transform({zipped}, zipped -> {body})"


@macro("array_sortby")
def _array_sortby(a):
    keys = ", ".join(f"{k}[p]" for k in a[1:])
    return f"transform(array_sort(transform({a[0]}, (z, p) -> struct(struct({keys}) AS k, p AS p, z AS z)), (l, r) -> CASE WHEN l.k < r.k THEN -1 WHEN l.k > r.k THEN 1 ELSE l.p - r.p END), e -> e.z)"


# --- maps, structs, JSON ---------------------------------------------------
text({
    "map_apply": "map_from_entries(transform(map_entries({1}), {0}))",
    "get_json_bool": "try_cast(get_json_object({0}, {1}) as boolean)",
    "get_json_int": "try_cast(get_json_object({0}, {1}) as bigint)",
    "get_json_double": "try_cast(get_json_object({0}, {1}) as double)",
    "get_json_string json_query": "get_json_object({0}, {1})",
    "get_variant_bool": "try_variant_get(try_parse_json({0}), {1}, 'boolean')",
    "get_variant_int": "try_variant_get(try_parse_json({0}), {1}, 'bigint')",
    "get_variant_double": "try_variant_get(try_parse_json({0}), {1}, 'double')",
    "get_variant_string": "try_variant_get(try_parse_json({0}), {1}, 'string')",
    "get_variant_date": "try_variant_get(try_parse_json({0}), {1}, 'date')",
    "get_variant_datetime": "try_variant_get(try_parse_json({0}), {1}, 'timestamp_ntz')",
    "get_variant_time": "unix_timestamp(try_to_timestamp(try_variant_get(try_parse_json({0}), {1}, 'string'), 'HH:mm:ss'))",
    "variant_query": "try_variant_get(try_parse_json({0}), {1}, 'variant')",
    "variant_typeof": "schema_of_variant(try_parse_json({0}))",
    "json_exists": "CASE WHEN {0} IS NOT NULL THEN try_variant_get(try_parse_json({0}), {1}, 'variant') IS NOT NULL END",
    "parse_json": "try_parse_json({0})",
})
MACROS["row"] = lambda a: f"struct({', '.join(a)})"
MACROS["json_keys"] = lambda a: f"json_object_keys({a[0] if len(a) < 2 else f'get_json_object({a[0]}, {a[1]})'})"
MACROS["json_length"] = lambda a: (lambda j: f"CASE WHEN {a[0]} IS NOT NULL THEN CASE WHEN try_parse_json({a[0]}) IS NULL OR {j} IS NULL THEN 0 ELSE coalesce(json_array_length({j}), size(json_object_keys({j})), 1) END END")(a[0] if len(a) < 2 else f"get_json_object({a[0]}, {a[1]})")
MACROS["json_object"] = lambda a: f"to_json(named_struct({', '.join(a)}))"

# --- bitmaps: sorted distinct ARRAY<BIGINT> --------------------------------
text({
    "array_to_bitmap": "sort_array(array_distinct(filter({0}, z -> z >= 0)))",
    "bitmap_and": "array_intersect({0}, {1})",
    "bitmap_or": "sort_array(array_union({0}, {1}))",
    "bitmap_andnot": "array_except({0}, {1})",
    "bitmap_xor": "sort_array(array_union(array_except({0}, {1}), array_except({1}, {0})))",
    "bitmap_contains": "array_contains({0}, {1})",
    "bitmap_count": "size({0})",
    "bitmap_empty": "cast(array() as array<bigint>)",
    "bitmap_from_string": "CASE WHEN forall(split({0}, ','), z -> try_cast(trim(z) as bigint) >= 0) THEN sort_array(array_distinct(transform(split({0}, ','), z -> try_cast(trim(z) as bigint)))) END",
    "bitmap_has_any": "arrays_overlap({0}, {1})",
    "bitmap_max": "array_max({0})",
    "bitmap_min": "array_min({0})",
    "bitmap_subset_in_range": "filter({0}, z -> z >= {1} AND z < {2})",
    "bitmap_subset_limit": "CASE WHEN {2} >= 0 THEN slice(filter({0}, z -> z >= {1}), 1, {2}) ELSE sort_array(slice(reverse(filter({0}, z -> z <= {1})), 1, -({2}))) END",
    "bitmap_to_array": "({0})",
    "bitmap_to_string": "array_join(transform({0}, z -> cast(z as string)), ',')",
    "sub_bitmap": "CASE WHEN {1} < 0 THEN slice({0}, {1}, {2}) ELSE slice({0}, {1} + 1, {2}) END",
    "to_bitmap": "CASE WHEN try_cast({0} as bigint) >= 0 THEN array(try_cast({0} as bigint)) END",
    "hll_hash hll_hash1 ds_hll_count_distinct_state": "xxhash64({0})",
    "hll_cardinality": "hll_sketch_estimate({0})",
    "hll_serialize hll_deserialize": "({0})",
    "percentile_empty": "cast(array() as array<double>)",
    "percentile_hash": "array(cast({0} as double))",
    "percentile_approx_raw": "element_at(sort_array({0}), cast(greatest(1, ceil({1} * size({0}))) as int))",
    "sleep": "true",
})

# --- bits, encoding, hashing -----------------------------------------------
text({
    "bit_shift_left": "shiftleft({0}, {1})",
    "bit_shift_right": "shiftright({0}, {1})",
    "bit_shift_right_logical": "shiftrightunsigned({0}, {1})",
    "bitand": "({0} & {1})",
    "bitor": "({0} | {1})",
    "bitxor": "({0} ^ {1})",
    "bitnot": "(~{0})",
    "to_base64": "base64({0})",
    "from_base64 base64_decode_string": "cast(try_to_binary({0}, 'base64') as string)",
    "base64_decode_binary": "try_to_binary({0}, 'base64')",
    "sha2": "CASE WHEN {1} IN (224, 256, 384, 512) THEN sha2({0}, {1}) END",
    "md5sum_numeric": "cast(conv(substr(md5({0}), 1, 15), 16, 10) as decimal(38, 0))",
    "aes_encrypt": "aes_encrypt({0}, {1}, 'ECB', 'PKCS')",
    "aes_decrypt": "try_aes_decrypt({0}, {1}, 'ECB', 'PKCS')",
})
MACROS["md5sum"] = lambda a: f"md5(concat_ws('', {', '.join(a)}))"
_ENCODINGS = {"hex": "hex({0})", "encode64": "base64({0})", "utf8": "decode({0}, 'UTF-8')"}
MACROS["from_binary"] = lambda a: _ENCODINGS[literal(a[1]).lower() if len(a) > 1 else "hex"].format(a[0])
MACROS["to_binary"] = lambda a: f"try_to_binary({a[0]}, '{ {'hex': 'hex', 'encode64': 'base64', 'utf8': 'utf-8'}[literal(a[1]).lower() if len(a) > 1 else 'hex'] }')"

# --- Iceberg partition transforms ------------------------------------------
text({
    "__iceberg_transform_identity": "({0})",
    "__iceberg_transform_void": "cast(NULL as string)",
    "__iceberg_transform_year": "(year({0}) - 1970)",
    "__iceberg_transform_month": "((year({0}) - 1970) * 12 + month({0}) - 1)",
    "__iceberg_transform_day": "unix_date(cast({0} as date))",
    "__iceberg_transform_hour": "cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {0}) / 3600) as int)",
    "__iceberg_transform_truncate": "({0} - pmod({0}, {1}))",
})

# --- aggregates ------------------------------------------------------------
text({
    "variance variance_pop": "var_pop({0})",
    "variance_samp": "var_samp({0})",
    "stddev std": "stddev_pop({0})",
    "ndv approx_count_distinct_hll_sketch": "approx_count_distinct({0})",
    "bool_or boolor_agg": "coalesce(bool_or({0}), false)",
    "booland_agg": "bool_and({0})",
    "any_value": "first({0}, true)",
    "max_by": "max_by({0}, CASE WHEN {0} IS NOT NULL THEN {1} END)",
    "min_by": "min_by({0}, CASE WHEN {0} IS NOT NULL THEN {1} END)",
    "max_by_v2": "max_by({0}, {1})",
    "min_by_v2": "min_by({0}, {1})",
    "array_agg": "transform(collect_list(struct({0} AS x)), e -> e.x)",
    "array_agg_distinct": "sort_array(collect_set({0}))",
    "array_unique_agg": "sort_array(array_distinct(flatten(collect_set({0}))))",
    "array_agg_ordered": "transform(sort_array(collect_list(struct({1} AS k, {0} AS x))), e -> e.x)",
    "map_agg": "map_from_entries(reverse(collect_list(CASE WHEN {0} IS NOT NULL THEN struct({0} AS key, {1} AS value) END)))",
    "min_n": "slice(sort_array(collect_list({0})), 1, {1})",
    "max_n": "sort_array(slice(sort_array(collect_list({0}), false), 1, {1}))",
    "bitmap_agg bitmap_union_int": "sort_array(collect_set(CASE WHEN {0} >= 0 THEN cast({0} as bigint) END))",
    "bitmap_union": "sort_array(array_distinct(flatten(collect_set({0}))))",
    "multi_distinct_count": "count(DISTINCT {0})",
    "multi_distinct_sum": "sum(DISTINCT {0})",
    "hll_raw hll_raw_agg ds_hll_count_distinct_union": "hll_sketch_agg({0})",
    "hll_union ds_hll_count_distinct_merge": "hll_union_agg({0})",
    "hll_union_agg": "hll_sketch_estimate(hll_union_agg({0}))",
    "ds_hll_count_distinct": "hll_sketch_estimate(hll_sketch_agg({0}))",
    "ds_theta_count_distinct": "theta_sketch_estimate(theta_sketch_agg({0}))",
    "percentile_union": "collect_list({0})",
    "percentile_approx_weighted": "percentile({0}, {2}, {1})",
    "percentile_disc percentile_disc_lc": "get(sort_array(filter(collect_list({0}), z -> z IS NOT NULL)), cast(ceil((count({0}) - 1) * {1}) as int))",
    "dict_merge": "sort_array(array_distinct(flatten(collect_set({0}))))",
    "sum_dec": "cast(sum({0}) as decimal(38, {1}))",
})
MACROS["multi_distinct_count"] = MACROS["count_distinct"] = lambda a: f"count(DISTINCT {', '.join(a)})"
# The members of all bitmaps; a number stands for the bitmap of itself.
MACROS["bitmap_union_count"] = lambda a: f"cast(size(array_remove(array_distinct(flatten(collect_set(split(translate(cast({a[0]} as string), '[] ', ''), ',')))), '')) as bigint)"


@macro("group_concat", "string_agg")
def _group_concat(a):
    from .dialect import GROUP_CONCAT_MAX_LEN

    return f"left(array_join(sort_array(collect_list(cast({a[0]} as string))), {a[1] if len(a) > 1 else repr(',')}), {GROUP_CONCAT_MAX_LEN.get()})"


MACROS["sum_map"] = lambda a: (
    f"aggregate(flatten(collect_list(map_entries({a[0]}))), cast(map() as map<string,double>), (acc, e) -> map_concat(acc, map(cast(e.key as string), coalesce(acc[cast(e.key as string)], 0D) + coalesce(cast(e.value as double), 0D))))"
)
_RETENTION = lambda a: f"aggregate(collect_list({a[0]}), cast(NULL as array<boolean>), (acc, c) -> CASE WHEN acc IS NULL THEN transform(c, x -> coalesce(x, false)) ELSE zip_with(acc, c, (p, r) -> p OR coalesce(r, false)) END, s -> transform(slice(s, 1, 31), (x, i) -> x AND s[0]))"


def _listed(arg: str) -> list[str] | None:
    """The items of an array written out."""
    from .dialect import arguments

    arg = arg[1:-1].strip() if arg.startswith("(") and arg.endswith(")") else arg
    m = re.match(r"array\s*\((.*)\)$", arg, re.IGNORECASE | re.DOTALL)
    return arguments(m[1]) if m else None


@macro("retention")
def _retention(a):
    """Conditions written out are combined before the shuffle; an array column is folded."""
    if (conditions := _listed(a[0])) is None:
        return _RETENTION(a)
    met = [f"coalesce(bool_or({c}), false)" for c in conditions[:31]]
    return f"array({', '.join([met[0], *(f'({met[0]} AND {c})' for c in met[1:])])})"


@macro("window_funnel")
def _window_funnel(a):
    """window_funnel(seconds, ts, mode, array of conditions): mode adds 1 (deduplicate), 2 (fixed) and 4 (strictly rising times)."""
    if (conditions := _listed(a[3])) is None:
        raise ValueError("window_funnel needs its conditions as array(...)")
    mode, n = int(a[2].strip("() ")), len(conditions)
    level = "CASE " + " ".join(f"WHEN {c} THEN {i + 1}" for i, c in reversed(list(enumerate(conditions)))) + " END"
    events = f"sort_array(collect_list(CASE WHEN {level} IS NOT NULL THEN struct(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({a[1]} as timestamp_ntz)) AS t, {level} AS l) END))"
    none = f"array_repeat(cast(NULL as bigint), {n})"
    start = f"named_struct('start', {none}, 'last', {none}, 'best', 0)"
    near = f"get(acc.start, e.l - 2) IS NOT NULL AND e.t - get(acc.start, e.l - 2) <= {a[0]} * 1000000L" + (" AND get(acc.last, e.l - 2) < e.t" if mode & 4 else "")
    begun = f"(CASE WHEN e.l = 1 THEN e.t WHEN {near} THEN get(acc.start, e.l - 2) END)"
    stops = [f"get(acc.start, e.l - 1) IS NOT NULL"] * bool(mode & 1) + ["(e.l > 1 AND get(acc.start, e.l - 2) IS NULL AND get(acc.start, 0) IS NOT NULL)"] * bool(mode & 2)
    stop = f"({' OR '.join(stops)})" if stops else "false"
    fresh = "transform(acc.start, (x, i) -> CASE WHEN i = 0 AND e.l = 1 THEN e.t END)"

    def moved(side: str, to: str) -> str:
        return f"CASE WHEN {stop} THEN {fresh} ELSE transform(acc.{side}, (x, i) -> CASE WHEN i = e.l - 1 AND {begun} IS NOT NULL THEN {to} ELSE x END) END"

    best = f"CASE WHEN {begun} IS NOT NULL AND NOT {stop} THEN greatest(acc.best, e.l) ELSE acc.best END"
    return f"aggregate({events}, {start}, (acc, e) -> named_struct('start', {moved('start', begun)}, 'last', {moved('last', 'e.t')}, 'best', {best}), acc -> acc.best)"


MACROS["first_value_rewrite"] = lambda a: f"first_value({', '.join(a)})"
MACROS["hll_empty"] = lambda a: "(SELECT hll_sketch_agg(x) FROM VALUES (1) AS none(x) WHERE false)"
