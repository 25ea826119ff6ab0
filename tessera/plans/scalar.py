"""The dialect's scalar functions over table columns, against plain SQL."""

from __future__ import annotations

#: The published 32-bit Murmur3 of a number below 2^32 as 8 bytes; the constants are its fixed values.
_M = "& 4294967295"
MURMUR3 = f"""WITH a AS (SELECT event_id, (user_id::ubigint * 3432918353) {_M} AS k FROM events),
b AS (SELECT event_id, (((k << 15) | (k >> 17)) {_M}) * 461845907 {_M} AS h FROM a),
c AS (SELECT event_id, ((((h << 13) | (h >> 19)) {_M}) * 5 + 3864292196) {_M} AS h FROM b),
d AS (SELECT event_id, xor(((((h << 13) | (h >> 19)) {_M}) * 5 + 3864292196) {_M}, 8::ubigint) AS h FROM c),
e AS (SELECT event_id, (xor(h, h >> 16) * 2246822507) {_M} AS h FROM d),
f AS (SELECT event_id, (xor(h, h >> 13) * 3266489909) {_M} AS h FROM e)
SELECT event_id, ((xor(h, h >> 16) & 2147483647) % 16)::int AS b FROM f"""

QUERIES = {
    "fn_date_parts": (
        "SELECT event_id, year(ts) AS f1, month(ts) AS f2, day(ts) AS f3, quarter(ts) AS f4, hour(ts) AS f5, minute(ts) AS f6, second(ts) AS f7, dayofweek(ts) AS f8, dayofweek_iso(ts) AS f9, dayofyear(ts) AS f10, week(ts) AS f11, week_iso(ts) AS f12, weekday(ts) AS f13, yearweek(ts) AS f14, dayname(ts) AS f15, monthname(ts) AS f16, to_days(ts) AS f17 FROM events",
        "SELECT event_id, year(ts)::int AS f1, month(ts)::int AS f2, day(ts)::int AS f3, quarter(ts)::int AS f4, hour(ts)::int AS f5, minute(ts)::int AS f6, second(ts)::int AS f7, (dayofweek(ts) + 1)::int AS f8, isodow(ts)::int AS f9, dayofyear(ts)::int AS f10, weekofyear(ts)::int AS f11, weekofyear(ts)::int AS f12, (isodow(ts) - 1)::int AS f13, yearweek(ts)::int AS f14, dayname(ts) AS f15, monthname(ts) AS f16, (ts::date - date '1970-01-01' + 719528)::int AS f17 FROM events",
    ),
    "fn_date_add_sub": (
        "SELECT event_id, months_add(ts, 2) AS f1, months_sub(ts, 1) AS f2, years_add(ts, 1) AS f3, years_sub(ts, 1) AS f4, quarters_add(ts, 1) AS f5, quarters_sub(ts, 1) AS f6, days_add(ts, 3) AS f7, days_sub(ts, 3) AS f8, weeks_add(ts, 2) AS f9, weeks_sub(ts, 2) AS f10, hours_add(ts, 5) AS f11, hours_sub(ts, 5) AS f12, minutes_add(ts, 7) AS f13, minutes_sub(ts, 7) AS f14, seconds_add(ts, 9) AS f15, seconds_sub(ts, 9) AS f16, milliseconds_add(ts, 1500) AS f17, milliseconds_sub(ts, 1500) AS f18, microseconds_add(ts, 25) AS f19, microseconds_sub(ts, 25) AS f20, date_add(ts, 4) AS f21, date_sub(ts, 4) AS f22, add_months(ts, 1) AS f23, timestampadd(HOUR, 2, ts) AS f24 FROM events",
        "SELECT event_id, ts + interval 2 month AS f1, ts - interval 1 month AS f2, ts + interval 1 year AS f3, ts - interval 1 year AS f4, ts + interval 3 month AS f5, ts - interval 3 month AS f6, ts + interval 3 day AS f7, ts - interval 3 day AS f8, ts + interval 14 day AS f9, ts - interval 14 day AS f10, ts + interval 5 hour AS f11, ts - interval 5 hour AS f12, ts + interval 7 minute AS f13, ts - interval 7 minute AS f14, ts + interval 9 second AS f15, ts - interval 9 second AS f16, ts + interval 1500 millisecond AS f17, ts - interval 1500 millisecond AS f18, ts + interval 25 microsecond AS f19, ts - interval 25 microsecond AS f20, ts + interval 4 day AS f21, ts - interval 4 day AS f22, ts + interval 1 month AS f23, ts + interval 2 hour AS f24 FROM events",
    ),
    "fn_date_diff": (
        "SELECT event_id, datediff(ts, timestamp_ntz'2023-12-25 12:00:00') AS f1, days_diff(ts, t0) AS f2, hours_diff(ts, t0) AS f3, minutes_diff(ts, t0) AS f4, seconds_diff(ts, t0) AS f5, weeks_diff(ts, t0) AS f6, date_diff('hour', ts, t0) AS f7, timestampdiff(MINUTE, t0, ts) AS f8, months_diff(ts, t1) AS f9, years_diff(ts, t1) AS f10, quarters_diff(ts, t1) AS f11, milliseconds_diff(ts, t0) AS f12, timediff(ts, t0) AS f13 FROM (SELECT *, timestamp_ntz'2023-12-25 12:00:00' AS t0, timestamp_ntz'2020-05-01 00:00:00' AS t1 FROM events) t",
        """SELECT event_id, date_diff('day', date '2023-12-25', ts::date)::int AS f1, date_sub('day', t0, ts) AS f2, date_sub('hour', t0, ts) AS f3, date_sub('minute', t0, ts) AS f4, date_sub('second', t0, ts) AS f5, date_sub('week', t0, ts) AS f6, date_sub('hour', t0, ts) AS f7, date_sub('minute', t0, ts) AS f8, date_sub('month', t1, ts) AS f9, date_sub('year', t1, ts) AS f10, date_sub('quarter', t1, ts) AS f11, date_sub('millisecond', t0, ts) AS f12,
  CASE WHEN date_sub('second', t0, ts) < 360000 THEN lpad((date_sub('second', t0, ts) // 3600)::varchar, 2, '0') ELSE (date_sub('second', t0, ts) // 3600)::varchar END || ':' || lpad((date_sub('second', t0, ts) // 60 % 60)::varchar, 2, '0') || ':' || lpad((date_sub('second', t0, ts) % 60)::varchar, 2, '0') AS f13
FROM (SELECT *, timestamp '2023-12-25 12:00:00' AS t0, timestamp '2020-05-01 00:00:00' AS t1 FROM events) t""",
    ),
    "fn_date_trunc_slice": (
        "SELECT event_id, date_trunc('month', ts) AS f1, date_trunc('week', ts) AS f2, date_trunc('hour', ts) AS f3, date_floor('day', ts) AS f4, time_slice(ts, 6, 'hour') AS f5, time_slice(ts, 6, 'hour', 'ceil') AS f6, date_slice(ts, 7, 'day') AS f7, last_day(ts) AS f8, last_day(ts, 'quarter') AS f9, last_day(ts, 'year') AS f10, next_day(cast(ts as date), 'MON') AS f11, previous_day(ts, 'MON') AS f12, date(ts) AS f13, alignment_timestamp('minute', ts) AS f14 FROM events",
        """SELECT event_id, date_trunc('month', ts)::timestamp AS f1, date_trunc('week', ts)::timestamp AS f2, date_trunc('hour', ts) AS f3, date_trunc('day', ts)::timestamp AS f4, time_bucket(interval 6 hour, ts, timestamp '0001-01-01 00:00:00') AS f5, time_bucket(interval 6 hour, ts, timestamp '0001-01-01 00:00:00') + interval 6 hour AS f6, time_bucket(interval 7 day, ts, timestamp '0001-01-01 00:00:00')::date AS f7, last_day(ts) AS f8,
  (date_trunc('quarter', ts) + interval 3 month - interval 1 day)::date AS f9, (date_trunc('year', ts) + interval 1 year - interval 1 day)::date AS f10, (ts::date + (8 - isodow(ts))::int)::date AS f11, (ts::date - (CASE WHEN isodow(ts) = 1 THEN 7 ELSE isodow(ts) - 1 END)::int)::date AS f12, ts::date AS f13, date_trunc('minute', ts) AS f14 FROM events""",
    ),
    "fn_date_format": (
        "SELECT event_id, date_format(ts, '%Y-%m-%d %H:%i:%s') AS f1, strftime(ts, '%d/%m/%y') AS f2, jodatime_format(ts, 'yyyy-MM-dd') AS f3, to_iso8601(ts) AS f4, str_to_date(date_format(ts, '%Y-%m-%d'), '%Y-%m-%d') AS f5, str2date('bad', '%Y-%m-%d') AS f6, time_format(ts, '%H:%i') AS f7, to_tera_date('2024/02/03', 'yyyy/mm/dd') AS f8, to_date('2024-02-30') AS f9, str_to_jodatime('2024-01-02 03:04:05', 'yyyy-MM-dd HH:mm:ss') AS f10, to_tera_timestamp('2024/02/03 04:05:06', 'yyyy/mm/dd hh24:mi:ss') AS f11, date_to_iso8601(ts) AS f12 FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f1, strftime(ts, '%d/%m/%y') AS f2, strftime(ts, '%Y-%m-%d') AS f3, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS f4, date_trunc('day', ts)::timestamp AS f5, cast(NULL as timestamp) AS f6, strftime(ts, '%H:%M') AS f7, date '2024-02-03' AS f8, cast(NULL as date) AS f9, timestamp '2024-01-02 03:04:05' AS f10, timestamp '2024-02-03 04:05:06' AS f11, strftime(ts, '%Y-%m-%d') AS f12 FROM events",
    ),
    "fn_date_epoch": (
        "SELECT event_id, unix_timestamp(ts) AS f1, from_unixtime(1700000000 + event_id) AS f2, from_unixtime(1700000000, '%Y/%m/%d') AS f3, from_unixtime_ms(1700000000123) AS f4, hour_from_unixtime(1700000000 + event_id) AS f5, to_datetime(1700000000) AS f6, to_datetime_ntz(1700000000123, 3) AS f7, from_days(738000) AS f8, makedate(2024, 60) AS f9, makedate(2024, 0) AS f10, time_to_sec(ts) AS f11, sec_to_time(3661) AS f12, convert_tz(timestamp_ntz'2024-01-01 00:00:00', 'UTC', 'Asia/Shanghai') AS f13, timestamp('2024-01-01 01:02:03') AS f14, substitute(ts) AS f15 FROM events",
        "SELECT event_id, floor(epoch(ts))::bigint AS f1, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS f2, '2023/11/14' AS f3, '2023-11-14 22:13:20' AS f4, hour(make_timestamp((1700000000 + event_id) * 1000000))::int AS f5, timestamp '2023-11-14 22:13:20' AS f6, timestamp '2023-11-14 22:13:20.123' AS f7, date '1970-01-01' + (738000 - 719528) AS f8, date '2024-02-29' AS f9, cast(NULL as date) AS f10, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::int AS f11, '01:01:01' AS f12, timestamp '2024-01-01 08:00:00' AS f13, timestamp '2024-01-01 01:02:03' AS f14, ts AS f15 FROM events",
    ),
    "fn_now": ("SELECT now() >= timestamp_ntz'2024-01-01 00:00:00' AS a, curdate() > date'2024-01-01' AS b, length(curtime()) AS c, utc_timestamp() IS NOT NULL AS d, length(utc_time()) AS e", "SELECT true AS a, true AS b, 8 AS c, true AS d, 8 AS e"),
    "fn_math_1": (
        "SELECT p_partkey AS k, abs(x) AS f1, round(acos(x / 100), 9) AS f2, round(asin(x / 100), 9) AS f3, round(atan(x), 9) AS f4, round(atan2(x, 2.0), 9) AS f5, bin(p_partkey) AS f6, round(cbrt(x), 9) AS f7, ceil(x) AS f8, round(cos(x), 9) AS f9, round(cot(x), 6) AS f10, round(degress(x), 6) AS f11, dlog1(-1.0) AS f12, exp(10000.0) AS f13, floor(x) AS f14, fmod(x, 7) AS f15, mod(p_partkey, 0) AS f16, pmod(-p_partkey, 7) AS f17, ln(0.0) AS f18, round(log(2, 8), 9) AS f19, log(1, 8) AS f20, round(log10(x + 1), 9) AS f21, round(log2(x + 1), 9) AS f22 FROM (SELECT p_partkey, p_size * 1.5D AS x FROM part) t",
        "SELECT p_partkey AS k, x AS f1, round(acos(x / 100), 9) AS f2, round(asin(x / 100), 9) AS f3, round(atan(x), 9) AS f4, round(atan2(x, 2.0), 9) AS f5, bin(p_partkey) AS f6, round(cbrt(x), 9) AS f7, ceil(x)::bigint AS f8, round(cos(x), 9) AS f9, round(cot(x), 6) AS f10, round(degrees(x), 6) AS f11, NULL::double AS f12, NULL::double AS f13, floor(x)::bigint AS f14, fmod(x, 7) AS f15, NULL::bigint AS f16, ((-p_partkey % 7) + 7) % 7 AS f17, NULL::double AS f18, 3.0::double AS f19, NULL::double AS f20, round(log10(x + 1), 9) AS f21, round(log2(x + 1), 9) AS f22 FROM (SELECT p_partkey, p_size * 1.5::double AS x FROM part) t",
    ),
    "fn_math_2": (
        "SELECT p_partkey AS k, greatest(p_size, 10) AS f1, greatest(p_size, cast(NULL as int)) AS f2, least(p_size, 10, 20) AS f3, pow(2.0, 3) AS f4, power(10.0, 999) AS f5, round(radians(x), 9) AS f6, sign(-x) AS f7, round(sin(x), 9) AS f8, round(sqrt(x), 9) AS f9, sqrt(-1.0) AS f10, square(p_size) AS f11, round(tan(x), 6) AS f12, truncate(-3.789D, 1) AS f13, truncate(x, 0) AS f14, dround(2.5D) AS f15, dround(2.56D, 1) AS f16, conv(p_size, 10, 16) AS f17, positive(x) AS f18, round(pi(), 9) AS f19, round(e(), 9) AS f20, equiwidth_bucket(p_size, 1, 50, 5) AS f21, round(x, 1) AS f22, ceiling(x) AS f23 FROM (SELECT p_partkey, p_size, p_size * 1.25D AS x FROM part) t",
        "SELECT p_partkey AS k, greatest(p_size, 10) AS f1, NULL::int AS f2, least(p_size, 10, 20) AS f3, 8.0::double AS f4, NULL::double AS f5, round(radians(x), 9) AS f6, (-1.0)::double AS f7, round(sin(x), 9) AS f8, round(sqrt(x), 9) AS f9, NULL::double AS f10, p_size * p_size AS f11, round(tan(x), 6) AS f12, (-3.7)::double AS f13, floor(x)::double AS f14, 3.0::double AS f15, 2.5::double AS f16, upper(to_hex(p_size)) AS f17, x AS f18, round(pi(), 9) AS f19, round(exp(1), 9) AS f20, ((p_size - 1) // 9)::bigint AS f21, round(x, 1) AS f22, ceil(x)::bigint AS f23 FROM (SELECT p_partkey, p_size, p_size * 1.25::double AS x FROM part) t",
    ),
    "fn_rand": ("SELECT n_nationkey AS k, rand() BETWEEN 0 AND 1 AS a, random() < 1 AS b, uuid() IS NOT NULL AS c FROM nation", "SELECT n_nationkey AS k, true AS a, true AS b, true AS c FROM nation"),
    "fn_string_1": (
        "SELECT p_partkey AS k, append_trailing_char_if_absent(p_name, 'g') AS f1, append_trailing_char_if_absent(p_name, 'xy') AS f2, ascii(p_name) AS f3, char_length(p_name) AS f4, concat(p_name, '-', p_size) AS f5, concat_ws('|', p_name, NULL, p_brand) AS f6, crc32('abc') = 891568578 AS f7, ends_with(p_name, 'g') AS f8, starts_with(p_name, 's') AS f9, field(p_brand, 'Brand#2', 'Brand#3') AS f10, find_in_set('b', 'a,b,c') AS f11, format_bytes(p_partkey * 1000 + 1) AS f12, hex(p_name) AS f13, unhex(hex(p_name)) AS f14, initcap('hello-wORLD it') AS f15, instr(p_name, 'i') AS f16, left(p_name, 3) AS f17, right(p_name, 3) AS f18, length('é') AS f19, locate('i', p_name, 2) AS f20, upper(p_name) AS f21, lower(p_brand) AS f22 FROM part",
        """SELECT p_partkey AS k, CASE WHEN p_name LIKE '%g' THEN p_name ELSE p_name || 'g' END AS f1, NULL::varchar AS f2, ascii(p_name)::int AS f3, length(p_name)::int AS f4, p_name || '-' || p_size AS f5, concat_ws('|', p_name, p_brand) AS f6, true AS f7, p_name LIKE '%g' AS f8, p_name LIKE 's%' AS f9, CASE p_brand WHEN 'Brand#2' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 0 END::bigint AS f10, 2 AS f11,
  CASE WHEN p_partkey * 1000 + 1 < 1024 THEN (p_partkey * 1000 + 1)::varchar || ' B' WHEN p_partkey * 1000 + 1 < 1048576 THEN format('{:.2f} KB', (p_partkey * 1000 + 1) / 1024) ELSE format('{:.2f} MB', (p_partkey * 1000 + 1) / 1048576) END AS f12, hex(p_name) AS f13, p_name AS f14, 'Hello-World It' AS f15, instr(p_name, 'i')::int AS f16, left(p_name, 3) AS f17, right(p_name, 3) AS f18, 2 AS f19, CASE WHEN instr(substr(p_name, 2), 'i') > 0 THEN instr(substr(p_name, 2), 'i') + 1 ELSE 0 END::int AS f20, upper(p_name) AS f21, lower(p_brand) AS f22 FROM part""",
    ),
    "fn_string_2": (
        "SELECT p_partkey AS k, lpad(p_name, 14, '*') AS f1, lpad(p_name, -1, '*') AS f2, rpad(p_name, 14, '*') AS f3, ltrim('  a ') AS f4, rtrim(' a  ') AS f5, trim('  a  ') AS f6, money_format(p_retailprice) AS f7, null_or_empty(p_name) AS f8, null_or_empty('') AS f9, parse_url('http://a.b/c?q=1', 'HOST') AS f10, regexp_count(p_name, '[aeiou]') AS f11, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS f12, regexp_extract_all('a1b22', '([0-9]+)', 1) AS f13, regexp_position(p_name, 'zzz') AS f14, regexp_replace(p_name, '[aeiou]', '_') AS f15, repeat('ab', 3) AS f16, replace(p_name, 'r', 'R') AS f17, reverse(p_name) AS f18, space(3) AS f19, split_part(p_name, ' ', 2) AS f20, split_part(p_name, ' ', 0) AS f21, split('a.b.c', '.') AS f22, strpos(p_name, 'n') AS f23, strpos('abcabc', 'b', 2) AS f24, strpos('abcabc', 'b', -1) AS f25 FROM part",
        "SELECT p_partkey AS k, lpad(p_name, 14, '*') AS f1, NULL::varchar AS f2, rpad(p_name, 14, '*') AS f3, 'a ' AS f4, ' a' AS f5, 'a' AS f6, format('{:,.2f}', p_retailprice) AS f7, false AS f8, true AS f9, 'a.b' AS f10, len(regexp_extract_all(p_name, '[aeiou]'))::int AS f11, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS f12, ['1', '22'] AS f13, -1 AS f14, regexp_replace(p_name, '[aeiou]', '_', 'g') AS f15, 'ababab' AS f16, replace(p_name, 'r', 'R') AS f17, reverse(p_name) AS f18, '   ' AS f19, split_part(p_name, ' ', 2) AS f20, '' AS f21, ['a', 'b', 'c'] AS f22, instr(p_name, 'n')::int AS f23, 5 AS f24, 5 AS f25 FROM part",
    ),
    "fn_string_3": (
        "SELECT p_partkey AS k, substring(p_name, 2, 3) AS f1, substring(p_name, 0, 3) AS f2, substr(p_name, -3) AS f3, substring(p_name, -99, 2) AS f4, substring_index(p_name, ' ', 1) AS f5, translate(p_name, 'abc', 'xyz') AS f6, url_encode('a b&c') AS f7, url_decode('a%20b') AS f8, url_extract_host('https://x.y.z/p') AS f9, str_to_map('a:1,b:2', ',', ':')['b'] AS f10, bar(p_size, 0, 50, 10) AS f11, if(p_size > 25, 'big', 'small') AS f12, ifnull(NULL, p_name) AS f13, nullif(p_size, 7) AS f14, coalesce(NULL, NULL, p_brand) AS f15, p_name LIKE '%ring' AS f16 FROM part",
        "SELECT p_partkey AS k, substr(p_name, 2, 3) AS f1, '' AS f2, right(p_name, 3) AS f3, '' AS f4, split_part(p_name, ' ', 1) AS f5, translate(p_name, 'abc', 'xyz') AS f6, 'a+b%26c' AS f7, 'a b' AS f8, 'x.y.z' AS f9, '2' AS f10, repeat('▓', (p_size * 10 // 50)::int) AS f11, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS f12, p_name AS f13, nullif(p_size, 7) AS f14, p_brand AS f15, p_name LIKE '%ring' AS f16 FROM part",
    ),
    "fn_bit": (
        "SELECT p_partkey AS k, bit_shift_left(p_partkey, 3) AS f1, bit_shift_right(p_partkey, 1) AS f2, bit_shift_right_logical(p_partkey, 2) AS f3, bitand(p_partkey, 12) AS f4, bitor(p_partkey, 3) AS f5, bitxor(p_partkey, 5) AS f6, bitnot(p_partkey) AS f7 FROM part",
        "SELECT p_partkey AS k, p_partkey * 8 AS f1, p_partkey >> 1 AS f2, p_partkey >> 2 AS f3, p_partkey & 12 AS f4, p_partkey | 3 AS f5, xor(p_partkey, 5) AS f6, ~p_partkey AS f7 FROM part",
    ),
    "fn_encoding": (
        "SELECT p_partkey AS k, md5(p_name) AS f1, md5sum(p_name, p_brand) AS f2, sha2(p_name, 256) AS f3, sha2(p_name, 100) AS f4, to_base64(p_name) AS f5, from_base64(to_base64(p_name)) AS f6, from_binary(to_binary(p_name, 'utf8'), 'utf8') AS f7, from_binary(cast(p_name as binary)) AS f8, cast(aes_decrypt(aes_encrypt(p_name, '0123456789abcdef'), '0123456789abcdef') as string) AS f9, md5sum_numeric(p_name) IS NOT NULL AS f10 FROM part",
        "SELECT p_partkey AS k, md5(p_name) AS f1, md5(p_name || p_brand) AS f2, sha256(p_name) AS f3, NULL::varchar AS f4, to_base64(p_name::blob) AS f5, p_name AS f6, p_name AS f7, hex(p_name) AS f8, p_name AS f9, true AS f10 FROM part",
    ),
    "fn_time_slice_seconds": (
        "SELECT event_id, time_slice(ts, INTERVAL 5 second) AS f1, time_slice(ts, INTERVAL 7 minute, ceil) AS f2, time_slice(ts, 90, 'second') AS f3, date_slice(ts, INTERVAL 1 month) AS f4, date_format(ts, '%Y-%c-%e %w') AS f5, cast(20240102 AS date) AS f6 FROM events",
        """SELECT event_id, epoch_ms(1000::bigint * (floor((floor(epoch(ts))::bigint + 62135596800) / 5) * 5 - 62135596800)::bigint) AS f1, epoch_ms(1000::bigint * ((floor((floor(epoch(ts))::bigint + 62135596800) / 420) + 1) * 420 - 62135596800)::bigint) AS f2,
  epoch_ms(1000::bigint * (floor((floor(epoch(ts))::bigint + 62135596800) / 90) * 90 - 62135596800)::bigint) AS f3, date_trunc('month', ts)::date AS f4, strftime(ts, '%Y-%m-%d ') || '%w' AS f5, date '2024-01-02' AS f6 FROM events""",
    ),
    "fn_array_map_three": (
        "SELECT n_nationkey AS k, array_map((x, y, z) -> x + y * z, array(n_nationkey, 2), array(3, n_regionkey), array(5, 6)) AS a FROM nation",
        "SELECT n_nationkey AS k, [n_nationkey + 15, 2 + n_regionkey * 6] AS a FROM nation",
    ),
    "fn_sort_key": (
        "SELECT p_partkey AS k, row_number() OVER (ORDER BY encode_sort_key(p_size), encode_sort_key(p_retailprice, p_partkey)) AS r FROM part",
        "SELECT p_partkey AS k, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey)::int AS r FROM part",
    ),
    "fn_hash_udf": ("SELECT p_partkey AS k, murmur_hash3_32(p_name) AS f1, xx_hash3_128(p_name) AS f2, sm3(p_name) AS f3, encode_fingerprint_sha256(p_name, p_brand) AS f4, encode_sort_key(p_name) AS f5, encode_row_id(p_partkey) AS f6 FROM part", None),
    "fn_ngram_search": (
        "SELECT p_partkey AS k, cast(ngram_search(p_name, 'ring', 3) as double) AS f1, cast(ngram_search_case_insensitive(p_name, 'RING', 3) as double) AS f2 FROM part",
        "SELECT p_partkey AS k, (contains(p_name, 'rin')::int + contains(p_name, 'ing')::int) / 2.0::double AS f1, (contains(lower(p_name), 'rin')::int + contains(lower(p_name), 'ing')::int) / 2.0::double AS f2 FROM part",
    ),
    "fn_sort_key": (
        "SELECT p_partkey AS k, hex(encode_sort_key(p_name)) AS f1, encode_fingerprint_sha256(p_name, p_brand) AS f2, hex(encode_sort_key(p_partkey, p_name)) AS f3 FROM part",
        "SELECT p_partkey AS k, '01' || hex(p_name) || '0001' AS f1, sha256(unhex('01' || hex(p_name) || '000101' || hex(p_brand) || '0001')) AS f2, upper('0180' || printf('%030x', p_partkey) || '01' || hex(p_name) || '0001') AS f3 FROM part",
    ),
    "fn_iceberg_transforms": (
        "SELECT event_id, __iceberg_transform_identity(user_id) AS f1, __iceberg_transform_void(user_id) AS f2, __iceberg_transform_year(ts) AS f3, __iceberg_transform_month(ts) AS f4, __iceberg_transform_day(ts) AS f5, __iceberg_transform_hour(ts) AS f6, __iceberg_transform_truncate(user_id, 10) AS f7 FROM events",
        "SELECT event_id, user_id AS f1, NULL::varchar AS f2, (year(ts) - 1970)::int AS f3, ((year(ts) - 1970) * 12 + month(ts) - 1)::int AS f4, (ts::date - date '1970-01-01')::int AS f5, floor(epoch(ts) / 3600)::int AS f6, user_id - user_id % 10 AS f7 FROM events",
    ),
    "fn_iceberg_bucket": ("SELECT event_id, __iceberg_transform_bucket(user_id, 16) AS b FROM events", MURMUR3),
    "fn_hll_hash": ("SELECT n_nationkey AS k, hll_hash(n_name) IS NOT NULL AS a, percentile_approx_raw(array(1.0D, 5.0D, 9.0D), 0.5D) AS b, size(percentile_empty()) AS c, percentile_hash(n_nationkey)[0] AS d, sleep(0) AS e FROM nation", "SELECT n_nationkey AS k, true AS a, 5.0::double AS b, 0 AS c, n_nationkey::double AS d, true AS e FROM nation"),
    "fn_decimal": (
        "SELECT l_orderkey, l_linenumber, cast(cast(l_quantity as decimal(10,2)) * cast(l_discount as decimal(10,2)) as decimal(20,4)) AS m, cast(cast(l_extendedprice as decimal(12,2)) + cast(l_tax as decimal(8,4)) as decimal(20,4)) AS a FROM lineitem",
        "SELECT l_orderkey, l_linenumber, cast(cast(l_quantity as decimal(10,2)) * cast(l_discount as decimal(10,2)) as decimal(20,4)) AS m, cast(cast(l_extendedprice as decimal(12,2)) + cast(l_tax as decimal(8,4)) as decimal(20,4)) AS a FROM lineitem",
    ),
}
