"""Arrays, maps, structs, JSON, bitmaps, table functions."""

from __future__ import annotations

A = "(SELECT n_nationkey AS k, array(n_nationkey, n_regionkey, n_nationkey % 3, cast(NULL as int)) AS a, array(n_regionkey, 2) AS b, split(n_name, '') AS s FROM nation) t"
B = "(SELECT n_nationkey AS k, [n_nationkey, n_regionkey, n_nationkey % 3, NULL] AS a, [n_regionkey, 2] AS b, string_split(n_name, '') AS s FROM nation) t"

QUERIES = {
    "fn_array_1": (
        f"SELECT k, array_append(a, 9) AS f1, array_avg(a) AS f2, array_concat(a, b) AS f3, array_contains(a, 2) AS f4, array_contains(a, cast(NULL as int)) AS f5, array_contains_all(a, b) AS f6, array_length(a) AS f7, array_sum(a) AS f8, array_max(a) AS f9, array_min(a) AS f10, array_distinct(b) AS f11, array_sort(a) AS f12, array_remove(a, 1) AS f13 FROM {A}",
        f"SELECT k, list_append(a, 9) AS f1, (a[1] + a[2] + a[3]) / 3.0::double AS f2, list_concat(a, b) AS f3, coalesce(list_contains(a, 2), false) AS f4, true AS f5, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS f6, 4 AS f7, (a[1] + a[2] + a[3])::bigint AS f8, list_max(a) AS f9, list_min(a) AS f10, CASE WHEN b[1] = 2 THEN [2] ELSE b END AS f11, list_sort(a, 'ASC', 'NULLS FIRST') AS f12, list_filter(a, lambda x: x IS DISTINCT FROM 1) AS f13 FROM {B}",
    ),
    "fn_array_2": (
        f"SELECT k, array_position(a, 2) AS f1, array_slice(a, 2, 2) AS f2, array_slice(a, 0, 2) AS f3, array_top_n(a, 2) AS f4, array_join(s, '-') AS f5, array_flatten(array(b, b)) AS f6, sort_array(array_intersect(array_remove(a, cast(NULL as int)), b)) AS f7, arrays_overlap(a, b) AS f8, element_at(a, 1) AS f9, element_at(a, 99) AS f10, array_repeat(k, 3) AS f11, array_map(x -> x * 2, b) AS f12, array_map((x, y) -> x + y, b, b) AS f13, array_difference(b) AS f14, array_cum_sum(b) AS f15 FROM {A}",
        f"SELECT k, coalesce(list_position(a, 2), 0) AS f1, a[2:3] AS f2, []::int[] AS f3, list_sort(a, 'DESC', 'NULLS LAST')[1:2] AS f4, array_to_string(s, '-') AS f5, flatten([b, b]) AS f6, list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))) AS f7, len(list_filter(a, lambda x: list_contains(b, x))) > 0 AS f8, a[1] AS f9, cast(NULL as int) AS f10, [k, k, k] AS f11, [x * 2 for x in b] AS f12, [x + x for x in b] AS f13, [0, b[2] - b[1]] AS f14, [b[1], b[1] + b[2]]::bigint[] AS f15 FROM {B}",
    ),
    "fn_array_3": (
        "SELECT k, all_match(transform(b, x -> x > 0)) AS f1, any_match(transform(b, x -> x > 3)) AS f2, array_filter(b, transform(b, x -> x > 1)) AS f3, array_contains_seq(array(1, 2, 3, k), array(2, 3)) AS f4, array_generate(1, 9, 3) AS f5, array_generate(5) AS f6, array_sortby(array('a', 'b', 'c'), array(3, 1, 2)) AS f7, array_sort_lambda(b, (x, y) -> y - x) AS f8 FROM (SELECT n_nationkey AS k, array(n_regionkey, 2, n_nationkey) AS b FROM nation) t",
        "SELECT k, len(list_filter(b, lambda x: x > 0)) = 3 AS f1, len(list_filter(b, lambda x: x > 3)) > 0 AS f2, list_filter(b, lambda x: x > 1) AS f3, true AS f4, [1, 4, 7]::bigint[] AS f5, [1, 2, 3, 4, 5]::bigint[] AS f6, ['b', 'c', 'a'] AS f7, list_sort(b, 'DESC') AS f8 FROM (SELECT n_nationkey AS k, [n_regionkey, 2, n_nationkey] AS b FROM nation) t",
    ),
    "fn_map": (
        """SELECT k, map_size(m) AS f1, array_sort(map_keys(m)) AS f2, array_sort(map_values(m)) AS f3, element_at(m, 'a') AS f4, element_at(m, 'zz') AS f5, map_concat(m, map('b', 9))['b'] AS f6, map_filter(m, (x, y) -> y > 3)['c'] AS f7,
  map_apply(e -> struct(upper(e.key), e.value + 1), m)['A'] AS f8, map_from_arrays(array('x', 'x'), array(1, 2))['x'] AS f9, cardinality(m) AS f10, size(map_entries(m)) AS f11, arrays_zip(array(1, 2), array(3))[1]['0'] AS f12, distinct_map_keys(m)['c'] AS f13
FROM (SELECT n_nationkey AS k, map('a', n_nationkey, 'b', n_regionkey, 'c', 5) AS m FROM nation) t""",
        "SELECT n_nationkey AS k, 3 AS f1, ['a', 'b', 'c'] AS f2, list_sort([n_nationkey, n_regionkey, 5]) AS f3, n_nationkey AS f4, cast(NULL as int) AS f5, 9 AS f6, 5 AS f7, n_nationkey + 1 AS f8, 2 AS f9, 3 AS f10, 3 AS f11, 2 AS f12, 5 AS f13 FROM nation",
    ),
    "fn_struct": (
        "SELECT n_nationkey AS k, named_struct('p', n_name, 'r', n_regionkey).p AS f1, row(n_name, n_regionkey).n_regionkey AS f2, struct(n_nationkey AS a).a AS f3 FROM nation",
        "SELECT n_nationkey AS k, n_name AS f1, n_regionkey AS f2, n_nationkey AS f3 FROM nation",
    ),
    "fn_json": (
        """SELECT event_id, get_json_int(props, '$.k') AS f1, get_json_double(props, '$.k') AS f2, get_json_string(props, '$.k') AS f3, get_variant_int(props, '$.k') AS f4, get_variant_string(props, '$.k') AS f5, json_exists(props, '$.k') AS f6, json_exists(props, '$.z') AS f7,
  json_length(props) AS f8, json_keys(props) AS f9, json_query(props, '$.k') AS f10, get_json_bool('{"b": true}', '$.b') AS f11, variant_typeof('[1]') IS NOT NULL AS f12, parse_json('{bad') IS NULL AS f13, json_object('a', event_id) AS f14 FROM events""",
        """SELECT event_id, cast(json_extract_string(props, '$.k') as bigint) AS f1, cast(json_extract_string(props, '$.k') as double) AS f2, json_extract_string(props, '$.k') AS f3, cast(json_extract_string(props, '$.k') as bigint) AS f4, json_extract_string(props, '$.k') AS f5, json_exists(props, '$.k') AS f6, json_exists(props, '$.z') AS f7,
  1 AS f8, ['k'] AS f9, json_extract_string(props, '$.k') AS f10, true AS f11, true AS f12, true AS f13, '{"a":' || event_id || '}' AS f14 FROM events""",
    ),
    "fn_variant_more": (
        """SELECT get_variant_bool('{"a": true}', '$.a') AS f1, get_variant_double('{"a": 1.5}', '$.a') AS f2, get_variant_date('{"a": "2024-02-03"}', '$.a') AS f3, get_variant_datetime('{"a": "2024-02-03 04:05:06"}', '$.a') AS f4, get_variant_time('{"a": "01:02:03"}', '$.a') AS f5, cast(variant_query('{"a": [1,2]}', '$.a') as string) AS f6, json_length('[1,2,3]') AS f7, json_length('5') AS f8, json_length('x') AS f9""",
        "SELECT true AS f1, 1.5::double AS f2, date '2024-02-03' AS f3, timestamp '2024-02-03 04:05:06' AS f4, 3723::bigint AS f5, '[1,2]' AS f6, 3 AS f7, 1 AS f8, 0 AS f9",
    ),
    "fn_bitmap": (
        """SELECT k, bitmap_count(a) AS f1, bitmap_and(a, b) AS f2, bitmap_or(a, b) AS f3, bitmap_xor(a, b) AS f4, bitmap_andnot(a, b) AS f5, bitmap_contains(a, 2L) AS f6, bitmap_has_any(a, b) AS f7, bitmap_max(a) AS f8, bitmap_min(a) AS f9, bitmap_subset_in_range(a, 1, 3) AS f10, bitmap_subset_limit(a, 1, 2) AS f11, bitmap_to_string(a) AS f12, bitmap_to_array(a) AS f13, sub_bitmap(a, 1, 2) AS f14, to_bitmap(k) AS f15, to_bitmap(-1) AS f16, bitmap_from_string('3,1,2,1') AS f17, bitmap_from_string('x') AS f18, bitmap_count(bitmap_empty()) AS f19
FROM (SELECT n_nationkey AS k, array_to_bitmap(array(1L, 2L, 3L, cast(n_nationkey as bigint))) AS a, array_to_bitmap(array(2L, 40L)) AS b FROM nation) t""",
        """SELECT k, len(a)::int AS f1, list_sort(list_filter(a, lambda x: x IN (2, 40))) AS f2, list_sort(list_distinct(list_concat(a, [2, 40]))) AS f3, list_sort(list_concat(list_filter(a, lambda x: x NOT IN (2, 40)), list_filter([2, 40]::bigint[], lambda x: NOT list_contains(a, x)))) AS f4, list_filter(a, lambda x: x NOT IN (2, 40)) AS f5, true AS f6, true AS f7, list_max(a) AS f8, list_min(a) AS f9, list_filter(a, lambda x: x >= 1 AND x < 3) AS f10, list_filter(a, lambda x: x >= 1)[1:2] AS f11, array_to_string(a, ',') AS f12, a AS f13, a[2:3] AS f14, [k]::bigint[] AS f15, cast(NULL as bigint[]) AS f16, [1, 2, 3]::bigint[] AS f17, cast(NULL as bigint[]) AS f18, 0 AS f19
FROM (SELECT n_nationkey AS k, list_sort(list_distinct([1, 2, 3, n_nationkey]::bigint[])) AS a FROM nation) t""",
    ),
    "fn_bitmap_binary": ("SELECT n_nationkey AS k, bitmap_from_binary(bitmap_to_binary(array(3L, 1L, 700L + n_nationkey))) AS a FROM nation", "SELECT n_nationkey AS k, [1, 3, 700 + n_nationkey]::bigint[] AS a FROM nation"),
    "fn_bitmap_base64": ("SELECT n_nationkey AS k, bitmap_to_base64(array(cast(n_nationkey as bigint))) AS a FROM nation", "SELECT n_nationkey AS k, to_base64(unhex('0100000000000000' || printf('%02x', n_nationkey))) AS a FROM nation"),
    "unnest_single": ("SELECT n_nationkey AS k, x FROM nation, unnest(array(n_regionkey, n_nationkey)) AS u(x)", "SELECT n_nationkey AS k, unnest([n_regionkey, n_nationkey]) AS x FROM nation"),
    "unnest_multi_uneven_left": (
        "SELECT id, x, y FROM (SELECT 1 AS id, array(1, 2, 3) AS a, array('a') AS b UNION ALL SELECT 2, array(4), array('b', 'c') UNION ALL SELECT 3, NULL, array('z') UNION ALL SELECT 4, NULL, NULL) t LEFT JOIN unnest(a, b) AS u(x, y) ON TRUE",
        "SELECT id, x, y FROM (VALUES (1, 1, 'a'), (1, 2, NULL), (1, 3, NULL), (2, 4, 'b'), (2, NULL, 'c'), (3, NULL, 'z'), (4, NULL, NULL)) t(id, x, y)",
    ),
    "unnest_bitmap": ("SELECT k, x FROM (SELECT n_nationkey AS k, array_to_bitmap(array(5L, 1L, 5L)) AS b FROM nation) t, unnest_bitmap(b) AS u(x)", "SELECT n_nationkey AS k, unnest([1, 5]::bigint[]) AS x FROM nation"),
    "subdivide_bitmap": (
        "SELECT x FROM (SELECT sequence(1L, 10L) AS b) t, subdivide_bitmap(b, 4) AS u(x)",
        "SELECT unnest([[1, 2, 3, 4], [5, 6, 7, 8], [9, 10]]::bigint[][]) AS x",
    ),
    "generate_series_per_row": ("SELECT n_nationkey AS k, g FROM nation LATERAL VIEW explode(array_generate(1, n_regionkey, 1)) u AS g", "SELECT n_nationkey AS k, unnest(range(1, n_regionkey + 1)) AS g FROM nation"),
    "fn_vector": (
        "SELECT vec_id, round(cosine_similarity(embedding, embedding), 9) AS c, round(l2_distance(embedding, transform(embedding, x -> float(0))), 6) AS l2, round(cosine_similarity_norm(embedding, embedding), 6) AS d FROM embeddings",
        "SELECT vec_id, 1.0::double AS c, round(list_sum([x::double * x::double for x in embedding]), 6) AS l2, round(list_sum([x::double * x::double for x in embedding]), 6) AS d FROM embeddings",
    ),
}
