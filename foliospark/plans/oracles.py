"""SQL for the queries: the same projection and operators, written for DuckDB."""

from __future__ import annotations

#: White space in RE2 syntax, and the visible length of a text.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def vis(t: str) -> str:
    return f"regexp_replace({t}, '{WS}', '', 'g')"


def vlen(t: str) -> str:
    return f"CAST(length({vis(t)}) AS BIGINT)"


def trim_(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def hits(t: str, p: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '{p}')) AS BIGINT)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"


INK = f"(kind = 'text' AND {vlen('text')} > 0 AND greatest(0, x1 - x0) * greatest(0, y1 - y0) > 0)"
BUCKET = "CASE WHEN size > 0 THEN floor(size / 0.5 + 0.5) * 0.5 ELSE 0.0 END"
HEAD_TEXT = r"(regexp_matches({t}, '^(?:[IVXLCDM]+\.\s+|[一二三四五六七八九十百]+[、.．]\s*)') OR regexp_matches({t}, '^(?:[A-Z]\.\s+|[（(](?:[一二三四五六七八九十百]+|[0-9]+)[）)]\s*)'))"
HEAD_NUM = r"(regexp_matches({t}, '^[0-9]{{1,2}}(?:\.[0-9]{{1,2}})*\s+[^0-9\s]') AND {n} <= 48)"
LEVEL = (
    r"CAST(CASE WHEN regexp_matches({t}, '^(?:[IVXLCDM]+\.\s+|[一二三四五六七八九十百]+[、.．]\s*)') THEN 1 "
    r"WHEN regexp_matches({t}, '^(?:[A-Z]\.\s+|[（(](?:[一二三四五六七八九十百]+|[0-9]+)[）)]\s*)') THEN 2 "
    r"WHEN regexp_extract({t}, '^([0-9]{{1,2}}(?:\.[0-9]{{1,2}})*)\s+[^0-9\s]', 1) != '' THEN len(string_split(regexp_extract({t}, '^([0-9]{{1,2}}(?:\.[0-9]{{1,2}})*)\s+[^0-9\s]', 1), '.')) "
    r"ELSE coalesce({ranked}, 1) END AS INTEGER)"
)

OBJ = """
WITH para AS (SELECT doc_id, source, i - 1 AS para, p[i] AS txt FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(i)),
wl AS (SELECT doc_id, source, para, l, array_to_string(w[12 * l + 1 : 12 * l + 12], ' ') AS txt FROM (SELECT *, string_split(txt, ' ') AS w FROM para), unnest(range(0, CAST(ceil(len(w) / 12.0) AS BIGINT))) AS r(l)),
line AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, l) - 1 AS k FROM wl),
placed AS (
  SELECT doc_id, source, para, l, k, CAST(k // 43 + 1 AS INTEGER) AS page, k % 43 AS rw, doc_id % 7 = 0 AS two,
         CASE WHEN doc_id % 13 = 0 AND k % 2 = 0 THEN txt || ' ��' ELSE txt END AS text,
         CASE WHEN doc_id % 11 = 0 THEN 'CourierNew' ELSE 'Times' END AS font, CAST(CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 16 ELSE 10 END AS DOUBLE) AS size FROM line),
body AS (
  SELECT doc_id, source, para, l, k, page, rw, text, font, size, CAST(CASE WHEN two THEN 72 + 248 * (rw % 2) ELSE 72 END AS DOUBLE) AS x0,
         CAST(60 + 16 * CASE WHEN two THEN rw - rw % 2 ELSE rw END AS DOUBLE) AS y0,
         CAST(CASE WHEN two THEN 72 + 248 * (rw % 2) ELSE 72 END + least(CASE WHEN two THEN 200 ELSE 451 END, 5 * length(text)) AS DOUBLE) AS x1,
         CAST(70 + 16 * CASE WHEN two THEN rw - rw % 2 ELSE rw END AS DOUBLE) AS y1 FROM placed),
pg AS (SELECT DISTINCT doc_id, source, page, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, 0 AS rotation FROM body),
one AS (SELECT doc_id, 1 AS page FROM documents),
parts AS (
  SELECT doc_id, page, 'text' AS kind, 11 + 2 * rw AS ord, x0, y0, x1, y1, text, font, size, 1.0 AS ta, 0.0 AS tb FROM body
  UNION ALL SELECT doc_id, page, 'text', 10 + 2 * rw, x0 - 12, y0, x0 - 7, y1, '•', 'Times', 10, 1, 0 FROM body WHERE para % 5 = 4 AND l = 0
  UNION ALL SELECT doc_id, page, 'text', 0, 72, 20, 72 + 5 * length(source), 30, source, 'Times', 10, 1, 0 FROM pg
  UNION ALL SELECT doc_id, page, 'text', 1000, 292, 806, 304, 816, CAST(page AS VARCHAR), 'Times', 10, 1, 0 FROM pg
  UNION ALL SELECT doc_id, page, 'text', 900, 150, 560, 190, 570, 'label', 'Times', 10, 1, 0 FROM one WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, page, 'text', 901, 100, 645, 190, 655, 'Figure 1: overview', 'Times', 10, 1, 0 FROM one WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, page, 'text', 950, 20, 300, 30, 400, 'side', 'Times', 10, 0, 1 FROM one WHERE doc_id % 17 = 0
  UNION ALL SELECT doc_id, page, 'image', 0, 100, 500, 300, 640, '', 'Times', 10, 1, 0 FROM one WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, page, 'annotation', 0, 72, 60, 120, 70, 'https://example.org', 'Times', 10, 1, 0 FROM one WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, page, 'graphic', 0, 72, 40, 523, 40.5, '', 'Times', 10, 1, 0 FROM one WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, page, 'graphic', 1, 40, 60, 40.4, 760, '', 'Times', 10, 1, 0 FROM one WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, page, 'graphic', 2, 400, 700, 440, 720, '', 'Times', 10, 1, 0 FROM one WHERE doc_id % 5 = 0),
nth AS (SELECT * REPLACE (CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(size AS DOUBLE) AS size, CAST(page AS INTEGER) AS page),
               CAST(row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY ord, x0, y0) - 1 AS INTEGER) AS seq FROM parts),
obj AS (SELECT *, format('p{}_{}{:04d}', page, CASE kind WHEN 'annotation' THEN 'a' ELSE kind[1] END, seq) AS obj_id FROM nth)
"""

FURN = f""", seen AS (
  SELECT doc_id, page, obj_id, seq, (x0 + x1) / 2 / width AS px, (y0 + y1) / 2 / height AS py,
         CASE WHEN {hits(vis('text'), r'[\p{N}]')} / {vlen('text')} >= 0.6 THEN 'page_number' WHEN (y0 + y1) / 2 <= height * 0.14 THEN 'header' ELSE 'footer' END AS type,
         lower(regexp_replace({trim_('text')}, '{WS}+', ' ', 'g')) AS folded
  FROM obj JOIN pg USING (doc_id, page)
  WHERE kind = 'text' AND {vlen('text')} BETWEEN 1 AND 180 AND ((y0 + y1) / 2 <= height * 0.14 OR (y0 + y1) / 2 >= height * (1 - 0.14))),
keyed AS (SELECT *, CASE WHEN type = 'page_number' THEN regexp_replace(folded, '[\\p{{N}}]+', '#', 'g') ELSE folded END AS key,
                 CAST(floor(px / 0.015 + 0.5) AS INTEGER) AS xbin, CAST(floor(py / 0.015 + 0.5) AS INTEGER) AS ybin FROM seen),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY doc_id, type, xbin, ybin, key, page ORDER BY seq) = 1),
member AS (SELECT firsts.*, n_pages, count(*) OVER g AS n, avg(px) OVER g AS mx, avg(py) OVER g AS my
           FROM firsts JOIN (SELECT doc_id, count(*) AS n_pages FROM pg GROUP BY doc_id) USING (doc_id)
           WINDOW g AS (PARTITION BY doc_id, type, xbin, ybin, key) QUALIFY n >= 2 AND n >= ceil(n_pages * 0.3))
"""
BODY = ", flow AS (SELECT obj.* FROM obj ANTI JOIN member USING (doc_id, obj_id))"

PROFILE = f""", sizes AS (SELECT doc_id, bucket, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, {BUCKET} AS bucket, {vlen('text')} AS n FROM obj WHERE kind = 'text') WHERE n > 0 AND bucket > 0 GROUP BY ALL),
totals AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id) AS total, first_value(bucket) OVER w AS mode_size, first_value(chars) OVER w AS mode_chars FROM sizes WINDOW w AS (PARTITION BY doc_id ORDER BY chars DESC, bucket)),
bodies AS (SELECT *, CASE WHEN mode_chars / total >= 0.2 THEN mode_size END AS body_size FROM totals),
heads AS (SELECT *, coalesce(bucket >= body_size * 1.08 AND chars >= 8 AND chars / total <= 0.35, false) AS head FROM bodies),
profile AS (SELECT doc_id, bucket, chars, body_size, CASE WHEN head AND lv <= 3 THEN CAST(lv AS INTEGER) END AS level
            FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY bucket DESC) AS lv FROM heads))
"""

LAYER = rf""", lang AS (SELECT doc_id, CAST(sum({vlen('text')}) AS BIGINT) AS chars, CAST(sum({hits('text', r'\p{Han}')}) AS BIGINT) AS han FROM obj WHERE kind = 'text' GROUP BY doc_id),
language AS (SELECT *, CASE WHEN chars = 0 THEN 'unknown' WHEN han / chars >= 0.1 THEN 'zh' ELSE 'en' END AS language FROM lang),
counted AS (
  SELECT doc_id, page, CAST(sum({vlen('text')}) AS BIGINT) AS chars, CAST(sum({hits('text', r'\x{FFFD}')}) AS BIGINT) AS replacement,
         CAST(sum(length(array_to_string(regexp_extract_all(text, '\(cid:[0-9]+\)|/[0-9]+'), ''))) AS BIGINT) AS cid,
         CAST(sum({hits('text', r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}]')}) AS BIGINT) AS suspicious,
         CAST(sum(len(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS BIGINT) AS words,
         CAST(sum(len(list_filter(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda w: regexp_matches(lower(w), '[bcdfghjklmnpqrstvwxz]{{5,}}')))) AS BIGINT) AS odd_words
  FROM obj WHERE kind = 'text' GROUP BY doc_id, page),
layer AS (
  SELECT *, CAST(CASE WHEN chars = 0 THEN 0 ELSE (replacement >= 2 AND replacement / chars >= 0.01)::INT + (cid >= 2 AND cid / chars >= 0.02)::INT + (suspicious >= 2 AND suspicious / chars >= 0.01)::INT + gibberish END AS INTEGER) AS statistical
  FROM (SELECT counted.*, coalesce((language = 'en' AND counted.chars >= 40 AND words >= 8 AND odd_words / words >= 0.22)::INT, 0) AS gibberish FROM counted JOIN language USING (doc_id))),
verdicts AS (SELECT *, CASE WHEN chars = 0 THEN 'absent' WHEN statistical >= 2 THEN 'broken' WHEN statistical = 1 THEN 'partial' ELSE 'trusted' END AS verdict FROM layer)
"""


def area(name: str, rows: str) -> str:
    """CTEs that end in ``name`` (doc_id, page, area) of the boxes ``rows``."""
    return f""", {name}_b AS (SELECT doc_id, page, x0, y0, x1, y1 FROM ({rows}) WHERE x1 > x0 AND y1 > y0),
{name}_e AS (SELECT doc_id, page, x, lead(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS x2 FROM (SELECT DISTINCT doc_id, page, unnest([x0, x1]) AS x FROM {name}_b)),
{name}_m AS (SELECT b.doc_id, b.page, x, x2, y0, y1, max(y1) OVER (PARTITION BY b.doc_id, b.page, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y
             FROM {name}_b b JOIN {name}_e e ON b.doc_id = e.doc_id AND b.page = e.page AND b.x0 < e.x2 AND b.x1 > e.x),
{name} AS (SELECT doc_id, page, sum((x2 - x) * greatest(0, y1 - greatest(y0, coalesce(y, y0)))) AS area FROM {name}_m GROUP BY ALL)
"""


GUTTER = f""", ink AS (SELECT doc_id, page, x0, x1, y1 - y0 AS h, {vlen('text')} AS n FROM obj WHERE {INK}),
bins AS (SELECT doc_id, page, bin, sum(h) AS occ FROM ink, unnest(range(CAST(least(119, greatest(0, floor(x0 / (595.0 / 120)))) AS BIGINT), CAST(least(119, greatest(0, floor(x1 / (595.0 / 120)))) AS BIGINT) + 1)) AS r(bin) GROUP BY ALL),
tops AS (SELECT doc_id, page, max(occ) AS top FROM bins GROUP BY ALL),
grid AS (SELECT tops.*, factor, bin FROM tops, (SELECT unnest([0.8::DOUBLE, 1.0::DOUBLE, 1.2::DOUBLE]) AS factor), unnest(range(36, 84)) AS r(bin)),
low AS (SELECT grid.*, bin - row_number() OVER (PARTITION BY doc_id, page, factor ORDER BY bin) AS island FROM grid LEFT JOIN bins USING (doc_id, page, bin) WHERE coalesce(occ, 0) <= top * 0.12 * factor),
runs AS (SELECT doc_id, page, factor, min(bin) * (595.0::DOUBLE / 120) AS g0, (max(bin) + 1) * (595.0::DOUBLE / 120) AS g1 FROM low GROUP BY doc_id, page, factor, island),
judged AS (SELECT runs.*, count(*) AS texts, count(*) FILTER (x0 < g1 AND x1 > g0) AS crossing, sum(n) AS n, coalesce(sum(n) FILTER ((x0 + x1) / 2 < g0), 0) AS l, coalesce(sum(n) FILTER ((x0 + x1) / 2 > g1), 0) AS r
           FROM runs JOIN ink USING (doc_id, page) GROUP BY ALL),
gut AS (SELECT *, 1 - crossing / texts AS purity FROM judged WHERE g1 - g0 >= 8 AND g1 - g0 <= 595 * 0.16 AND 1 - crossing / texts >= 0.92 AND l / n >= 0.2 AND r / n >= 0.2
        QUALIFY row_number() OVER (PARTITION BY doc_id, page, factor ORDER BY g0) < 4),
per AS (SELECT pg.doc_id, pg.page, f.factor, coalesce(k, 1) AS k, coalesce(w, 0) AS w, coalesce(pu, 1) AS pu
        FROM pg, (SELECT unnest([0.8::DOUBLE, 1.0::DOUBLE, 1.2::DOUBLE]) AS factor) f LEFT JOIN (SELECT doc_id, page, factor, count(*) + 1 AS k, sum(g1 - g0) AS w, avg(purity) AS pu FROM gut GROUP BY ALL) g ON g.doc_id = pg.doc_id AND g.page = pg.page AND g.factor = f.factor),
base AS (SELECT doc_id, page, max(k) FILTER (factor = 1) AS columns, max(w) FILTER (factor = 1) AS w, max(pu) FILTER (factor = 1) AS pu, list(k) AS ks FROM per GROUP BY ALL),
cols AS (SELECT doc_id, page, columns, {r6('w')} AS gutter_width, {r6('pu')} AS gutter_purity, {r6('len(list_filter(ks, lambda k: k = columns)) / len(ks)')} AS column_stability FROM base)
"""

SIGNALS = (
    area("textarea", f"SELECT doc_id, page, least(width, greatest(0, x0)) AS x0, least(height, greatest(0, y0)) AS y0, least(width, greatest(0, x1)) AS x1, least(height, greatest(0, y1)) AS y1 FROM obj JOIN pg USING (doc_id, page) WHERE {INK}")
    + area("imagearea", "SELECT doc_id, page, x0, y0, x1, y1 FROM obj WHERE kind = 'image'")
    + rf""", counts AS (
  SELECT doc_id, page, count(*) FILTER ({INK}) AS texts, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'graphic') AS graphics,
         sum({hits('text', r'[\p{Sm}]')}) FILTER ({INK}) AS math, count(*) FILTER ({INK} AND regexp_matches(font, '(?i)(?:math|symbol|cmmi|cmsy|rtx)')) AS mf,
         sum({hits('text', r'[-+]?[0-9]+(?:[.,][0-9]+)?')}) FILTER ({INK}) AS numbers, sum(length(text)) FILTER ({INK}) AS chars,
         count(*) FILTER ({INK} AND least(abs(degrees(atan2(tb, ta))), abs(180 - abs(degrees(atan2(tb, ta))))) >= 5) AS turned FROM obj GROUP BY ALL),
signals AS (
  SELECT doc_id, page, rotation, texts, images > 0 AS has_image, {r6('coalesce(imagearea.area, 0) / (width * height)')} AS image_area_ratio, {r6('coalesce(textarea.area, 0) / (width * height)')} AS text_density,
         {r6('graphics / (width * height / 5184)')} AS vector_density, texts > 0 AND images > 0 AND coalesce(imagearea.area, 0) / (width * height) >= 0.08 AS has_mixed, math >= 1 OR mf > 0 AS has_formula,
         graphics >= 10 AND chars / texts <= 18 AND numbers >= 4 AS has_chart, turned > 0 AS has_rotated
  FROM pg JOIN counts USING (doc_id, page) LEFT JOIN textarea USING (doc_id, page) LEFT JOIN imagearea USING (doc_id, page))
"""
)

T = trim_("text")
CLASS = rf""", ranked AS (SELECT doc_id, bucket, level AS ranked FROM profile WHERE level IS NOT NULL),
typed AS (
  SELECT doc_id, page, seq, obj_id, text, t, font, size, x0, y0, x1, y1, ranked,
    CASE WHEN regexp_matches(t, '^(?:[-*•▪◦]|[0-9]+[.)、．])$') THEN 'list_marker' WHEN {HEAD_TEXT.format(t='t')} OR {HEAD_NUM.format(t='t', n=vlen('t'))} THEN 'heading'
         WHEN regexp_matches(t, '(?i)^(?:fig(?:ure)?\.?\s*[0-9]+\s*[:.]?)') THEN 'figure' WHEN regexp_matches(font, '(?i)(?:mono|courier|typewriter|t1x(?:b)?tt)') THEN 'code'
         WHEN ranked IS NOT NULL AND {vlen('t')} <= 80 AND NOT regexp_matches(t, '[.。．!！?？;；:：,，、)）\]】》」』]$') THEN 'heading'
         WHEN contains(t, '=') AND coalesce(list_max(list_transform(regexp_extract_all(t, '\p{{Latin}}+'), lambda r: length(r))), 0) <= 3 AND abs((x0 + x1) / 2 - width / 2) <= 0.06 * width THEN 'formula' ELSE 'unknown' END AS type
  FROM (SELECT flow.*, {T} AS t, {BUCKET} AS bucket, width FROM flow JOIN pg USING (doc_id, page) WHERE kind = 'text' AND {vlen('text')} > 0) LEFT JOIN ranked USING (doc_id, bucket)),
classed AS (SELECT *, CASE WHEN type = 'heading' THEN {LEVEL.format(t='t', ranked='ranked')} END AS level FROM typed),
elem AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, seq) AS INTEGER) AS ord FROM classed),
tree AS (
  SELECT doc_id, obj_id, ord, type, level, CASE WHEN type = 'heading' THEN CASE level WHEN 1 THEN NULL WHEN 2 THEN p1 WHEN 3 THEN p2 WHEN 4 THEN p3 WHEN 5 THEN p4 ELSE p9 END ELSE p9 END AS parent_id
  FROM (SELECT *, {', '.join(f"last_value(CASE WHEN type = 'heading' AND level <= {99 if k == 9 else k} THEN obj_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{k}" for k in (1, 2, 3, 4, 9))} FROM elem))
"""

COVER = f""", named AS (SELECT doc_id, page, obj_id FROM obj WHERE seq % 7 != 3 UNION ALL SELECT doc_id, page, obj_id FROM obj WHERE seq % 5 = 2 AND seq % 7 != 3),
cover AS (SELECT doc_id, page, {r6('avg(CASE WHEN n = 1 THEN 0.0 ELSE 1.0 END)')} AS residual FROM (SELECT * FROM obj WHERE kind = 'text' AND {vlen('text')} > 0) t LEFT JOIN (SELECT doc_id, page, obj_id, count(*) AS n FROM named GROUP BY ALL) USING (doc_id, page, obj_id) GROUP BY ALL)
"""
JUDGE = f""", doubts AS (SELECT doc_id, page, verdict, {r6('least(1, greatest(0, (0.28 * residual + 0.22 * (1 - column_stability) + 0.19 * 0) / (0.28 + 0.22 + 0.19)))')} AS uncertainty FROM verdicts JOIN cover USING (doc_id, page) JOIN cols USING (doc_id, page)),
judgement AS (SELECT doc_id, page, uncertainty, CASE WHEN verdict != 'trusted' OR uncertainty > 0.3 THEN 'degraded' ELSE 'ok' END AS status,
  CASE WHEN verdict IN ('broken', 'absent') THEN 'full_parser' WHEN verdict = 'partial' OR uncertainty > 0.3 THEN 'layout_oracle' ELSE '' END AS escalation,
  array_to_string(list_filter([CASE verdict WHEN 'absent' THEN 'NO_TEXT_LAYER' WHEN 'broken' THEN 'BROKEN_TEXT_LAYER' WHEN 'partial' THEN 'TEXT_LAYER_SUSPECT' END, CASE WHEN uncertainty > 0.3 THEN 'LAYOUT_UNCERTAIN' END], lambda w: w IS NOT NULL), ',') AS warnings FROM doubts)
"""

TABLES = """
WITH item AS (SELECT l_orderkey AS order_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS r,
                     [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR), l_returnflag] AS v FROM lineitem),
txt AS (SELECT order_id, r, v FROM item UNION ALL SELECT DISTINCT order_id, 0, ['part', 'supp', 'qty', 'price', 'flag'] FROM item),
cell AS (SELECT order_id, r, CAST(i - 1 AS INTEGER) AS c, v[i] AS text FROM txt, unnest(range(1, 6)) AS u(i)),
num AS (SELECT order_id, max(r) AS n FROM cell GROUP BY order_id),
hr AS (SELECT order_id, CAST(100 + 20 * i AS DOUBLE) AS y, n, i FROM num, unnest(range(0, n + 2)) AS u(i)),
vr AS (SELECT order_id, CAST(100 + 80 * i AS DOUBLE) AS x, n, i FROM num, unnest(range(0, 6)) AS u(i))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "typeset_runs": OBJ + "SELECT doc_id, page, CAST(k AS INTEGER) AS k, text, x0, y0, x1, y1, size, font FROM body",
        "source_index": OBJ + "SELECT doc_id, page, obj_id, kind, x0, y0, x1, y1, sha256(text) AS text_sha256 FROM obj",
        "visible_length": OBJ + f"SELECT doc_id, obj_id, {vlen('text')} AS n, length(text) AS length FROM obj WHERE kind = 'text'",
        "visible_filter": OBJ + f"SELECT doc_id, page, count(*) FILTER ({INK}) AS with_ink, count(*) FILTER (kind = 'text' AND {vlen('text')} > 0) AS visible, count(*) FILTER (kind = 'text' AND text = '') AS ignorable FROM obj GROUP BY ALL",
        "bbox_quantize": OBJ + "SELECT doc_id, obj_id, floor(x0 / 7 * 100 + 0.5) / 100 AS x0, floor(y0 / 7 * 100 + 0.5) / 100 AS y0, greatest(floor(x1 / 7 * 100 + 0.5) / 100, floor(x0 / 7 * 100 + 0.5) / 100 + 0.01) AS x1, greatest(floor(y1 / 7 * 100 + 0.5) / 100, floor(y0 / 7 * 100 + 0.5) / 100 + 0.01) AS y1 FROM obj",
        "font_bucket": OBJ + "SELECT floor(size * 1.03::DOUBLE / 0.5 + 0.5) * 0.5 AS bucket, count(*) AS n FROM obj WHERE kind = 'text' GROUP BY 1",
        "lane_assignment": OBJ + f"SELECT doc_id, page, obj_id, CAST(CASE WHEN x1 - x0 >= 0.5 * width AND x0 < width / 2 AND x1 > width / 2 THEN -1 ELSE least(1, greatest(0, floor((x0 + x1) / 2 / width * 2))) END AS INTEGER) AS lane FROM obj JOIN pg USING (doc_id, page) WHERE {INK}",
        "list_markers": OBJ + f"SELECT doc_id, page, obj_id, text FROM obj WHERE kind = 'text' AND regexp_matches({T}, '^(?:[-*•▪◦]|[0-9]+[.)、．])$')",
        "heading_markers": OBJ + f"SELECT doc_id, obj_id, {LEVEL.format(t='t', ranked='NULL')} AS level FROM (SELECT doc_id, obj_id, {T} AS t FROM obj WHERE kind = 'text') WHERE {HEAD_TEXT.format(t='t')} OR {HEAD_NUM.format(t='t', n=vlen('t'))}",
        "local_page_numbers": OBJ + f"SELECT doc_id, page, obj_id, {T} AS text, 0.86::DOUBLE AS confidence FROM obj JOIN pg USING (doc_id, page) WHERE kind = 'text' AND regexp_matches({T}, '^[0-9]{{1,4}}$') AND y0 >= height * (1 - 0.08) AND ((x0 + x1) / 2 / width <= 0.18 OR (x0 + x1) / 2 / width >= 0.82 OR abs((x0 + x1) / 2 / width - 0.5) <= 0.09)",
        "thin_rules": OBJ + "SELECT doc_id, page, obj_id, CASE WHEN w >= h THEN 'h' ELSE 'v' END AS orientation, CASE WHEN w >= h THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS axis, CASE WHEN w >= h THEN x0 ELSE y0 END AS lo, CASE WHEN w >= h THEN x1 ELSE y1 END AS hi FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM obj WHERE kind = 'graphic') WHERE greatest(w, h) >= 4 AND least(w, h) <= 2 AND (least(w, h) <= 0 OR greatest(w, h) / least(w, h) >= 8)",
        "text_profile": OBJ + PROFILE + "SELECT * REPLACE (coalesce(level, 0) AS level) FROM profile",
        "dominant_style": OBJ + "SELECT doc_id, page, font, size, chars FROM (SELECT doc_id, page, font, size, CAST(sum(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) AS BIGINT) AS chars, min(seq) AS f FROM obj WHERE kind = 'text' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY chars DESC, f) = 1",
        "language_profile": OBJ + LAYER + "SELECT * FROM language",
        "codepoint_rates": OBJ + LAYER + "SELECT doc_id, page, chars, replacement, cid, suspicious FROM layer",
        "language_evidence": OBJ + LAYER + "SELECT doc_id, page, words, odd_words FROM layer WHERE gibberish = 1",
        "text_layer_verdict": OBJ + LAYER + "SELECT doc_id, page, statistical, verdict FROM verdicts",
        "page_signals": OBJ + SIGNALS + "SELECT * FROM signals",
        "union_area": OBJ + area("covered", f"SELECT * FROM obj WHERE {INK}") + f"SELECT doc_id, page, {r6('area')} AS area FROM covered",
        "overlaid_text": OBJ + f"SELECT t.doc_id, t.page, t.obj_id, {r6('(least(t.x1, i.x1) - greatest(t.x0, i.x0)) * (least(t.y1, i.y1) - greatest(t.y0, i.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0))')} AS share FROM (SELECT * FROM obj WHERE {INK}) t JOIN obj i ON i.kind = 'image' AND i.doc_id = t.doc_id AND i.page = t.page AND t.x0 < i.x1 AND t.x1 > i.x0 AND t.y0 < i.y1 AND t.y1 > i.y0 WHERE (least(t.x1, i.x1) - greatest(t.x0, i.x0)) * (least(t.y1, i.y1) - greatest(t.y0, i.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.2",
        "figure_owned_text": OBJ + f"SELECT t.doc_id, t.page, t.obj_id, i.obj_id AS image_id FROM (SELECT * FROM obj WHERE {INK}) t JOIN obj i ON i.kind = 'image' AND i.doc_id = t.doc_id AND i.page = t.page WHERE greatest(0, least(t.x1, i.x1) - greatest(t.x0, i.x0)) * greatest(0, least(t.y1, i.y1) - greatest(t.y0, i.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.9 QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.page, t.obj_id ORDER BY i.y0, i.x0, i.obj_id) = 1",
        "column_histogram": OBJ + GUTTER + f"SELECT doc_id, page, {r6('g0')} AS x0, {r6('g1')} AS x1, {r6('purity')} AS purity FROM gut WHERE factor = 1",
        "column_stability": OBJ + GUTTER + "SELECT * FROM cols",
        "row_cells": OBJ + f"SELECT doc_id, page, y1, CAST(cell AS BIGINT) AS cell, min(x0) AS x0, max(x1) AS x1, count(*) AS runs FROM (SELECT *, sum(CASE WHEN x0 - edge <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, y1 ORDER BY x0, seq) AS cell FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, y1 ORDER BY x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM obj WHERE {INK})) GROUP BY ALL",
        "page_layout_type": OBJ + SIGNALS + GUTTER + LAYER + f""", over AS (SELECT DISTINCT t.doc_id, t.page FROM (SELECT * FROM obj WHERE {INK}) t JOIN obj i ON i.kind = 'image' AND i.doc_id = t.doc_id AND i.page = t.page AND t.x0 < i.x1 AND t.x1 > i.x0 AND t.y0 < i.y1 AND t.y1 > i.y0
  WHERE (least(t.x1, i.x1) - greatest(t.x0, i.x0)) * (least(t.y1, i.y1) - greatest(t.y0, i.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.2),
typ AS (SELECT doc_id, page, CASE WHEN image_area_ratio >= 0.5 AND text_density <= 0.02 AND verdict = 'trusted' THEN 'partial' ELSE verdict END AS verdict, over.doc_id IS NOT NULL AS overlaid, columns, column_stability,
  CASE WHEN image_area_ratio >= 0.8 AND text_density < 0.08 THEN 'scanned' WHEN columns = 2 THEN 'two_column' WHEN columns > 2 THEN 'mixed' ELSE 'single_column' END AS layout_type
  FROM signals JOIN cols USING (doc_id, page) JOIN verdicts USING (doc_id, page) LEFT JOIN over USING (doc_id, page)),
unc AS (SELECT doc_id, page, verdict, layout_type, {r6("CASE WHEN verdict IN ('broken', 'absent') THEN 1.0 ELSE greatest(CASE WHEN verdict = 'partial' THEN 0.5::DOUBLE ELSE 0 END, CASE WHEN columns > 1 THEN 1 - column_stability ELSE 0 END, CASE WHEN overlaid THEN 0.3::DOUBLE ELSE 0 END) END")} AS uncertainty FROM typ)
SELECT *, CASE WHEN uncertainty >= 0.7 THEN 'high' WHEN uncertainty >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM unc""",
        "furniture_clusters": OBJ + FURN + f"SELECT doc_id, type, xbin, ybin, key, n AS pages, min(page) AS first_page, max(page) AS last_page, {r6('n / n_pages * 0.55 + least(1, greatest(0, 1 - avg(sqrt((px - mx) * (px - mx) + (py - my) * (py - my))) / 0.015)) * 0.45')} AS confidence FROM member GROUP BY doc_id, type, xbin, ybin, key, n, n_pages",
        "furniture_modes": OBJ + FURN + "SELECT doc_id, page, obj_id, type, mode, mode = 'off' AS is_body, mode != 'extract' AS in_elements FROM member, (SELECT unnest(['off', 'drop', 'extract']) AS mode)",
        "continuations": OBJ + FURN + BODY + rf""", runs AS (SELECT flow.*, height FROM flow JOIN pg USING (doc_id, page) WHERE kind = 'text' AND {vlen('text')} >= 2),
tail AS (SELECT doc_id, page, string_agg(text, '' ORDER BY seq) AS t, string_agg(obj_id, ',' ORDER BY seq) AS ti FROM runs WHERE y1 >= height * (1 - 0.12) GROUP BY ALL),
head AS (SELECT doc_id, page - 1 AS page, string_agg(text, '' ORDER BY seq) AS h, string_agg(obj_id, ',' ORDER BY seq) AS hi FROM runs WHERE y0 <= height * 0.12 GROUP BY ALL),
both_ AS (SELECT *, regexp_matches(t, '^\s*(?:[-*•▪◦]|\(?[0-9]+[.)、]|[（(]?[一二三四五六七八九十]+[）)、.])') OR regexp_matches(h, '^\s*(?:[-*•▪◦]|\(?[0-9]+[.)、]|[（(]?[一二三四五六七八九十]+[）)、.])') AS listed FROM tail JOIN head USING (doc_id, page))
SELECT doc_id, page AS from_page, CAST(page + 1 AS INTEGER) AS to_page, CASE WHEN listed THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN listed THEN 0.78::DOUBLE ELSE 0.72::DOUBLE END AS confidence, ti || ',' || hi AS objects FROM both_
WHERE listed OR NOT regexp_matches(regexp_replace(t, '{WS}+$', ''), '[。！？.!?;；:：]$')""",
        "block_classify": OBJ + FURN + BODY + PROFILE + CLASS + "SELECT doc_id, page, obj_id, type, coalesce(level, 0) AS level FROM classed",
        "heading_parents": OBJ + FURN + BODY + PROFILE + CLASS + "SELECT * REPLACE (coalesce(level, 0) AS level) FROM tree",
        "heading_jumps": OBJ + FURN + BODY + PROFILE + CLASS + "SELECT doc_id, obj_id, previous, level FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS previous FROM elem WHERE type = 'heading') WHERE level > previous + 1",
        "parent_cycles": OBJ + FURN + BODY + PROFILE + CLASS + "SELECT count(*) AS violations FROM tree t LEFT JOIN tree p ON p.doc_id = t.doc_id AND p.obj_id = t.parent_id WHERE t.parent_id IS NOT NULL AND (p.ord IS NULL OR p.ord >= t.ord)",
        "markdown_document": OBJ + FURN + BODY + PROFILE + CLASS + "SELECT doc_id, string_agg(m, chr(10) || chr(10) ORDER BY ord) || chr(10) AS markdown FROM (SELECT doc_id, ord, CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || t WHEN 'code' THEN '```' || chr(10) || t || chr(10) || '```' WHEN 'formula' THEN '$$' || t || '$$' WHEN 'list_marker' THEN '-' ELSE t END AS m FROM elem) WHERE m != '' GROUP BY doc_id",
        "caption_targets": OBJ + "SELECT c.doc_id, c.page, c.obj_id, f.obj_id AS figure_id, greatest(0, c.y0 - f.y1) AS gap FROM obj c JOIN obj f ON f.kind = 'image' AND f.doc_id = c.doc_id AND f.page = c.page WHERE c.kind = 'text' AND c.text LIKE 'Figure%' AND f.y0 <= c.y0 AND greatest(0, least(c.x1, f.x1) - greatest(c.x0, f.x0)) / (c.x1 - c.x0) >= 0.5 AND greatest(0, c.y0 - f.y1) <= 2.5 * c.size QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.page, c.obj_id ORDER BY greatest(0, c.y0 - f.y1), f.obj_id) = 1",
        "list_containers": """
WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem),
item AS (SELECT l_orderkey AS doc_id, 'i' || nth AS item_id, nth AS ord, CASE WHEN l_returnflag = 'R' THEN NULL ELSE nth END AS n, CASE WHEN l_linestatus = 'F' THEN 10 ELSE 3 END AS size FROM lines),
flag AS (SELECT *, CASE WHEN lag(ord) OVER w = ord - 1 AND (lag(n) OVER w IS NULL) = (n IS NULL) AND (n IS NULL OR n = lag(n) OVER w + 1) AND 10 <= 2.5 * greatest(size, lag(size) OVER w) THEN 0 ELSE 1 END AS new FROM item WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
grp AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM flag)
SELECT doc_id, item_id, first_value(item_id) OVER (PARTITION BY doc_id, g ORDER BY ord) || '_list' AS container_id, CAST(row_number() OVER (PARTITION BY doc_id, g ORDER BY ord) AS INTEGER) AS nth FROM grp""",
        "stable_ids": OBJ + """, pair AS (SELECT doc_id, page, list_sort(list(obj_id)) AS ids, min(x0) AS x0, min(y0) AS y0, min(x1) AS x1, min(y1) AS y1 FROM obj WHERE kind = 'text' GROUP BY doc_id, page, seq // 2),
draft AS (SELECT * FROM pair UNION ALL SELECT doc_id, page, ids, x0 + 1, y0, x1, y1 FROM pair WHERE ids[1] LIKE '%t0000'),
based AS (SELECT *, 'e_p' || page || '_' || substr(sha1(list_min(ids) || '~' || list_max(ids)), 1, 8) AS base FROM draft)
SELECT doc_id, page, CASE WHEN count(*) OVER (PARTITION BY doc_id, base) > 1 THEN base || '_' || row_number() OVER (PARTITION BY doc_id, base ORDER BY x0, y0, x1, y1) ELSE base END AS element_id, array_to_string(ids, ',') AS ids FROM based""",
        "ledger": OBJ + "SELECT doc_id, page, count(*) AS objects, count(*) AS covered, 1.0::DOUBLE AS coverage, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind IN ('graphic', 'rule')) AS path, count(*) FILTER (kind = 'image') AS image, count(*) FILTER (kind = 'annotation') AS annotation FROM obj GROUP BY ALL",
        "dispositions": OBJ + FURN + "SELECT o.doc_id, CASE WHEN kind = 'annotation' THEN 'recorded' WHEN kind = 'text' AND text = '' THEN 'ignored_empty' WHEN m.obj_id IS NOT NULL THEN 'suppressed' ELSE 'represented' END AS disposition, count(*) AS n FROM obj o LEFT JOIN (SELECT doc_id, obj_id FROM member) m USING (doc_id, obj_id) GROUP BY ALL",
        "lost_kinds": OBJ + """, census AS (SELECT doc_id, page, count(*) FILTER (kind = 'text') AS ct, count(*) FILTER (kind IN ('graphic', 'rule')) AS cp, count(*) FILTER (kind = 'image') AS ci, count(*) FILTER (kind = 'annotation') AS ca,
  count(*) FILTER (kind = 'graphic' AND NOT seq % 3 = 1) AS ep FROM obj GROUP BY ALL)
SELECT doc_id, page, 'path' AS lost FROM census WHERE ep < cp UNION ALL SELECT doc_id, page, 'image' FROM census WHERE ci > 0""",
        "object_coverage": OBJ + COVER + "SELECT * FROM cover",
        "kendall_distance": OBJ + f", p AS (SELECT doc_id, page, seq AS a, x0 * 10000000 + y0 * 10000 + seq AS b FROM obj WHERE kind = 'text' AND page = 1) SELECT p.doc_id, p.page, {r6('avg(CASE WHEN p.b > q.b THEN 1.0 ELSE 0.0 END)')} AS distance FROM p JOIN p q ON p.doc_id = q.doc_id AND p.page = q.page AND p.a < q.a GROUP BY ALL",
        "kendall_distance_pages": OBJ + f", p AS (SELECT doc_id, page, seq AS a, x0 * 10000000 + y0 * 10000 + seq AS b FROM obj WHERE kind = 'text') SELECT p.doc_id, p.page, {r6('avg(CASE WHEN p.b > q.b THEN 1.0 ELSE 0.0 END)')} AS distance FROM p JOIN p q ON p.doc_id = q.doc_id AND p.page = q.page AND p.a < q.a GROUP BY ALL",
        "page_verdict": OBJ + LAYER + GUTTER + COVER + JUDGE + "SELECT * FROM judgement",
        "page_status": OBJ + LAYER + GUTTER + COVER + JUDGE + "SELECT j.doc_id, j.page, CASE WHEN v.verdict = 'broken' THEN 'failed' WHEN status = 'degraded' THEN 'degraded' ELSE 'ok' END AS status FROM judgement j JOIN verdicts v USING (doc_id, page)",
        "anchor_audit": OBJ + "SELECT a.* FROM (SELECT doc_id, CAST(page + CASE WHEN seq % 11 = 5 THEN 1 ELSE 0 END AS INTEGER) AS page, obj_id FROM obj) a ANTI JOIN obj USING (doc_id, page, obj_id)",
        "grid_intersections": TABLES + "SELECT order_id, x, y FROM hr JOIN vr USING (order_id) WHERE x BETWEEN 100 - 0.75 AND 500 + 0.75 AND y BETWEEN 100 - 0.75 AND 100 + 20 * (hr.n + 1) + 0.75",
        "grid_closure": TABLES + "SELECT order_id, CAST(n + 1 AS BIGINT) AS rows, CAST(5 AS BIGINT) AS cols, 1.0::DOUBLE AS closure FROM num",
        "rule_components": TABLES + "SELECT order_id, 'h' AS orientation, y AS axis, 'h000100.00' AS component FROM hr UNION ALL SELECT order_id, 'v', x, 'h000100.00' FROM vr",
        "cell_text": TABLES + "SELECT order_id, r, c, text FROM cell",
        "table_header_rows": TABLES + r""", f AS (SELECT order_id, r, c, regexp_matches(text, '^[-+（(]?[0-9,.]+%?[）)]?$')::INT AS num FROM cell),
row_ AS (SELECT order_id, r, 1 - avg(num) AS words, avg(num) FILTER (c > 0) AS numbers FROM f GROUP BY ALL),
hl AS (SELECT order_id, r, words >= 0.6 AND coalesce(lead(numbers) OVER (PARTITION BY order_id ORDER BY r), 0) >= 0.6 AS header_like FROM row_)
SELECT *, sum((NOT header_like)::INT) OVER (PARTITION BY order_id ORDER BY r) = 0 AS leading FROM hl""",
        "table_tiling": TABLES + "SELECT order_id, r, CAST(2 AS INTEGER) AS c, CAST(2 AS BIGINT) AS n FROM cell WHERE c = 4 AND text = 'R'",
        "markdown_table": TABLES + ", line AS (SELECT order_id, r, '| ' || string_agg(text, ' | ' ORDER BY c) || ' |' AS l FROM cell GROUP BY ALL) SELECT order_id, string_agg(CASE WHEN r = 0 THEN l || chr(10) || '| --- | --- | --- | --- | --- |' ELSE l END, chr(10) ORDER BY r) AS markdown FROM line GROUP BY order_id",
        "cross_page_tables": """
WITH part AS (SELECT o_custkey AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page, CASE WHEN o_orderkey % 5 = 0 THEN 400 ELSE 60 END AS y0, CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE 800 END AS y1,
  CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 5 END AS cols, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS header, o_orderkey % 2 AS hr, 3 + o_orderkey % 4 AS rows_, 100 + o_orderkey % 3 AS edge FROM orders),
l AS (SELECT *, coalesce(hr > 0 AND lag(hr) OVER w = hr AND lag(header) OVER w = header, false) AS same, lag(y1) OVER w >= 842 * 0.8 AND y0 <= 842 * 0.2 AND lag(cols) OVER w = cols AND abs(lag(edge) OVER w - edge) <= 2 AS fits FROM part WINDOW w AS (PARTITION BY key ORDER BY page)),
k AS (SELECT *, coalesce(fits AND (hr = 0 OR same), false) AS linked FROM l), d AS (SELECT *, CASE WHEN linked AND same THEN hr ELSE 0 END AS dropped FROM k),
c AS (SELECT *, sum((NOT linked)::INT) OVER (PARTITION BY key ORDER BY page) AS chain FROM d)
SELECT key, page, CAST(chain AS BIGINT) AS chain, CAST(dropped AS INTEGER) AS dropped, CAST(coalesce(sum(rows_ - dropped) OVER (PARTITION BY key, chain ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - dropped AS BIGINT) AS row_offset FROM c""",
        "table_roles": TABLES + r""", f AS (SELECT order_id, r, c, regexp_matches(text, '^[-+（(]?[0-9,.]+%?[）)]?$')::INT AS num FROM cell),
row_ AS (SELECT order_id, r, 1 - avg(num) AS words, avg(num) FILTER (c > 0) AS numbers FROM f GROUP BY ALL),
hl AS (SELECT order_id, r, words >= 0.6 AND coalesce(lead(numbers) OVER (PARTITION BY order_id ORDER BY r), 0) >= 0.6 AS header_like FROM row_),
ld AS (SELECT *, sum((NOT header_like)::INT) OVER (PARTITION BY order_id ORDER BY r) = 0 AS leads FROM hl),
ro AS (SELECT order_id, r, c, CASE WHEN leads THEN 'column_header' WHEN header_like THEN 'section_header' WHEN c = 0 THEN 'row_header' ELSE 'data' END AS role FROM cell JOIN ld USING (order_id, r))
SELECT *, role != 'data' AS is_header FROM ro""",
        "borderless_vs_ruled": """
WITH box AS (SELECT o_custkey AS key, o_orderkey AS box, o_orderstatus AS st, CAST(o_orderkey * 37 % 700 AS DOUBLE) AS y0, CAST(o_orderkey * 13 % 300 AS DOUBLE) AS x0 FROM orders)
SELECT key, box, x0, y0 FROM box b WHERE st = 'O' AND NOT EXISTS (SELECT 1 FROM box t WHERE t.st = 'F' AND t.key = b.key AND abs(t.x0 - b.x0) < 150 AND abs(t.y0 - b.y0) < 25)""",
        "region_ids": OBJ + "SELECT doc_id, page, CAST(seq // 4 AS INTEGER) AS region, CASE WHEN count(*) = 1 THEN 'region_' || max_by(obj_id, seq) ELSE 'region_' || max_by(obj_id, seq) || '_' || min_by(obj_id, seq) END AS region_id, count(*) AS n FROM obj WHERE kind = 'text' GROUP BY ALL",
        "furniture_regions": OBJ + FURN + f"""SELECT doc_id, page, 'region_' || obj_id AS region_id, type, 'l2-cross-page-furniture-v1' AS engine FROM member
UNION ALL SELECT doc_id, page, 'region_' || obj_id, 'page_number', 'local-page-number-v1' FROM obj JOIN pg USING (doc_id, page) ANTI JOIN member USING (doc_id, obj_id)
WHERE kind = 'text' AND regexp_matches({T}, '^[0-9]{{1,4}}$') AND y0 >= height * (1 - 0.08) AND ((x0 + x1) / 2 / width <= 0.18 OR (x0 + x1) / 2 / width >= 0.82 OR abs((x0 + x1) / 2 / width - 0.5) <= 0.09)""",
        "accepted_pages": OBJ.replace("WITH para", "WITH RECURSIVE para", 1) + """, sz AS (SELECT doc_id, page, count(*) AS n FROM obj GROUP BY ALL),
fold AS (SELECT doc_id, page, n <= 60 AS accepted, CASE WHEN n <= 60 THEN n ELSE 0 END AS total FROM sz WHERE page = 1
  UNION ALL SELECT sz.doc_id, sz.page, total + n <= 60, total + CASE WHEN total + n <= 60 THEN n ELSE 0 END FROM fold JOIN sz ON sz.doc_id = fold.doc_id AND sz.page = fold.page + 1)
SELECT doc_id, page, accepted FROM fold""",
        "missing_fields": OBJ + "SELECT doc_id, 'font' AS field, count(*) AS n FROM obj WHERE kind != 'text' GROUP BY ALL UNION ALL SELECT doc_id, 'text', count(*) FROM obj WHERE text = '' GROUP BY ALL",
        "box_audit": OBJ + "SELECT doc_id, 'boxes' AS \"check\", obj_id AS subject, CAST(page AS VARCHAR) AS detail FROM obj JOIN pg USING (doc_id, page) WHERE x0 < -1 OR y0 < -1 OR x1 + CASE WHEN seq % 9 = 4 THEN 100 ELSE 0 END > width + 1 OR y1 > height + 1",
    }
