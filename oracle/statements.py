"""One SQL statement per catalog query, over the same contract views."""

from __future__ import annotations

from oracle import expressions as x
from tariffmill.adapters.star_views import sql_with_views
from tariffmill.schemas import HOTEL_HEADERS, SUPP_HEADERS, SUPPLEMENT_HEADERS

SQL: dict[str, str] = {}

RATE_WORDS = (
    "from", "to", "period", "room", "rate", "rates", "single", "double", "triple", "child", "chd", "sgl", "dbl", "tpl", "extra bed",
    "supplement", "release", "min stay", "meal", "bb", "hb", "fb", "ai", "board", "allotment", "occupancy", "per person", "per room",
    "per night", "price list", "season",
)
HEADER_WORDS = (
    "from", "to", "valid from", "valid to", "start", "end", "room", "villa", "pavilion", "bungalow", "suite", "studio", "chalet",
    "cabana", "residence", "rate", "rates", "single", "double", "triple", "child", "chd", "sgl", "dbl", "tpl", "extra bed",
    "supplement", "release", "min stay", "meal", "bb", "hb", "fb", "ai",
)
NOTE_WORDS = (
    "cancellation", "no show", "no-show", "terms", "conditions", "tax", "service charge", "vat", "gala", "christmas", "new year",
    "booking window",
)
HOTEL_WORDS = r"(?i)\b(hotel|resort|inn|palace|villa|residence|suites|spa|club|riad)\b"


def words(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def spread(view: str, keep: str, rows: list[tuple[str, ...]], names: tuple[str, ...], where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, " + ", ".join(f"{v} AS {n}" for v, n in zip(r, names)) + f" FROM {view} WHERE {where}" for r in rows
    )


# ---- sources ---------------------------------------------------------------------------------------------------------

SQL["src1_landing_inventory"] = r"""
SELECT path, CASE WHEN head_hex = '25504446' THEN 'pdf' WHEN head_hex = 'D0CF11E0' THEN 'xls'
  WHEN head_hex IN ('89504E47', 'FFD8FF', '49492A00', '4D4D002A') THEN 'image'
  ELSE CASE lower(regexp_extract(path, '(\.[^.]+)$', 1)) WHEN '.xlsx' THEN 'xlsx' WHEN '.docx' THEN 'docx' WHEN '.pdf' THEN 'pdf'
    WHEN '.png' THEN 'image' WHEN '.tif' THEN 'image' WHEN '.jpeg' THEN 'image' WHEN '.xls' THEN 'xls' ELSE 'unknown' END END AS kind
FROM files"""
SQL["src2_file_checksum"] = "SELECT path, sha256(text) AS sha256 FROM files"
SQL["src2_duplicate_files"] = (
    "SELECT sha256(text) AS sha256, CAST(count(*) AS BIGINT) AS copies FROM files GROUP BY 1 HAVING count(*) > 1"
)
SQL["src3_read_canonical"] = "SELECT contract_id || '/' || hotel AS contract_id, hotel, entity, CAST(ord AS BIGINT) AS ord, name, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(
    f"SELECT contract_id, {h} AS hotel, '{e}' AS entity, {o} AS ord, {n} AS name, {v} AS value FROM hotels"
    for h, e, o, n, v in [
        ("hotel", "room", 0, "'A'", "2"), ("hotel", "room", 1, "'B'", "NULL"), ("hotel", "rate", 0, "'A'", "ord"),
        ("hotel", "rate", 1, "'B'", "NULL"), ("hotel", "band", 0, "hotel", "11.99"), ("hotel", "supplement", 0, "'Gala'", "ord"),
    ]
) + ") UNION ALL SELECT contract_id || '/' || hotel, NULL, 'note', 0, 'text', NULL FROM hotels" \
    " UNION ALL SELECT contract_id || '/' || hotel, hotel, 'hotel', 0, code, latitude FROM hotels"
SQL["src4_read_raw_json"] = """
SELECT text_id, CASE WHEN text_id % 4 < 2 THEN event_type END AS name, CASE WHEN text_id % 4 < 2 THEN user_id END AS n,
  CASE WHEN text_id % 4 >= 2 THEN 'invalid JSON' END AS error FROM model_texts"""
SQL["src5_vision_text"] = """
SELECT contract_id, doc_id, CASE event_id % 3 WHEN 0 THEN 'Hello ' || event_type WHEN 1 THEN 'Only text of ' || event_type ELSE '' END
  AS text FROM vision_texts"""
SQL["src5_vision_tables"] = """
SELECT contract_id, doc_id, 0 AS table_idx, CASE event_id % 3 WHEN 0 THEN 'Rates' ELSE 'Bare' END AS title,
  CASE event_id % 3 WHEN 0 THEN 2 ELSE 1 END AS n_rows FROM vision_texts WHERE event_id % 3 <> 1"""
SQL["src6_explode_dict_tables"] = """
SELECT v.contract_id, v.doc_id, 0 AS table_idx, 'vision' AS source, c.row_idx, c.col_name,
  CASE WHEN c.raw = '?' THEN '€' || CAST(e.user_id AS VARCHAR) ELSE c.raw END AS raw
FROM vision_texts v JOIN events e ON v.event_id = e.event_id
JOIN (VALUES (0, 0, 'Board', 'BB'), (0, 0, 'Double', '?'), (0, 1, 'Board', 'HB'), (0, 1, 'Double', '€99,00'), (2, 0, 'Board', 'AI'))
  c(kind, row_idx, col_name, raw) ON v.event_id % 3 = c.kind"""
SQL["src6_explode_list_tables"] = "SELECT contract_id, doc_id, row_idx, col_name, raw FROM (" + spread(
    "lines", "contract_id, ord AS doc_id",
    [("0", "'Board'", "meal"), ("0", "'Room'", "room"), ("0", "'col3'", "season"), ("1", "'Board'", "meal")],
    ("row_idx", "col_name", "raw"),
) + ")"
SQL["src7_read_cells"] = "SELECT * FROM cells"

# ---- scalar functions ------------------------------------------------------------------------------------------------

SQL |= {
    "fn1_normalize_currency": f"SELECT row_id, {x.currency('currency')} AS currency, {x.currency('customer_currency')} AS customer FROM raw_rows",
    "fn2_normalize_meal_plan": f"SELECT row_id, {x.board('meal_plan')} AS meal_plan FROM raw_rows",
    "fn3_normalize_rate_type": f"SELECT row_id, {x.rate_type('rate_type')} AS rate_type FROM raw_rows",
    "fn4_normalize_status": f"SELECT row_id, {x.status('status')} AS status FROM raw_rows",
    "fn5_normalize_iso_date": f"SELECT row_id, {x.iso_date('start_date')} AS start_date, {x.iso_date('end_date')} AS end_date FROM raw_rows",
    "fn6_to_iso_date_strict": f"SELECT row_id, {x.strict_date('start_date')} AS start_date, {x.strict_date('end_date')} AS end_date FROM raw_rows",
    "fn7_coerce_number": f"SELECT row_id, {x.dbl(x.coerced('dbl'))} AS dbl, {x.prose('dbl')} AS dbl_prose, {x.dbl(x.coerced('min_adult', True))} AS min_adult, {x.dbl(x.coerced('chd1', free='100'))} AS child FROM raw_rows",
    "fn8_to_float": f"SELECT row_id, {x.dbl(x.to_float('dbl'))} AS dbl, {x.dbl(x.to_float('extra_bed'))} AS extra_bed, CAST(trunc({x.to_float('min_adult')}) AS BIGINT) AS min_adult FROM raw_rows",
    "fn9_parse_price_cell": f"SELECT contract_id, row_idx, col_name, raw, {x.dbl(x.price_cell('raw'))} AS price FROM source_cells",
    "fn10_days_mask": f"SELECT row_id, {x.days_mask('days')} AS days FROM raw_rows",
    "fn11_fmt_dd_mm_yyyy": f"SELECT row_id, {x.day_first('start_date')} AS start_date, {x.day_first('end_date')} AS end_date FROM raw_rows",
    "fn12_date_diff_inclusive": f"SELECT row_id, CAST(({x.real_date('end_date')}) - ({x.real_date('start_date')}) AS BIGINT) + 1 AS days FROM rows",
    "fn13_hotel_code": f"SELECT hotel, {x.hotel_code('hotel')} AS made, {x.hotel_code('hotel', 'code')} AS code FROM hotels",
    "fn14_classify_band": "SELECT contract_id, hotel, ord, CASE WHEN age_to <= 2 THEN 'baby' WHEN age_from >= 12 THEN 'teen' ELSE 'child' END AS band FROM child_bands",
    "fn16_fare_and_index": "SELECT ord, CASE WHEN calculation_method = 'Standard' THEN 'Per ' || traveler_type ELSE fare_type_name END AS fare, CASE WHEN calculation_method = 'Standard' AND charge_type = 'Per Person Per Night' THEN NULL ELSE ordinal END AS place FROM supplements",
    "fn17_supplement_type": f"SELECT ord, {x.supplement_type('kind', 'name', 'description')} AS kind FROM supplements",
    "fn18_detect_currency": f"SELECT doc_id, {x.found_currency('raw_excerpt')} AS currency FROM text_docs",
    "fn19_detect_meal_plan": f"SELECT doc_id, {x.found_board('raw_excerpt')} AS meal_plan FROM text_docs",
    "fn20_detect_child_columns": rf"""
WITH hits AS (SELECT contract_id, unnest(regexp_extract_all(raw_excerpt, '(?i)CHD\s*\(?\s*\d+(?:\.\d+)?\s*[-–to]+\s*\d+(?:\.\d+)?')) AS m FROM text_docs),
ages AS (SELECT contract_id, regexp_extract_all(m, '\d+(?:\.\d+)?') AS a FROM hits)
SELECT DISTINCT contract_id, 'CHD(' || {x.g('CAST(a[1] AS DECIMAL(10,5))')} || '-' || {x.g('CAST(a[2] AS DECIMAL(10,5))')} || ')' AS key,
  CAST(a[1] AS DOUBLE) AS age_from, CAST(a[2] AS DOUBLE) AS age_to, 'amount' AS value_type FROM ages
UNION ALL
SELECT contract_id, 'CHD(Child)', NULL, NULL, 'unknown' FROM text_docs
WHERE contract_id NOT IN (SELECT contract_id FROM hits) GROUP BY contract_id
HAVING bool_or(regexp_matches(raw_excerpt, '(?i){x.EDGE}(CHD|CHILD|INFANT|BABY|TEEN|JUNIOR){x.END}'))""",
    "fn21_child_key": f"SELECT contract_id, hotel, ord, CASE position WHEN 'first_child' THEN 'CHD1' WHEN 'second_child' THEN 'CHD2' WHEN 'third_child' THEN 'CHD3' ELSE 'CHD' END || '(' || {x.g('age_from')} || '-' || {x.g('age_to')} || ')' AS key FROM child_bands",
    "fn22_room_tokens": f"SELECT doc_id, room_name, array_to_string({x.room_tokens('room_name')}, ' | ') AS tokens, array_to_string({x.room_tokens(chr(40) + 'doc_id || ' + chr(39) + ' Dlx SV (the)' + chr(39) + chr(41))}, ' | ') AS sheet_tokens FROM occupancy",
    "fn23_format_cost": f"SELECT ord, CASE WHEN cost_format = 'percentage' THEN {x.g('supplier_cost')} || '%' ELSE CAST(supplier_cost AS VARCHAR) END AS cost FROM supplements",
    "fn24_slugify": f"SELECT hotel, {x.slug('supplier')} AS slug, {x.slug('hotel || ' + chr(39) + '  & Spa!' + chr(39))} AS name FROM hotels",
    "fn25_meal_from_treatment": "SELECT doc_id, CASE basic_treatment WHEN 'HB' THEN 'Half Board' WHEN 'Soft All Inclusive' THEN 'All Inclusive' WHEN 'bed / breakfast' THEN 'Bed & Breakfast' WHEN 'picnic' THEN 'Picnic' END AS board FROM sheet_meta",
    "fn27_rate_token_hits": f"SELECT doc_id, {x.contained('lower(raw_excerpt)', RATE_WORDS)} AS hits FROM text_docs",
    "fn28_has_numeric_table": rf"""
SELECT contract_id, doc_id, row_idx, bool_or(coalesce(abs(num) >= 5, false)) AND bool_or(num IS NULL AND coalesce(
  regexp_matches(raw, '\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}') OR regexp_matches(lower(raw), '\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)'), false)) AS has_numeric_table
FROM (SELECT *, {x.pnum("trim(replace(replace(replace(trim(raw), ',', ''), '€', ''), '$', ''))")} AS num FROM source_cells) GROUP BY 1, 2, 3""",
    "fn29_page_numbers": "SELECT page_id, CASE hint WHEN '1-3, 5' THEN '1 | 2 | 3 | 5' WHEN 'Page 4' THEN '4' WHEN '5-2' THEN '2 | 3 | 4 | 5' WHEN 'Pages 2 - 2, 2, 1' THEN '2 | 1' ELSE '1 | 2 | 3 | 4 | 5 | 6' END AS pages FROM pdf_pages",
    "fn30_is_index_sheet": r"SELECT ord, regexp_matches(name, '(?i)^\s*(hotel\s*list|hotels|index|summary|contents|table\s+of\s+contents|toc|overview|cover|legend|key|info|info\s*page|notes|terms|glossary|master|masterdata|sheet\d+)\s*$') AS is_index FROM sheets",
    "fn31_norm_label": r"SELECT contract_id, hotel, ord, trim(regexp_replace(lower(label), '\s+', ' ', 'g')) AS label FROM seasons_repeated",
}


def scrambled(text: str) -> str:
    parts = rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"
    short = rf"len(list_filter({parts}, lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]{{1,2}}')))"
    return f"(length({text}) >= 80 AND len({parts}) >= 30 AND {short} * 100 > len({parts}) * 35)"


SQL["fn26_is_scrambled"] = (
    f"SELECT doc_id, {scrambled('raw_excerpt')} AS scrambled, {scrambled('spaced_text')} AS spaced FROM "
    r"(SELECT doc_id, raw_excerpt, regexp_replace(raw_excerpt, '([aeiou])', '\1 ', 'g') AS spaced_text FROM text_docs)"
)

BASE_RATES = """room_base AS (
  SELECT r.contract_id, r.hotel, r.room, CASE WHEN h.top <> 0 AND p.own <= 30 AND p.own * 2 <= h.top THEN h.top ELSE p.own END AS base_rate,
    h.low AS fallback
  FROM (SELECT DISTINCT contract_id, hotel, room FROM rooms) r
  LEFT JOIN (SELECT contract_id, hotel, room, min(dbl) AS own FROM {rates} WHERE dbl IS NOT NULL GROUP BY 1, 2, 3) p
    USING (contract_id, hotel, room)
  LEFT JOIN (SELECT contract_id, hotel, min(dbl) AS low, max(dbl) AS top FROM {rates} WHERE dbl IS NOT NULL GROUP BY 1, 2) h
    USING (contract_id, hotel))"""
SQL["fn15_band_price"] = f"""
WITH {BASE_RATES.format(rates='rates')}
SELECT contract_id, hotel, room, ord, {x.dbl(x.band_price('value_type', 'value', 'base_rate'))} AS price
FROM child_bands JOIN room_base USING (contract_id, hotel)"""

# ---- projections, filters, predicates --------------------------------------------------------------------------------

PRICED = "coalesce(sgl, dbl, tpl, qdp, extra_bed, chd1, chd2, chd3) IS NOT NULL"
KEPT = f"(trim(coalesce(hotel, '')) <> '' OR {PRICED})"
SKELETON_TEXT = (
    " candidate row(s) were dropped because they had neither a Hotel Name nor any rate values. These were likely occupancy / min-stay "
    "artifacts. Review the source preview if you expect rates from those rows."
)


def default(field: str, option: str) -> str:
    return f"coalesce(nullif(r.{field}, ''), nullif(o.{option}, ''), r.{field}) AS {field}"


SQL |= {
    "pf1_apply_defaults": "SELECT row_id, " + ", ".join(default(f, o) for f, o in [
        ("supplier", "supplier"), ("country_code", "country"), ("city_area", "city_area"), ("currency", "currency"),
        ("customer_currency", "currency"), ("check_in", "check_in"), ("check_out", "check_out"), ("status", "status"),
    ]) + " FROM rows r LEFT JOIN options o USING (contract_id)",
    "pf2_drop_skeleton_rows": f"SELECT row_id, sheet FROM rows WHERE {KEPT}",
    "pf2_skeleton_notes": f"SELECT contract_id, string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS page, 'Source ambiguity' AS category, CAST(count(*) AS VARCHAR) || '{SKELETON_TEXT}' AS note, CAST(0.2 AS DOUBLE) AS confidence FROM rows WHERE NOT {KEPT} GROUP BY contract_id",
    "pf3_priced_predicate": f"SELECT row_id, {PRICED} AS priced FROM rows",
    "pf4_exportable_contracts": "SELECT contract_id FROM contracts WHERE contract_id NOT IN (SELECT contract_id FROM issues WHERE severity = 'error')",
    "pf4_blocking_issues": "SELECT contract_id, row_id, message FROM issues WHERE severity = 'error'",
    "pf5_review_grid_filter": "SELECT row_id FROM rows r WHERE contains(coalesce(hotel, ''), 'Supplier') AND contains(sheet, 'Page:3') AND EXISTS (SELECT 1 FROM issues i WHERE i.severity = 'error' AND i.row_id = r.row_id AND i.contract_id = r.contract_id)",
    "pf6_notes_filter": "SELECT note_id, note FROM notes WHERE contains(lower(note), 'gala') AND category = 'Special offer'",
    "pf7_notes_partition": "SELECT note_id, CASE category WHEN 'Room supplement' THEN 'supplements' WHEN 'Special offer' THEN 'offers' WHEN 'Cancellation' THEN 'cancellation' END AS bucket FROM notes",
    "pf10_ai_marker_split": "SELECT hotel, " + ", ".join(f"{x.no_ai(f)} AS {f}" for f in ("address_line_1", "address_line_4", "county_state_province", "email")) + ", " + x.join_list(*[
        f"CASE WHEN {x.has_ai(f)} THEN '{h}' END" for f, h in [("address_line_1", "Address Line 1"), ("address_line_4", "Address Line 4"), ("county_state_province", "County / State / Province"), ("email", "Email Address")]
    ], "CASE WHEN latitude IS NOT NULL THEN 'Latitude' END", "CASE WHEN longitude IS NOT NULL THEN 'Longitude' END") + " AS ai_fields FROM hotels",
    "pf11_field_state": "SELECT row_id, CASE WHEN city_mark = 'ai' THEN 'enriched' WHEN city_mark = 'user' THEN 'edited' WHEN warning IS NOT NULL OR confidence < 0.4 THEN 'verify' ELSE 'none' END AS field_state FROM rows",
    "pf12_trim_documents": """
SELECT contract_id, doc_id, CASE WHEN length(raw_excerpt) > shown THEN substr(raw_excerpt, 1, shown) || chr(10) || '...[truncated]' ELSE raw_excerpt END AS raw_excerpt
FROM (SELECT *, CASE lower(input_format) WHEN 'xlsx' THEN 60000 WHEN 'pdf' THEN 10000 WHEN 'docx' THEN 12000 ELSE 8000 END AS shown FROM text_docs
  QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY CASE classification WHEN 'hotel_contract' THEN 0 WHEN 'index_reference' THEN 1 ELSE 2 END, ord) <= 40)""",
    "pf12_trim_cells": "SELECT contract_id, doc_id, row_idx, col_idx, value_str FROM cells",
    "pf13_clear_child_values": "SELECT row_id, CASE WHEN max_rollaways > 0 OR room IS NULL THEN CAST(chd1 AS DOUBLE) END AS chd1, CASE WHEN max_rollaways > 0 OR room IS NULL THEN CAST(chd2 AS DOUBLE) END AS chd2, CASE WHEN warning IS NULL THEN 0 ELSE 1 END + CASE WHEN max_rollaways > 0 OR room IS NULL THEN 0 ELSE 1 END AS n_warnings FROM rows",
}
VIEW_NAME = " OR ".join(f"contains(lower(name), '{w}')" for w in ("supp.", "view supp", "pool view", "sea view", "sea side view", "garden view", "beach front", "swim up", "swim-up"))
SCOPED = f"kind <> 'room_view' AND NOT (kind = 'other' AND coalesce({VIEW_NAME}, false))"
SQL["pf8_supplement_scope_filter"] = f"SELECT ord, kind, name FROM supplements WHERE {SCOPED}"

# The grid rows of sheet blocks, for PF9 and EX1.
NARROWED = """narrowed AS (
  SELECT b.contract_id, b.doc_id, b.block_idx, b.role, b.col_idx, b.label, b.position, b.value_type, b.supp_field, b.ord,
    coalesce(n.f, b.age_from) AS age_from, coalesce(n.t, b.age_to) AS age_to
  FROM block_columns b LEFT JOIN (
    SELECT b.contract_id, b.doc_id, b.ord, arg_min(o.age_from, (o.age_to - o.age_from) * 100 + o.ord) AS f,
      arg_min(o.age_to, (o.age_to - o.age_from) * 100 + o.ord) AS t
    FROM block_columns b JOIN overrides o USING (contract_id, doc_id, position)
    WHERE b.role = 'child' AND o.age_from >= b.age_from AND o.age_to <= b.age_to
      AND o.age_to - o.age_from < b.age_to - b.age_from GROUP BY 1, 2, 3) n USING (contract_id, doc_id, ord))"""
GRID = f"""{NARROWED}, grid AS (
  SELECT c.contract_id, c.doc_id, c.row_idx, max(b.title) AS title,
    max(CASE WHEN col_idx = 0 THEN {x.iso_date('value_str')} END) AS start_date,
    max(CASE WHEN col_idx = 1 THEN {x.iso_date('value_str')} END) AS end_date,
    max(CASE WHEN col_idx = 2 THEN {x.to_float('value_str')} END) AS base,
    max(CASE WHEN col_idx = 3 THEN {x.to_float('value_str')} END) AS s,
    max(CASE WHEN col_idx = 4 THEN {x.to_float('value_str')} END) AS t,
    max(CASE WHEN col_idx = 5 THEN {x.to_float('value_str')} END) AS chd1,
    max(CASE WHEN col_idx = 6 THEN {x.to_float('value_str')} END) AS up,
    max(CASE WHEN col_idx = 7 THEN trunc({x.to_float('value_str')}) END) AS release
  FROM cells c JOIN blocks b USING (contract_id, doc_id) WHERE c.row_idx BETWEEN b.first_data_row_idx AND b.last_data_row_idx
    AND c.col_idx <= 7 GROUP BY 1, 2, 3)"""
SQL["pf9_expand_row_guard"] = f"WITH {GRID} SELECT doc_id, row_idx, {x.dbl('base')} AS base, start_date, end_date FROM grid WHERE base IS NOT NULL AND start_date IS NOT NULL AND end_date IS NOT NULL"

# ---- joins -----------------------------------------------------------------------------------------------------------

CELL = "contract_id, hotel, room, season, meal"
FULL_GRID = """full_grid AS (
  SELECT r.contract_id, r.hotel, r.room, s.label AS season, m.code AS meal, r.ord AS room_ord, s.ord AS season_ord, m.ord AS meal_ord
  FROM rooms r JOIN seasons s USING (contract_id, hotel) JOIN meals m USING (contract_id, hotel))"""
ANY_PRICE = "coalesce(sgl, dbl, tpl, qdp) IS NOT NULL"
FILLED = f"filled AS (SELECT DISTINCT {CELL} FROM rates WHERE {ANY_PRICE})"
MISSING = f"{FULL_GRID}, {FILLED}, missing AS (SELECT * FROM full_grid ANTI JOIN filled USING ({CELL}))"
LAST_RATE = f"last_rate AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY {CELL} ORDER BY ord DESC) = 1)"
PRICES = ", ".join(f"{x.dbl(p)} AS {p}" for p in ("sgl", "dbl", "tpl", "qdp"))
COVERAGE = f"""{MISSING}, cov AS (
  SELECT g.contract_id, g.hotel, CAST(g.n AS BIGINT) AS expected, CAST(coalesce(f.n, 0) AS BIGINT) AS filled, CAST(m.n AS BIGINT) AS missing
  FROM (SELECT contract_id, hotel, count(*) AS n FROM full_grid GROUP BY 1, 2) g
  JOIN (SELECT contract_id, hotel, count(*) AS n FROM missing GROUP BY 1, 2) m USING (contract_id, hotel)
  LEFT JOIN (SELECT contract_id, hotel, count(*) AS n FROM filled GROUP BY 1, 2) f USING (contract_id, hotel))"""
SEVERITY = "CASE WHEN CAST(filled AS DOUBLE) / expected < 0.5 THEN 'error' ELSE 'warning' END AS severity"
SQL |= {
    "j1_rate_grid": f"WITH {FULL_GRID}, {LAST_RATE} SELECT {CELL}, {PRICES} FROM full_grid LEFT JOIN last_rate USING ({CELL})",
    "j2_coverage": f"WITH {COVERAGE} SELECT contract_id, hotel, expected, filled, missing, CAST(filled AS DOUBLE) / expected AS ratio, {SEVERITY} FROM cov",
    "j2_missing_rates": f"WITH {MISSING} SELECT {CELL} FROM missing",
    "j3_fill_missing_rates": f"""
WITH {MISSING}, added AS (
  SELECT p.* FROM patch_rates p SEMI JOIN missing USING ({CELL}) WHERE {ANY_PRICE}
  QUALIFY row_number() OVER (PARTITION BY {CELL} ORDER BY ord) = 1)
SELECT {CELL}, {x.dbl('sgl')} AS sgl, {x.dbl('dbl')} AS dbl, ord FROM rates
UNION ALL SELECT {CELL}, {x.dbl('sgl')}, {x.dbl('dbl')}, ord FROM added""",
    "j4_supplement_hotel_lookup": f"SELECT s.ord, CASE WHEN h.hotel IS NOT NULL THEN {x.hotel_code('h.hotel', 'h.code')} END AS hotel_code, {x.no_ai('h.supplier')} AS supplier, coalesce(nullif(h.currency, ''), 'EUR') AS currency, {x.has_ai('h.supplier')} AS supplier_is_ai FROM supplements s LEFT JOIN hotels h USING (contract_id, hotel)",
    "j5_supplement_room_lookup": "SELECT s.ord, r.min_adult, r.max_adult, r.max_children AS max_child FROM supplements s LEFT JOIN rooms r ON s.contract_id = r.contract_id AND s.hotel = r.hotel AND s.rooms = r.room",
    "j6_occupancy_best_match": f"""
WITH asked AS (SELECT DISTINCT contract_id, doc_id, label AS room FROM block_columns WHERE role IN ('base_room', 'upgrade') AND label <> ''),
scored AS (SELECT a.*, o.* EXCLUDE (contract_id, doc_id), CASE WHEN lower(trim(room)) = lower(trim(room_name)) THEN 999 ELSE greatest(
  10 * len(list_intersect({x.room_tokens('room')}, {x.room_tokens('room_name')})), CASE WHEN contains(lower(room), lower(room_name)) OR
  contains(lower(room_name), lower(room)) THEN 100 ELSE 0 END) END AS score FROM asked a JOIN occupancy o USING (contract_id, doc_id))
SELECT doc_id, room, room_name, min_adult, max_adult, max_child FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY contract_id, doc_id, room ORDER BY score DESC, ord) = 1""",
    "j7_child_age_narrowing": f"WITH {NARROWED} SELECT doc_id, ord, position, {x.dbl('age_from')} AS age_from, {x.dbl('age_to')} AS age_to FROM narrowed WHERE role = 'child'",
}
LABEL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


def contained_seasons(view: str) -> str:
    return f"""SELECT * FROM {view} s WHERE NOT EXISTS (SELECT 1 FROM {view} w WHERE w.contract_id = s.contract_id AND w.hotel = s.hotel
  AND w.start_date <= s.start_date AND s.end_date <= w.end_date AND (w.start_date < s.start_date OR s.end_date < w.end_date)
  AND contains({LABEL.format('w.label')}, {LABEL.format('s.label')}))"""


UNMAPPED = f"""price_cells AS (SELECT *, {x.price_cell('raw')} AS price FROM source_cells WHERE ({x.price_cell('raw')}) IS NOT NULL),
mapped AS (SELECT DISTINCT contract_id, unnest([sgl, dbl, tpl, qdp, extra_bed, chd1, chd2, chd3]) AS price FROM rows),
unmapped AS (SELECT * FROM price_cells ANTI JOIN (SELECT * FROM mapped WHERE price IS NOT NULL) m USING (contract_id, price))"""
SQL["j8_season_subsumption"] = f"SELECT contract_id, hotel, label, ord FROM ({contained_seasons('seasons_repeated')})"
SQL["j9_cell_reconciliation"] = f"WITH {UNMAPPED} SELECT contract_id, doc_id, row_idx, col_name, {x.dbl('price')} AS price FROM unmapped"
BATCH = "'batch ' || CAST(r.batch_no AS VARCHAR)"
SQL["j10_skeleton_broadcast"] = "SELECT r.row_id, " + ", ".join(
    f"coalesce(nullif(r.{f}, ''), nullif(s.{f}, ''), r.{f}) AS {f}"
    for f in ("hotel", "supplier", "address_line_1", "country_code", "postal_code", "email", "currency")
) + f" FROM rows r LEFT JOIN skeletons s ON r.contract_id = s.contract_id AND s.batch_id = {BATCH}"
ROOM_JOIN = f"rows r LEFT JOIN skeleton_rooms s ON r.contract_id = s.contract_id AND s.batch_id = {BATCH} AND s.room = r.room"
SQL["j11_room_broadcast"] = "SELECT r.row_id, " + ", ".join(
    f"coalesce(r.{f}, s.{f}) AS {f}" for f in ("min_adult", "max_adult", "max_pax")
) + f" FROM {ROOM_JOIN}"
SQL["j12_extra_bed_literal"] = f"""
SELECT r.row_id, CAST(CASE s.literal WHEN '-30%' THEN 30 WHEN 'free' THEN 0 WHEN '25 EUR' THEN 25 WHEN 'n/a' THEN NULL WHEN '12,5' THEN 12.5
  ELSE r.extra_bed END AS DOUBLE) AS extra_bed, coalesce(s.literal = '-30%', false) AS extra_bed_is_pct,
  coalesce(s.literal IN ('-30%', 'free'), false) AS sourced FROM {ROOM_JOIN}"""

ENRICHED = (
    "address_line_1", "address_line_2", "address_line_3", "address_line_4", "postal_code", "country_code", "state_region", "city_area",
    "phone", "email", "website", "latitude", "longitude",
)
KNOWN = "known AS (SELECT contract_id, trim(hotel) AS name, " + ", ".join(
    f"arg_min(CAST({f} AS VARCHAR), ord) FILTER (CAST({f} AS VARCHAR) <> '') AS {f}" for f in ENRICHED
) + " FROM rows WHERE trim(hotel) <> '' GROUP BY 1, 2)"
OFFER = {
    **{f: f"nullif(trim(e.{f}), '')" for f in ENRICHED},
    "country_code": "CASE WHEN length(trim(e.country_code)) >= 2 THEN substr(upper(trim(e.country_code)), 1, 2) END",
    "latitude": "TRY_CAST(e.latitude AS DOUBLE)", "longitude": "TRY_CAST(e.longitude AS DOUBLE)",
}
FILLS = {
    f: f"(nullif(CAST(r.{f} AS VARCHAR), '') IS NULL AND k.name IS NOT NULL AND k.{f} IS NULL AND ({OFFER[f]}) IS NOT NULL)"
    for f in ENRICHED
}
N_FILLS = " + ".join(f"CAST({t} AS INT)" for t in FILLS.values())
SQL["j13_metadata_enrichment"] = f"WITH {KNOWN} SELECT r.row_id, " + ", ".join(
    f"CASE WHEN {FILLS[f]} THEN {OFFER[f]} ELSE r.{f} END AS {f}"
    for f in ("address_line_1", "address_line_2", "postal_code", "country_code", "state_region", "phone", "latitude")
) + f""", {N_FILLS} + CASE WHEN r.warning IS NULL THEN 0 ELSE 1 END AS n_warnings, {N_FILLS} AS n_marks
FROM rows r LEFT JOIN known k ON k.contract_id = r.contract_id AND k.name = trim(r.hotel)
LEFT JOIN reference_hotels e ON e.hotel = trim(r.hotel)"""
SQL["j14_enrichment_missing_fields"] = f"WITH {KNOWN} SELECT contract_id, hotel, field, known, known IS NULL AS missing FROM (" + spread(
    "known", "contract_id, name AS hotel", [(f"'{f}'", f) for f in ENRICHED], ("field", "known")
) + ")"
IDENTITY = [
    "supplier_cost", "customer_price", "kind", "charge_type", "calculation_method", "traveler_type", "ordinal", "age_min", "age_max",
    "start_date", "end_date",
]
SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM p.{c}" for c in IDENTITY)
SQL["j15_supplement_patch_merge"] = f"""
WITH focus AS (SELECT contract_id, max(hotel) AS focus FROM supplements GROUP BY 1),
own AS (SELECT * FROM supplements),
patch AS (SELECT s.* EXCLUDE (hotel, ord), -s.ord AS ord, CASE WHEN {x.fold('coalesce(s.shouted, s.hotel)')} = {x.fold('f.focus')}
  THEN coalesce(s.shouted, s.hotel) ELSE f.focus END AS hotel, f.focus FROM supplements s JOIN focus f USING (contract_id)),
fresh AS (SELECT * FROM patch QUALIFY row_number() OVER (PARTITION BY contract_id, {x.fold('season_label')}, {', '.join(IDENTITY)} ORDER BY ord) = 1)
SELECT contract_id, hotel, ord FROM own UNION ALL
SELECT contract_id, hotel, ord FROM fresh p WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.contract_id = p.contract_id
  AND {x.fold('o.hotel')} = {x.fold('p.focus')} AND {x.fold('o.season_label')} = {x.fold('p.season_label')} AND {SAME})"""
LETTERS = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
SQL["j16_sheet_match"] = f"""
WITH pairs AS (
  SELECT h.contract_id, h.ord, h.hotel, s.name AS sheet, s.ord AS sheet_ord,
    CASE WHEN {x.fold('s.name')} = {x.fold("regexp_replace(h.source_hint, '^[^:]*:', '')")} AND h.source_hint <> '' THEN 1
      WHEN {x.fold('s.name')} = {x.fold('h.hotel')} THEN 2
      WHEN {LETTERS.format('h.hotel')} <> '' AND (contains({LETTERS.format('s.name')}, {LETTERS.format('h.hotel')}) OR
        contains({LETTERS.format('h.hotel')}, {LETTERS.format('s.name')})) THEN 3 END AS tier
  FROM sheet_hotels h JOIN sheets s USING (contract_id)),
best AS (SELECT * FROM pairs WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contract_id, ord ORDER BY tier, sheet_ord) = 1)
SELECT h.ord, h.hotel, b.sheet, CASE b.tier WHEN 1 THEN 'hint' WHEN 2 THEN 'name' WHEN 3 THEN 'letters' END AS matched_by
FROM sheet_hotels h LEFT JOIN best b USING (contract_id, ord)"""


def bands_per_room(bands: str) -> str:
    return f"""hits AS (
  SELECT DISTINCT b.contract_id, b.hotel, b.ord, r.room FROM (SELECT *, unnest(string_split(rooms_text, ',')) AS n FROM {bands}) b
  JOIN rooms r ON r.contract_id = b.contract_id AND r.hotel = b.hotel AND {x.fold('r.room')} = {x.fold('b.n')}),
band_rooms AS (
  SELECT b.*, h.room FROM {bands} b JOIN hits h USING (contract_id, hotel, ord)
  UNION ALL
  SELECT b.*, coalesce(r.room, 'ALL') FROM {bands} b LEFT JOIN rooms r USING (contract_id, hotel)
  WHERE (b.contract_id, b.hotel, b.ord) NOT IN (SELECT contract_id, hotel, ord FROM hits))"""


SQL["j17_room_scope_filter"] = f"WITH {bands_per_room('child_bands')} SELECT contract_id, hotel, ord, room FROM band_rooms"
_LINKS = r"""
asked AS (SELECT DISTINCT contract_id, source_ref FROM doc_refs),
exact AS (SELECT a.contract_id, a.source_ref, arg_min(d.doc_id, d.ord) AS doc_id FROM asked a JOIN text_docs d ON d.contract_id = a.contract_id
  AND (d.source_ref = a.source_ref OR d.doc_id = a.source_ref) GROUP BY 1, 2),
numbered AS (SELECT contract_id, source_ref, list_transform(regexp_extract_all(regexp_replace(source_ref, '^[^|]*\|', ''), '\d+'),
  lambda n: CAST(n AS INT)) AS n FROM asked ANTI JOIN exact USING (contract_id, source_ref) WHERE contains(source_ref, '|') AND NOT contains(source_ref, '!')),
sheeted AS (SELECT DISTINCT a.contract_id, a.source_ref, d.doc_id FROM (SELECT * FROM asked ANTI JOIN exact USING (contract_id, source_ref)) a JOIN text_docs d
  ON d.contract_id = a.contract_id AND contains(a.source_ref, '!') AND d.doc_id = 'Sheet:' || trim(regexp_extract(a.source_ref, '^[^|]*\|\s*''?(.*?)''?![^!]*$', 1))),
paged AS (SELECT DISTINCT p.contract_id, p.source_ref, d.doc_id FROM numbered p JOIN text_docs d ON d.contract_id = p.contract_id
  AND d.kind = 'pdf_page' AND list_contains(p.n, d.page_number)),
ranged AS (SELECT p.contract_id, p.source_ref, d.doc_id FROM (SELECT * FROM numbered ANTI JOIN paged USING (contract_id, source_ref)) p
  JOIN text_docs d ON d.contract_id = p.contract_id AND d.kind = 'pdf_page' AND d.page_number BETWEEN list_min(p.n) AND list_max(p.n)),
found AS (SELECT *, 'exact' AS tier FROM exact UNION ALL SELECT *, 'sheet' FROM sheeted UNION ALL SELECT *, 'pages' FROM paged UNION ALL SELECT *, 'range' FROM ranged),
links AS (SELECT contract_id, source_ref, doc_id, tier FROM found
UNION ALL SELECT contract_id, source_ref, NULL, 'approximate' FROM asked ANTI JOIN found USING (contract_id, source_ref))"""
SQL["j18_source_ref_lookup"] = f"""WITH {_LINKS} SELECT * FROM links WHERE tier <> 'approximate'
UNION ALL SELECT l.contract_id, l.source_ref, d.doc_id, l.tier FROM links l JOIN text_docs d USING (contract_id) WHERE l.tier = 'approximate'"""
SQL["j18_lost_documents"] = f"WITH {_LINKS} SELECT contract_id, doc_id FROM text_docs WHERE contract_id IN (SELECT contract_id FROM links WHERE tier = 'approximate')"
CHUNK = 400
SQL["j18_opening_text"] = f"""
SELECT contract_id, CAST(chunk AS BIGINT) AS chunk, string_agg(block, '' ORDER BY ord) AS text FROM (
  SELECT contract_id, ord, block, (sum(length(block)) OVER (PARTITION BY contract_id ORDER BY ord) - length(block)) // {CHUNK} AS chunk
  FROM (SELECT contract_id, ord, '[' || doc_id || ']' || chr(10) || coalesce(raw_excerpt, '') || chr(10) || chr(10) AS block FROM text_docs))
GROUP BY 1, 2"""
COUNTED = "(SELECT contract_id, row_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM issues GROUP BY 1, 2) i"
SQL["j19_row_issue_counts"] = f"SELECT r.row_id, CAST(coalesce(i.e, 0) AS BIGINT) AS errors, CAST(coalesce(i.w, 0) AS BIGINT) AS warnings_count FROM rows r LEFT JOIN {COUNTED} USING (contract_id, row_id)"
SQL["j20_uncovered_rooms"] = f"""
SELECT s.contract_id, s.batch_id, s.room FROM skeleton_rooms s WHERE NOT EXISTS (SELECT 1 FROM rows r WHERE r.contract_id = s.contract_id
  AND s.batch_id = {BATCH} AND r.room = s.room)"""

# ---- aggregations ----------------------------------------------------------------------------------------------------

LAYOUTS = """layouts AS (
  SELECT contract_id, t AS rate_type, CASE WHEN contains(t, 'per room') AND contains(t, 'pax') THEN 'prn_pax' WHEN contains(t, 'per room') THEN
    'prn_ac' ELSE 'ppn' END AS layout
  FROM (SELECT c.contract_id, d.t FROM (SELECT DISTINCT contract_id FROM rows) c LEFT JOIN (
    SELECT contract_id, lower(trim(rate_type)) AS t FROM rows WHERE trim(rate_type) <> '' GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY count(*) DESC, min(ord)) = 1) d USING (contract_id)))"""
POSITION_ORDER = "CASE position WHEN 'first_child' THEN 1 WHEN 'second_child' THEN 2 WHEN 'third_child' THEN 3 ELSE 4 END"
COLUMNS = f"""keyed AS (
  SELECT *, coalesce(nullif(key, ''), nullif(label, ''), 'CHD(Unknown)') AS k FROM child_columns
  QUALIFY row_number() OVER (PARTITION BY contract_id, k ORDER BY age_from NULLS LAST, age_to NULLS LAST, {POSITION_ORDER},
    coalesce(nullif(label, ''), nullif(key, ''), ''), ord) = 1),
ncols AS (
  SELECT contract_id, k AS key, position, age_from, age_to, coalesce(value_type, 'unknown') AS value_type,
    row_number() OVER (PARTITION BY contract_id ORDER BY age_from NULLS LAST, age_to NULLS LAST, {POSITION_ORDER}, coalesce(nullif(coalesce(label, k), ''), k), ord) AS ord
  FROM keyed)"""


def typed_columns(values: str) -> str:
    """ncols with types after detection; ``values`` yields contract_id, key, v."""
    return f"""seen AS (SELECT contract_id, key, bool_and(v BETWEEN 0 AND 1) AS share FROM ({values}) WHERE v IS NOT NULL GROUP BY 1, 2),
tcols AS (SELECT n.* EXCLUDE (value_type), CASE WHEN n.value_type IN ('amount', 'unknown') AND coalesce(s.share, false) THEN
  'percentage_of_adult' ELSE n.value_type END AS value_type FROM ncols n LEFT JOIN seen s USING (contract_id, key))"""


CHILD_KEYS = {"chd1": "CHD1(2-11.99)", "chd2": "CHD2(0-5.99)", "chd3": "CHD(12-17.99)"}
ROW_VALUES = " UNION ALL ".join(f"SELECT contract_id, '{k}' AS key, {c} AS v FROM rows" for c, k in CHILD_KEYS.items())
BANDED = "CASE WHEN age_to <= 2 THEN 'baby' WHEN age_from >= 12 THEN 'teen' ELSE 'child' END"
BAND_KEYS = f"""banded AS (SELECT contract_id, {BANDED} AS band, key, age_from, age_to,
  row_number() OVER (PARTITION BY contract_id, {BANDED} ORDER BY ord) AS rn FROM child_columns WHERE key <> ''),
bands AS (SELECT contract_id, band, min(age_from) AS age_from, max(age_to) AS age_to, max(key) FILTER (rn = 1) AS primary_key,
  max(key) FILTER (rn = 2) AS secondary_key FROM banded GROUP BY 1, 2)"""
SQL |= {
    "ag1_dominant_rate_type": f"WITH {LAYOUTS} SELECT * FROM layouts",
    "ag2_weighted_rate_type_vote": f"""
WITH votes AS (SELECT p.contract_id, p.detected_rate_type, CAST(sum(greatest(coalesce(r.n, 0), 1)) AS BIGINT) AS votes, min(p.part_idx) AS f
  FROM parts p LEFT JOIN (SELECT contract_id, part_idx, count(*) AS n FROM rates WHERE {ANY_PRICE} GROUP BY 1, 2) r USING (contract_id, part_idx)
  GROUP BY 1, 2)
SELECT contract_id, detected_rate_type, votes FROM votes QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY votes DESC, f) = 1""",
    "ag3_aggregate_contract": f"""
WITH firsts AS (SELECT * FROM part_hotels WHERE {x.fold('hotel')} <> ''
  QUALIFY row_number() OVER (PARTITION BY contract_id, {x.fold('hotel')} ORDER BY part_idx, ord) = 1)
SELECT 'hotels' AS part, contract_id, hotel, ord, count(*) OVER (PARTITION BY contract_id) > 1 AS is_multi_hotel, NULL AS room, NULL AS season, NULL AS meal, NULL AS position FROM firsts
UNION ALL SELECT 'rates', contract_id, hotel, ord, NULL, room, season, meal, NULL FROM rates
UNION ALL SELECT 'child_bands', contract_id, hotel, ord, NULL, NULL, NULL, NULL, position FROM child_bands""",
    "ag4_room_base_rate": f"WITH {BASE_RATES.format(rates='rates')} SELECT contract_id, hotel, room, {x.dbl('base_rate')} AS base_rate, {x.dbl('fallback')} AS fallback FROM room_base",
    "ag5_child_column_type_detect": f"WITH {COLUMNS}, {typed_columns(ROW_VALUES)} SELECT contract_id, key, value_type FROM tcols",
    "ag6_band_assignment": f"WITH {BAND_KEYS} SELECT contract_id, band, {x.dbl('age_from')} AS age_from, {x.dbl('age_to')} AS age_to, primary_key AS \"primary\", secondary_key AS secondary FROM bands",
    "ag7_cell_audit_stats": f"""
WITH {UNMAPPED}
SELECT contract_id, CAST(coalesce(c.n, 0) AS BIGINT) AS source_price_cells, CAST(coalesce(m.n, 0) AS BIGINT) AS mapped_price_values,
  CAST(coalesce(u.n, 0) AS BIGINT) AS unmapped_cells, CAST(r.n AS BIGINT) AS rows_without_prices
FROM (SELECT contract_id, count(*) FILTER (room <> '' AND NOT ({PRICED})) AS n FROM rows GROUP BY 1) r
LEFT JOIN (SELECT contract_id, count(*) AS n FROM price_cells GROUP BY 1) c USING (contract_id)
LEFT JOIN (SELECT contract_id, count(price) AS n FROM mapped GROUP BY 1) m USING (contract_id)
LEFT JOIN (SELECT contract_id, count(*) AS n FROM unmapped GROUP BY 1) u USING (contract_id)""",
    "ag8_unmapped_notes": f"""
WITH {UNMAPPED}
SELECT contract_id, doc_id AS page, 'Rate anomaly' AS category, 'Source table on ' || doc_id || ' column ''' || col_name || ''' contained ' ||
  CAST(max(n) AS VARCHAR) || ' numeric value(s) that no Hotel row used: ' || string_agg('''' || raw || '''', ', ' ORDER BY place) ||
  CASE WHEN max(n) > 8 THEN ' (+' || (max(n) - 8) || ' more)' ELSE '' END || '. Cross-check the rate table and add or correct the rows manually if needed.' AS note, CAST(0.3 AS DOUBLE) AS confidence
FROM (SELECT *, count(*) OVER (PARTITION BY contract_id, doc_id, col_name) AS n,
  row_number() OVER (PARTITION BY contract_id, doc_id, col_name ORDER BY table_idx, row_idx) AS place FROM unmapped)
WHERE place <= 8 GROUP BY contract_id, doc_id, col_name""",
}
DIMENSIONS = r"""dims AS (
  SELECT contract_id, doc_id, table_idx, count(DISTINCT col_name) FILTER (col_name IN ('Double room', 'Single')) AS rooms,
    count(DISTINCT CASE WHEN regexp_matches(raw, '\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}') THEN regexp_replace(trim(raw), '\s+', ' ', 'g') END) AS periods,
    count(DISTINCT CASE WHEN upper(trim(raw)) IN ('BB', 'HB', 'FB', 'AI', 'RO', 'UAI') THEN upper(trim(raw)) END) AS boards
  FROM source_cells GROUP BY 1, 2, 3)"""
SQL["ag9_rate_dimensions"] = f"WITH {DIMENSIONS} SELECT contract_id, doc_id, table_idx, CAST(rooms AS BIGINT) AS rooms, CAST(periods AS BIGINT) AS periods, CAST(boards AS BIGINT) AS boards FROM dims"
SQL["ag10_completeness"] = f"""
WITH {DIMENSIONS}, made AS (
  SELECT contract_id, unnest(CASE WHEN sheet = 'Pages:1-2' THEN ['Page:1', 'Page:2'] ELSE [sheet] END) AS doc_id FROM rows),
sized AS (SELECT d.contract_id, d.doc_id, d.rooms, d.periods, d.boards, d.rooms * d.periods * d.boards AS expected, coalesce(m.n, 0) AS actual
  FROM dims d JOIN page_docs p ON p.contract_id = d.contract_id AND p.doc_id = d.doc_id AND p.classification = 'hotel_contract'
  LEFT JOIN (SELECT contract_id, doc_id, count(*) AS n FROM made GROUP BY 1, 2) m ON m.contract_id = d.contract_id AND m.doc_id = d.doc_id
  WHERE d.rooms >= 2 AND d.periods >= 1 AND d.boards >= 1)
SELECT contract_id, doc_id AS page, 'Detected a rate table on ' || doc_id || ' with ' || rooms || ' room column(s), ' || periods || ' period(s) and ' ||
  boards || ' board plan(s) — expected up to ' || expected || ' Hotel rows but only ' || actual || ' were generated (' || (expected - actual) ||
  ' missing). Review the source preview and add the missing rows by hand, or re-run with Force Vision and a different DPI.' AS note,
  CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual
FROM sized WHERE actual < floor(expected * 0.5)"""
SQL |= {
    "ag11_merge_summary": "SELECT contract_id, coalesce(round(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(confidence), 3), 0.5) AS overall_confidence, arg_min(source_file, part_idx) FILTER (source_file <> '') AS source_file, arg_min(input_format, part_idx) FILTER (input_format <> '') AS input_format FROM parts GROUP BY 1",
    "ag11_merged_sheet_lists": "SELECT contract_id, 'sheets' AS list, sheet AS entry, min(ord) AS first_ord FROM rows GROUP BY 1, 3",
    "ag12_merge_hotels": """
SELECT 'hotels' AS part, contract_id, coalesce(nullif(hotel, ''), 'Unknown Hotel') AS hotel, arg_min(city_area, (part_idx, ord)) FILTER (city_area <> '') AS city_area,
  arg_min(phone, (part_idx, ord)) FILTER (phone <> '') AS phone, min(part_idx) AS first_part, arg_min(ord, (part_idx, ord)) AS first_ord, NULL AS entry, NULL AS ord
FROM part_hotels GROUP BY 1, 2, 3
UNION ALL SELECT 'rate_blocks', contract_id, coalesce(nullif(hotel, ''), 'Unknown Hotel'), NULL, NULL, NULL, NULL, room || '/' || season || '/' || meal, ord FROM rates
UNION ALL SELECT 'rooms', contract_id, coalesce(nullif(hotel, ''), 'Unknown Hotel'), NULL, NULL, NULL, NULL, room, ord FROM rooms
UNION ALL SELECT 'child_policies', contract_id, coalesce(nullif(hotel, ''), 'Unknown Hotel'), NULL, NULL, NULL, NULL, position, ord FROM child_bands""",
    "ag13_usage_totals": "SELECT contract_id, counter, CAST(sum(n) AS BIGINT) AS total FROM (SELECT contract_id, 'prompt_tokens' AS counter, prompt_tokens AS n FROM usage UNION ALL SELECT contract_id, 'completion_tokens', completion_tokens FROM usage) WHERE n IS NOT NULL GROUP BY 1, 2",
    "ag14_sheet_summary": """
SELECT d.contract_id, d.doc_id, CASE WHEN d.classification IN ('hotel_contract', 'index_reference') THEN d.classification ELSE 'other' END AS classification,
  coalesce(r.hotel, '—') AS hotel, CAST(coalesce(r.n, 0) AS BIGINT) AS rows, CAST(coalesce(r.n, 0) AS BIGINT) AS notes
FROM page_docs d LEFT JOIN (SELECT contract_id, sheet, count(*) AS n, arg_min_null(hotel, ord) AS hotel FROM rows GROUP BY 1, 2) r
  ON r.contract_id = d.contract_id AND r.sheet = d.doc_id""",
    "ag15_summary_cards": """
SELECT contract_id, CAST(d.h AS BIGINT) AS hotel_sheets, CAST(d.i AS BIGINT) AS index_sheets, CAST(d.n AS BIGINT) AS sheets, CAST(r.n AS BIGINT) AS hotel_rows,
  CAST(c.n AS BIGINT) AS child_columns, CAST(s.n AS BIGINT) AS notes, CAST(coalesce(q.e, 0) AS BIGINT) AS errors, CAST(coalesce(q.w, 0) AS BIGINT) AS warnings,
  r.a AS avg_confidence
FROM (SELECT contract_id, count(*) FILTER (classification = 'hotel_contract') AS h, count(*) FILTER (classification = 'index_reference') AS i, count(*) AS n FROM page_docs GROUP BY 1) d
JOIN (SELECT contract_id, count(*) AS n, round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(*), 2) AS a FROM rows GROUP BY 1) r USING (contract_id)
JOIN (SELECT contract_id, count(*) AS n FROM child_columns GROUP BY 1) c USING (contract_id)
JOIN (SELECT contract_id, count(*) AS n FROM source_cells GROUP BY 1) s USING (contract_id)
LEFT JOIN (SELECT contract_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM issues GROUP BY 1) q USING (contract_id)""",
    "ag16_grouped_issues": "SELECT contract_id, CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS BIGINT) AS group_rank, severity, row_id, hotel, sheet, message, field FROM issues WHERE severity IN ('error', 'warning', 'info')",
    "ag22_failed_chunks": "SELECT contract_id, chunk_idx, CAST(0 AS BIGINT) AS place, error FROM usage WHERE error IS NOT NULL",
    "ag16_issues_by_severity": "SELECT contract_id, severity, CAST(count(*) AS BIGINT) AS issues FROM issues GROUP BY 1, 2",
    "ag17_season_agg": """
SELECT contract_id, coalesce(start_date, '') AS start_date, coalesce(end_date, '') AS end_date, coalesce(nullif(season, ''), nullif(rate_plan, ''), '') AS name,
  coalesce(days, '') AS days, min_stay, release_period, ord AS first_ord FROM rows
QUALIFY row_number() OVER (PARTITION BY contract_id, coalesce(start_date, ''), coalesce(end_date, '') ORDER BY ord) = 1""",
    "ag18_room_agg": """
SELECT contract_id, coalesce(nullif(room, ''), '(unnamed room)') AS room, coalesce(hotel, '') AS hotel, coalesce(bed_type, '') AS bed_type, min_adult, max_adult,
  max_pax, max_rollaways, max_cribs, ord AS first_ord FROM rows
QUALIFY row_number() OVER (PARTITION BY contract_id, coalesce(nullif(room, ''), '(unnamed room)') ORDER BY ord) = 1""",
    "ag19_distinct_counts": "SELECT contract_id, CAST(count(DISTINCT coalesce(room, chr(0))) AS BIGINT) AS rooms, CAST(count(DISTINCT nullif(meal_plan, '')) AS BIGINT) AS meals, CAST(count(DISTINCT coalesce(nullif(hotel, ''), 'Unknown Hotel')) AS BIGINT) AS hotels FROM rows GROUP BY 1",
    "ag20_export_summary": f"""
WITH {COLUMNS} SELECT contract_id, CAST(r.n AS BIGINT) AS hotel_rows, CAST(coalesce(i.n, 0) AS BIGINT) AS notes, CAST(c.n AS BIGINT) AS child_columns, CAST(48 + c.n AS BIGINT) AS headers
FROM (SELECT contract_id, count(*) AS n FROM rows GROUP BY 1) r LEFT JOIN (SELECT contract_id, count(*) AS n FROM issues GROUP BY 1) i USING (contract_id)
JOIN (SELECT contract_id, count(*) AS n FROM ncols GROUP BY 1) c USING (contract_id)""",
    "ag22_chunk_failure_notes": "SELECT contract_id, CAST(count(*) AS BIGINT) AS failed, 'Source ambiguity' AS category, CAST(count(*) AS VARCHAR) || ' extraction chunk(s) failed: ' || string_agg('chunk ' || chunk_idx || ': ' || error, '; ' ORDER BY chunk_idx) AS note FROM usage WHERE error IS NOT NULL GROUP BY 1",
}
FLAGGED = f"""flagged AS (SELECT *, {scrambled('text')} AS scrambled, {x.contained('lower(text)', RATE_WORDS)} AS hits, length(trim(text)) < 20 AND n_tables = 0 AS empty FROM pdf_pages),
marked AS (SELECT *, hits >= 3 AND NOT has_numeric_table AS thin FROM flagged)"""
SQL["ag21_pdf_strategy"] = f"""
WITH {FLAGGED}, counted AS (SELECT contract_id, count(*) AS pages, count(*) FILTER (empty) AS e, count(*) FILTER (scrambled) AS s, count(*) FILTER (thin) AS t,
  bool_or(has_numeric_table) AS u, sum(hits) AS h FROM marked GROUP BY 1)
SELECT contract_id, CAST(pages AS BIGINT) AS pages, CAST(e AS BIGINT) AS empty_pages, CAST(s AS BIGINT) AS scrambled_pages, CAST(h AS BIGINT) AS token_hits,
  CASE WHEN e >= greatest(1, floor(pages * 0.6)) THEN 'vision_only' WHEN s > 0 OR t > 0 THEN 'two_call_vision' WHEN u AND h >= 3 THEN 'native_text_llm'
    ELSE 'two_call_vision' END AS strategy FROM counted"""
SQL["t4_page_vision_flags"] = f"""
WITH {FLAGGED} SELECT page_id, empty OR scrambled OR thin AS needs_vision, concat_ws(' | ', CASE WHEN empty THEN 'empty_page' END,
  CASE WHEN scrambled THEN 'scrambled_text' END, CASE WHEN thin THEN 'rate_tokens_without_numeric_table' END) AS vision_reasons, scrambled, hits AS rate_token_hits
FROM marked"""

# ---- windows and ordered rows, limits --------------------------------------------------------------------------------

N_FILLED = "(CAST(sgl IS NOT NULL AS INT) + CAST(dbl IS NOT NULL AS INT) + CAST(tpl IS NOT NULL AS INT) + CAST(qdp IS NOT NULL AS INT))"
BEST_RATES = f"SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY {CELL} ORDER BY {N_FILLED} DESC, ord) = 1"
FIRST_BANDS = "SELECT * FROM child_bands QUALIFY row_number() OVER (PARTITION BY contract_id, hotel, position, age_from, age_to, value_type, value ORDER BY ord) = 1"
BEST_SUPPLEMENTS = f"""SELECT * FROM supplements QUALIFY row_number() OVER (PARTITION BY contract_id, {x.fold('hotel')}, {x.fold('season_label')},
  coalesce(supplier_cost, customer_price), kind, charge_type, calculation_method, traveler_type, ordinal, age_min, age_max, start_date, end_date
  ORDER BY CAST(supplier_cost IS NOT NULL AS INT) + CAST(customer_price IS NOT NULL AS INT) + CAST(coalesce(name, '') <> '' AS INT) DESC, ord) = 1"""
FIRST_SEASONS = f"SELECT * FROM seasons_repeated QUALIFY row_number() OVER (PARTITION BY contract_id, hotel, {LABEL.format('label')}, start_date, end_date ORDER BY ord) = 1"
KEPT_SEASONS = f"first_seasons AS ({FIRST_SEASONS}), kept_seasons AS ({contained_seasons('first_seasons')})"
SQL |= {
    "w1_dedup_rates": f"SELECT {CELL}, ord, {PRICES} FROM ({BEST_RATES})",
    "w2_dedup_seasons": f"WITH {KEPT_SEASONS} SELECT contract_id, hotel, label, ord FROM kept_seasons",
    "w2_relabel_rates": f"""
WITH {KEPT_SEASONS}, labels AS (SELECT contract_id, hotel, {LABEL.format('label')} AS n, arg_max(label, ord) AS label FROM kept_seasons GROUP BY 1, 2, 3)
SELECT r.ord, coalesce(l.label, r.s) AS season FROM (SELECT *, CASE WHEN part_idx = 0 THEN ' ' || lower(season) ELSE season END AS s FROM rates) r
LEFT JOIN labels l ON l.contract_id = r.contract_id AND l.hotel = r.hotel AND l.n = {LABEL.format('r.s')}""",
    "w3_dedup_bands": f"SELECT contract_id, hotel, ord FROM ({FIRST_BANDS})",
    "w4_dedup_supplements": f"SELECT contract_id, hotel, ord FROM ({BEST_SUPPLEMENTS})",
    "w5_dedup_notes": f"SELECT contract_id, note_id FROM notes QUALIFY row_number() OVER (PARTITION BY contract_id, coalesce(source_file, ''), coalesce(page, ''), coalesce(category, ''), {x.fold('note')} ORDER BY ord) = 1",
    "w6_dedup_child_columns": "SELECT contract_id, key, label, ord FROM child_columns WHERE coalesce(nullif(key, ''), nullif(label, '')) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contract_id, coalesce(nullif(key, ''), nullif(label, '')) ORDER BY ord) = 1",
    "w6_dedup_child_columns_named": "SELECT contract_id, coalesce(nullif(key, ''), nullif(label, ''), 'CHD(Unknown)') AS key, coalesce(label, nullif(key, ''), 'CHD(Unknown)') AS label, ord FROM child_columns QUALIFY row_number() OVER (PARTITION BY contract_id, coalesce(nullif(child_columns.key, ''), nullif(child_columns.label, ''), 'CHD(Unknown)') ORDER BY ord) = 1",
}


def slots(view: str, group: str, demote: bool) -> str:
    ordinal = "CASE position WHEN 'first_child' THEN 1 WHEN 'second_child' THEN 2 WHEN 'third_child' THEN 3 END"
    loose = "slot IS NULL OR rn > 1" if demote else "slot IS NULL"
    on = " AND ".join(f"u.{c} = l.{c}" for c in group.split(", "))
    return f"""slotted AS (SELECT *, row_number() OVER (PARTITION BY {group}, slot ORDER BY ord) AS rn FROM (SELECT *, {ordinal} AS slot FROM {view})),
named AS (SELECT * FROM slotted WHERE slot IS NOT NULL AND rn = 1),
used AS (SELECT {group}, list(slot) AS u FROM named GROUP BY ALL),
dealt AS (SELECT l.* EXCLUDE (slot, rn, place, u, cut), list_filter([1, 2, 3], lambda n: NOT list_contains(coalesce(l.u, CAST([] AS INT[])), n))[l.place] AS slot
  FROM (SELECT l.*, u.u, 1 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY ord) AS place FROM slotted WHERE {loose}) l LEFT JOIN used u ON {on}) l WHERE place <= 3),
slotted_all AS (SELECT * EXCLUDE (rn) FROM named UNION ALL BY NAME SELECT * FROM dealt WHERE slot IS NOT NULL)"""


KEYED_COLUMNS = "keyed_columns AS (SELECT * FROM child_columns WHERE key <> '')"
SQL["w7_position_assignment"] = f"WITH {KEYED_COLUMNS}, {slots('keyed_columns', 'contract_id', True)} SELECT contract_id, slot, key, ord, {x.dbl('age_from')} AS age_from, {x.dbl('age_to')} AS age_to FROM slotted_all"
SQL["w7_band_positions"] = f"WITH {slots('child_bands', 'contract_id, hotel', False)} SELECT contract_id, hotel, slot, ord FROM slotted_all"

MARKERS = ("contract rate", "booking window", "early booking", "ebd", "spo", "special offer", "promotion", "winter season", "summer season", "shoulder season", "high season", "low season")
COLUMN_WORDS = ("from", "to", "release", "supplement", "reduction", "1st child", "2nd child", "3rd child", "extra adult", "child policy", "room type", "occupancies", "min pax", "max pax", "min adults", "max adults")
SHEET_CLASS = f"""read_cells AS (SELECT *, lower(trim(value_str)) AS t FROM cells WHERE trim(value_str) <> ''
  ),
hits AS (SELECT contract_id, doc_id, count(DISTINCT t) FILTER (t IN {words(HEADER_WORDS)}) AS rate_hits, count(DISTINCT t) FILTER (t IN {words(NOTE_WORDS)}) AS note_hits
  FROM read_cells GROUP BY 1, 2),
names AS (SELECT contract_id, doc_id, arg_min(trim(value_str), (row_idx, col_idx)) AS hotel FROM cells WHERE
  regexp_matches(value_str, '{HOTEL_WORDS}') AND length(trim(value_str)) <= 80 GROUP BY 1, 2),
classes AS (SELECT h.contract_id, h.doc_id, h.rate_hits, h.note_hits, CASE WHEN regexp_matches(lower(h.doc_id), 'hotel list|index|summary|contents|hotels|table of contents') THEN 'index_reference'
    WHEN h.rate_hits >= 3 THEN 'hotel_contract' WHEN regexp_matches(substr(h.doc_id, 7), '{HOTEL_WORDS}') THEN 'hotel_contract'
    WHEN h.note_hits >= 3 AND h.rate_hits < 2 THEN 'support_notes' ELSE 'unknown' END AS classification,
  CASE WHEN regexp_matches(lower(h.doc_id), 'hotel list|index|summary|contents|hotels|table of contents') THEN NULL ELSE n.hotel END AS detected_hotel_name
  FROM hits h LEFT JOIN names n USING (contract_id, doc_id))"""


def block_rows(gate: str) -> str:
    return f"""sheet_row AS (SELECT contract_id, doc_id, row_idx, lower(string_agg(value_str, ' | ' ORDER BY col_idx)) AS t,
  count(*) FILTER (abs(value_num) BETWEEN 5 AND 50000) AS nums, count(*) FILTER (trim(value_str) <> '') AS filled FROM cells GROUP BY 1, 2, 3),
opened AS (SELECT r.*, CAST(trim(t) <> '' AND nums < 3 AND NOT (filled >= 5 AND {x.contained('t', COLUMN_WORDS)} >= 2) AND
  ({' OR '.join(f"contains(t, '{m}')" for m in MARKERS)} OR regexp_matches(t, '(^|[^a-z0-9])bw([^a-z0-9]|$)')) AND {gate} AS INT) AS o
  FROM sheet_row r JOIN classes c USING (contract_id, doc_id)),
placed AS (SELECT *, sum(o) OVER d AS b, sum(o) OVER (PARTITION BY contract_id, doc_id) AS n, min(row_idx) FILTER (o = 1) OVER (PARTITION BY contract_id, doc_id) AS first_row FROM opened
  WINDOW d AS (PARTITION BY contract_id, doc_id ORDER BY row_idx)),
heads AS (SELECT contract_id, doc_id, b, trim(t) AS title, row_idx AS start_row FROM placed WHERE o = 1),
block_row AS (
  SELECT p.contract_id, p.doc_id, p.row_idx, p.b - 1 AS block_idx, h.title, false AS is_preamble, p.first_row + p.row_idx - h.start_row + 1 AS line, p.n AS block_count
  FROM placed p JOIN heads h ON h.contract_id = p.contract_id AND h.doc_id = p.doc_id AND h.b = p.b
  UNION ALL SELECT p.contract_id, p.doc_id, p.row_idx, h.b - 1, h.title, true, p.row_idx + 1, p.n FROM placed p JOIN heads h ON h.contract_id = p.contract_id
    AND h.doc_id = p.doc_id WHERE p.b = 0
  UNION ALL SELECT contract_id, doc_id, row_idx, 0, NULL, false, row_idx + 1, NULL FROM placed WHERE n = 0)"""


CLEAN_CELL = x.strip("regexp_replace(replace(value_str, chr(9), ' '), '\\r?\\n', ' / ', 'g')")


def line_text(source: str, group: str, line: str) -> str:
    """Rendered lines per group: CTEs ``shown``, ``rendered(group, line, text, width)``."""
    return f"""shown AS (SELECT {group}, {line} AS line, col_idx, {CLEAN_CELL} AS v FROM {source} WHERE {CLEAN_CELL} <> ''),
widths AS (SELECT {group}, max(col_idx) + 1 AS width FROM shown GROUP BY ALL),
numbered AS (SELECT DISTINCT {group}, line, width FROM shown JOIN widths USING ({group})),
places AS (SELECT *, unnest(range(width)) AS col_idx FROM numbered),
bodies AS (SELECT {group}, line, width, string_agg(coalesce(v, ''), chr(9) ORDER BY col_idx) AS body
  FROM places LEFT JOIN shown USING ({group}, line, col_idx) GROUP BY {group}, line, width),
rendered AS (SELECT {group}, line, width, CAST(line AS VARCHAR) || chr(9) || body AS text FROM bodies)"""


def in_chunks(group: str, name: str) -> str:
    """CTEs ``chunked(group, chunk, text)``: the rendered lines of each group under their headings, cut at line starts."""
    letters = "array_to_string(list_transform(range(max(width)), lambda i: chr(CAST(65 + i AS INT))), chr(9))"
    return f"""headed AS (SELECT {group}, 0 AS line, '=== Sheet: ' || regexp_replace({name}, '^Sheet:', '') || ' ===' || chr(10) || 'Row' || chr(9) || {letters} AS text
  FROM rendered GROUP BY {group} UNION ALL SELECT {group}, line, chr(10) || text FROM rendered),
measured AS (SELECT *, (sum(length(text)) OVER (PARTITION BY {group} ORDER BY line) - length(text)) // {CHUNK} AS chunk FROM headed),
chunked AS (SELECT {group}, CAST(chunk AS BIGINT) AS chunk, string_agg(text, '' ORDER BY line) AS text FROM measured GROUP BY {group}, chunk)"""


DELTAS = """meal_cells AS (SELECT contract_id, hotel, room, season, meal, arg_max_null(coalesce(dbl, sgl), ord) AS amount, min(ord) AS ord FROM {rates} GROUP BY ALL),
deltas AS (SELECT * FROM (SELECT *, first_value(meal) OVER w AS base_meal, first_value(amount) OVER w AS base_amount,
  count(*) OVER (PARTITION BY contract_id, hotel, room, season) AS n FROM meal_cells
  WINDOW w AS (PARTITION BY contract_id, hotel, room, season ORDER BY amount NULLS LAST, ord)) WHERE n >= 2 AND amount > base_amount)"""
PRIORITY = "CASE classification WHEN 'hotel_contract' THEN 0 WHEN 'index_reference' THEN 1 ELSE 2 END"
MATCHED_DATE = r"(?:\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4})"
# Digits on either side rule a match out; a leading and a trailing character are matched along and cut off again.
DATE_LIST = f"""found_dates AS (
  SELECT contract_id, doc_id, list_filter(list_transform(list_concat(
      list_transform(regexp_extract_all(replace(raw_excerpt, ' ', '  '), '(?:^|[^0-9])({MATCHED_DATE})(?:$|[^0-9])', 1), lambda d: d),
      regexp_extract_all(replace(raw_excerpt, ' ', '  '), '(?:^|[^0-9])([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})(?:$|[^0-9])', 1)),
    lambda d: {x.strict_date('d')}), lambda d: d IS NOT NULL) AS dates FROM text_docs),
date_pair AS (SELECT contract_id, doc_id, i AS pair_ord, dates[2 * i + 1] AS start_date, dates[2 * i + 2] AS end_date
  FROM (SELECT *, unnest(range(len(dates) // 2)) AS i FROM found_dates))"""
TRIGGERS = {
    "Taxes/service": "tax(?:es)?|service charge|VAT|municipality", "Cancellation": "cancellation|no[- ]show|no show|early departure",
    "Gala dinner": "gala|christmas|new ?year", "Special offer": "special offer|promotion|free night|stay pay",
    "Booking window": "booking window|EBD|early booking", "Minimum stay": "min(?:imum)? stay|MLOS",
    "Child policy": "child policy|free of charge|FOC|infant",
}
DOC_HOTEL = "coalesce(nullif(detected_hotel_name, ''), CASE WHEN kind = 'excel_sheet' THEN regexp_replace(doc_id, '^Sheet:', '') END, 'Unknown Hotel')"
TRIGGER_NOTES = "trigger_note AS (SELECT contract_id, doc_id, classification, hotel, category, " \
    + f"replace({x.strip('substr(raw_excerpt, greatest(s - 40, 0) + 1, s + length(w) + 80 - greatest(s - 40, 0))')}, chr(10), ' ') AS note FROM (" \
    + " UNION ALL ".join(
        f"SELECT contract_id, doc_id, classification, {DOC_HOTEL} AS hotel, raw_excerpt, '{c}' AS category, "
        rf"length(regexp_extract(raw_excerpt, '(?is)^((?:.*?[^\p{{L}}\p{{N}}_])?)(?:{p}){x.END}', 1)) AS s, "
        rf"regexp_extract(raw_excerpt, '(?is)^(?:.*?[^\p{{L}}\p{{N}}_])?({p}){x.END}', 1) AS w "
        rf"FROM text_docs WHERE regexp_matches(raw_excerpt, '(?i){x.EDGE}(?:{p}){x.END}')"
        for c, p in TRIGGERS.items()
    ) + "))"
SQL |= {
    "w8_rate_block_segmentation": f"WITH {SHEET_CLASS}, {block_rows('true')} SELECT contract_id, doc_id, row_idx, CAST(block_idx AS BIGINT) AS block_idx, title, is_preamble, CAST(line AS BIGINT) AS line, CAST(block_count AS BIGINT) AS block_count FROM block_row",
    "w9_meal_upgrade_delta": f"WITH {DELTAS.format(rates='rates')} SELECT {CELL}, base_meal, {x.dbl('amount - base_amount')} AS delta FROM deltas",
    "w10_chunk_assignment": """
WITH h AS (SELECT contract_id, doc_id, (row_number() OVER (PARTITION BY contract_id ORDER BY ord) - 1) // 3 AS chunk_idx FROM text_docs WHERE classification = 'hotel_contract'),
n AS (SELECT contract_id, max(chunk_idx) AS m FROM h GROUP BY 1)
SELECT contract_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, doc_id FROM h
UNION ALL SELECT contract_id, CAST(CASE WHEN classification = 'unknown' THEN 0 ELSE c END AS BIGINT), doc_id FROM (
  SELECT d.*, unnest(CASE WHEN d.classification = 'unknown' THEN [0] ELSE range(coalesce(n.m, 0) + 1) END) AS c FROM text_docs d LEFT JOIN n USING (contract_id)
  WHERE d.classification <> 'hotel_contract')""",
    "w12_date_pairs": f"WITH {DATE_LIST} SELECT contract_id, doc_id, pair_ord, start_date, end_date FROM date_pair",
    "w13_first_three_periods": f"WITH {DATE_LIST} SELECT contract_id, doc_id, pair_ord, start_date, end_date FROM date_pair WHERE pair_ord < 3",
    "w15_first_seen_order": "SELECT contract_id, coalesce(nullif(hotel, ''), 'Unknown Hotel') AS hotel, min(ord) AS first_ord FROM rows GROUP BY 1, 2",
    "w16_detected_hotel_name": f"WITH {SHEET_CLASS} SELECT contract_id, doc_id, hotel AS detected_hotel_name FROM names",
    "w17_note_first_match": f"WITH {TRIGGER_NOTES} SELECT contract_id, doc_id, category, note, hotel FROM trigger_note",
    "st1_sort_child_columns": f"SELECT contract_id, key, label, {x.dbl('age_from')} AS age_from, row_number() OVER (PARTITION BY contract_id ORDER BY age_from NULLS LAST, age_to NULLS LAST, {POSITION_ORDER}, coalesce(nullif(label, ''), nullif(key, ''), ''), ord) AS ord FROM child_columns",
    "st2_missing_preview": f"""
WITH {MISSING}, placed AS (SELECT *, count(*) OVER (PARTITION BY contract_id, hotel) AS n,
  row_number() OVER (PARTITION BY contract_id, hotel ORDER BY room_ord, season_ord, meal_ord, room, season, meal) AS place FROM missing)
SELECT contract_id, hotel, CAST(max(n) AS BIGINT) AS missing, string_agg('(''' || room || ''', ''' || season || ''', ''' || meal || ''')', '; ' ORDER BY place) || '.' ||
  CASE WHEN max(n) > 60 THEN ' Plus ' || (max(n) - 60) || ' more (room, season, meal_code) combinations following the same pattern.' ELSE '' END AS text
FROM placed WHERE place <= 60 GROUP BY 1, 2""",
    "st2_retry_triples": f"WITH {MISSING} SELECT contract_id, hotel, room_ord, season_ord, meal_ord, '(''' || room || ''', ''' || season || ''', ''' || meal || ''')' AS triple FROM missing",
    "st3_sample_8": "SELECT contract_id, doc_id, col_name, table_idx, row_idx, raw FROM source_cells",
    "st4_doc_priority": f"SELECT contract_id, doc_id, CAST({PRIORITY} AS BIGINT) AS priority FROM text_docs",
}

# ---- supplement sheets -----------------------------------------------------------------------------------------------

SUPPLEMENT_NUMBERS = {"min_age": "DOUBLE", "max_age": "DOUBLE", "min_stay": "BIGINT", "max_stay": "BIGINT", "standard_count_index": "BIGINT", "min_adult": "BIGINT", "max_adult": "BIGINT", "max_child": "BIGINT"}


def supplement_select(values: dict[str, str], source: str) -> str:
    values = {"display_on_customer_documentation": "'Yes'", "display_on_supplier_notification": "'Yes'", **values}
    columns = ", ".join(f"CAST({values.get(n, 'NULL')} AS {SUPPLEMENT_NUMBERS.get(n, 'VARCHAR')}) AS {n}" for n in SUPPLEMENT_HEADERS)
    marked = f"CASE WHEN {x.has_ai('h.supplier')} AND {x.no_ai('h.supplier')} <> '' THEN 'Supplier' ELSE '' END AS ai_fields"
    return f"SELECT contract_id, {columns}, {marked} FROM {source}"


HOTEL_VALUES = {
    "hotel": "hotel", "hotel_code": f"CASE WHEN h.ord IS NOT NULL THEN {x.hotel_code('hotel', 'h.code')} END", "supplier": x.no_ai("h.supplier"),
    "currency": "coalesce(nullif(h.currency, ''), 'EUR')", "min_adult": "r.min_adult", "max_adult": "r.max_adult", "max_child": "r.max_children",
}


def cost(c: str) -> str:
    return f"CASE WHEN s.cost_format = 'percentage' THEN {x.g(c)} || '%' ELSE CAST({c} AS VARCHAR) END"


def contract_supplements(view: str) -> str:
    return supplement_select({
        **HOTEL_VALUES, "supplement_code": "s.code", "supplement_name": "s.name", "rooms": "coalesce(nullif(s.rooms, ''), 'ALL')", "rate_plans": "s.rate_plans",
        "min_stay": "s.min_stay", "max_stay": "s.max_stay", "supplement_type": x.supplement_type("s.kind", "s.name", "s.description"),
        "display_as_separate_room": "coalesce(nullif(s.display_as_separate_room, ''), 'No')", "description": "s.description",
        "contract_period": "s.contract_period", "season_name": "s.season_label", "start_date": x.day_first("s.start_date"), "end_date": x.day_first("s.end_date"),
        "charge_type": "s.charge_type", "calculation_method": "s.calculation_method", "traveler_type": "s.traveler_type",
        "fare_type_name": "CASE WHEN s.calculation_method = 'Standard' THEN 'Per ' || s.traveler_type ELSE s.fare_type_name END",
        "standard_count_index": "CASE WHEN s.calculation_method = 'Standard' AND s.charge_type = 'Per Person Per Night' THEN NULL ELSE s.ordinal END",
        "min_age": "s.age_min", "max_age": "s.age_max", "supplier_cost": cost("s.supplier_cost"), "customer_price": cost("coalesce(s.customer_price, s.supplier_cost)"),
    }, f"(SELECT * FROM {view} WHERE {SCOPED}) s LEFT JOIN hotels h USING (contract_id, hotel) LEFT JOIN rooms r USING (contract_id, hotel) WHERE r.room = s.rooms OR r.room IS NULL".replace(
        "LEFT JOIN rooms r USING (contract_id, hotel) WHERE r.room = s.rooms OR r.room IS NULL",
        "LEFT JOIN (SELECT *, room AS rooms FROM rooms) r USING (contract_id, hotel, rooms)",
    )).replace("s.rooms", "rooms")


def upgrade_rows(rates: str) -> tuple[str, str]:
    name = "coalesce(nullif(m.canonical, ''), d.meal)"
    return DELTAS.format(rates=rates), supplement_select({
        **HOTEL_VALUES, "supplement_code": "'SUP-' || d.meal", "supplement_name": f"{name} || ' upgrade'", "rooms": "room", "min_stay": "s.min_stay",
        "supplement_type": "'Exclusive'", "display_as_separate_room": "'No'", "description": f"{name} || ' supplement over ' || coalesce(b.canonical, d.base_meal)",
        "season_name": "d.season", "start_date": x.day_first("s.start_date"), "end_date": x.day_first("s.end_date"), "charge_type": "'Per Person Per Night'",
        "calculation_method": "'Standard'", "traveler_type": "'Adult'", "fare_type_name": "'Per Adult'", "supplier_cost": "d.amount - d.base_amount",
        "customer_price": "d.amount - d.base_amount",
    }, """deltas d SEMI JOIN (SELECT contract_id, hotel FROM meals GROUP BY 1, 2 HAVING count(*) >= 2) q USING (contract_id, hotel)
  LEFT JOIN meals m ON m.contract_id = d.contract_id AND m.hotel = d.hotel AND m.code = d.meal
  LEFT JOIN meals b ON b.contract_id = d.contract_id AND b.hotel = d.hotel AND b.code = d.base_meal
  LEFT JOIN seasons s ON s.contract_id = d.contract_id AND s.hotel = d.hotel AND s.label = d.season
  JOIN hotels h ON h.contract_id = d.contract_id AND h.hotel = d.hotel LEFT JOIN rooms r ON r.contract_id = d.contract_id AND r.hotel = d.hotel AND r.room = d.room
""").replace("SELECT contract_id, CAST(hotel AS", "SELECT d.contract_id, CAST(d.hotel AS").replace(x.hotel_code("hotel", "h.code"), x.hotel_code("h.hotel", "h.code")).replace("CAST(room AS", "CAST(d.room AS")


def child_policy(bands: str, rates: str) -> tuple[str, str]:
    index = "CASE b.position WHEN 'first_child' THEN 1 WHEN 'second_child' THEN 2 WHEN 'third_child' THEN 3 ELSE b.place END"
    label = "CASE b.position WHEN 'first_child' THEN '1st Child' WHEN 'second_child' THEN '2nd Child' WHEN 'third_child' THEN '3rd Child' ELSE 'Child' END"
    ages = f"{x.g('b.age_from')} || '-' || {x.g('b.age_to')}"
    price = x.band_price("b.value_type", "b.value", "coalesce(nullif(p.base_rate, 0), p.fallback, c.low)")
    ctes = f"""offered AS (SELECT *, row_number() OVER (PARTITION BY contract_id, hotel ORDER BY ord) AS place FROM {bands} WHERE value_type <> 'not_applicable'),
{bands_per_room('offered')}, {BASE_RATES.format(rates=rates)}, cheapest AS (SELECT contract_id, hotel, min(dbl) AS low FROM {rates} WHERE dbl IS NOT NULL GROUP BY 1, 2)"""
    select = supplement_select({
        **HOTEL_VALUES, "supplement_code": f"'CHILD-' || {index} || '-' || {ages}", "supplement_name": "'Child policy'", "rooms": "room",
        "supplement_type": "'Compulsory'", "display_as_separate_room": "'No'",
        "description": f"{label} || ' age band ' || {ages} || '; ' || b.value_type || coalesce('=' || {x.g('b.value')}, '')", "charge_type": "'Per Person Per Night'",
        "calculation_method": "'Pax Index'", "traveler_type": "CASE WHEN b.age_to <= 2 THEN 'Infant' ELSE 'Child' END",
        "fare_type_name": f"coalesce(nullif(b.label, ''), {label} || ' (' || {ages} || ')')", "standard_count_index": index, "min_age": "b.age_from",
        "max_age": "b.age_to", "supplier_cost": price, "customer_price": price,
    }, """band_rooms b LEFT JOIN room_base p USING (contract_id, hotel, room) LEFT JOIN cheapest c USING (contract_id, hotel) JOIN hotels h USING (contract_id, hotel)
  LEFT JOIN rooms r USING (contract_id, hotel, room)""")
    return ctes, select


_UPGRADES, _UPGRADE_ROWS = upgrade_rows("rates")
_POLICY, _POLICY_ROWS = child_policy("child_bands", "rates")
SQL["ex11_build_supplement_rows"] = contract_supplements("supplements")
SQL["ex12_child_policy_supplements"] = f"WITH {_POLICY} {_POLICY_ROWS}"
SQL["ex13_meal_upgrade_rows"] = f"WITH {_UPGRADES} {_UPGRADE_ROWS}"
_UPGRADES2, _UPGRADE_ROWS2 = upgrade_rows("best_rates")
_POLICY2, _POLICY_ROWS2 = child_policy("first_bands", "best_rates")
SQL["so6_supplement_union"] = f"""
WITH best_rates AS ({BEST_RATES}), first_bands AS ({FIRST_BANDS}), best_supplements AS ({BEST_SUPPLEMENTS}), {_UPGRADES2}, {_POLICY2}
SELECT * EXCLUDE (ai_fields) FROM ({contract_supplements('best_supplements')} UNION ALL {_UPGRADE_ROWS2} UNION ALL {_POLICY_ROWS2})"""

# ---- set operations --------------------------------------------------------------------------------------------------

FIXED = "(SELECT contract_id, row_id, " + ", ".join(f"bool_or(quick_fix_type = '{f}') AS {a}" for f, a in (("set_default_currency", "c"), ("copy_currency_to_customer", "k"), ("set_default_supplier", "s"), ("set_all_weekdays", "w"))) + " FROM issues GROUP BY 1, 2) i"
EDITED_FIELDS = ("city_area", "status")


def _edit(grain: str, keys: tuple[str, ...]) -> str:
    return f"{grain}_edit AS (SELECT contract_id, {', '.join(keys)}, " + ", ".join(
        f"arg_max_null(value, (\"at\", ord)) FILTER (field = '{f}') AS {f}, max((\"at\", ord)) FILTER (field = '{f}') AS {f}_at" for f in EDITED_FIELDS
    ) + f" FROM edits WHERE grain = '{grain}' GROUP BY ALL)"


GRAINS = {"hotel": ("hotel",), "room": ("hotel", "room"), "season": ("start_date", "end_date"), "row": ("row_id",)}
_HOTEL_NAME = "coalesce(nullif(r.hotel, ''), 'Unknown Hotel')"
PATCHED = ", ".join(_edit(gr, k) for gr, k in GRAINS.items()) + ", patched AS (SELECT r.* EXCLUDE (city_area, status), " + ", ".join(
    "CASE " + " ".join(
        f"WHEN {gr}_edit.{f}_at IS NOT NULL AND " + " AND ".join(
            f"({o}_edit.{f}_at IS NULL OR {o}_edit.{f}_at <= {gr}_edit.{f}_at)" for o in GRAINS if o != gr
        ) + f" THEN {gr}_edit.{f}" for gr in reversed(GRAINS)
    ) + f" ELSE r.{f} END AS {f}" for f in EDITED_FIELDS
) + ", " + " OR ".join(f"{gr}_edit.{f}_at IS NOT NULL" for gr in GRAINS for f in EDITED_FIELDS) + " AS touched, hotel_edit.city_area_at IS NOT NULL AS by_hotel FROM rows r " + " ".join(
    f"LEFT JOIN {gr}_edit ON {gr}_edit.contract_id = r.contract_id AND " + " AND ".join(
        f"{gr}_edit.{k} = {_HOTEL_NAME if k == 'hotel' else 'r.' + k}" for k in keys
    ) for gr, keys in GRAINS.items()
) + ")"
ISSUE_ROWS = {}
HEADER = {"hotel": "Hotel Name", "room": "Room Name", "start_date": "Start Date", "end_date": "End Date"}
_DAYS = f"(({x.real_date('end_date')}) - ({x.real_date('start_date')}) + 1)"
_BOTH = "start_date <> '' AND end_date <> ''"
RULES = {
    "v1_required_fields": [("error", f"'Required field missing: {h}'", h, None, f"coalesce({f}, '') = ''") for f, h in HEADER.items()],
    "v2_dates": [
        ("error", "'Start Date or End Date is malformed'", "Start Date", None, f"{_BOTH} AND {_DAYS} IS NULL"),
        ("error", "'End Date is before or equal to Start Date'", "End Date", None, f"{_BOTH} AND {_DAYS} <= 0"),
    ],
    "v3_currencies": [
        ("warning", "'Currency missing'", "Currency", "set_default_currency", "coalesce(currency, '') = ''"),
        ("warning", "'Customer Price Currency missing'", "Customer Price Currency", "copy_currency_to_customer", "coalesce(customer_currency, '') = ''"),
    ],
    "v4_plans": [("warning", f"'{h} missing'", h, None, f"coalesce({f}, '') = ''") for f, h in [("rate_type", "Rate Type"), ("rate_plan", "Rate Plan"), ("meal_plan", "Meal Plan")]],
    "v5_provenance": [
        ("warning", "'Source reference missing'", None, None, "ref IS NULL"),
        ("warning", "'Low confidence (' || printf('%.2f', confidence) || ')'", None, None, "confidence < 0.4"),
    ],
}


def rule_rows(names: list[str], rows: str = "rows") -> str:
    def lit(v: str | None) -> str:
        return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    return " UNION ALL ".join(
        f"SELECT contract_id, row_id, hotel, sheet, '{sev}' AS severity, {msg} AS message, {lit(field)} AS field, {lit(fix)} AS quick_fix_type, max_rollaways FROM {rows} WHERE {test}"
        for n in names for sev, msg, field, fix, test in RULES[n]
    )


SQL |= {n: f"SELECT * EXCLUDE (max_rollaways) FROM ({rule_rows([n])})" for n in RULES}
SQL |= {
    "so1_merge_chunks": f"""
WITH merged_notes AS (SELECT contract_id, coalesce(source_file, '') || '|' || coalesce(page, '') || '|' || coalesce(category, '') || '|' || {x.fold('note')} AS key, * EXCLUDE (contract_id)
  FROM notes QUALIFY row_number() OVER (PARTITION BY contract_id, coalesce(source_file, ''), coalesce(page, ''), coalesce(category, ''), {x.fold('note')} ORDER BY ord) = 1),
merged_columns AS (SELECT *, coalesce(nullif(key, ''), nullif(label, '')) AS k FROM child_columns WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contract_id, k ORDER BY ord) = 1),
merged_hotels AS (SELECT contract_id, coalesce(nullif(hotel, ''), 'Unknown Hotel') AS key, arg_min(city_area, (part_idx, ord)) FILTER (city_area <> '') AS city_area,
  arg_min(phone, (part_idx, ord)) FILTER (phone <> '') AS phone FROM part_hotels GROUP BY 1, 2),
merged_summary AS (SELECT contract_id, arg_min(source_file, part_idx) FILTER (source_file <> '') AS source_file, arg_min(input_format, part_idx) FILTER (input_format <> '') AS input_format,
  coalesce(round(avg(CAST(confidence AS DECIMAL(18,6))), 3), 0.5) AS overall_confidence FROM parts GROUP BY 1)
""" + " UNION ALL ".join(
        f"SELECT '{part}' AS part, contract_id, {key} AS key, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM {source}" + (f" WHERE {f} IS NOT NULL" if part in ("hotels", "summary") else "")
        for part, key, source, names in [
            ("rows", "row_id", "rows", ("hotel", "room", "start_date", "end_date", "meal_plan")), ("issues", "row_id", "issues", ("hotel", "severity", "message", "field")),
            ("notes", "key", "merged_notes", ("note_id", "category", "page", "note")), ("child_columns", "k", "merged_columns", ("key", "label", "position", "value_type")),
            ("hotels", "key", "merged_hotels", ("city_area", "phone")), ("summary", "''", "merged_summary", ("source_file", "input_format")),
        ] for f in names
    ) + " UNION ALL SELECT 'summary', contract_id, '', 'overall_confidence', printf('%.3f', overall_confidence) FROM merged_summary",
    "so2_union_list": "SELECT contract_id, room, min(ord) AS first_ord FROM rows WHERE room IS NOT NULL GROUP BY 1, 2",
    "so3_missing_supplement_names": "SELECT contract_id, hotel, trim(missing_supplement_name) AS name, ord FROM findings WHERE finding_kind = 'MISSING_SUPPLEMENT' AND trim(missing_supplement_name) <> '' QUALIFY row_number() OVER (PARTITION BY contract_id, hotel, lower(trim(missing_supplement_name)) ORDER BY ord) = 1",
    "so4_unmapped_strict_children": "SELECT row_id AS linked_row_id, sheet AS page, 'Child policy' AS category, 'Strict template export dropped child column ''' || key || ''' (value: ' || CAST(v AS VARCHAR) || ') for hotel ' || coalesce(hotel, 'None') || ' / ' || coalesce(room, 'None') || ' ' || coalesce(start_date, 'None') || ' – ' || coalesce(end_date, 'None') AS note, confidence FROM (" + spread(
        "rows", "row_id, sheet, hotel, room, start_date, end_date, confidence", [(f"'{k}'", c) for c, k in CHILD_KEYS.items()], ("key", "v")
    ) + ") WHERE v IS NOT NULL",
    "so5_child_policy_flatten": f"SELECT contract_id, hotel, ord, position, {x.dbl('age_from')} AS age_from, {x.dbl('age_to')} AS age_to FROM child_bands",
    "so7_golden_diff": f"""
WITH {PATCHED} SELECT *, CAST(sum(sign) AS BIGINT) AS surplus FROM (
  SELECT contract_id, hotel, room, start_date, city_area, status, sign FROM (SELECT *, 1 AS sign FROM rows)
  UNION ALL SELECT contract_id, hotel, room, start_date, city_area, status, -1 FROM patched)
GROUP BY ALL HAVING sum(sign) <> 0""".replace("SELECT *, CAST(sum", "SELECT contract_id, hotel, room, start_date, city_area, status, CAST(sum"),
    "so7_issue_diff": f"""
WITH fixed AS (SELECT r.* REPLACE (CASE WHEN i.c THEN coalesce(r.currency, 'EUR') ELSE r.currency END AS currency,
  CASE WHEN i.k THEN (CASE WHEN i.c THEN coalesce(r.currency, 'EUR') ELSE r.currency END) ELSE r.customer_currency END AS customer_currency,
  CASE WHEN i.s THEN coalesce(r.supplier, 'Unknown Supplier') ELSE r.supplier END AS supplier, CASE WHEN i.w THEN '0,1,2,3,4,5,6' ELSE r.days END AS days)
  FROM rows r LEFT JOIN {FIXED} USING (contract_id, row_id))
SELECT contract_id, severity, coalesce(field, '') AS field, coalesce(hotel, '') AS hotel, CAST(sum(sign) AS BIGINT) AS surplus FROM (
  SELECT *, 1 AS sign FROM ({rule_rows(list(RULES))}) UNION ALL SELECT *, -1 FROM ({rule_rows(list(RULES), 'fixed')}))
GROUP BY 1, 2, 3, 4 HAVING sum(sign) <> 0""",
}

# ---- expansion and reshaping -----------------------------------------------------------------------------------------

GRAND = "contract_id, doc_id"
MEAL_OF = "CASE basic_treatment WHEN 'HB' THEN 'Half Board' WHEN 'Soft All Inclusive' THEN 'All Inclusive' WHEN 'bed / breakfast' THEN 'Bed & Breakfast' WHEN 'picnic' THEN 'Picnic' END"
R2 = "CAST(round({}, 2) AS DECIMAL(12,2))"
SINGLE = "CASE WHEN s > 0 AND s < 1 THEN " + R2.format("dbl + dbl * CAST(s AS DECIMAL(12,4))") + " ELSE " + R2.format("dbl + CAST(s AS DECIMAL(12,4))") + " END"
TRIPLE = "CASE WHEN t > 0 AND t < 1 THEN " + R2.format("dbl - dbl * CAST(t AS DECIMAL(12,4))") + " ELSE " + R2.format("dbl - CAST(t AS DECIMAL(12,4))") + " END"
SQL["ex1_expand_block"] = f"""
WITH {GRID}, guarded AS (SELECT g.*, b.label AS base_label FROM grid g JOIN block_columns b USING (contract_id, doc_id) WHERE b.role = 'base_room'
  AND base IS NOT NULL AND start_date IS NOT NULL AND end_date IS NOT NULL),
roomed AS (SELECT *, coalesce(base_label, 'Standard') AS room, true AS is_base, CAST(round(base, 2) AS DECIMAL(12,2)) AS dbl FROM guarded
  UNION ALL SELECT *, 'Sup PV', false, CAST(round(base + up, 2) AS DECIMAL(12,2)) FROM guarded WHERE up IS NOT NULL),
matched AS (SELECT r.*, m.name, m.currency AS own_currency, m.country_code AS own_country, {MEAL_OF} AS board,
  CASE WHEN room = 'Sup PV' THEN 2 END AS e_min, CASE WHEN room IN ('Sup PV', 'Standard GV', 'Standard') THEN 2 END AS e_max,
  CASE WHEN room = 'Sup PV' THEN 3 END AS e_pax, CASE WHEN room = 'Sup PV' THEN o.max_child WHEN room IN ('Standard GV', 'Standard') THEN 2 END AS e_child
  FROM roomed r JOIN sheet_meta m USING (contract_id, doc_id) JOIN occupancy o ON o.contract_id = r.contract_id AND o.doc_id = r.doc_id AND o.ord = 1)
SELECT doc_id, row_idx, room, nullif(name, '') AS hotel, start_date, end_date, CAST(release AS BIGINT) AS release_period, coalesce(nullif(title, ''), 'Contract') AS rate_plan,
  board AS meal_plan, {x.dbl('dbl')} AS dbl, {x.dbl(SINGLE)} AS sgl, {x.dbl(TRIPLE)} AS tpl, CAST(NULL AS DOUBLE) AS extra_bed, {x.dbl('up')} AS supp_hb_adult,
  e_min AS min_adult, e_max AS max_adult, e_pax AS max_pax, coalesce(nullif(own_currency, ''), 'USD') AS currency, coalesce(nullif(own_country, ''), 'ES') AS country_code,
  'Open' AS status, CAST(CASE WHEN is_base THEN 0.92 ELSE 0.8 END AS DOUBLE) AS confidence, 2 AS n_children, CASE WHEN e_child <= 0 THEN 1 ELSE 0 END AS n_warnings,
  CASE WHEN coalesce(e_child, 1) > 0 THEN {x.dbl('chd1')} END AS chd1, CASE WHEN coalesce(e_child, 1) > 0 THEN {x.dbl('CAST(t AS DECIMAL(12,2))')} END AS chd2,
  contract_id || ' | ' || substr(doc_id, 7) || '!Row ' || CAST(row_idx + 1 AS VARCHAR) AS ref
FROM matched"""
SQL["ex2_occupancy_prices"] = "SELECT row_id, " + ", ".join(
    f"CAST(CASE WHEN {s} > 0 AND {s} < 1 THEN round(dbl {op} dbl * {s}, 2) ELSE round(dbl {op} {s}, 2) END AS DOUBLE) AS {n}"
    for n, op, s in (("sgl", "+", "CAST(confidence AS DECIMAL(12,4))"), ("tpl", "-", "CAST(CAST(confidence AS DECIMAL(12,2)) * 3 AS DECIMAL(12,4))"))
) + ", CAST(NULL AS DOUBLE) AS qdp FROM rows"
SQL["ex3_child_values_widen"] = f"SELECT row_id, {x.dbl('chd1')} AS \"CHD1(2-11.99)\", {x.dbl('chd2')} AS \"CHD2(0-5.99)\", CAST(NULL AS DOUBLE) AS \"CHD(0-2)\" FROM rows"


def child_of(key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN r.{c}" for c, k in CHILD_KEYS.items()) + " END"


KEYS_ROW = f"{BAND_KEYS}, band_row AS (SELECT contract_id, " + ", ".join(
    f"max({s}_key) FILTER (band = '{b}') AS {b}_{s}" for b in ("baby", "child", "teen") for s in ("primary", "secondary")
) + " FROM bands GROUP BY 1)"
ADULT_CHILD = {
    "adult_1": "r.sgl", "adult_2": "r.dbl", "adult_3": "r.tpl", "adult_4": "r.qdp", "baby_1": child_of("k.baby_primary"), "child_1": child_of("k.child_primary"),
    "teen_1": child_of("k.teen_primary"), "extra_adult": "r.extra_bed", "multi_infant": child_of("k.baby_secondary"), "extra_child": child_of("k.child_secondary"),
    "extra_teen": child_of("k.teen_secondary"),
}
PAX = {
    "pax_1": "r.sgl", "pax_2": "r.dbl", "pax_3": "r.tpl", "pax_4": "r.qdp", "pax_5": "NULL", "extra_adult": "r.extra_bed",
    "multi_infant": child_of("k.baby_primary"), "extra_child": child_of("k.child_primary"), "extra_teen": child_of("k.teen_primary"),
}
SLOT_ROW = f"{KEYED_COLUMNS}, {slots('keyed_columns', 'contract_id', True)}, slot_row AS (SELECT contract_id, " + ", ".join(
    f"max({f}) FILTER (slot = {n}) AS s{n}_{f}" for n in (1, 2, 3) for f in ("key", "age_from", "age_to")
) + " FROM slotted_all GROUP BY 1)"
POSITIONS = {}
for _n in (1, 2, 3):
    POSITIONS |= {f"child_{_n}_price": child_of(f"p.s{_n}_key"), f"child_{_n}_age_min": f"p.s{_n}_age_from", f"child_{_n}_age_max": f"p.s{_n}_age_to"}


def doubles(columns: dict[str, str]) -> str:
    return ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in columns.items())


SQL["ex4_layout_adult_child"] = f"WITH {KEYS_ROW} SELECT r.row_id, {doubles(ADULT_CHILD)} FROM rows r LEFT JOIN band_row k USING (contract_id)"
SQL["ex5_layout_pax"] = f"WITH {KEYS_ROW} SELECT r.row_id, {doubles(PAX)} FROM rows r LEFT JOIN band_row k USING (contract_id)"
SQL["ex6_layout_child_positions"] = f"WITH {SLOT_ROW} SELECT r.row_id, {doubles(POSITIONS)} FROM rows r LEFT JOIN slot_row p USING (contract_id)"
TEXTS = ("hotel", "supplier", "star_rating", "short_description", "bed_type", "address_line_1", "address_line_2", "address_line_3", "address_line_4", "postal_code", "country_code", "state_region", "city_area", "phone", "email", "website", "room", "season", "rate_plan", "meal_plan")
_RATES7 = {n: f"CASE WHEN l.layout = 'prn_pax' THEN NULL ELSE {v} END" for n, v in ADULT_CHILD.items() if n in ("adult_1", "adult_2", "adult_3", "adult_4", "baby_1", "child_1", "teen_1")}
_RATES7 |= {n: f"CASE WHEN l.layout = 'prn_pax' THEN {v} END" for n, v in PAX.items() if n.startswith("pax")}
_RATES7 |= {n: f"CASE WHEN l.layout = 'prn_pax' THEN {PAX[n]} ELSE {ADULT_CHILD[n]} END" for n in ("extra_adult", "multi_infant", "extra_child", "extra_teen")}
SQL["ex7_build_row_values"] = f"""
WITH {LAYOUTS}, {KEYS_ROW}, {SLOT_ROW}
SELECT r.contract_id, r.row_id, l.layout, {', '.join(f"CASE WHEN trim(r.{t}) <> '' THEN r.{t} END AS {t}" for t in TEXTS)}, CAST(NULL AS VARCHAR) AS hotel_code,
  CAST(NULL AS VARCHAR) AS sell_channel, {doubles({n: 'r.' + n for n in ('max_rollaways', 'max_cribs', 'min_adult', 'max_adult', 'max_pax', 'min_stay', 'booking_limit', 'release_period', 'add_charge_value')})},
  coalesce(nullif(r.check_in, ''), '00:00') AS check_in, coalesce(nullif(r.check_out, ''), '00:00') AS check_out, coalesce(nullif(r.status, ''), 'Open') AS status,
  'Fixed' AS add_charge_type, 'Mark Up' AS charge, coalesce(nullif(r.currency, ''), 'EUR') AS currency,
  coalesce(nullif(r.customer_currency, ''), nullif(r.currency, ''), 'EUR') AS customer_currency,
  CASE l.layout WHEN 'ppn' THEN 'Per Person Per Night' WHEN 'prn_ac' THEN 'Per Room Per Night (Adult / Child count)' ELSE 'Per Room Per Night (Pax count)' END AS rate_type,
  {x.days_mask('r.days')} AS days, CAST({x.real_date('r.start_date')} AS VARCHAR) AS start_date, CAST({x.real_date('r.end_date')} AS VARCHAR) AS end_date, {doubles(_RATES7)}, {doubles(POSITIONS)}
FROM rows r JOIN layouts l USING (contract_id) LEFT JOIN band_row k USING (contract_id) LEFT JOIN slot_row p USING (contract_id)"""
MARKED = [("address_line_1", "Address Line 1"), ("address_line_2", "Address Line 2"), ("address_line_3", "Address Line 3"), ("address_line_4", "Address Line 4"), ("postal_code", "Postal Code"),
          ("county_state_province", "County / State / Province"), ("city_area", "City / Area"), ("phone", "Phone Number"), ("email", "Email Address"), ("website", "Hotel Website")]
LAYOUT_OF = "CASE c.detected_rate_type WHEN 'Per Room Per Night' THEN 'prn_ac' WHEN 'Per Room Per Stay' THEN 'prn_ac' WHEN 'Per Room Per Night (Pax Count)' THEN 'prn_pax' ELSE 'ppn' END"
SQL["ex8_hotel_base_columns"] = f"""
SELECT h.contract_id, h.hotel, {LAYOUT_OF} AS layout, {x.hotel_code('h.hotel', 'h.code')} AS hotel_code, h.sell_channel, h.supplier, h.star_rating, h.short_description,
  {', '.join(f"{x.no_ai('h.' + f)} AS {'state_region' if f == 'county_state_province' else f}" for f, _ in MARKED)}, h.country_code, h.latitude, h.longitude,
  coalesce(nullif(h.check_in, ''), '00:00') AS check_in, coalesce(nullif(h.check_out, ''), '00:00') AS check_out, coalesce(nullif(h.currency, ''), 'EUR') AS currency,
  coalesce(nullif(h.currency, ''), 'EUR') AS customer_currency,
  CASE {LAYOUT_OF} WHEN 'ppn' THEN 'Per Person Per Night' WHEN 'prn_ac' THEN 'Per Room Per Night (Adult / Child count)' ELSE 'Per Room Per Night (Pax count)' END AS rate_type,
  'Open' AS status, '1234567' AS days, 'Contract' AS rate_plan, 'Fixed' AS add_charge_type, 'Mark Up' AS charge,
  {x.join_list(*[f"CASE WHEN {x.has_ai('h.' + f)} THEN '{t}' END" for f, t in MARKED], "CASE WHEN h.latitude IS NOT NULL THEN 'Latitude' END", "CASE WHEN h.longitude IS NOT NULL THEN 'Longitude' END")} AS ai_fields
FROM hotels h JOIN contracts c USING (contract_id)"""
EXTRA = f"CASE WHEN {{0}}extra_bed_adult_kind = 'discount_percentage' AND coalesce({{0}}dbl, {{0}}sgl) IS NOT NULL AND {{0}}extra_bed_adult IS NOT NULL THEN {x.percent_of('coalesce({0}dbl, {0}sgl)', '100 - {0}extra_bed_adult')} ELSE {{0}}extra_bed_adult END"
SQL["ex9_rate_columns"] = f"""
WITH {FULL_GRID}, {LAST_RATE}
SELECT g.contract_id, g.hotel, g.room, g.season, g.meal, {LAYOUT_OF} AS layout, m.canonical AS meal_plan, s.start_date, q.bed_type, q.max_pax,
  {', '.join(f"CAST(CASE WHEN {LAYOUT_OF} = 'prn_pax' THEN NULL ELSE r.{p} END AS DOUBLE) AS adult_{i}, CAST(CASE WHEN {LAYOUT_OF} = 'prn_pax' THEN r.{p} END AS DOUBLE) AS pax_{i}" for i, p in enumerate(('sgl', 'dbl', 'tpl', 'qdp'), 1))},
  {x.dbl(EXTRA.format('r.'))} AS extra_adult
FROM full_grid g LEFT JOIN last_rate r USING ({CELL}) JOIN contracts c ON c.contract_id = g.contract_id JOIN hotels h ON h.contract_id = g.contract_id AND h.hotel = g.hotel
JOIN meals m ON m.contract_id = g.contract_id AND m.hotel = g.hotel AND m.code = g.meal JOIN seasons s ON s.contract_id = g.contract_id AND s.hotel = g.hotel AND s.label = g.season
JOIN rooms q ON q.contract_id = g.contract_id AND q.hotel = g.hotel AND q.room = g.room"""
SQL["ex10_extra_adult_amount"] = f"SELECT ord, {x.dbl(EXTRA.format(''))} AS extra_adult FROM rates"
BAND_SLOTS = {"baby_1": ("baby", 1), "child_1": ("child", 1), "teen_1": ("teen", 1), "multi_infant": ("baby", 2), "extra_child": ("child", 2), "extra_teen": ("teen", 2)}
SQL["ex14_child_band_columns"] = f"""
WITH placed AS (SELECT *, {BANDED} AS band, row_number() OVER (PARTITION BY contract_id, hotel, {BANDED} ORDER BY ord) AS rn FROM child_bands),
wide AS (SELECT contract_id, hotel, {', '.join(f"max(value_type) FILTER (band = '{b}' AND rn = {n}) AS {k}_t, max(value) FILTER (band = '{b}' AND rn = {n}) AS {k}_v" for k, (b, n) in BAND_SLOTS.items())} FROM placed GROUP BY 1, 2)
SELECT r.ord, {', '.join(f"{x.dbl(x.band_price('w.' + k + '_t', 'w.' + k + '_v', 'coalesce(r.dbl, r.sgl)'))} AS {k}" for k in BAND_SLOTS)} FROM rates r LEFT JOIN wide w USING (contract_id, hotel)"""
SQL["ex15_text_rows"] = f"""
WITH {DATE_LIST}
SELECT p.contract_id, p.doc_id AS sheet, p.pair_ord, {DOC_HOTEL} AS hotel, o.supplier, o.country AS country_code, o.city_area, o.check_in, o.check_out,
  coalesce({x.found_currency('d.raw_excerpt')}, o.currency) AS currency, coalesce({x.found_currency('d.raw_excerpt')}, o.currency) AS customer_currency, CAST(NULL AS VARCHAR) AS room,
  p.start_date, p.end_date, CAST(CAST(p.end_date AS DATE) - CAST(p.start_date AS DATE) AS BIGINT) + 1 AS days, 'Contract' AS rate_plan, {x.found_board('d.raw_excerpt')} AS meal_plan,
  'Open' AS status, CAST(0.35 AS DOUBLE) AS confidence
FROM date_pair p JOIN text_docs d ON d.contract_id = p.contract_id AND d.doc_id = p.doc_id JOIN text_options o ON o.contract_id = p.contract_id
WHERE d.classification <> 'index_reference'""".replace(DOC_HOTEL, DOC_HOTEL.replace("doc_id", "d.doc_id"))
SQL["ex15_text_notes"] = f"""
WITH {DATE_LIST}, {TRIGGER_NOTES}
SELECT contract_id, doc_id, hotel, category, note FROM trigger_note WHERE classification <> 'index_reference'
UNION ALL SELECT contract_id, doc_id, {DOC_HOTEL}, 'Source ambiguity', 'No date pairs detected on ' || doc_id || '. Review manually to find rate periods.' FROM text_docs
WHERE classification <> 'index_reference' AND doc_id NOT IN (SELECT doc_id FROM date_pair)"""
SQL["ex16_sheet_grid_lines"] = f"WITH {line_text('cells', GRAND, 'row_idx + 1')} SELECT doc_id, CAST(line AS BIGINT) AS line, text FROM rendered"
SQL["ex16_sheet_grid_text"] = f"WITH {line_text('cells', GRAND, 'row_idx + 1')}, {in_chunks(GRAND, 'doc_id')} SELECT contract_id, doc_id, chunk, text FROM chunked"
_BLOCK_CELLS = "block_cells AS (SELECT b.contract_id, b.doc_id, b.block_idx, b.title, b.block_count, b.line, b.doc_id || coalesce(' | ' || b.title, '') AS block_doc_id, c.col_idx, c.value_str FROM block_row b JOIN cells c USING (contract_id, doc_id, row_idx))"
_BLOCK = "contract_id, doc_id, block_idx, block_doc_id"
SQL["ex17_block_documents"] = f"""
WITH {SHEET_CLASS}, {block_rows("c.classification = 'hotel_contract'")}, {_BLOCK_CELLS}, {line_text('block_cells', _BLOCK, 'line')},
titles AS (SELECT contract_id, doc_id, block_idx, block_doc_id, max(title) AS block_title, max(block_count) AS block_count FROM block_cells GROUP BY 1, 2, 3, 4),
{in_chunks(_BLOCK, 'block_doc_id')}
SELECT t.contract_id, t.doc_id, c.classification, c.detected_hotel_name, CAST(t.block_idx AS BIGINT) AS block_idx, q.block_title, CAST(q.block_count AS BIGINT) AS block_count, t.block_doc_id, t.chunk, t.text AS raw_excerpt
FROM chunked t JOIN titles q USING (contract_id, doc_id, block_idx, block_doc_id) JOIN classes c ON c.contract_id = t.contract_id AND c.doc_id = t.doc_id"""
SQL["ex18_period_column_rows"] = """
SELECT l.ord, l.period, CAST(l.price AS DOUBLE) AS sgl, CAST(l.price AS DOUBLE) AS dbl, CASE WHEN r.max_pax >= 3 THEN CAST(l.price AS DOUBLE) END AS tpl,
  CASE WHEN r.max_pax >= 4 THEN CAST(l.price AS DOUBLE) END AS qdp, 'Room Only' AS meal_plan
FROM (SELECT contract_id, hotel, room, ord, 'low' AS period, cents AS price FROM lines WHERE qty % 3 <> 0 UNION ALL SELECT contract_id, hotel, room, ord, 'high', qty FROM lines) l
JOIN rooms r USING (contract_id, hotel, room)"""
SQL["ex19_stacked_period_split"] = r"""
SELECT contract_id, doc_id, row_idx, contract_id || '/' || doc_id || '/0/' || CAST(row_idx AS VARCHAR) AS price_group, i - 1 AS period_idx, trim(p[i]) AS period
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT contract_id, doc_id, row_idx, string_split_regex(raw, '\s+&\s+') AS p FROM source_cells WHERE col_name = 'Period'))"""
SQL["ex20_expected_grid_note"] = """
WITH made AS (SELECT contract_id, 'batch ' || CAST(batch_no AS VARCHAR) AS batch_id, count(*) AS n FROM rows GROUP BY 1, 2),
sized AS (SELECT s.*, n_rooms * n_periods * CASE WHEN layout_pattern = 'period_column' THEN 1 ELSE greatest(n_meals, 1) END AS expected, coalesce(m.n, 0) AS actual
  FROM skeletons s LEFT JOIN made m USING (contract_id, batch_id))
SELECT contract_id, batch_id, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, 'Source ambiguity' AS category,
  'Two-call extraction expected ' || expected || ' rows from the skeleton (' || n_rooms || ' rooms × ' || n_periods || ' periods × ' || n_meals || ' meal plans) but produced ' || actual || '. ' ||
  (expected - actual) || ' row(s) appear to be missing — check the source preview and fill them in manually.' AS note, CAST(0.3 AS DOUBLE) AS confidence
FROM sized WHERE expected > 0 AND actual < expected"""

# ---- normalisation and repair ----------------------------------------------------------------------------------------

NUMERIC = {
    "min_adult": True, "max_adult": True, "max_pax": True, "min_stay": True, "booking_limit": True, "release_period": True, "latitude": False, "longitude": False,
    "add_charge_value": False, "charge": False, "sgl": False, "dbl": False, "tpl": False, "qdp": False, "extra_bed": False, "supp_hb_adult": False, "supp_hb_child": False,
    "supp_ai_adult": False, "supp_ai_child": False,
}
_ALL_HEADERS = {**HOTEL_HEADERS, **SUPP_HEADERS}
N_MOVED = " + ".join(f"CAST(({x.prose(f)}) IS NOT NULL AS INT)" for f in NUMERIC)


def typed(f: str) -> str:
    return f"CAST({x.coerced(f, NUMERIC[f])} AS {'BIGINT' if NUMERIC[f] else 'DECIMAL(18,6)' if f in ('latitude', 'longitude') else 'DECIMAL(12,2)'})"


VALUE_TYPES = f"{COLUMNS}, vt AS (SELECT contract_id, " + ", ".join(
    f"bool_or(key = '{k}') AS has_{c}, max(value_type) FILTER (key = '{k}') AS {c}_vt" for c, k in CHILD_KEYS.items()
) + ", count(*) AS n_keys FROM ncols GROUP BY 1)"


def child_num(c: str) -> str:
    return f"CAST({x.coerced('r.' + c, free=f'CASE WHEN vt.{c}_vt = {chr(39)}discount_percentage{chr(39)} THEN 100 ELSE 0 END')} AS DECIMAL(12,2))"


N_CHILD_MOVED = " + ".join(f"CAST(({x.prose('r.' + c)}) IS NOT NULL AS INT)" for c in CHILD_KEYS)
FIX_END = """CASE WHEN s > e AND substr(e, 1, 4) < substr(s, 1, 4) AND substr(s, 1, 4) || substr(e, 5) > s THEN substr(s, 1, 4) || substr(e, 5) END"""
DATED = f"(SELECT *, {x.iso_date('start_date')} AS s, {x.iso_date('end_date')} AS e FROM raw_rows)"
FIX_TEXT = "'End Date year auto-corrected from ' || e || ' -> ' || fixed || ' (source contract typo)'"
MOVED_TEXT = x.join_list(*[f"'{k}: ''' || {x.prose('r.' + c)} || ''' moved to Extraction Notes'" for c, k in CHILD_KEYS.items()], mark=";")


def filled_or(field: str, option: str) -> str:
    return f"coalesce(nullif(r.{field}, ''), nullif(o.{option}, ''), r.{field})"


N1_BASE = f"""{VALUE_TYPES}, read_rows AS (
  SELECT r.*, s, e, {FIX_END} AS fixed, {filled_or('supplier', 'supplier')} AS d_supplier, {filled_or('country_code', 'country')} AS d_country, {filled_or('city_area', 'city_area')} AS d_city,
    {filled_or('currency', 'currency')} AS d_currency, {filled_or('customer_currency', 'currency')} AS d_customer, {filled_or('check_in', 'check_in')} AS d_in, {filled_or('status', 'status')} AS d_status,
    {typed('sgl')} AS n_sgl, {typed('dbl')} AS n_dbl, {typed('extra_bed')} AS n_extra, {', '.join(f'{child_num(c)} AS n_{c}' for c in CHILD_KEYS)}, vt.n_keys,
    {N_MOVED} + {N_CHILD_MOVED} AS moved
  FROM {DATED} r LEFT JOIN options o USING (contract_id) LEFT JOIN vt USING (contract_id))""".replace(N_MOVED, N_MOVED)
N1_VALUES = " UNION ALL ".join(f"SELECT contract_id, '{k}' AS key, n_{c} AS v FROM read_rows" for c, k in CHILD_KEYS.items())
N1_TYPES = f"{typed_columns(N1_VALUES)}, tv AS (SELECT contract_id, " + ", ".join(f"max(value_type) FILTER (key = '{k}') AS {c}_t" for c, k in CHILD_KEYS.items()) + " FROM tcols GROUP BY 1)"


def amount_or_same(c: str, dbl: str) -> str:
    return f"CASE WHEN {dbl} IS NULL THEN n_{c} ELSE {x.child_amount('tv.' + c + '_t', 'n_' + c, dbl)} END"


def kept(raw: str, fn: str) -> str:
    return f"CASE WHEN coalesce({raw}, '') = '' THEN {raw} ELSE coalesce({fn}, {raw}) END"


SQL["n1_normalize_rows"] = f"""
WITH {N1_BASE}, {N1_TYPES}
SELECT row_id, coalesce(sheet, '—') AS sheet, d_supplier AS supplier, d_country AS country_code, d_city AS city_area, coalesce({x.currency('d_currency')}, d_currency) AS currency,
  coalesce({x.currency('d_customer')}, d_customer) AS customer_currency, d_in AS check_in, {kept('meal_plan', x.board('meal_plan'))} AS meal_plan,
  {kept('rate_type', x.rate_type('rate_type'))} AS rate_type, {kept('d_status', x.status('d_status'))} AS status, s AS start_date, coalesce(fixed, e) AS end_date,
  {x.days_mask('days')} AS days, {typed('min_adult')} AS min_adult, {typed('max_adult')} AS max_adult, {typed('min_stay')} AS min_stay, {x.dbl(typed('longitude'))} AS longitude,
  {x.dbl(typed('charge'))} AS charge, {x.dbl('n_sgl')} AS sgl, {x.dbl('n_dbl')} AS dbl, {x.dbl('n_extra')} AS extra_bed,
  {', '.join(f"{x.dbl(amount_or_same(c, 'n_dbl'))} AS {c}" for c in CHILD_KEYS)}, n_keys AS n_children, moved + CASE WHEN fixed IS NULL THEN 0 ELSE 1 END AS n_warnings,
  coalesce(confidence, 0.5) AS confidence, 'auto' AS review_state
FROM read_rows LEFT JOIN tv USING (contract_id)"""
SQL["n1_normalize_columns"] = f"""
WITH {N1_BASE}, {N1_TYPES} SELECT contract_id, key, key AS label, CASE WHEN value_type IN ('discount_percentage', 'percentage_of_adult') THEN 'amount' ELSE value_type END AS value_type, ord FROM tcols"""
SQL["n1_normalize_notes"] = "SELECT row_id AS linked_row_id, coalesce(sheet, '—') AS page, category, note, CAST(0.4 AS DOUBLE) AS confidence FROM (" + " UNION ALL ".join(
    [f"SELECT row_id, sheet, 'Rate anomaly' AS category, 'Field ''{_ALL_HEADERS[f]}'' on row ' || row_id || ' contained non-numeric text and was moved here for review: ''' || ({x.prose(f)}) || '''' AS note FROM raw_rows" for f in NUMERIC]
    + [f"SELECT row_id, sheet, 'Child policy', 'Child column ''{k}'' on row ' || row_id || ' contained non-numeric text and was moved here for review: ''' || ({x.prose(c)}) || '''' FROM raw_rows" for c, k in CHILD_KEYS.items()]
) + ") WHERE note IS NOT NULL"
SQL["n2_repair_end_year"] = f"SELECT row_id, s AS start_date, coalesce(fixed, e) AS end_date, CASE WHEN fixed IS NULL THEN '' ELSE {FIX_TEXT} END AS warnings FROM (SELECT *, {FIX_END} AS fixed FROM {DATED})"
SQL["n3_prose_to_notes"] = "SELECT row_id, " + ", ".join(
    f"{typed(f)} AS {f}" if NUMERIC[f] else f"{x.dbl(typed(f))} AS {f}" for f in ("min_adult", "min_stay", "charge", "sgl", "dbl", "extra_bed", "longitude")
) + f", {N_MOVED} AS n_moved FROM raw_rows"
SQL["n4_child_prose_to_notes"] = f"WITH {VALUE_TYPES} SELECT r.row_id, " + ", ".join(f"{x.dbl(child_num(c))} AS {c}" for c in CHILD_KEYS) + f", {N_CHILD_MOVED} AS n_moved, {MOVED_TEXT} AS told FROM raw_rows r LEFT JOIN vt USING (contract_id)"
SQL["n5_discount_to_amount"] = f"WITH {VALUE_TYPES} SELECT r.row_id, " + ", ".join(
    f"{x.dbl(f'CASE WHEN r.dbl IS NULL THEN r.{c} ELSE ' + x.child_amount('vt.' + c + '_vt', 'r.' + c, 'r.dbl') + ' END')} AS {c}" for c in CHILD_KEYS
) + " FROM rows r LEFT JOIN vt USING (contract_id)"
SQL["n6_extra_bed_percentage"] = f"SELECT row_id, {x.dbl('coalesce(CASE WHEN extra_bed_is_pct AND extra_bed BETWEEN 0 AND 100 THEN ' + x.percent_of('dbl', '100 - extra_bed') + ' END, extra_bed)')} AS extra_bed FROM rows"
SQL["n7_column_labels"] = "SELECT contract_id, ord, coalesce(nullif(key, ''), nullif(label, ''), '') || CASE value_type WHEN 'discount_percentage' THEN ' (% off)' WHEN 'percentage_of_adult' THEN ' (% of adult)' ELSE '' END AS label FROM child_columns"
SQL["n8_apply_meta"] = """
SELECT s.contract_id, s.doc_id, s.ord, coalesce(nullif(m.name, ''), 'old') AS hotel, coalesce(nullif(m.supplier, ''), o.supplier) AS supplier, coalesce(nullif(m.country_code, ''), o.country) AS country_code,
  m.state_or_region AS state_region, coalesce(nullif(m.city_or_area, ''), o.city_area) AS city_area, coalesce(nullif(m.currency, ''), o.currency) AS currency,
  coalesce(nullif(m.currency, ''), o.currency) AS customer_currency, m.rate_type
FROM sheets s LEFT JOIN sheet_meta m USING (contract_id, doc_id) LEFT JOIN sheet_options o USING (contract_id)"""
SQL["n9_page_rows"] = """
SELECT ord, CASE WHEN max_rollaways = 1 THEN row_id ELSE 'row_' || substr(sha256(contract_id || '|' || sheet || '|' || CAST(ord AS VARCHAR)), 1, 16) END AS row_id, sheet,
  coalesce(ref, 'f | ' || sheet) AS refs, CASE WHEN confidence > 0.3 THEN confidence ELSE 0.7 END AS confidence, 'auto' AS review_state FROM rows"""
SQL["n9_page_notes"] = "SELECT note_id, page, coalesce(nullif(category, ''), 'Other') AS category, coalesce(note, '') AS note, coalesce(source_file, 'f | p') AS refs, CAST(0.5 AS DOUBLE) AS confidence FROM notes"
SQL["n10_patch_fields"] = f"WITH {PATCHED} SELECT row_id, city_area, status, CASE WHEN touched THEN 'edited' ELSE 'auto' END AS review_state, by_hotel OR coalesce(city_mark = 'user', false) AS city_by_hand FROM patched"
SQL["n11_delete_rows"] = """
SELECT row_id FROM rows r WHERE NOT EXISTS (SELECT 1 FROM deletes d WHERE d.contract_id = r.contract_id AND ((d.kind = 'season' AND d.start_date = r.start_date AND d.end_date = r.end_date)
  OR (d.kind = 'room' AND d.value = r.room) OR (d.kind = 'meal' AND d.value = r.meal_plan)))"""
SQL["n12_quick_fixes"] = f"""
SELECT r.row_id, CASE WHEN i.c THEN coalesce(r.currency, 'EUR') ELSE r.currency END AS currency, CASE WHEN i.k THEN r.currency ELSE r.customer_currency END AS customer_currency,
  CASE WHEN i.s THEN coalesce(r.supplier, 'Unknown Supplier') ELSE r.supplier END AS supplier, CASE WHEN i.w THEN '0,1,2,3,4,5,6' ELSE r.days END AS days
FROM rows r LEFT JOIN {FIXED} USING (contract_id, row_id)"""
SQL["n13_active_result"] = f"""
WITH {PATCHED} SELECT row_id, city_area, status FROM patched WHERE contract_id IN (SELECT contract_id FROM edits)
UNION ALL SELECT row_id, city_area, status FROM rows WHERE contract_id NOT IN (SELECT contract_id FROM edits)"""

# ---- validation and classification -----------------------------------------------------------------------------------

SQL["v6_strict_child_keys"] = "SELECT contract_id, row_id, hotel, sheet, 'warning' AS severity, 'Child age band ''' || key || ''' is not in the strict template. Value will be moved to Extraction Notes on export.' AS message, key AS field, CAST(NULL AS VARCHAR) AS quick_fix_type FROM (" + spread(
    "rows", "contract_id, row_id, hotel, sheet", [(f"'{k}'",) for k in CHILD_KEYS.values()], ("key",)
) + ") JOIN options USING (contract_id) WHERE child_column_mode = 'strict_template'"
SQL["v7_ignored_sheets"] = "SELECT contract_id, doc_id AS sheet, 'info' AS severity, 'Sheet/page ignored: ' || doc_id || ' (Support / policy sheet)' AS message FROM text_docs WHERE classification = 'support_notes'"
SQL["v8_coverage_issues"] = f"""
WITH {COVERAGE} SELECT contract_id, hotel, 'MISSING_RATES' AS code, {SEVERITY}, 'Rate matrix coverage for hotel ''' || hotel || ''': ' || filled || '/' || expected || ' priced (' ||
  printf('%.0f', round(CAST(filled AS DOUBLE) / expected * 100, 0)) || '%). ' || missing || ' (room, season, meal) combinations are missing rates.' AS message, missing FROM cov"""
DOMAIN_LISTS = {
    "meal_plan": ("All inclusive", "Bed and Breakfast", "Half board"), "bed_type": ("Double", "King"),
    "star_rating": ("4 Star",), "status": ("Open", "On Request", "Close", "Company Close"),
}
SQL["v9_domain_violations"] = "SELECT contract_id, row_id, field, value FROM (" + " UNION ALL ".join(
    [f"SELECT contract_id, row_id, '{f}' AS field, {f} AS value FROM rows WHERE {f} <> '' AND {f} NOT IN {words(v + ('',))}" for f, v in DOMAIN_LISTS.items()]
    + ["SELECT contract_id, row_id, 'country_code', country_code FROM rows WHERE country_code <> '' AND NOT regexp_full_match(country_code, '[A-Z]{2}')"]
) + ")"
SQL["t1_classify_sheets"] = f"WITH {SHEET_CLASS} SELECT contract_id, doc_id, CAST(rate_hits AS BIGINT) AS rate_hits, CAST(note_hits AS BIGINT) AS note_hits, classification, detected_hotel_name FROM classes"
SQL["t2_classify_pages"] = f"""
SELECT doc_id, r AS rate_hits, n AS note_hits, CASE WHEN r >= 3 OR (t > 0 AND r >= 1) THEN 'hotel_contract' WHEN n >= 3 THEN 'support_notes' ELSE 'unknown' END AS classification
FROM (SELECT doc_id, ord % 3 AS t, {x.contained('lower(raw_excerpt)', HEADER_WORDS)} AS r, {x.contained('lower(raw_excerpt)', NOTE_WORDS)} AS n FROM text_docs)"""
SQL["t3_outline_hotels"] = """
WITH h AS (SELECT contract_id, name AS hotel, 'Sheet:' || name AS source_hint, ord FROM sheets WHERE lower(trim(name)) NOT IN ('hotel list', 'sheet12', 'notes'))
SELECT *, count(*) OVER (PARTITION BY contract_id) > 1 AS is_multi_hotel FROM h"""
SQL["t5_job_sheet_summary"] = "SELECT contract_id, doc_id, kind, classification, detected_hotel_name, source_ref FROM text_docs"

# ---- sinks and streams -----------------------------------------------------------------------------------------------

_DATE_COLUMNS, _INTS = ("start_date", "end_date"), ("min_adult", "max_adult", "max_pax", "min_stay", "booking_limit", "release_period")


def export_cell(f: str) -> str:
    if f in _DATE_COLUMNS:
        return f"CAST({x.real_date(f)} AS VARCHAR)"
    if f in _INTS:
        return f"CAST({f} AS BIGINT)"
    if f in NUMERIC:
        return f"CAST({f} AS DOUBLE)"
    return f"CASE WHEN trim({f}) <> '' THEN {f} END"


def export_select(children: dict[str, str], tail: str = "") -> str:
    columns = [f'{export_cell(f)} AS "{h}"' for f, h in HOTEL_HEADERS.items()]
    columns += [f'CAST({v} AS DOUBLE) AS "{k}"' for k, v in children.items()]
    columns += [f'{export_cell(f)} AS "{h}"' for f, h in SUPP_HEADERS.items()]
    return f"SELECT contract_id, {', '.join(columns)}{tail} FROM rows"


SQL["snk1_export_hotel"] = export_select({k: c for c, k in CHILD_KEYS.items()}, ", coalesce(ref, '') AS _source_refs, confidence AS _confidence, coalesce(warning, '') AS _warnings")
SQL["snk1_export_hotel_strict"] = export_select({k: "NULL" for k in ("CHD(0-2)", "CHD(0-4)", "CHD(3-11)", "CHD(0-10)", "CHD(5-12)")})
_SHEET_NAME = "coalesce(nullif(hotel, ''), 'Unknown Hotel')"
SQL["snk2_export_per_hotel"] = f"""
WITH named AS (SELECT *, {_SHEET_NAME} AS hotel_sheet FROM rows), used AS (SELECT contract_id, hotel_sheet, {', '.join(f'count({c}) > 0 AS u_{c}' for c in CHILD_KEYS)} FROM named GROUP BY 1, 2),
several AS (SELECT contract_id FROM named GROUP BY 1 HAVING count(DISTINCT hotel_sheet) > 1)
SELECT row_id, hotel_sheet, concat_ws(' | ', CASE WHEN u_chd3 THEN 'CHD(12-17.99)' END, CASE WHEN u_chd1 THEN 'CHD1(2-11.99)' END, CASE WHEN u_chd2 THEN 'CHD2(0-5.99)' END) AS child_keys,
  {x.dbl('chd1')} AS chd1, {x.dbl('chd2')} AS chd2, {x.dbl('chd3')} AS chd3
FROM named SEMI JOIN several USING (contract_id) JOIN used USING (contract_id, hotel_sheet)"""
SQL["snk3_export_notes"] = "SELECT contract_id, coalesce(source_file, '') AS \"Source File\", coalesce(page, '') AS \"Page\", coalesce(category, '') AS \"Category\", coalesce(note, '') AS \"Note\" FROM notes"
SQL["snk4_export_supplements"] = "SELECT contract_id, " + ", ".join(
    f'{"CAST(NULL AS VARCHAR)" if n == "rate_plans" else n} AS "{h}"' for n, h in SUPPLEMENT_HEADERS.items()
) + f" FROM ({contract_supplements('supplements')})"
SQL["snk5_export_raw_rows"] = f"SELECT contract_id, row_id AS \"Hotel Code\", room AS \"Room Name\", CAST(NULL AS VARCHAR) AS \"Bed Type\", {x.dbl('dbl')} AS \"Adult 2 (DBL)\" FROM rows"


def templates(name: str, rows: str) -> str:
    owned = f"owned_{name}"
    return f"""{owned} AS (SELECT *, {x.slug('supplier')} AS slug FROM {rows} WHERE supplier <> ''),
{name} AS (
  SELECT slug, 'room' AS kind, room AS value, min(ord) AS first_seen FROM {owned} WHERE room <> '' GROUP BY 1, 3
  UNION ALL SELECT slug, 'period', start_date || '/' || end_date, min(ord) FROM {owned} WHERE start_date <> '' AND end_date <> '' GROUP BY 1, 3
  UNION ALL SELECT slug, 'meal_plan', meal_plan, min(ord) FROM {owned} WHERE meal_plan <> '' GROUP BY 1, 3
  UNION ALL SELECT slug, 'currency', v, 0 FROM (SELECT slug, arg_min_null(currency, ord) AS v FROM {owned} GROUP BY 1) WHERE v IS NOT NULL
  UNION ALL SELECT slug, 'rate_type', v, 0 FROM (SELECT slug, arg_min_null(rate_type, ord) AS v FROM {owned} GROUP BY 1) WHERE v IS NOT NULL
  UNION ALL SELECT o.slug, 'child_column', n.key, min(n.ord) FROM ncols n JOIN (SELECT DISTINCT contract_id, slug FROM {owned}) o USING (contract_id) GROUP BY 1, 3)"""


TEMPLATES = f"{COLUMNS}, {templates('template', 'rows')}"
SQL["snk6_template_versions"] = f"""
WITH {COLUMNS}, fixed AS (SELECT r.* REPLACE (CASE WHEN i.c THEN coalesce(r.currency, 'EUR') ELSE r.currency END AS currency, coalesce(r.supplier, 'Unknown Supplier') AS supplier)
  FROM rows r JOIN {FIXED} USING (contract_id, row_id) WHERE i.s),
{templates('before', 'rows')}, {templates('after', 'fixed')},
versions AS (SELECT 0 AS as_of, * FROM before UNION ALL SELECT 1, * FROM after
  UNION ALL SELECT 1, * FROM before WHERE slug NOT IN (SELECT slug FROM after))
SELECT CAST(as_of AS BIGINT) AS as_of, slug AS supplier_slug, kind, value, CAST(first_seen AS BIGINT) AS first_seen FROM versions"""
SQL["snk6_supplier_template_save"] = f"WITH {TEMPLATES} SELECT slug AS supplier_slug, kind, value, CAST(first_seen AS BIGINT) AS first_seen FROM template"
SQL["snk7_supplier_template_load"] = f"""
WITH {TEMPLATES} SELECT o.contract_id, o.s AS supplier_slug, t.kind, t.value, CAST(t.first_seen AS BIGINT) AS first_seen
FROM (SELECT contract_id, 'supplier-' || split_part(contract_id, '-', 2) AS s FROM options) o LEFT JOIN template t ON t.slug = o.s"""
SQL["ss2_job_status"] = "SELECT job_id, arg_max(event, (\"at\", event)) AS status, max(\"at\") AS at, CAST(count(*) AS BIGINT) AS events FROM job_events GROUP BY 1"
SQL["ss2_job_status_stream"] = SQL["ss2_job_status"]
SQL["ss1_incremental_landing"] = """
SELECT sha256(text) AS sha256, arg_min(path, (day, path)) AS path, min(day) AS day FROM arrivals GROUP BY 1"""
SQL["ss2_job_event_counts"] = "SELECT job_id, event, CAST(count(*) AS BIGINT) AS events FROM job_events GROUP BY 1, 2"


def oracle_sql() -> dict[str, str]:
    """Name -> statement with the views it needs."""
    return {name: sql_with_views(text, "union") for name, text in SQL.items()}
