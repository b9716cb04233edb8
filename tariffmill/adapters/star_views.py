"""Contract tables as views over the star schema: name -> SELECT, in dependency order.

The texts keep to SQL that most engines share. Where one differs per engine, it is a dict: ``spark`` unnests with
``inline`` in one scan, ``union`` spells the same rows as a UNION ALL.

A contract is a nation's suppliers in blocks of a hundred; a hotel is a supplier; a rate is an order line.
"""

from __future__ import annotations


def money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(14,2)) * 0.01 AS DECIMAL(12,2))"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def pick(expr: str, values: list[str | None], cast: str = "STRING") -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + (f"CAST(NULL AS {cast})" if v is None else v) for i, v in enumerate(values)
    )
    return f"CASE {expr} % {len(values)} {arms} END"


def quoted(*values: str | None) -> list[str | None]:
    return [None if v is None else "'" + v.replace("'", "''") + "'" for v in values]


def unnest(base: str, keep: str, rows: list[dict[str, str]], where: str = "") -> dict[str, str]:
    """Several output rows per base row: one ``inline`` scan for Spark, a UNION ALL elsewhere."""
    names = list(rows[0])
    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {r[n]}" for n in names) + ")" for r in rows
    )
    condition = f" WHERE {where}" if where else ""
    spark = f"SELECT {keep}, inline(array({structs})) FROM {base}{condition}"
    union = " UNION ALL ".join(
        f"SELECT {keep}, " + ", ".join(f"{r[n]} AS {n}" for n in names) + f" FROM {base}{condition}" for r in rows
    )
    return {"spark": spark, "union": union}


CONTRACT = "'C' || " + text(whole("s_suppkey / 100")) + " || '-' || " + text("s_nationkey")

BOARD_NAME = "CASE meal WHEN 'AI' THEN 'All inclusive' WHEN 'BB' THEN 'Bed and Breakfast' ELSE 'Half board' END"
QUARTER_START = "CASE quarter(ship) WHEN 1 THEN '-01-01' WHEN 2 THEN '-04-01' WHEN 3 THEN '-07-01' ELSE '-10-01' END"
QUARTER_END = "CASE quarter(ship) WHEN 1 THEN '-03-31' WHEN 2 THEN '-06-30' WHEN 3 THEN '-09-30' ELSE '-12-31' END"
LABEL_START = QUARTER_START.replace("quarter(ship)", "CAST(substr(season, 7, 1) AS INT)")
LABEL_END = QUARTER_END.replace("quarter(ship)", "CAST(substr(season, 7, 1) AS INT)")

VIEWS: dict[str, str | dict[str, str]] = {}

VIEWS["supplier_keys"] = f"""
SELECT s_suppkey AS suppkey, s_name AS hotel, {CONTRACT} AS contract_id, s_nationkey AS nation, s_acctbal AS balance
FROM supplier"""

VIEWS["lines"] = f"""
SELECT k.contract_id, k.hotel, k.suppkey, k.nation, p.p_type AS room,
  {text("year(l.l_shipdate)")} || '-Q' || {text("quarter(l.l_shipdate)")} AS season,
  CASE l.l_returnflag WHEN 'A' THEN 'AI' WHEN 'N' THEN 'BB' ELSE 'HB' END AS meal,
  {whole("l.l_extendedprice * 100 / l.l_quantity + 0.5")} AS cents, l.l_linestatus AS status, l.l_linenumber AS line,
  l.l_orderkey AS orderkey, l.l_partkey AS partkey, CAST(l.l_quantity AS BIGINT) AS qty,
  CAST(l.l_shipdate AS DATE) AS ship,
  ((l.l_orderkey * 10 + l.l_linenumber) * 1000000 + l.l_partkey % 1000000) * 64 + CAST(l.l_quantity AS BIGINT) AS ord
FROM lineitem l JOIN supplier_keys k ON l.l_suppkey = k.suppkey JOIN part p ON l.l_partkey = p.p_partkey"""

VIEWS["hotels"] = f"""
SELECT contract_id, hotel, suppkey AS ord,
  CASE WHEN suppkey % 3 = 0 THEN NULL ELSE 'H' || {text("suppkey")} END AS code,
  CAST(NULL AS STRING) AS sell_channel,
  CASE WHEN suppkey % 4 = 0 THEN '[AI] ' ELSE '' END || 'Supplier ' || {text("nation")} AS supplier,
  {text("1 + suppkey % 7")} || ' Star' AS star_rating, 'A hotel' AS short_description,
  CASE WHEN suppkey % 2 = 0 THEN '[AI] ' ELSE '' END || 'Street ' || {text("suppkey")} AS address_line_1,
  CAST(NULL AS STRING) AS address_line_2, CAST(NULL AS STRING) AS address_line_3,
  CASE WHEN suppkey % 5 = 0 THEN '[AI] Floor 4' ELSE NULL END AS address_line_4,
  {text("10000 + suppkey")} AS postal_code, 'GR' AS country_code,
  CASE WHEN suppkey % 3 = 1 THEN '[AI] Region' ELSE 'Region' END AS county_state_province,
  'City ' || {text("nation")} AS city_area, CAST(NULL AS STRING) AS phone,
  CASE WHEN suppkey % 6 = 0 THEN '[AI] a@b.example' ELSE NULL END AS email, 'example.com' AS website,
  CASE WHEN suppkey % 2 = 0 THEN balance ELSE NULL END AS latitude,
  CASE WHEN suppkey % 3 = 0 THEN balance ELSE NULL END AS longitude,
  CASE WHEN suppkey % 4 = 1 THEN '' WHEN suppkey % 4 = 2 THEN NULL ELSE '14:00' END AS check_in,
  CASE WHEN suppkey % 4 = 1 THEN NULL ELSE '11:00' END AS check_out,
  {pick("suppkey", ["''", None, "'USD'", "'EUR'", "'GBP'"])} AS currency
FROM supplier_keys"""

VIEWS["contracts"] = f"""
SELECT contract_id, {pick("max(nation)", quoted("Per Person Per Night", "Per Room Per Night",
    "Per Room Per Night (Pax Count)", "Per Person Per Day", "Per Room Per Stay", "Per Person Per Stay"))}
  AS detected_rate_type
FROM supplier_keys GROUP BY contract_id"""

ROOM_ORD = """CASE room WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3
  WHEN 'SMALL' THEN 4 ELSE 5 END"""
VIEWS["rooms"] = f"""
SELECT contract_id, hotel, room, ord, 'R' || {text("ord")} AS code,
  {pick("ord", quoted("Double", "Twin", None, "King", "Queen", "Single"))} AS bed_type, 1 AS min_adult,
  2 + ord % 2 AS max_adult, 2 + ord % 4 AS max_pax, ord % 2 AS max_rollaways, 1 AS max_cribs, ord % 3 AS max_children
FROM (SELECT DISTINCT contract_id, hotel, room, {ROOM_ORD} AS ord FROM lines) r"""

VIEWS["seasons"] = f"""
SELECT contract_id, hotel, season AS label, substr(season, 1, 4) || {LABEL_START} AS start_date,
  substr(season, 1, 4) || {LABEL_END} AS end_date, CAST(substr(season, 7, 1) AS INT) AS min_stay,
  7 * CAST(substr(season, 7, 1) AS INT) AS release_period,
  CAST(substr(season, 1, 4) AS INT) * 4 + CAST(substr(season, 7, 1) AS INT) AS ord
FROM (SELECT DISTINCT contract_id, hotel, season FROM lines) s"""

VIEWS["seasons_repeated"] = unnest(
    "seasons", "contract_id, hotel, min_stay, release_period", [
        {"label": "label", "start_date": "start_date", "end_date": "end_date", "ord": "ord * 3"},
        {"label": "'  ' || lower(label)", "start_date": "start_date", "end_date": "end_date", "ord": "ord * 3 + 1"},
        {
            "label": "label || '  &  ' || substr(label, 1, 4) || '-Q4'", "start_date": "start_date",
            "end_date": "substr(label, 1, 4) || '-12-31'", "ord": "ord * 3 + 2",
        },
    ],
)

VIEWS["meals"] = f"""
SELECT contract_id, hotel, meal AS code, {BOARD_NAME} AS canonical,
  CASE meal WHEN 'AI' THEN 0 WHEN 'BB' THEN 1 ELSE 2 END AS ord
FROM (SELECT DISTINCT contract_id, hotel, meal FROM lines) m"""

VIEWS["rates"] = f"""
SELECT contract_id, hotel, room, season, meal, ord,
  CASE WHEN status = 'F' AND qty % 11 <> 0 THEN {money("cents")} ELSE NULL END AS sgl,
  CASE WHEN qty % 11 <> 0 THEN {money("cents")} ELSE NULL END AS dbl,
  CASE WHEN line % 3 = 0 AND qty % 11 <> 0 THEN {money("cents + 1000")} ELSE NULL END AS tpl,
  CASE WHEN line = 7 AND qty % 11 <> 0 THEN {money("cents + 2000")} ELSE NULL END AS qdp,
  CASE WHEN line % 3 = 2 THEN NULL ELSE {money("line * 500")} END AS extra_bed_adult,
  {pick("line", quoted("amount", "discount_percentage", None))} AS extra_bed_adult_kind,
  qty % 3 AS part_idx
FROM lines"""

VIEWS["patch_rates"] = f"""
SELECT contract_id, hotel, {pick("qty", quoted("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))} AS room,
  season, {pick("line", quoted("AI", "BB", "HB"))} AS meal, ord,
  CAST(NULL AS DECIMAL(12,2)) AS sgl, CASE WHEN qty % 5 = 0 THEN NULL ELSE {money("cents")} END AS dbl,
  CAST(NULL AS DECIMAL(12,2)) AS tpl, CAST(NULL AS DECIMAL(12,2)) AS qdp
FROM lines"""

_BAND = {
    "position": "CAST(NULL AS STRING)", "label": "CAST(NULL AS STRING)", "age_from": "0", "age_to": "0",
    "value_type": "''", "value": "CAST(NULL AS DECIMAL(12,2))", "rooms_text": "CAST(NULL AS STRING)", "ord": "0",
}


def _band(ord_: int, low: str, high: str, kind: str, value: str, **more: str) -> dict[str, str]:
    return {
        **_BAND, "age_from": f"CAST({low} AS DECIMAL(5,2))", "age_to": f"CAST({high} AS DECIMAL(5,2))",
        "value_type": f"'{kind}'", "value": f"CAST({value} AS DECIMAL(12,2))", "ord": str(ord_), **more,
    }


VIEWS["child_bands"] = unnest("supplier_keys", "contract_id, hotel", [
    _band(0, "0", "12.99", "discount_percentage", "100", position="'first_child'"),
    _band(1, "0", "1.99", "amount", "suppkey % 5", position="'second_child'", label="'Infants'"),
    _band(2, "6", "12.99", "discount_percentage", "10 * (suppkey % 5)", position="'second_child'",
          rooms_text="'economy, Large ,PROMO'"),
    _band(3, "13", "17.99", "percentage_of_adult", "75", rooms_text="'Castle'"),
    _band(4, "6", "12.99", "discount_percentage", "10 * (suppkey % 5)", position="'second_child'"),
    _band(5, "2", "11.5", "not_applicable", "NULL", position="'third_child'"),
    _band(6, "2", "5", "percentage_of_adult", "120"),
])

VIEWS["supplements"] = f"""
SELECT coalesce(k.contract_id, 'C0-0') AS contract_id, coalesce(k.hotel, 'Hotel ' || {text("e.user_id")}) AS hotel,
  CASE WHEN e.event_id % 9 = 0 THEN upper(coalesce(k.hotel, '')) ELSE NULL END AS shouted,
  CASE WHEN e.event_id % 8 = 0 THEN '' ELSE {pick("e.event_id", quoted("Gala dinner", "Pool View Supp.", "Mandatory fee",
    "Inclusive drinks", "Late checkout"))} END AS name,
  'S' || {text("e.event_id % 50")} AS code,
  CASE e.event_type WHEN 'error' THEN 'gala_dinner' WHEN 'view' THEN 'room_view' WHEN 'click' THEN 'other'
    WHEN 'signup' THEN 'meal_upgrade' ELSE 'tax' END AS kind,
  CASE WHEN e.event_id % 6 = 0 THEN 'compulsory for all' ELSE NULL END AS description,
  {pick("e.event_id", quoted("ECONOMY", None, "LARGE", "", "All Rooms", "PROMO", "ALL"))} AS rooms,
  CAST(NULL AS STRING) AS rate_plans, CAST(e.event_id % 4 AS INT) AS min_stay, CAST(NULL AS INT) AS max_stay,
  CAST(NULL AS STRING) AS suppliment_type,
  {pick("e.event_id", quoted(None, "Yes", "", "No"))} AS display_as_separate_room,
  CAST(NULL AS STRING) AS contract_period,
  {pick("e.event_id", quoted("High", " high ", "Low", None))} AS season_label,
  {pick("e.event_id", quoted("2025-05-01", "2025-12-24", None))} AS start_date,
  {pick("e.event_id", quoted("2025-10-31", "24/12/2025", None))} AS end_date,
  {pick("e.event_id", quoted("Per Person Per Night", "Per Room Per Night"))} AS charge_type,
  {pick("e.event_id", quoted("Standard", "Pax Index", "Pax Count"))} AS calculation_method,
  {pick("e.event_id", quoted("Adult", "Child", "Infant", "Traveller"))} AS traveler_type,
  CAST(e.event_id % 2 AS INT) AS ordinal,
  'Fare ' || {text("e.event_id % 3")} AS fare_type_name,
  CASE WHEN e.event_id % 4 = 1 THEN CAST(2 AS DECIMAL(5,2)) ELSE NULL END AS age_min,
  CASE WHEN e.event_id % 4 = 1 THEN CAST(11.99 AS DECIMAL(5,2)) ELSE NULL END AS age_max,
  CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE CAST({whole("e.value / 25")} * 12.5 AS DECIMAL(12,2)) END AS supplier_cost,
  CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST({whole("e.value / 25")} * 12.5 AS DECIMAL(12,2)) END
    AS customer_price,
  {pick("e.event_id", quoted("amount", "percentage", "amount"))} AS cost_format, e.event_id AS ord
FROM events e LEFT JOIN supplier_keys k ON e.user_id = k.suppkey"""

_NOTHING = "CAST(NULL AS STRING)"
VIEWS["rows"] = f"""
SELECT contract_id, 'row_' || {text("ord")} AS row_id, ord, line % 3 AS batch_no,
  CASE WHEN qty % 10 = 0 THEN 'Pages:1-2' ELSE 'Page:' || {text("line")} END AS sheet,
  CASE partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE hotel END AS hotel, hotel AS true_hotel, suppkey, nation, meal,
  CASE WHEN partkey % 5 = 0 THEN NULL ELSE 'Supplier ' || {text("nation")} END AS supplier,
  CASE WHEN qty % 6 = 0 THEN NULL ELSE '4 Star' END AS star_rating, CAST(NULL AS STRING) AS short_description,
  CASE WHEN partkey % 3 = 0 THEN NULL ELSE 'Street ' || {text("suppkey")} END AS address_line_1,
  {_NOTHING} AS address_line_2, {_NOTHING} AS address_line_3, {_NOTHING} AS address_line_4, '' AS postal_code,
  {pick("qty", quoted("GR", None, "greece", "ES"))} AS country_code, {_NOTHING} AS state_region,
  {pick("qty", quoted("Athens", "", None))} AS city_area, {_NOTHING} AS phone, {_NOTHING} AS email,
  {_NOTHING} AS website, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
  {pick("qty", quoted(None, "14:00"))} AS check_in, {_NOTHING} AS check_out,
  {pick("qty", quoted(None, "", "EUR", "USD"))} AS currency, {pick("qty", quoted("EUR", None, "USD"))} AS customer_currency,
  {pick("suppkey + line", quoted("Per Person Per Night", "per room per night", "Per Room (Pax count)", None, ""))}
    AS rate_type,
  CASE WHEN partkey % 23 = 0 THEN NULL ELSE room END AS room, {pick("qty", quoted("Double", None, "King"))} AS bed_type,
  CASE WHEN qty % 2 = 0 THEN NULL ELSE 1 END AS min_adult, CASE WHEN qty % 3 = 0 THEN NULL ELSE 2 END AS max_adult,
  CAST(NULL AS INT) AS max_pax, CAST(qty % 2 AS INT) AS max_rollaways, CAST(NULL AS INT) AS max_cribs,
  CASE WHEN line = 7 THEN NULL ELSE season END AS season,
  CASE partkey % 29 WHEN 0 THEN '2026-02-30' WHEN 2 THEN NULL
    ELSE {text("year(ship)")} || {QUARTER_START} END AS start_date,
  CASE partkey % 29 WHEN 1 THEN '1994-01-01' WHEN 3 THEN '' WHEN 4 THEN {text("year(ship) - 1")} || {QUARTER_END}
    ELSE {text("year(ship)")} || {QUARTER_END} END AS end_date,
  {pick("qty", quoted(None, "0 to 6", "1,2,3", "67"))} AS days, CAST(quarter(ship) AS INT) AS min_stay,
  {pick("line", quoted("Contract", None, "Early booking"))} AS rate_plan,
  CASE WHEN line = 6 THEN NULL ELSE {BOARD_NAME} END AS meal_plan,
  {pick("qty", quoted("Open", None, "On Request", "Maybe"))} AS status, CAST(NULL AS INT) AS booking_limit,
  CAST(7 * quarter(ship) AS INT) AS release_period, {_NOTHING} AS add_charge_type,
  CAST(NULL AS DECIMAL(12,2)) AS add_charge_value, CAST(NULL AS DECIMAL(12,2)) AS charge,
  CASE WHEN status = 'F' AND qty % 13 <> 0 THEN {money("cents + 500")} ELSE NULL END AS sgl,
  CASE WHEN qty % 13 <> 0 THEN {money("cents")} ELSE NULL END AS dbl,
  CASE WHEN line % 3 = 0 AND qty % 13 <> 0 THEN {money("cents + 1000")} ELSE NULL END AS tpl,
  CAST(NULL AS DECIMAL(12,2)) AS qdp,
  CASE WHEN line = 5 AND qty % 13 <> 0 THEN CAST(30 AS DECIMAL(12,2)) ELSE NULL END AS extra_bed,
  line = 5 AND qty % 2 = 0 AS extra_bed_is_pct,
  CASE WHEN qty % 13 <> 0 AND qty % 4 <> 0 THEN {money("qty * 100")} ELSE NULL END AS chd1,
  CASE WHEN qty % 13 <> 0 THEN {money("(qty % 5) * 25")} ELSE NULL END AS chd2,
  CASE WHEN line = 1 AND qty % 13 <> 0 THEN CAST(50 AS DECIMAL(12,2)) ELSE NULL END AS chd3,
  CAST(line AS DOUBLE) / 10 AS confidence,
  CASE WHEN qty % 5 = 0 THEN 'city_area looked odd' ELSE NULL END AS warning,
  CASE WHEN partkey % 7 = 0 THEN NULL ELSE 'file.pdf | Page ' || {text("line")} END AS ref,
  CASE WHEN qty % 7 = 0 THEN 'ai' WHEN qty % 7 = 1 THEN 'user' ELSE NULL END AS city_mark,
  CAST(NULL AS DECIMAL(12,2)) AS supp_hb_adult, CAST(NULL AS DECIMAL(12,2)) AS supp_hb_child,
  CAST(NULL AS DECIMAL(12,2)) AS supp_ai_adult, CAST(NULL AS DECIMAL(12,2)) AS supp_ai_child
FROM lines"""

PLAIN = f"{text(money('cents'))}"
RAW_PRICE = (
    f"CASE qty % 9 WHEN 0 THEN NULL WHEN 1 THEN 'free' WHEN 2 THEN 'n/a' WHEN 3 THEN '-50%' WHEN 4 THEN 'on request' "
    f"WHEN 5 THEN ' ' || {PLAIN} || ' ' WHEN 6 THEN '1,' || lpad({text('cents % 1000')}, 3, '0') WHEN 7 THEN '' "
    f"ELSE {PLAIN} END"
)
VIEWS["raw_rows"] = f"""
SELECT contract_id, 'row_' || {text("ord")} AS row_id, ord, suppkey,
  CASE WHEN line = 7 THEN NULL ELSE 'Page:' || {text("line")} END AS sheet, hotel, room,
  CASE WHEN partkey % 5 = 0 THEN '' ELSE 'Supplier ' || {text("nation")} END AS supplier,
  {pick("qty", quoted("GR", None))} AS country_code, {pick("qty", quoted(None, "Athens", ""))} AS city_area,
  {pick("qty", quoted("eur", "€", "US$", "GBP sterling", "xyz", "?? none", None, "", "aed "))} AS currency,
  {pick("line", quoted("Euro", None, "chf", "$"))} AS customer_currency,
  {pick("qty", quoted(None, "14:00"))} AS check_in, {_NOTHING} AS check_out,
  {pick("qty", quoted("ai", "Ultra All Inclusive", "european", "Bed & Breakfast", "half board plus", "Picnic", "", None))}
    AS meal_plan,
  {pick("line", quoted("per person per night", "Rates per room per night", "weekly", "PER UNIT PER NIGHT", None))}
    AS rate_type,
  {pick("qty", quoted("live", "On request only", "gone", "", None))} AS status,
  CASE partkey % 7 WHEN 0 THEN {text("day(ship)")} || '/' || {text("month(ship)")} || '/' || {text("year(ship)")}
    WHEN 1 THEN {text("day(ship)")} || '.' || {text("month(ship)")} || '.' || substr({text("year(ship)")}, 3, 2)
    WHEN 2 THEN 'soon' WHEN 3 THEN NULL ELSE {text("ship")} || ' 00:00:00' END AS start_date,
  CASE partkey % 5 WHEN 0 THEN {text("year(ship) - 1")} || '-12-31' WHEN 1 THEN '31-12-' || {text("year(ship)")}
    ELSE {text("year(ship) + 1")} || '-3-1' END AS end_date,
  {pick("qty", quoted(None, "0 to 6", "1,2,3", "67", "", "3-1", "weekdays"))} AS days,
  {pick("qty", quoted("2", " 3 ", "two", "2.7", "N/A", None))} AS min_adult,
  {pick("line", quoted("4", None, "-"))} AS max_adult, {_NOTHING} AS max_pax,
  {pick("line", quoted("7 nights", "3", ""))} AS min_stay, {_NOTHING} AS booking_limit, {_NOTHING} AS release_period,
  {_NOTHING} AS latitude, '23.7275' AS longitude, {_NOTHING} AS add_charge_value,
  {pick("qty", quoted("tax included", None, "12.50"))} AS charge,
  {RAW_PRICE.replace("qty % 9", "(qty + 3) % 9")} AS sgl, {RAW_PRICE.replace("qty % 9", "(qty + line) % 9")} AS dbl,
  {_NOTHING} AS tpl, {_NOTHING} AS qdp, {pick("line", quoted("30", "free", None))} AS extra_bed,
  {_NOTHING} AS supp_hb_adult, {_NOTHING} AS supp_hb_child, {_NOTHING} AS supp_ai_adult, {_NOTHING} AS supp_ai_child,
  {pick("qty", quoted("50", "free", "n/a", "ask us", "0.5", "-30%", None))} AS chd1,
  {pick("line", quoted("0.5", "1", None, "0", "0.75"))} AS chd2,
  {pick("qty", quoted("25", "included", "75%"))} AS chd3,
  'file.pdf | Page ' || {text("line")} AS ref, CASE WHEN line = 3 THEN NULL ELSE CAST(line AS DOUBLE) / 10 END AS confidence
FROM lines"""

VIEWS["options"] = f"""
SELECT contract_id, {pick("max(nation)", quoted("Default supplier", None))} AS supplier, 'GR' AS country,
  'Athens' AS city_area, {pick("max(nation)", quoted("EUR", "", "USD"))} AS currency, 'Open' AS status,
  '15:00' AS check_in, '' AS check_out,
  {pick("max(nation)", quoted("dynamic_review", "strict_template"))} AS child_column_mode
FROM supplier_keys GROUP BY contract_id"""

VIEWS["child_columns"] = unnest("supplier_keys", "contract_id", [
    {
        "key": key, "label": label, "position": position, "age_from": f"CAST({low} AS DECIMAL(5,2))",
        "age_to": f"CAST({high} AS DECIMAL(5,2))", "value_type": kind, "ord": f"CAST(suppkey * 6 + {i} AS INT)",
    }
    for i, (key, label, position, low, high, kind) in enumerate([
        ("'CHD(12-17.99)'", "'Teens'", "CAST(NULL AS STRING)", "12", "17.99", "'amount'"),
        ("'CHD2(0-5.99)'", "CAST(NULL AS STRING)", "'second_child'", "0", "5.99",
         pick("nation", quoted("percentage_of_adult", "unknown", None))),
        ("'CHD1(2-11.99)'", "'0,1 - 11,99'", "'first_child'", "2", "11.99",
         pick("nation", quoted("discount_percentage", "amount"))),
        ("'CHD1(2-11.99)'", "'again'", "'first_child'", "2", "11.99", "'amount'"),
        ("CAST(NULL AS STRING)", "'Late teens'", "CAST(NULL AS STRING)", "NULL", "NULL", "CAST(NULL AS STRING)"),
        ("''", "CAST(NULL AS STRING)", "'third_child'", "0", "1.99", "'amount'"),
    ])
])

CELL_PRICE = money("cents + CASE WHEN qty % 3 = 0 THEN 7 ELSE 0 END")
CELL_TEXT = (
    f"CASE qty % 8 WHEN 0 THEN '€' || {text(CELL_PRICE)} WHEN 1 THEN {text(CELL_PRICE)} || ' EUR' WHEN 2 THEN 'n/a' "
    f"WHEN 3 THEN '-50%' WHEN 4 THEN replace({text(CELL_PRICE)}, '.', ',') WHEN 5 THEN '14/06-31/08' "
    f"WHEN 6 THEN '3 | 10' ELSE {text(CELL_PRICE)} END"
)
VIEWS["source_cells"] = unnest(
    "lines", "contract_id, 'Page:' || " + text("line") + " AS doc_id, 0 AS table_idx, ord AS row_idx, 'vision' AS source", [
        {"col_name": "'Period'", "raw": f"{text('year(ship)')} || {QUARTER_START} || '  -  ' || {text('year(ship)')} || "
                                        f"{QUARTER_END} || ' & 01.04.2026 - 13.06.2026'"},
        {"col_name": "'Board'", "raw": "meal"},
        {"col_name": "'Double room'", "raw": CELL_TEXT},
        {"col_name": "'Single'", "raw": CELL_TEXT.replace("qty % 8", "(qty + 3) % 8")},
    ],
)

VIEWS["page_docs"] = f"""
SELECT DISTINCT contract_id, 'Page:' || {text("line")} AS doc_id, 'pdf_page' AS kind,
  CASE WHEN line = 7 THEN 'unknown' WHEN line = 6 THEN 'index_reference' ELSE 'hotel_contract' END AS classification,
  'file.pdf | Page ' || {text("line")} AS source_ref, line AS page_number, CAST(line AS BIGINT) AS ord,
  'Text of page ' || {text("line")} AS raw_excerpt
FROM lines"""

_SENTENCE = (
    "' Valid 01/05/2025 - 31/10/2025, then 2025-11-0' || " + text("1 + doc_id % 9") + " || ' to 31.3.26. ' || "
    + pick("doc_id", quoted(
        "Prices in EUR, HB. CHD(2-11.99) and CHD (0 - 1.99) pay half. Cancellation: 30 days prior.",
        "Rates in US$ on AI basis; child discounts apply. Gala dinner 24/12 obligatory.",
        "No rates here.",
        "GBP 62,00 bed and breakfast, min stay 3 nights, taxes included, CHD(2-11.99). New year 1.1.26 - 7.1.26",
        "Special offer: early booking FOC infant 31-12-2025",
    ))
)
VIEWS["text_docs"] = f"""
SELECT 'D' || {text(whole("doc_id / 20"))} AS contract_id,
  CASE WHEN doc_id % 3 = 0 THEN 'Sheet:' || source || ' ' || {text("doc_id")} ELSE 'Page:' || {text("doc_id")} END AS doc_id,
  {pick("doc_id", quoted("excel_sheet", "pdf_page", "pdf_page"))} AS kind,
  {pick("doc_id", quoted("hotel_contract", "hotel_contract", "support_notes", "hotel_contract", "index_reference", "unknown"))}
    AS classification,
  CASE WHEN doc_id % 5 = 0 THEN 'Hotel ' || source ELSE NULL END AS detected_hotel_name,
  source || '.pdf | Page ' || {text("doc_id % 20")} AS source_ref, CAST(doc_id % 20 AS INT) AS page_number, doc_id AS ord,
  {pick("doc_id", quoted("pdf", "docx", "image", "xlsx"))} AS input_format,
  CASE WHEN doc_id % 6 = 5 THEN text ELSE text || {_SENTENCE} END AS raw_excerpt
FROM documents"""

VIEWS["text_options"] = f"""
SELECT DISTINCT 'D' || {text(whole("doc_id / 20"))} AS contract_id, 'Supplier' AS supplier, 'GR' AS country,
  'Athens' AS city_area, 'AED' AS currency, CAST(NULL AS STRING) AS status, '14:00' AS check_in,
  CAST(NULL AS STRING) AS check_out
FROM documents"""

VIEWS["doc_refs"] = f"""
SELECT 'D' || {text(whole("doc_id / 20"))} AS contract_id,
  {pick("doc_id", [
      "source || '.pdf | Page ' || " + text("doc_id % 20"), "'Page:' || " + text("doc_id"),
      "'other.pdf | Pages ' || " + text("doc_id % 10") + " || '-' || " + text("doc_id % 10 + 3"),
      "'other.pdf | Pages 900-901'", "'lost'", "'other.pdf | Pages -1 and 90'", "'book.xlsx | Rates!Row ' || " + text("doc_id % 20"),
  ])} AS source_ref
FROM documents"""

VIEWS["pdf_pages"] = f"""
SELECT 'P' || {text(whole("page_id / 5"))} AS contract_id, CAST(page_id % 5 + 1 AS INT) AS page_number,
  CASE WHEN page_id % 7 = 0 THEN '  ' ELSE html END AS text, CAST(page_id % 3 AS INT) AS n_tables,
  page_id % 2 = 0 AS has_numeric_table, page_id,
  {pick("page_id", quoted("1-3, 5", "Page 4", "", "7,9", "5-2", "Pages 2 - 2, 2, 1"))} AS hint
FROM pages"""

_SHEET = "'Sheet:' || " + pick("o_orderkey", [
    "'Order ' || " + text("o_orderkey"), "'Resort ' || " + text("o_orderkey"),
    "'Rates ' || " + text("o_orderkey"), "'Hotel List ' || " + text("o_orderkey"),
])
_ORDER_KEEP = f"'O' || {text(whole('o_orderkey / 20'))} AS contract_id, {_SHEET} AS doc_id"


def _cell(row: str, col: int, value: str, number: str = "CAST(NULL AS DOUBLE)") -> dict[str, str]:
    return {
        "row_idx": f"CAST({row} AS INT)", "col_idx": str(col), "value_str": value, "value_num": number,
        "value_type": "'n'" if number != "CAST(NULL AS DOUBLE)" else "'s'",
    }


VIEWS["head_cells"] = unnest("orders", _ORDER_KEEP, [
    _cell("0", 0, pick("o_orderkey", quoted("Grand Hotel", "Price list", "Palace & Spa"))),
    _cell("1", 0, "'Currency'"), _cell("1", 1, "'EUR'"),
    _cell("1", 2, pick("o_orderkey", quoted("cancellation", "rates", "tax", None, "vat", "terms", "gala"))),
    _cell("1", 3, pick("o_orderkey", quoted("terms", "gala", "vat", "bb", "tax", "hb"))),
    _cell("1", 4, pick("o_orderkey", quoted("gala", "tax", "no show", " AI ", "from"))),
    _cell("2", 0, pick("o_orderkey", quoted("Contract Rate 2025", "General information", "Winter season BW", "Intro"))),
    _cell("2", 3, "'  '"),
    _cell("3", 0, "'FROM'"), _cell("3", 1, "'TO'"), _cell("3", 2, "'DBL'"), _cell("3", 3, "'SGL supplement'"),
    _cell("3", 5, "'1st child'"), _cell("3", 7, "'Release'"),
    _cell("256000000", 0, pick("o_orderkey", quoted("Booking Window 30 days", None, "Remarks", "SPO\n2025", None))),
])

_LINE_ROW = "(l_linenumber * 1000000 + l_partkey % 1000000) * 64 + CAST(l_quantity AS BIGINT)"
_LINE_CENTS = whole("l_extendedprice * 100 / l_quantity + 0.5")
_LINE_DOC = _SHEET.replace("o_orderkey", "l_orderkey")
_LINE_KEEP = f"'O' || {text(whole('l_orderkey / 20'))} AS contract_id, {_LINE_DOC} AS doc_id"
_DAY = "CAST(l_shipdate AS DATE)"
# A few order lines share a sheet row; they are merged before they become cells.
VIEWS["sheet_lines"] = f"""
SELECT l_orderkey, CAST({_LINE_ROW} AS INT) AS row_idx, l_linenumber, max(l_quantity) AS l_quantity,
  max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_shipdate) AS l_shipdate,
  max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS flag, max(CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS open_line
FROM lineitem GROUP BY l_orderkey, l_linenumber, {_LINE_ROW}"""

VIEWS["line_cells"] = unnest("sheet_lines", _LINE_KEEP, [
    _cell("row_idx", 0, f"CASE WHEN l_quantity = 3 THEN '' WHEN l_linenumber % 2 = 0 THEN {text('day(' + _DAY + ')')} || '/'"
                        f" || {text('month(' + _DAY + ')')} || '/' || {text('year(' + _DAY + ')')} ELSE {text(_DAY)} END"),
    _cell("row_idx", 1, f"{text('year(' + _DAY + ') + 1')} || '-12-31'"),
    _cell("row_idx", 2, f"CASE WHEN l_quantity = 5 THEN 'n/a' ELSE {text(money(_LINE_CENTS))} END",
          f"CASE WHEN l_quantity = 5 THEN NULL ELSE CAST({money(_LINE_CENTS)} AS DOUBLE) END"),
    _cell("row_idx", 3, "CASE WHEN l_discount > 0.05 THEN '0,7' WHEN l_discount > 0.02 THEN '€ 12' ELSE NULL END"),
    _cell("row_idx", 4, "CASE WHEN l_tax > 0.04 THEN '0.3' WHEN l_tax > 0.02 THEN '2' ELSE 'free' END"),
    _cell("row_idx", 5, "CASE WHEN open_line = 0 THEN '50%' ELSE '-' END"),
    _cell("row_idx", 6, "CASE WHEN flag = 0 THEN '3' WHEN flag = 1 THEN '10,5' ELSE NULL END"),
    _cell("row_idx", 7, "CASE WHEN flag = 2 THEN '14' ELSE '7.9' END"),
])

VIEWS["cells"] = """
SELECT contract_id, doc_id, row_idx, col_idx, value_str, value_num, value_type
FROM head_cells WHERE value_str IS NOT NULL
UNION ALL
SELECT contract_id, doc_id, row_idx, col_idx, value_str, value_num, value_type
FROM line_cells WHERE value_str IS NOT NULL"""

VIEWS["blocks"] = f"""
SELECT {_ORDER_KEEP}, 0 AS block_idx, {pick("o_orderkey", quoted("Contract Rate", None, "EBD"))} AS title,
  4 AS header_row_idx, 4 AS first_data_row_idx, CASE WHEN o_orderkey % 5 = 0 THEN 256000000 ELSE 2000000000 END AS last_data_row_idx
FROM orders"""


def _role(role: str, col: int, ord_: int, **more: str) -> dict[str, str]:
    base = {
        "role": f"'{role}'", "col_idx": str(col), "label": _NOTHING, "position": _NOTHING,
        "age_from": "CAST(NULL AS DECIMAL(5,2))", "age_to": "CAST(NULL AS DECIMAL(5,2))", "value_type": _NOTHING,
        "supp_field": _NOTHING, "ord": str(ord_),
    }
    return {**base, **more}


VIEWS["block_columns"] = unnest("orders", _ORDER_KEEP + ", 0 AS block_idx", [
    _role("date_from", 0, 0), _role("date_to", 1, 1),
    _role("base_room", 2, 2, label=pick("o_orderkey", quoted("Standard GV", None, "Promo Room"))),
    _role("sgl_supp", 3, 3), _role("tpl_reduct", 4, 4),
    _role("child", 5, 5, position="'first_child'", age_from="CAST(0 AS DECIMAL(5,2))", age_to="CAST(5.99 AS DECIMAL(5,2))",
          value_type="'discount_percentage'"),
    _role("child", 4, 6, position="'second_child'", age_from="CAST(2 AS DECIMAL(5,2))", age_to="CAST(11.99 AS DECIMAL(5,2))"),
    _role("upgrade", 6, 7, label="'Sup PV'"), _role("release", 7, 8),
    _role("meal_upgrade", 6, 9, supp_field="'SUPP-HB-ADULT'"),
])

VIEWS["overrides"] = unnest("orders", _ORDER_KEEP, [
    {"position": "'first_child'", "age_from": "CAST(o_orderkey % 3 AS DECIMAL(5,2))",
     "age_to": "CAST(5.99 AS DECIMAL(5,2))", "ord": "0"},
    {"position": "'first_child'", "age_from": "CAST(2 AS DECIMAL(5,2))", "age_to": "CAST(4 AS DECIMAL(5,2))", "ord": "1"},
    {"position": "'second_child'", "age_from": "CAST(0 AS DECIMAL(5,2))", "age_to": "CAST(5 AS DECIMAL(5,2))", "ord": "2"},
])

VIEWS["occupancy"] = unnest("orders", _ORDER_KEEP, [
    {"room_name": "'SUPERIOR Pool View'", "min_adult": "1", "max_adult": "3", "max_pax": "4", "max_child": "1", "ord": "0"},
    {"room_name": "'Sup PV'", "min_adult": "2", "max_adult": "2", "max_pax": "3", "max_child": "CAST(o_orderkey % 2 AS INT)",
     "ord": "1"},
    {"room_name": "'standard'", "min_adult": "CAST(NULL AS INT)", "max_adult": "2", "max_pax": "CAST(NULL AS INT)",
     "max_child": "2", "ord": "2"},
])

VIEWS["sheet_meta"] = f"""
SELECT {_ORDER_KEEP}, {pick("o_orderkey", quoted("Grand Hotel", None))} AS name, 'Supplier' AS supplier,
  {pick("o_orderkey", quoted("GR", ""))} AS country_code, 'Attica' AS state_or_region, {_NOTHING} AS city_or_area,
  {pick("o_orderkey", quoted("EUR", "", None))} AS currency, 'Per Person Per Night' AS rate_type, '4' AS stars,
  {pick("o_orderkey", quoted("HB", "Soft All Inclusive", "bed / breakfast", None, "picnic"))} AS basic_treatment
FROM orders"""

VIEWS["sheet_options"] = f"""
SELECT DISTINCT 'O' || {text(whole("o_orderkey / 20"))} AS contract_id, 'Default supplier' AS supplier, 'ES' AS country,
  'Athens' AS city_area, 'USD' AS currency, CAST(NULL AS STRING) AS status, '14:00' AS check_in, '11:00' AS check_out
FROM orders"""

VIEWS["sheets"] = f"""
SELECT {_ORDER_KEEP}, {pick("o_orderkey", [
    "'Order ' || " + text("o_orderkey"), "'Hotel List'", "'Resort ' || " + text("o_orderkey"), "'Sheet12'",
    "' notes '", "'Customer#' || lpad(" + text("o_custkey") + ", 9, '0')"])} AS name, o_orderkey AS ord, o_custkey AS custkey
FROM orders"""

VIEWS["sheet_hotels"] = f"""
SELECT {_ORDER_KEEP}, {pick("o_orderkey", [
    "'order ' || " + text("o_orderkey"), "'Resort-' || " + text("o_orderkey + 1"), "'RESORT ' || " + text("o_orderkey"),
    "'nobody'", "'c'", "'Customer 000000001'"])} AS hotel,
  {pick("o_orderkey", [_NOTHING, "'Sheet: hotel list'", _NOTHING, "'Sheet12'", _NOTHING])} AS source_hint, o_orderkey AS ord
FROM orders"""

VIEWS["notes"] = f"""
SELECT 'N' || {text(whole("user_id / 10"))} AS contract_id, event_id AS ord, 'note_' || {text("event_id")} AS note_id,
  {pick("event_id", quoted("a.pdf", None, ""))} AS source_file, 'Page:' || {text("event_id % 4")} AS page,
  CASE event_type WHEN 'error' THEN 'Room supplement' WHEN 'view' THEN 'Special offer' WHEN 'click' THEN 'Cancellation'
    WHEN 'signup' THEN 'Other' ELSE NULL END AS category,
  {pick("event_id", quoted("Gala dinner", " gala DINNER ", "Deposit 30%", "Room upgrade", None))} AS note
FROM events"""

VIEWS["issues"] = f"""
SELECT contract_id, 'row_' || {text("ord")} AS row_id, hotel, 'Page:' || {text("line")} AS sheet,
  {pick("qty", quoted("error", "warning", "info", "warning"))} AS severity, 'message' AS message,
  {pick("line", quoted("Currency", "Supplier", None))} AS field,
  {pick("qty", quoted("set_default_currency", "copy_currency_to_customer", None, "set_default_supplier", "set_all_weekdays"))}
    AS quick_fix_type
FROM lines WHERE partkey % 3 = 0"""

VIEWS["edits"] = f"""
SELECT k.contract_id, e.event_id AS ord, {text("e.ts")} AS at, {pick("e.event_id", quoted("hotel", "season", "room"))} AS grain,
  k.hotel, {pick("e.event_id", quoted("ECONOMY", "LARGE", "PROMO"))} AS room,
  {text("1995 + e.event_id % 7")} || '-01-01' AS start_date, {text("1995 + e.event_id % 7")} || '-03-31' AS end_date,
  CAST(NULL AS STRING) AS row_id, {pick("e.event_id", quoted("city_area", "status"))} AS field,
  CASE WHEN e.event_id % 10 = 0 THEN NULL ELSE 'edit ' || {text("e.event_id")} END AS value
FROM events e JOIN supplier_keys k ON e.user_id = k.suppkey
UNION ALL
SELECT contract_id, ord, '2024-01-15 00:00:00' AS at, 'row' AS grain, hotel, room, CAST(NULL AS STRING), CAST(NULL AS STRING),
  'row_' || {text("ord")}, 'city_area', 'by row'
FROM lines WHERE qty = 50"""

VIEWS["deletes"] = f"""
SELECT contract_id, {pick("suppkey", quoted("season", "room", "meal"))} AS kind,
  {text("1995 + suppkey % 7")} || '-01-01' AS start_date, {text("1995 + suppkey % 7")} || '-03-31' AS end_date,
  {pick("suppkey", quoted(None, "ECONOMY", "Half board", None, "LARGE", "All inclusive"))} AS value
FROM supplier_keys"""

VIEWS["job_events"] = f"""
SELECT 'job_' || {text("user_id")} AS job_id, event_type AS event, {text("ts")} AS at, ts, event_id FROM events"""

VIEWS["findings"] = f"""
SELECT 'F' || {text("user_id")} AS contract_id, 'Hotel' AS hotel, event_id AS ord,
  {pick("event_id", quoted("MISSING_SUPPLEMENT", "WRONG_RATE", "MISSING_SUPPLEMENT"))} AS finding_kind,
  {pick("event_id", quoted(" Gala Dinner ", "gala dinner", "X-Mas", "", None, "Half Board", "HALF BOARD"))}
    AS missing_supplement_name
FROM events"""

VIEWS["parts"] = f"""
SELECT contract_id, CAST(suppkey % 3 AS BIGINT) AS part_idx,
  {pick("max(suppkey)", quoted("Per Person Per Night", "Per Room Per Night", "Per Room Per Night (Pax Count)"))}
    AS detected_rate_type,
  {pick("max(suppkey)", quoted("a.pdf", None, ""))} AS source_file, {pick("max(suppkey)", quoted(None, "pdf"))} AS input_format,
  CASE WHEN max(suppkey) % 5 = 0 THEN NULL ELSE CAST(max(suppkey) % 10 AS DOUBLE) / 10 END AS confidence
FROM supplier_keys GROUP BY contract_id, suppkey % 3"""

VIEWS["part_hotels"] = unnest("supplier_keys", "contract_id", [
    {"hotel": "hotel", "part_idx": "suppkey % 3", "ord": "suppkey", "city_area": _NOTHING, "phone": "'1'"},
    {"hotel": "'  ' || upper(hotel)", "part_idx": "(suppkey + 1) % 3", "ord": "suppkey", "city_area": "'Athens'",
     "phone": "'2'"},
    {"hotel": "hotel", "part_idx": "(suppkey + 2) % 3", "ord": "suppkey", "city_area": "'Rhodes'", "phone": "''"},
    {"hotel": pick("suppkey", quoted("", None, " ")), "part_idx": "suppkey % 3", "ord": "suppkey", "city_area": "'Nowhere'",
     "phone": "'3'"},
])

VIEWS["usage"] = f"""
SELECT 'U' || {text(whole("user_id / 10"))} AS contract_id, event_id AS chunk_idx, CAST(event_id % 100 AS BIGINT) AS prompt_tokens,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS completion_tokens,
  CASE WHEN event_type = 'error' THEN 'HTTP ' || {text("500 + event_id % 4")} ELSE NULL END AS error
FROM events"""

VIEWS["skeletons"] = f"""
SELECT contract_id, 'batch ' || {text("suppkey % 3")} AS batch_id, max(hotel) AS hotel, 'Skeleton supplier' AS supplier,
  'Main street' AS address_line_1, {pick("max(nation)", quoted("GR", "", None))} AS country_code, 'Attica' AS state_region,
  'Athens' AS city_area, '10558' AS postal_code, {_NOTHING} AS phone, 'x@example.com' AS email, {_NOTHING} AS website,
  'EUR' AS currency, 'EUR' AS customer_currency, 'Per Person Per Night' AS rate_type,
  CAST(max(suppkey) % 7 AS BIGINT) AS n_rooms, CAST(4 * count(*) AS BIGINT) AS n_periods, CAST(max(suppkey) % 3 AS BIGINT) AS n_meals,
  {pick("max(suppkey)", quoted("period_column", "unknown"))} AS layout_pattern
FROM supplier_keys GROUP BY contract_id, suppkey % 3"""

VIEWS["skeleton_rooms"] = f"""
SELECT contract_id, 'batch ' || {text("suppkey % 3")} AS batch_id, room, ord,
  {pick("ord", quoted("-30%", "free", "25 EUR", "n/a", "12,5", "half"))} AS literal, 1 AS min_adult, 3 AS max_adult,
  CAST(2 + ord AS INT) AS max_pax
FROM (
  SELECT DISTINCT contract_id, suppkey % 3 AS suppkey, room, CAST({ROOM_ORD} AS BIGINT) AS ord FROM lines
  UNION ALL
  SELECT DISTINCT contract_id, suppkey % 3 AS suppkey, 'Suite ' || {text("nation")} AS room, CAST(6 + nation AS BIGINT) AS ord
  FROM supplier_keys
) r"""

VIEWS["reference_hotels"] = f"""
SELECT hotel, CASE WHEN suppkey % 3 = 0 THEN NULL ELSE ' Street ' || {text("suppkey")} || ' ' END AS address_line_1,
  'Line 2' AS address_line_2, {_NOTHING} AS address_line_3, '' AS address_line_4, {text("10000 + suppkey")} AS postal_code,
  {pick("suppkey", quoted("gr", "greece", "G"))} AS country_code, 'Attica' AS state_region, 'Athens' AS city_area,
  '+30' AS phone, {_NOTHING} AS email, 'example.com' AS website, {pick("suppkey", quoted("37.5", "north"))} AS latitude,
  '23.7' AS longitude
FROM supplier_keys"""


VIEWS["files"] = f"""
SELECT 'inbox/' || {text("doc_id")} || {pick("doc_id", quoted(".xlsx", ".docx", ".pdf", ".png", ".xls", ".TIF", ".zip", "",
    ".jpeg"))} AS path,
  {pick("doc_id", quoted("25504446", "504B0304", "D0CF11E0", "89504E47", "FFD8FF", "49492A00", "4D4D002A", ""))} AS head_hex, text
FROM documents"""

# Every file arrives on one of three days, and all of them once more after a month.
VIEWS["arrivals"] = """
SELECT path, text, CAST(4 * (length(path) % 3) AS BIGINT) AS day FROM files
UNION ALL SELECT 'again/' || path, text, CAST(30 AS BIGINT) FROM files"""

VIEWS["model_texts"] = f"""
SELECT event_id AS text_id, user_id, {pick("event_id", [
    "'```json\n{\"name\": \"' || event_type || '\", \"n\": ' || " + text("user_id") + " || '}\n```'",
    "'  {\"name\": \"' || event_type || '\", \"n\": ' || " + text("user_id") + " || '}'",
    "'{\"name\": ' || event_type || '}'", "'```\n{\"name\": \"open\"'",
])} AS text, event_type
FROM events""".replace("\\n", "\n")

VIEWS["vision_texts"] = f"""
SELECT 'V' || {text(whole("event_id / 10"))} AS contract_id, 'Page:' || {text("event_id")} AS doc_id, event_id, event_type,
  {pick("event_id", [
    "'## TEXT\nHello ' || event_type || '\n## TABLES\n```json\n[{\"title\": \"Rates\", \"columns\": [\"Board\", \"Double\"], "
    "\"rows\": [{\"Board\": \"BB\", \"Double\": \"€' || " + text("user_id") + " || '\"}, {\"Board\": \"HB\", \"Double\": \"€99,00\"}]}]\n```"
    "\nand\n```json\n{\"title\": \"Broken\", \"rows\": [\n```'",
    "'Only text of ' || event_type",
    "'## TABLES\n{\"title\": \"Bare\", \"rows\": [{\"Board\": \"AI\"}]}'",
])} AS text
FROM events""".replace("\\n", "\n")


def sql_with_views(query: str, dialect: str) -> str:
    """``query`` with the views it needs, directly or through others, as common table expressions."""
    import re

    texts = {n: v if isinstance(v, str) else v["spark" if dialect == "spark" else "union"] for n, v in VIEWS.items()}
    words = {n: set(re.findall(r"\w+", t)) for n, t in texts.items()}
    needed, queue = set(), [n for n in texts if n in set(re.findall(r"\w+", query))]
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += [n for n in texts if n in words[name] and n != name]
    ctes = ",\n".join(f"{n} AS ({t.strip()})" for n, t in texts.items() if n in needed)
    body = query.strip()
    if not ctes:
        return body
    return f"WITH {ctes}\n{body}" if not body.upper().startswith("WITH ") else f"WITH {ctes},\n{body[5:]}"
