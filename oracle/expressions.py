"""SQL text for scalar rules, so that larger statements can be written from parts."""

from __future__ import annotations

NUMBER = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?$'"
EDGE = r"(?:^|[^\p{L}\p{N}_])"
END = r"(?:$|[^\p{L}\p{N}_])"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sq(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def fold(x: str) -> str:
    return f"lower({strip(f'coalesce({x}, {chr(39)*2})')})"


def blank(x: str) -> str:
    return f"nullif({x}, '')"


def g(x: str) -> str:
    """Decimal text without trailing zeros."""
    return rf"regexp_replace(CAST({x} AS VARCHAR), '\.?0+$', '')"


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(12,2))"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def currency(x: str) -> str:
    u = f"upper({sq(x)})"
    return (
        f"CASE WHEN contains({u}, 'EUR') OR contains({u}, '€') THEN 'EUR' WHEN contains({u}, 'USD') OR contains({u}, '$') "
        f"THEN 'USD' WHEN contains({u}, 'GBP') OR contains({u}, '£') THEN 'GBP' WHEN contains({u}, 'AED') THEN 'AED' "
        rf"WHEN contains({u}, 'EGP') THEN 'EGP' WHEN regexp_full_match({u}, '\p{{L}}{{3}}') THEN {u} END"
    )


def found_currency(x: str) -> str:
    u = f"upper({x})"
    return (
        f"CASE WHEN contains({u}, 'EUR') OR contains({u}, '€') THEN 'EUR' WHEN contains({u}, '$') OR contains({u}, 'USD') "
        f"THEN 'USD' WHEN contains({u}, 'GBP') OR contains({u}, '£') THEN 'GBP' WHEN contains({u}, 'AED') THEN 'AED' "
        f"WHEN contains({u}, 'EGP') THEN 'EGP' END"
    )


def board(x: str) -> str:
    u = f"upper({sq(x)})"
    return (
        f"CASE WHEN {u} IS NULL THEN NULL WHEN {u} IN ('ULTRA AI', 'ULTRA ALL INCLUSIVE') THEN 'Ultra All Inclusive' "
        f"WHEN contains({u}, 'AI') OR contains({u}, 'ALL INCLUSIVE') THEN 'All Inclusive' "
        f"WHEN contains({u}, 'BB') OR contains({u}, 'BED AND BREAKFAST') OR contains({u}, 'B&B') THEN 'Bed & Breakfast' "
        f"WHEN contains({u}, 'HB') OR contains({u}, 'HALF BOARD') THEN 'Half Board' "
        f"WHEN contains({u}, 'FB') OR contains({u}, 'FULL BOARD') THEN 'Full Board' "
        f"WHEN contains({u}, 'RO') OR contains({u}, 'ROOM ONLY') THEN 'Room Only' "
        f"WHEN {u} = 'BED & BREAKFAST' THEN 'Bed & Breakfast' ELSE {x} END"
    )


def found_board(x: str) -> str:
    u = f"upper({x})"
    words = [
        ("AI", "All Inclusive"), ("ALL INCLUSIVE", "All Inclusive"), ("BB", "Bed & Breakfast"),
        ("BED AND BREAKFAST", "Bed & Breakfast"), ("HB", "Half Board"), ("HALF BOARD", "Half Board"), ("FB", "Full Board"),
        ("FULL BOARD", "Full Board"), ("RO", "Room Only"), ("ROOM ONLY", "Room Only"),
    ]
    arms = " ".join(f"WHEN regexp_matches({u}, '{EDGE}{w}{END}') THEN '{name}'" for w, name in words)
    return f"CASE {arms} END"


def rate_type(x: str) -> str:
    u = f"upper({sq(x)})"
    return (
        f"CASE WHEN contains({u}, 'PER PERSON PER NIGHT') THEN 'Per Person Per Night' WHEN contains({u}, 'PER PERSON PER DAY') "
        f"THEN 'Per Person Per Day' WHEN contains({u}, 'PER ROOM PER NIGHT') OR contains({u}, 'PER UNIT PER NIGHT') THEN "
        f"'Per Room Per Night' WHEN contains({u}, 'RATES PER NIGHT PER PERSON') THEN 'Per Person Per Night' END"
    )


def status(x: str) -> str:
    s = f"lower({sq(x)})"
    return (
        f"CASE WHEN contains({s}, 'request') THEN 'On Request' WHEN contains({s}, 'open') OR contains({s}, 'live') OR "
        f"contains({s}, 'available') THEN 'Open' END"
    )


def iso_date(x: str) -> str:
    s = strip(x)
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$"

    def part(p: str, i: int, n: int) -> str:
        return f"lpad(regexp_extract({s}, '{p}', {i}), {n}, '0')"

    year = f"regexp_extract({s}, '{dmy}', 3)"
    return (
        f"CASE WHEN regexp_matches({s}, '{iso}') THEN {part(iso, 1, 4)} || '-' || {part(iso, 2, 2)} || '-' || {part(iso, 3, 2)} "
        f"WHEN regexp_matches({s}, '{dmy}') THEN lpad(CASE WHEN length({year}) = 2 THEN '20' || {year} ELSE {year} END, 4, '0') "
        f"|| '-' || {part(dmy, 2, 2)} || '-' || {part(dmy, 1, 2)} END"
    )


def real_date(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN TRY_CAST({x} AS DATE) END"


def strict_date(x: str) -> str:
    s = strip(x)
    same = " OR ".join(
        rf"regexp_matches({s}, '^\d{{1,2}}{m}\d{{1,2}}{m}\d{{2,4}}$')" for m in (r"\.", "/", "-")
    )
    d = iso_date(x)
    return (
        rf"CASE WHEN (regexp_matches({s}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') OR {same}) AND ({real_date(d)}) IS NOT NULL "
        f"THEN {d} END"
    )


def pnum(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {NUMBER}) THEN TRY_CAST({x} AS DECIMAL(18,6)) END"


def coerced(x: str, integer: bool = False, free: str = "0") -> str:
    s = sq(x)
    percent = rf"CASE WHEN {s} LIKE '%\%' ESCAPE '\' THEN " + pnum(rf"trim(regexp_replace(regexp_replace({s}, '%+$', ''), '^-+', ''))") + " END"
    plain = pnum(f"replace(replace({s}, ',', ''), ' ', '')")
    if integer:
        plain = f"CAST(trunc({plain}) AS DECIMAL(18,6))"
    return f"coalesce({percent}, {plain}, CASE WHEN upper({s}) IN ('FREE', 'FOC', 'INCLUDED') THEN CAST({free} AS DECIMAL(18,6)) END)"


def prose(x: str) -> str:
    s = sq(x)
    return (
        f"CASE WHEN ({coerced(x)}) IS NULL AND upper({s}) NOT IN ('N/A', 'NA', '-', 'NULL', 'UNDEFINED', 'NONE') THEN {s} END"
    )


def to_float(x: str) -> str:
    s = sq(x)
    cleaned = f"replace(replace(replace({s}, ',', '.'), '€', ''), '$', '')"
    cleaned = f"trim(regexp_replace(trim({cleaned}), '%$', ''))"
    return (
        f"CASE WHEN upper({s}) NOT IN ('N/A', 'NA', '-', 'FREE', 'FOC', 'NULL', 'INCLUDED') THEN {pnum(cleaned)} END"
    )


def price_cell(x: str) -> str:
    s = sq(x)
    money_mark = r"(?i)\b(EUR|EURO|USD|US\$|GBP|AED|EGP)\b|[€$£]"
    period = (
        r"\b\d{1,2}\s*[/-]\s*\d{1,2}(?:\s*[/-]\s*\d{2,4})?\b|\b\d{1,2}\s*\.\s*\d{1,2}\s*\.\s*\d{2,4}\b"
        r"|\b\d{1,2}\s*\.\s*\d{1,2}\s*-\s*\d{1,2}\s*\.\s*\d{1,2}\b"
    )
    bare = rf"regexp_replace(replace(regexp_replace({s}, '{money_mark}', '', 'g'), ',', '.'), '\s+', '', 'g')"
    value = f"TRY_CAST({bare} AS DECIMAL(12,2))"
    return (
        f"CASE WHEN upper({s}) NOT IN ('N/A', 'NA', '-', 'FREE', 'FOC', 'INCLUDED', 'NULL') AND NOT contains({s}, '%') AND NOT "
        f"contains({s}, '|') AND length({s}) <= 80 AND NOT regexp_matches({s}, '{period}') AND "
        rf"regexp_full_match({bare}, '-?\d{{1,5}}(\.\d{{1,2}})?') AND abs({value}) BETWEEN 5 AND 50000 THEN {value} END"
    )


def days_mask(x: str) -> str:
    s = strip(x)
    ranged = r"^(\d)\s*(?:to|TO|To|tO|-|–)\s*(\d)$"
    low, high = (f"TRY_CAST(regexp_extract({s}, '{ranged}', {i}) AS INT)" for i in (1, 2))
    joined = "array_to_string(list_sort(list_distinct(list_transform({}, lambda d: CASE WHEN d = '0' THEN '7' ELSE d END))), '')"
    return (
        f"CASE WHEN coalesce({s}, '') = '' THEN '1234567' WHEN regexp_full_match({s}, '[1-7]+') THEN "
        + joined.format(f"string_split({s}, '')")
        + f" WHEN regexp_matches({s}, '{ranged}') THEN "
        + joined.format(f"list_transform(range(least({low}, {high}), greatest({low}, {high}) + 1), lambda n: CAST(n AS VARCHAR))")
        + f" WHEN regexp_matches({s}, '[0-6]') THEN " + joined.format(f"regexp_extract_all({s}, '[0-6]')")
        + " ELSE '1234567' END"
    )


def day_first(x: str) -> str:
    return rf"regexp_replace(nullif({x}, ''), '^([^-]{{4}})-([^-]{{2}})-([^-]{{2}})$', '\3-\2-\1')"


def hotel_code(name: str, code: str | None = None) -> str:
    n = f"CAST(('0x' || substr(md5({fold(name)}), 1, 8)) AS BIGINT)"
    digits = " || ".join(
        f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(floor(({n} % 2176782336) / {36 ** i}) AS BIGINT) % 36 + 1, 1)"
        for i in range(5, -1, -1)
    )
    made = f"CASE WHEN {fold(name)} = '' THEN '000000' ELSE {digits} END"
    return made if code is None else f"coalesce(nullif({code}, ''), {made})"


def percent_of(amount: str, pct: str) -> str:
    return f"CAST(round(CAST({amount} AS DECIMAL(12,2)) * CAST({pct} AS DECIMAL(12,4)) * 0.01, 2) AS DECIMAL(12,2))"


def band_price(kind: str, v: str, adult: str) -> str:
    return (
        f"CASE {kind} WHEN 'amount' THEN {money(v)} WHEN 'discount_percentage' THEN CASE WHEN {v} >= 100 THEN {money('0')} ELSE "
        f"{percent_of(adult, f'100 - {v}')} END WHEN 'percentage_of_adult' THEN CASE WHEN {adult} IS NULL THEN NULL WHEN {v} >= 100 "
        f"THEN {money('0')} ELSE {percent_of(adult, v)} END END"
    )


def child_amount(kind: str, v: str, adult: str) -> str:
    return (
        f"coalesce(CASE WHEN {kind} = 'discount_percentage' AND {v} BETWEEN 0 AND 100 THEN {percent_of(adult, f'100 - {v}')} "
        f"WHEN {kind} = 'percentage_of_adult' AND {v} BETWEEN 0 AND 5 THEN CAST(round(CAST({adult} AS DECIMAL(12,2)) * "
        f"CAST({v} AS DECIMAL(12,4)), 2) AS DECIMAL(12,2)) WHEN {kind} = 'percentage_of_adult' AND {v} > 5 AND {v} <= 100 THEN "
        f"{percent_of(adult, v)} END, {money(v)})"
    )


def slug(x: str) -> str:
    return (
        f"coalesce(nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), "
        "'unknown-supplier')"
    )


def room_tokens(x: str) -> str:
    synonyms = (
        "CASE w WHEN 'sup' THEN 'superior' WHEN 'dlx' THEN 'deluxe' WHEN 'jun' THEN 'junior' WHEN 'fam' THEN 'family' WHEN 'gv' THEN "
        "'gardenview' WHEN 'sv' THEN 'seaview' WHEN 'ssv' THEN 'seasideview' WHEN 'bf' THEN 'beachfront' WHEN 'pv' THEN 'poolview' "
        "ELSE w END"
    )
    words = rf"string_split_regex(lower(trim(coalesce({x}, ''))), '[\s/_().,-]+')"
    kept = (
        f"list_filter({words}, lambda w: w NOT IN ('', 'room', 'rooms', 'type', 'view', 'couple', 'only', 'side', 'the', 'a', 'an', "
        "'&'))"
    )
    return f"list_sort(list_distinct(list_transform({kept}, lambda w: {synonyms})))"


def has_ai(x: str) -> str:
    return f"coalesce(starts_with({x}, '[AI] '), false)"


def no_ai(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '[AI] ') THEN substr({x}, 6) ELSE {x} END"


def supplement_type(kind: str, name: str, description: str) -> str:
    text = f"lower(concat_ws(' ', nullif({name}, ''), nullif({description}, '')))"
    return (
        f"CASE WHEN {kind} IN ('gala_dinner', 'festive_period', 'tax', 'city_fee') THEN 'Compulsory' WHEN contains({text}, 'obligatory') "
        f"OR contains({text}, 'compulsory') OR contains({text}, 'mandatory') THEN 'Compulsory' WHEN contains({text}, 'inclusive') AND "
        f"NOT contains({text}, 'exclusive') THEN 'Inclusive' ELSE 'Exclusive' END"
    )


def contained(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in words) + ")"


def join_list(*parts: str, mark: str = " | ") -> str:
    return f"concat_ws('{mark}', {', '.join(parts)})"
