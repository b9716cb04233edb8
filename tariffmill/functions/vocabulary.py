"""Currencies, boards, rate types, statuses, supplement types and other controlled vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffmill.functions.base import any_contains, blank, cases, col, count_contained, squeezed

# Currency tokens in order of precedence, and the code each stands for.
CURRENCY_TOKENS = {
    "EUR": ("EUR", "€", "EURO"),
    "USD": ("USD", "US$", "$"),
    "GBP": ("GBP", "£"),
    "AED": ("AED",),
    "EGP": ("EGP",),
}

# Board names in order of precedence.
BOARD_TOKENS = {
    "AI": "All Inclusive",
    "ALL INCLUSIVE": "All Inclusive",
    "HARD ALL INCLUSIVE": "All Inclusive",
    "SOFT ALL INCLUSIVE": "All Inclusive",
    "ULTRA AI": "Ultra All Inclusive",
    "ULTRA ALL INCLUSIVE": "Ultra All Inclusive",
    "BB": "Bed & Breakfast",
    "BED AND BREAKFAST": "Bed & Breakfast",
    "B&B": "Bed & Breakfast",
    "HB": "Half Board",
    "HALF BOARD": "Half Board",
    "FB": "Full Board",
    "FULL BOARD": "Full Board",
    "RO": "Room Only",
    "ROOM ONLY": "Room Only",
}

# Board words looked for in running text, in order of precedence.
TEXT_BOARD_WORDS = (
    "AI", "ALL INCLUSIVE", "HARD ALL INCLUSIVE", "SOFT ALL INCLUSIVE", "BB", "BED AND BREAKFAST", "HB", "HALF BOARD",
    "FB", "FULL BOARD", "RO", "ROOM ONLY",
)

# Rate type phrases in order of precedence.
RATE_TYPE_TOKENS = {
    "PER PERSON PER NIGHT": "Per Person Per Night",
    "PER PERSON PER DAY": "Per Person Per Day",
    "PER ROOM PER NIGHT": "Per Room Per Night",
    "PER UNIT PER NIGHT": "Per Room Per Night",
    "RATES PER NIGHT PER PERSON": "Per Person Per Night",
}

# Canonical rate types of a contract and the layout each is exported in.
LAYOUT_OF_RATE_TYPE = {
    "Per Person Per Night": "ppn",
    "Per Person Per Day": "ppn",
    "Per Person Per Stay": "ppn",
    "Per Room Per Night": "prn_ac",
    "Per Room Per Night (Pax Count)": "prn_pax",
    "Per Room Per Stay": "prn_ac",
}

# The rate type printed by each layout.
RATE_TYPE_OF_LAYOUT = {
    "ppn": "Per Person Per Night",
    "prn_ac": "Per Room Per Night (Adult / Child count)",
    "prn_pax": "Per Room Per Night (Pax count)",
}

# Supplement names that describe a room view.
ROOM_VIEW_WORDS = (
    "supp.", "view supp", "pool view", "sea view", "sea side view", "garden view", "beach front", "swim up", "swim-up",
)

# Supplement kinds that are always compulsory, and the words that make any other kind so.
COMPULSORY_KINDS = ("gala_dinner", "festive_period", "tax", "city_fee")
COMPULSORY_WORDS = ("obligatory", "compulsory", "mandatory")

# Tokens of rate tables in page text.
RATE_TABLE_TOKENS = (
    "from", "to", "period", "room", "rate", "rates", "single", "double", "triple", "child", "chd", "sgl", "dbl", "tpl",
    "extra bed", "supplement", "release", "min stay", "meal", "bb", "hb", "fb", "ai", "board", "allotment",
    "occupancy", "per person", "per room", "per night", "price list", "season",
)


def _first_board(text: Column) -> Column:
    return cases([(text.contains(token), name) for token, name in BOARD_TOKENS.items()])


def normalize_currency(c: Column | str) -> Column:
    """FN1: three-letter code, by token precedence; null when the text names no currency."""
    return currency_of(upper_text(c))


def upper_text(c: Column | str) -> Column:
    """Stripped upper case: what the rules below look at. Keep it in a column of its own when rules repeat per row."""
    return F.upper(squeezed(c))


def currency_of(s: Column) -> Column:
    rules = [(any_contains(s, tokens), code) for code, tokens in CURRENCY_TOKENS.items()]
    return cases(rules + [(s.rlike(r"^\p{L}{3}$"), s)])


def normalize_meal_plan(c: Column | str) -> Column:
    """FN2: exact name first, then the first board token contained, else the text as given."""
    return F.when(squeezed(c).isNotNull(), F.coalesce(board_of(upper_text(c)), col(c)))


def board_of(s: Column) -> Column:
    exact = cases([(s == token, name) for token, name in BOARD_TOKENS.items()])
    spelled = F.when(s == "BED & BREAKFAST", F.lit("Bed & Breakfast"))
    return F.coalesce(exact, _first_board(s), spelled)


def normalize_rate_type(c: Column | str) -> Column:
    """FN3."""
    return rate_type_of(upper_text(c))


def rate_type_of(s: Column) -> Column:
    return cases([(s.contains(token), name) for token, name in RATE_TYPE_TOKENS.items()])


def normalize_status(c: Column | str) -> Column:
    """FN4."""
    return status_of(upper_text(c))


def status_of(s: Column) -> Column:
    return cases([
        (s.contains("REQUEST"), "On Request"),
        (any_contains(s, ("OPEN", "LIVE", "AVAILABLE")), "Open"),
    ])


def supplement_type(kind: Column | str, name: Column | str, description: Column | str) -> Column:
    """FN17: Compulsory, Inclusive or Exclusive."""
    text = F.lower(F.concat_ws(" ", blank(name), blank(description)))
    return cases([
        (F.coalesce(col(kind).isin(*COMPULSORY_KINDS), F.lit(False)), "Compulsory"),
        (any_contains(text, COMPULSORY_WORDS), "Compulsory"),
        (text.contains("inclusive") & ~text.contains("exclusive"), "Inclusive"),
    ], default="Exclusive")


def fare_type_name(method: Column | str, traveler: Column | str, label: Column | str) -> Column:
    """FN16a: 'Per Adult' and so on for the Standard method, else the contract's own label."""
    known = F.when(col(traveler).isin("Adult", "Child", "Infant", "Traveller"), F.concat(F.lit("Per "), col(traveler)))
    return F.when(col(method) == "Standard", known).otherwise(col(label))


def standard_count_index(method: Column | str, charge: Column | str, ordinal: Column | str) -> Column:
    """FN16b: blank for Standard per person per night, else the ordinal."""
    plain = F.coalesce((col(method) == "Standard") & (col(charge) == "Per Person Per Night"), F.lit(False))
    return F.when(~plain, col(ordinal))


def detect_currency(text: Column | str) -> Column:
    """FN18: first currency, by precedence, named anywhere in the text."""
    s = F.upper(col(text))
    return cases([(any_contains(s, tokens), code) for code, tokens in CURRENCY_TOKENS.items()])


def detect_meal_plan(text: Column | str) -> Column:
    """FN19: first board, by precedence, that stands as whole words in the text."""
    s = F.upper(col(text))
    return cases([(s.rlike(rf"(?U)\b{word}\b"), BOARD_TOKENS[word]) for word in TEXT_BOARD_WORDS])


def meal_from_treatment(c: Column | str) -> Column:
    """FN25: board of a sheet's 'basic treatment' line."""
    low = F.lower(blank(c))
    bare = F.btrim(low)
    return cases([
        (low.contains("all inclusive") | bare.isin("ai", "hai", "sai"), "All Inclusive"),
        (low.contains("half board") | (bare == "hb"), "Half Board"),
        (low.contains("full board") | (bare == "fb"), "Full Board"),
        (low.contains("bed") & low.contains("breakfast"), "Bed & Breakfast"),
        (bare.isin("bb", "b&b"), "Bed & Breakfast"),
        (low.contains("room only") | (bare == "ro"), "Room Only"),
    ], default=F.initcap(F.btrim(col(c))))


def is_room_view_name(name: Column | str) -> Column:
    """True for supplement names that describe a room view."""
    return F.coalesce(any_contains(F.lower(blank(name)), ROOM_VIEW_WORDS), F.lit(False))


def rate_token_hits(text: Column | str) -> Column:
    """FN27: how many of the rate table tokens the text contains."""
    return count_contained(F.lower(F.coalesce(col(text), F.lit(""))), RATE_TABLE_TOKENS)


def layout_of_rate_type(c: Column | str) -> Column:
    """Export layout of a canonical rate type; unknown types export per person per night."""
    return cases([(col(c) == name, layout) for name, layout in LAYOUT_OF_RATE_TYPE.items()], default="ppn")


def rate_type_of_layout(c: Column | str) -> Column:
    return cases([(col(c) == layout, text) for layout, text in RATE_TYPE_OF_LAYOUT.items()])
