"""Table schemas, headers and domains of the contract model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
AGE = T.DecimalType(5, 2)
NUMBER = T.DecimalType(18, 6)

PRICE_FIELDS = ("sgl", "dbl", "tpl", "qdp", "extra_bed")
OCCUPANCY_PRICES = ("sgl", "dbl", "tpl", "qdp")

# The hotel sheet's base columns, in order, as column name and printed header.
HOTEL_HEADERS = {
    "hotel": "Hotel Name",
    "supplier": "Supplier",
    "star_rating": "Star Rating",
    "short_description": "Short Description",
    "address_line_1": "Address Line 1",
    "address_line_2": "Address Line 2",
    "address_line_3": "Address Line 3",
    "address_line_4": "Address Line 4",
    "postal_code": "Postal Code",
    "country_code": "Country Code ",
    "state_region": "State / Province / Region",
    "city_area": "City / Area",
    "phone": "Phone Number",
    "email": "Email Address",
    "website": "Hotel Website",
    "latitude": "Latitude",
    "longitude": "Longitude",
    "check_in": "Check-In",
    "check_out": "Check-Out",
    "currency": "Currency",
    "rate_type": "Rate Type",
    "room": "Room Name",
    "min_adult": "Min Adult",
    "max_adult": "Max Adult",
    "max_pax": "Max Pax",
    "season": "Season",
    "start_date": "Start Date",
    "end_date": "End Date",
    "days": "Days",
    "min_stay": "Min Stay",
    "rate_plan": "Rate Plan",
    "meal_plan": "Meal Plan",
    "status": "Status",
    "booking_limit": "Booking Limit",
    "release_period": "Release Period",
    "customer_currency": "Customer Price Currency",
    "add_charge_type": "Add Charge Type",
    "add_charge_value": "Add Charge Value",
    "charge": "Charge",
    "sgl": "SGL",
    "dbl": "DBL",
    "tpl": "TPL",
    "qdp": "QDP",
    "extra_bed": "Extra Bed",
}

# The four meal supplement columns that close the hotel sheet.
SUPP_HEADERS = {
    "supp_hb_adult": "SUPP-HB-ADULT",
    "supp_hb_child": "SUPP-HB-CHILD",
    "supp_ai_adult": "SUPP-AI-ADULT",
    "supp_ai_child": "SUPP-AI-CHILD",
}

# Numeric columns of the hotel sheet; integers first.
INTEGER_FIELDS = ("min_adult", "max_adult", "max_pax", "min_stay", "booking_limit", "release_period")
GEO_FIELDS = ("latitude", "longitude")
MONEY_FIELDS = (
    "add_charge_value", "charge", "sgl", "dbl", "tpl", "qdp", "extra_bed",
    "supp_hb_adult", "supp_hb_child", "supp_ai_adult", "supp_ai_child",
)
NUMERIC_FIELDS = INTEGER_FIELDS + GEO_FIELDS + MONEY_FIELDS
DATE_FIELDS = ("start_date", "end_date")

# Child columns of the strict layout.
STRICT_CHILD_KEYS = ("CHD(0-2)", "CHD(0-4)", "CHD(3-11)", "CHD(0-10)", "CHD(5-12)")

# Columns of the notes sheet.
NOTE_HEADERS = {"source_file": "Source File", "page": "Page", "category": "Category", "note": "Note"}

# The supplement sheet's columns, in order.
SUPPLEMENT_HEADERS = {
    "hotel": "Hotel Name",
    "hotel_code": "Hotel Code",
    "supplement_code": "Supplement Code",
    "supplement_name": "Supplement Name",
    "rooms": "Rooms",
    "rate_plans": "Rate Plans",
    "min_stay": "Min Stay",
    "max_stay": "Max Stay",
    "supplement_type": "Supplement Type",
    "display_as_separate_room": "Display As Separate Room",
    "meal_plan": "Meal Plan",
    "required_supplement": "Required Supplement",
    "restricted_supplement": "Restricted Supplement",
    "display_on_customer_documentation": "Display on Customer Documentation",
    "display_on_supplier_notification": "Display on Supplier Notification",
    "description": "Description",
    "contract_period": "Contract Period",
    "season_name": "Season Name",
    "start_date": "Start Date (DD-MM-YYYY)",
    "end_date": "End Date (DD-MM-YYYY)",
    "supplier": "Supplier",
    "currency": "Currency",
    "charge_type": "Charge Type",
    "calculation_method": "Calculation Method",
    "traveler_type": "Traveler Type",
    "fare_type_name": "FareType Name",
    "standard_count_index": "Standard / Count / Index",
    "min_age": "Min Age",
    "max_age": "Max Age",
    "min_adult": "Min Adult",
    "max_adult": "Max Adult",
    "max_child": "Max Child",
    "supplier_cost": "Supplier Cost",
    "customer_price": "Customer Price",
}

SUPPLEMENT_TYPES = {
    "min_stay": T.IntegerType(), "max_stay": T.IntegerType(), "standard_count_index": T.IntegerType(),
    "min_age": AGE, "max_age": AGE, "min_adult": T.IntegerType(), "max_adult": T.IntegerType(),
    "max_child": T.IntegerType(),
}

# Child columns the raw hotel layout no longer carries.
DROPPED_CHILD_HEADERS = (
    "1st Child Price", "1st Child Age Min", "1st Child Age Max",
    "2nd Child Price", "2nd Child Age Min", "2nd Child Age Max",
    "3rd Child Price", "3rd Child Age Min", "3rd Child Age Max",
    "Baby 1 (0-1)", "Child 1 (2-12)", "Teen 1 (12-17)",
    "Multi Infant (0-1)", "Extra Child (2-12)", "Extra Teen (12-17)",
)

# Pick lists of the review screens, by row field.
DOMAINS = {
    "meal_plan": (
        "All inclusive", "American", "As brochured", "Bed and Breakfast", "Breakfast", "Continental breakfast",
        "Dinner", "European", "Family plan", "Full board", "Full breakfast", "Half board", "Lunch",
        "Modified American", "No meals", "Room only", "Self-catering", "Ultra All Inclusive",
    ),
    "bed_type": (
        "Double", "Full", "Futon", "King", "Queen", "Single", "Sofa bed", "Twin", "Murphy bed", "Dorm bed",
        "Run of the house", "Tatami mats", "Water bed",
    ),
    "star_rating": (
        "1 Star", "2 Star", "3 Star", "4 Star", "5 Star", "6 Star", "7 Star", "Boutique Hotel", "Self Catering",
    ),
    "status": ("Open", "On Request", "Close", "Company Close"),
}


CELL_META = "map<string,struct<confidence:double,source_ref:string,ai_inferred:boolean,user_edited:boolean>>"

CANONICAL_HOTEL = (
    "name string, code string, sell_channel string, supplier string, star_rating string, short_description string, "
    "address_line_1 string, address_line_2 string, address_line_3 string, address_line_4 string, postal_code string, "
    "country_code string, county_state_province string, city_area string, phone string, email string, website string, "
    "latitude double, longitude double, check_in string, check_out string, currency string, contract_start string, "
    "contract_end string, contract_period_label string"
)
CANONICAL_ROOM = (
    "name string, code string, bed_type string, min_adult int, max_adult int, max_pax int, max_rollaways int, "
    "max_cribs int, max_children int"
)
CANONICAL_SEASON = "label string, start_date string, end_date string, min_stay int, release_period int"
CANONICAL_MEAL = "code string, canonical string"
CANONICAL_RATE = (
    "room_name string, season_label string, meal_code string, sgl double, dbl double, tpl double, qdp double, "
    "extra_bed_adult double, extra_bed_adult_kind string, extra_bed_child double, extra_bed_child_kind string"
)
CANONICAL_BAND = (
    "position string, label string, age_from double, age_to double, value_type string, value double, "
    "conditions string, applies_to_rooms array<string>"
)
CANONICAL_SUPPLEMENT = (
    "name string, code string, kind string, description string, hotel_name string, rooms string, rate_plans string, "
    "min_stay int, max_stay int, suppliment_type string, display_as_separate_room string, contract_period string, "
    "season_label string, start_date string, end_date string, charge_type string, calculation_method string, "
    "traveler_type string, ordinal int, fare_type_name string, age_min double, age_max double, supplier_cost double, "
    "customer_price double, cost_format string"
)
CANONICAL_NOTE = "category string, note string, hotel_name string"


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(", ")) + ">"


CANONICAL_CONTRACT = (
    "source_filename string, is_multi_hotel boolean, detected_rate_type string, "
    f"hotels array<struct<metadata:{_struct(CANONICAL_HOTEL)}, rooms:array<{_struct(CANONICAL_ROOM)}>, "
    f"seasons:array<{_struct(CANONICAL_SEASON)}>, meal_plans:array<{_struct(CANONICAL_MEAL)}>, "
    f"rates:array<{_struct(CANONICAL_RATE)}>, child_policy:array<{_struct(CANONICAL_BAND)}>>>, "
    f"supplements array<{_struct(CANONICAL_SUPPLEMENT)}>, notes array<{_struct(CANONICAL_NOTE)}>"
)
