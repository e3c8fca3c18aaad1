"""Explicit schemas; nothing is inferred."""

PLACES = (
    "city string, place_id string, name string, formatted_address string, lat double, lng double, rating double, "
    "user_ratings_total bigint, price_level int, business_status string, types string, raw_json string, fetched_at timestamp"
)

PLACE_PAYLOAD = (
    "struct<place_id:string,name:string,vicinity:string,formatted_address:string,"
    "geometry:struct<location:struct<lat:double,lng:double>>,rating:double,user_ratings_total:bigint,"
    "price_level:int,business_status:string,types:array<string>>"
)

# results stay JSON text, so that the whole payload of a place survives, fields unknown here included
SEARCH_PAGE = (
    "city string, point_no bigint, page_no int, attempt int, "
    "payload struct<status:string,error_message:string,next_page_token:string,results:array<string>>"
)

PLACE_DETAIL = (
    "city string, place_id string, status string, "
    "result struct<formatted_address:string,"
    "address_components:array<struct<long_name:string,types:array<string>>>>"
)

AREA_DEMOGRAPHICS = (
    "zip5 string, census_name string, population_total bigint, median_age double, pct_under_18 double, "
    "pct_65_plus double, median_household_income bigint"
)

ENRICHED_PLACES = (
    "place_id string, city string, name string, rating double, user_ratings_total bigint, price_level int, "
    "business_status string, types string, census_name string, population_total bigint, median_age double, "
    "pct_under_18 double, pct_65_plus double, median_household_income bigint, census_state_fips string, "
    "census_place_fips string"
)
