"""Comparison of a given street with a matched one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def compare(given: Column, found: Column) -> tuple[Column, Column]:
    """Lists of minor and of meaningful differences between two parsed streets."""
    same_number = given["low"].eqNullSafe(found["low"]) & given["high"].eqNullSafe(found["high"])
    endpoint = given["high"].isNotNull() & found["high"].isNull() & ((found["low"] == given["low"]) | (found["low"] == given["high"]))
    no_number, names = given["low"].isNull(), given["name"] == found["name"]
    directions = given["predir"].eqNullSafe(found["predir"]) & given["postdir"].eqNullSafe(found["postdir"])
    suffixes, both = given["suffix"].eqNullSafe(found["suffix"]), given["suffix"].isNotNull() & found["suffix"].isNotNull()
    minor = F.array_compact(
        F.array(F.when(~no_number & ~same_number & F.coalesce(endpoint, F.lit(False)), "house_number_range_endpoint"), F.when(given["unit"].isNotNull(), "secondary_unit_in_input"), F.when(names & ~suffixes & ~both, "street_suffix_only_on_one_side"))
    )
    meaningful = F.array_compact(
        F.array(
            F.when(no_number, "house_number_missing_in_input").when(~same_number & ~F.coalesce(endpoint, F.lit(False)), "house_number_differs"), F.when(~names, "street_name_differs"), F.when(names & ~directions, "street_directional_differs"), F.when(names & ~suffixes & both, "street_suffix_differs")
        )
    )
    return minor, meaningful


def compare_places(minor: Column, meaningful: Column, city: Column, found_city: Column, zip_code: Column, found_zip: Column, plausible: Column) -> tuple[Column, Column]:
    """The lists with what city and ZIP code add: each alone is minor (an implausible ZIP code is said to be so), both together are meaningful if the ZIP code
    is plausible for its state. A missing city or ZIP code doesn't differ."""
    other_city = (F.coalesce(city, F.lit("")) != "") & (T.fold_key(city) != T.fold_key(found_city))
    other_zip = (F.coalesce(zip_code, F.lit("")) != "") & (zip_code != found_zip)
    more = F.array_compact(F.array(F.when(other_city, "city_differs"), F.when(other_zip & plausible, "zip_differs").when(other_zip, "zip_differs_outside_state")))
    return F.concat(minor, more), F.concat(meaningful, F.when(other_city & other_zip & plausible, F.array(F.lit("city_and_zip_both_differ"))).otherwise(F.array().cast("array<string>")))
