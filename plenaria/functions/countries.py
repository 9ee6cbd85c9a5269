"""Country notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six countries of the corpus in their order, with their codes.
COUNTRIES = ("France", "Germany", "Netherlands", "Italy", "Spain", "Poland")
CODES = {"FR": "France", "DE": "Germany", "NL": "Netherlands", "IT": "Italy", "ES": "Spain", "PL": "Poland"}


def country_name(country: Column) -> Column:
    """The country's name for a name or code in any letter case and with outer blanks; other values as they are."""
    plain = F.upper(F.trim(country))
    out = F.when(plain == COUNTRIES[0].upper(), F.lit(COUNTRIES[0]))
    for name in COUNTRIES[1:]:
        out = out.when(plain == name.upper(), F.lit(name))
    for code, name in CODES.items():
        out = out.when(plain == code, F.lit(name))
    return out.otherwise(country)
