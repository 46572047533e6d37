"""Aircraft identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_identifier(value: Column) -> Column:
    """Trimmed upper case; NULL when nothing is left."""
    return F.nullif(F.upper(F.trim(value)), F.lit(""))


def strip_callsign(value: Column) -> Column:
    """Callsign without its trailing padding underscores."""
    return F.rtrim(value, F.lit("_"))
