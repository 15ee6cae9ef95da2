"""Words of a text as column expressions: A-Z lower-cased, other letters left as they are."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything in ASCII but digits and letters parts words.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII takes the faster built-in. Null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    narrow = F.char_length(text) == F.octet_length(text)
    return F.when(narrow, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Array of the words of a text; none for null, empty and wordless texts."""
    return F.array_remove(F.split(lower_ascii(text), NOT_A_WORD), "")
