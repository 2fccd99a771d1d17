"""String functions with the semantics that submissions are validated by: white space, UTF-16 length and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and line terminators that trimming removes.
TRIMMED = "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without the white space of TRIMMED at both ends."""
    return F.btrim(text, F.lit(TRIMMED))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_key(text: Column) -> Column:
    """Bytes whose order is that of the text's UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def default_name(name: Column, index: Column) -> Column:
    """The trimmed name, or F and the 1-based position where it is blank or missing."""
    return F.coalesce(F.nullif(trimmed(name), F.lit("")), F.concat(F.lit("F"), (index + 1).cast("string")))
