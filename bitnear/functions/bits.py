"""Column expressions over 64-bit hashes. All are built-in expressions, so they stay in whole-stage codegen.

Nulls: a null operand, or a null centre or distance of a ball, gives null; a filter then drops the row.
A negative distance matches nothing, 64 or more matches every non-null hash.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of the errors that callers match on.
BITS_LENGTH_ERROR = "bitstring_to_int64() input MUST be 64 characters long. Passed string length: "
BITS_CHARACTER_ERROR = "bitstring_to_int64() input can only contain either '1' or '0'. Found bad char '"
BITS_INDEX_TEXT = "' at index "
NO_COLUMN = 'column "{}" does not exist'
NULL_DISTANCE = "distance cannot be NULL"


def as_hash(value: Column | str | int) -> Column:
    """A column from a column, a column's name or an integer."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value).cast("bigint")


def hamming(a: Column | str | int, b: Column | str | int) -> Column:
    """Number of differing bits, 0..64, as bigint."""
    return F.bit_count(as_hash(a).bitwiseXOR(as_hash(b))).cast("bigint")


def within(value: Column | str | int, center: Column | str | int, distance: Column | str | int) -> Column:
    """Is the value in the ball, the border included? No arithmetic is done on the distance, so any bigint is safe."""
    return F.bit_count(as_hash(value).bitwiseXOR(as_hash(center))) <= as_hash(distance)


def area(center: Column | str | int, distance: Column | str | int) -> Column:
    """A ball as struct<center:bigint,distance:bigint>."""
    return F.struct(as_hash(center).cast("bigint").alias("center"), as_hash(distance).cast("bigint").alias("distance"))


def within_area(value: Column | str | int, ball: Column | str) -> Column:
    """within() for a ball held as a struct."""
    ball = as_hash(ball)
    return within(value, ball["center"], ball["distance"])


def equal_bits(a: Column | str | int, b: Column | str | int) -> Column:
    """64-bit equality; against a literal it is pushed to Parquet."""
    return as_hash(a) == as_hash(b)


def to_bitstring(value: Column | str | int) -> Column:
    """64 characters, most significant bit first, two's complement."""
    return F.lpad(F.bin(as_hash(value)), 64, "0")


def from_bitstring(text: Column | str) -> Column:
    """Inverse of to_bitstring. Fails the query on a wrong length (in bytes) first, then on the first bad character.

    conv() alone would silently read only a prefix, hence the checks.
    """
    text = F.col(text) if isinstance(text, str) else text
    bad = F.regexp_instr(text, F.lit("[^01]"))
    fault = F.when(
        F.octet_length(text) != 64, F.concat(F.lit(BITS_LENGTH_ERROR), F.octet_length(text).cast("string"))
    ).otherwise(
        F.concat(
            F.lit(BITS_CHARACTER_ERROR), F.substr(text, bad, F.lit(1)), F.lit(BITS_INDEX_TEXT), (bad - 1).cast("string")
        )
    )
    broken = (F.octet_length(text) != 64) | (bad > 0)
    return F.when(broken, F.raise_error(fault).cast("bigint")).otherwise(F.conv(text, 2, -10).cast("bigint"))
