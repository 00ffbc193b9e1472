"""The SQL surface: temporary SQL functions, which Catalyst inlines completely."""

from pyspark.sql import SparkSession

from bitnear.functions import bits


def register(spark: SparkSession) -> None:
    """Create hamming_distance, hash_equal, area, within_area, within_ball, int64_to_bitstring and bitstring_to_int64."""
    ball = "struct<center:bigint,distance:bigint>"
    quoted = {k: v.replace("'", "\\'") for k, v in vars(bits).items() if k.startswith("BITS_")}
    length_error = f"concat('{quoted['BITS_LENGTH_ERROR']}', octet_length(s))"
    character_error = (
        f"concat('{quoted['BITS_CHARACTER_ERROR']}', substr(s, regexp_instr(s, '[^01]'), 1), "
        f"'{quoted['BITS_INDEX_TEXT']}', regexp_instr(s, '[^01]') - 1)"
    )
    for head, body in (
        ("hamming_distance(a bigint, b bigint) RETURNS bigint", "cast(bit_count(a ^ b) AS bigint)"),
        ("hash_equal(a bigint, b bigint) RETURNS boolean", "a = b"),
        (f"area(c bigint, d bigint) RETURNS {ball}", "named_struct('center', c, 'distance', d)"),
        (f"within_area(v bigint, ball {ball}) RETURNS boolean", "bit_count(v ^ ball.center) <= ball.distance"),
        ("within_ball(v bigint, c bigint, d bigint) RETURNS boolean", "bit_count(v ^ c) <= d"),
        ("int64_to_bitstring(v bigint) RETURNS string", "lpad(bin(v), 64, '0')"),
        (
            "bitstring_to_int64(s string) RETURNS bigint",
            f"CASE WHEN octet_length(s) <> 64 THEN cast(raise_error({length_error}) AS bigint) "
            f"WHEN regexp_instr(s, '[^01]') > 0 THEN cast(raise_error({character_error}) AS bigint) "
            "ELSE cast(conv(s, 2, -10) AS bigint) END",
        ),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_search(spark: SparkSession, name: str, table: str, column: str, key: str) -> None:
    """Create the table function name(targets array<bigint>, distance bigint) -> (target, match, key) over a view or table.

    key is a column that identifies a row and stands in place of a physical row address. Null hashes never match.
    """
    source = spark.table(table)
    for c in (column, key):
        if c not in source.columns:
            raise ValueError(bits.NO_COLUMN.format(c))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(targets array<bigint>, distance bigint) "
        f"RETURNS TABLE(target bigint, match bigint, key {source.schema[key].dataType.simpleString()}) "
        f"RETURN SELECT t.target, s.`{column}`, s.`{key}` FROM explode({name}.targets) AS t(target) "
        f"JOIN {table} s ON bit_count(s.`{column}` ^ t.target) <= {name}.distance"
    )
