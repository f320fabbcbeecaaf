"""JSON text whose bytes are hashed, so it must equal ``JSON.stringify``'s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealtrail.schema import ENVELOPE_VERSION

# Control characters whose \u escape has a hexadecimal letter: Spark writes
# those letters in upper case, JSON.stringify in lower case.
_LETTERED_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def js_escapes(json_text: Column) -> Column:
    """JSON text written by Spark with its escapes as JSON.stringify has them.

    Only text with such an escape is rewritten.  An even run of backslashes
    before it is escaped backslashes and stays.
    """
    codes = F.array(*[F.lit(code) for code in _LETTERED_ESCAPES])

    def lower_one(text: Column, code: Column) -> Column:
        return F.regexp_replace(
            text,
            F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\u"), code),
            F.concat(F.lit(r"$1\\u"), F.lower(code)),
        )

    rewritten = F.aggregate(codes, json_text, lower_one)
    return F.when(F.contains(json_text, F.lit("\\u00")), rewritten).otherwise(json_text)


def json_object(*fields: Column) -> Column:
    """JSON object of text fields in the order given; null fields are left out."""
    return js_escapes(F.to_json(F.struct(*fields)))


def json_string(text: Column) -> Column:
    """One JSON string literal, with Spark's escapes."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def json_string_array(items: Column) -> Column:
    return js_escapes(F.to_json(items))


def js_number(value: Column) -> Column:
    """A double as JavaScript prints it: ``5``, ``0.0001``, ``1e+21``.

    Digits come from Java's double printing, which is shortest-form on JDK 19
    and later; older JDKs may add a digit to magnitudes of about 1e17 and up.
    """
    value = value.cast("double")
    size = F.abs(value)
    text = value.cast("string")
    power = F.replace(F.replace(text, F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e+"))
    return (
        F.when(value == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), _trim_zeros(text))
        .when((size >= 1e7) & (size < 1e21), _trim_zeros(value.cast("decimal(38,16)").cast("string")))
        .when((size >= 1e-6) & (size < 1e-3), _trim_zeros(value.cast("decimal(38,24)").cast("string")))
        .otherwise(F.replace(power, F.lit("e+-"), F.lit("e-")))
    )


def _trim_zeros(text: Column) -> Column:
    """Drop the zeros after a decimal point, and the point if nothing follows."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def canonical_envelope(
    *,
    object_type: Column,
    parents: Column,
    media_type: Column,
    bytes_sha256: Column,
    byte_length: Column,
    author: Column,
    release_class: Column,
    device_id: Column,
    device_type: Column,
    claim_type: Column,
    statement: Column,
    claim_ceiling: Column,
    created_at_utc: Column,
) -> Column:
    """Canonical envelope text: keys sorted at every level, no white space.

    An absent device id or type is left out, as an undefined key would be.
    """
    return json_object(
        F.struct(
            author.alias("author"),
            device_id.alias("device_id"),
            device_type.alias("device_type"),
            release_class.alias("release_class"),
        ).alias("authorization"),
        F.struct(
            claim_ceiling.alias("claim_ceiling"),
            statement.alias("statement"),
            claim_type.alias("type"),
        ).alias("claim"),
        created_at_utc.alias("created_at_utc"),
        F.lit(ENVELOPE_VERSION).alias("fco_version"),
        object_type.alias("object_type"),
        parents.alias("parents"),
        F.struct(
            byte_length.cast("long").alias("byte_length"),
            bytes_sha256.alias("bytes_sha256"),
            media_type.alias("media_type"),
        ).alias("payload"),
    )


def canonical_json(text: Column) -> Column:
    """Canonical form of free-form JSON text, null where it does not parse.

    The variant type keeps object keys sorted.  Numbers are printed by Spark,
    so only integers and plain decimals are sure to keep their text.
    """
    return js_escapes(F.to_json(F.try_parse_json(text)))
