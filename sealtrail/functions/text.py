"""Text, number and time formatting.

Lengths of previews and chunks are counted in UTF-16 units, as the format's first producer
counts them: a character outside the basic plane counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealtrail.schema import CHUNK_CHARS, HEAD_LINES, PREVIEW_CHARS, TAIL_LINES

# Fixed set: the characters JavaScript's trim() removes.
_JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# A separator for rejoining paragraphs and splitting them again.
PARAGRAPH_BREAK = "\n\n"


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_JS_SPACE))


_WIDE = "UTF-16BE"


def _in_basic_plane(text: Column) -> Column:
    """Sure to be true without characters of four bytes; each of them has three bytes more than characters."""
    return F.octet_length(text) < F.length(text) + 3


def utf16_length(text: Column) -> Column:
    units = F.floor(F.octet_length(F.encode(text, _WIDE)) / 2).cast("int")
    return F.when(_in_basic_plane(text), F.length(text)).otherwise(units)


def utf16_head(text: Column, units: int) -> Column:
    """The first UTF-16 units of a text.

    Half of a character at the end becomes U+FFFD, as when such a text is stored as UTF-8.
    """
    head = F.substring(text, 1, units)
    wide = F.encode(head, _WIDE)
    last = F.hex(F.substring(wide, 2 * units - 1, 1))
    halved = last.between("D8", "DB")
    whole = F.substring(wide, 1, 2 * units)
    mended = F.concat(F.substring(wide, 1, 2 * units - 2), F.lit(bytearray(b"\xff\xfd")))
    return F.when(_in_basic_plane(head), head).otherwise(F.decode(F.when(halved, mended).otherwise(whole), _WIDE))


def cut(text: Column, chars: int, marker: str = "") -> Column:
    """First characters of a text, in UTF-16 units, with a marker if anything was cut off."""
    head = utf16_head(text, chars)
    if not marker:
        return head
    return F.concat(head, F.when(utf16_length(text) > chars, F.lit(marker)).otherwise(F.lit("")))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in milliseconds with ``Z``.

    A timestamp without zone is taken as UTC.  One with a zone is printed in
    the session's zone, which has to be UTC.
    """
    text = ts.cast("timestamp_ntz").cast("string")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.lit("."),
        F.rpad(F.substring(text, 21, 3), 3, "0"),
        F.lit("Z"),
    )


def clock_time(iso_text: Column) -> Column:
    """``HH:mm:ss`` of an ISO time, in UTC and 24 hours."""
    parsed = F.date_format(F.try_to_timestamp(iso_text), "HH:mm:ss")
    return F.when(
        iso_text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.substring(iso_text, 12, 8)
    ).otherwise(parsed)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round to digits with ties toward plus infinity (-2.5 becomes -2)."""
    scale = float(10**digits)
    value = value.cast("double")
    return F.floor(value * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def fixed_two(value: Column) -> Column:
    """A non-negative double with two decimals, as ``toFixed(2)`` prints it.

    The double's exact value decides, not its decimal print: 2.675 lies below
    the tie and gives 2.67.  Splitting the value into two short halves makes
    both products with 100 exact, so their distance to a tie has a sure sign.
    """
    value = value.cast("double")
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    low = value - high
    guess = F.floor(value * 100 + F.lit(0.5))
    gap = (high * 100 - guess.cast("double")) + low * 100
    cents = (
        F.when(gap < F.lit(-0.5), guess - 1).when(gap >= F.lit(0.5), guess + 1).otherwise(guess)
    )
    return F.concat(
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def plural_label(count: Column, noun: str = "FCO") -> Column:
    return F.concat(
        count.cast("string"), F.when(count == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s"))
    )


def turn_preview(role: Column, device_id: Column, content: Column) -> Column:
    return F.concat(role, F.lit(" via "), device_id, F.lit(": "), cut(content, PREVIEW_CHARS, "..."))


def sample_preview(name: Column, device_id: Column, sequence: Column) -> Column:
    return F.concat(
        name, F.lit(" via "), device_id, F.lit(": "), F.length(sequence).cast("string"), F.lit(" aa")
    )


def assessed_preview(name: Column, assessment: Column) -> Column:
    """Preview of a sample that arrives with an assessment."""
    return F.concat(name, F.lit(" via android: "), assessment)


def node_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def node_device(node_id: Column) -> Column:
    """Device part of a node key."""
    return F.split_part(node_id, F.lit("/"), F.lit(1))


def gps_parse(
    text: Column, default_lat: float = 37.4275, default_lng: float = -122.1697
) -> tuple[Column, Column]:
    """Latitude and longitude of ``"<lat>° N, <lng>° W"``, defaults if no match.

    Degrees are taken as signed: a west longitude is written negative.
    """
    pattern = r"(-?\d+\.\d+)°\s*N,\s*(-?\d+\.\d+)°\s*W"

    def part(group: int, default: float) -> Column:
        number = F.regexp_extract(text, pattern, group)
        return F.coalesce(F.when(number != "", number.cast("double")), F.lit(default))

    return part(1, default_lat), part(2, default_lng)


def head_lines(text: Column, lines: int = HEAD_LINES) -> Column:
    return F.substring_index(text, "\n", lines)


def tail_lines(text: Column, lines: int = TAIL_LINES) -> Column:
    return F.substring_index(text, "\n", -lines)


def text_chunks(
    text: Column, separator: str = r"\n\n+", max_chars: int = CHUNK_CHARS
) -> Column:
    """Array of chunks: paragraphs packed in order up to ``max_chars`` each.

    Lengths are UTF-16 units.  A text that fits is one chunk.  A paragraph that does not fit stays whole.
    Paragraphs in one chunk are joined by a blank line, and chunks are trimmed.
    """
    body = js_trim(text)
    joined = lambda cur, para: F.concat(cur, F.lit(PARAGRAPH_BREAK), para)
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")
    )

    def pack(acc: Column, para: Column) -> Column:
        done, cur = acc["done"], acc["cur"]
        # There are never more units than bytes, and bytes need no counting.
        gap = F.lit(len(PARAGRAPH_BREAK))
        full = (
            (cur != "")
            & (F.octet_length(cur) + gap + F.octet_length(para) > max_chars)
            & (utf16_length(cur) + gap + utf16_length(para) > max_chars)
        )
        return F.struct(
            F.when(full, F.concat(done, F.array(js_trim(cur)))).otherwise(done).alias("done"),
            F.when(full | (cur == ""), para).otherwise(joined(cur, para)).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        last = js_trim(acc["cur"])
        return F.when(last != "", F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    packed = F.aggregate(F.split(body, separator), empty, pack, finish)
    return (
        F.when(body == "", F.array().cast("array<string>"))
        .when((F.octet_length(body) <= max_chars) | (utf16_length(body) <= max_chars), F.array(body))
        .otherwise(packed)
    )


def history_text(history: Column) -> Column:
    """``Human: …`` and ``AI: …`` lines of an array of (role, content)."""
    return F.when(history.isNotNull(), F.coalesce(history_lines(history), F.lit("")))


def turn_lines(history: Column) -> Column:
    """One line per turn, null for a turn without content."""
    return F.transform(
        history,
        lambda turn: F.concat(
            F.when(turn["role"] == "user", F.lit("Human: ")).otherwise(F.lit("AI: ")),
            turn["content"],
        ),
    )


def history_lines(history: Column) -> Column:
    """The same, but null if there is no line: a turn without content leaves none."""
    said = F.filter(turn_lines(history), lambda line: line.isNotNull())
    return F.when(F.size(said) > 0, F.array_join(said, "\n"))


def joined_length(texts: Column) -> Column:
    """Length of an array's texts joined by a line break; none of them is null."""
    lengths = F.transform(texts, lambda text: F.length(text).cast("long") + 1)
    return F.greatest(F.aggregate(lengths, F.lit(-1).cast("long"), lambda total, one: total + one), F.lit(0).cast("long"))


def prompt_text(system_text: Column, history: Column, message: Column) -> Column:
    """Prompt made of a system text, the history lines and the new message."""
    return F.concat(
        system_text,
        F.lit("\n\nChat history:\n"),
        history,
        F.lit("\n\nHuman: "),
        message,
        F.lit("\nAI:"),
    )
