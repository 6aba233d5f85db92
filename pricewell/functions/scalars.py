"""Column functions: cleansing, formats, and texts. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
#: The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PERIOD = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
#: What the two sources write for a missing number.
PRIMARY_MISSING = ("", "...", "…", "..", ".", "-", "na", "n/a", "null")
COMPARISON_MISSING = ("", ".", "..", "...", "na", "n/a", "null")
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, use) -> Column:
    """use(value), with the value made once and `use` kept out of the code that Spark generates for the whole stage.

    The JVM does not compile methods of over 8,000 bytes, and a stage with many texts becomes one; what stands in a
    lambda is evaluated node by node instead, each by a method that is compiled.
    """
    return F.get(F.transform(F.array(value), use), 0)


def apart(x: Column) -> Column:
    """x, which takes the projection that it stands in out of the code of the whole stage.

    Such a projection is generated by itself, and then Spark cuts it into methods that are small enough to be compiled;
    what stands in no lambda there is not evaluated node by node. x may not be a constant.
    """
    return let(x, lambda same: same)


def normalize_text(x: Column) -> Column:
    """Null to '', each run of white space to one space, no space at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def normalize_header(x: Column) -> Column:
    return F.lower(normalize_text(x))


def finite(x: Column) -> Column:
    """Never null. NaN is greater than infinity in Spark, so one comparison, with one mention of x, tells all."""
    return F.coalesce(F.abs(x) < INFINITY, F.lit(False))


def trimmed(x: Column) -> Column:
    """Null to '', no white space of any kind at the ends."""
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(WHITE_SPACE))


def trimmed_at_need(x: Column) -> Column:
    """trimmed(); a look at the ends of the text is quicker than btrim, where x itself is no long expression."""
    text = F.coalesce(x, F.lit(""))
    visible = lambda char: F.ascii(char).between(33, 126)
    return F.when(visible(text) & visible(F.substring(text, -1, 1)), text).otherwise(trimmed(text))


def fixed(x: Column, places: int) -> Column:
    """A finite number with so many places, rounded half up on its decimal digits; other values are null."""
    return F.when(finite(x), x).try_cast(f"decimal(38,{places})").cast("string")


def signed(x: Column, places: int) -> Column:
    return F.replace(F.concat(F.lit("+"), fixed(x, places)), F.lit("+-"), F.lit("-"))


def short_number(x: Column, places: int = 6) -> Column:
    """The shortest text of a number rounded to so many places: `35`, not `35.000000`; null if it is not finite or too large."""
    whole = F.floor(x)
    short = F.rtrim(F.rtrim(fixed(x, places), F.lit("0")), F.lit("."))  # places > 0, so there is a point
    return F.when((F.abs(x) < 1e15) & (whole == x), whole.cast("string")).otherwise(short)


def plain_number(x: Column, places: int = 6) -> Column:
    """short_number(), for one too large as Spark writes it; '' if it is not finite."""
    return F.coalesce(short_number(x, places), F.when(finite(x), x.cast("string")), F.lit(""))


def strict_number(text: Column) -> Column:
    """A plain decimal number as a double; anything else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _positive(text: Column, missing: tuple[str, ...]) -> Column:
    number = strict_number(F.replace(text, F.lit(","), F.lit("")))
    return F.when(~F.lower(text).isin(*missing) & finite(number) & (number > 0), number)


def primary_number(x: Column) -> Column:
    """A finite positive number of the primary source, with thousands separators; else null."""
    return _positive(normalize_text(x), PRIMARY_MISSING)


def comparison_number(x: Column) -> Column:
    """A finite positive number of the comparison source; inner spaces aren't joined; else null."""
    return _positive(trimmed(x), COMPARISON_MISSING)


def form_number(x: Column) -> Column:
    """A form field: blank is 0; null where it isn't a finite number."""
    text = trimmed(x)
    number = strict_number(text)
    return F.when(text == "", 0.0).when(finite(number), number)


def grid_period(x: Column) -> Column:
    """`2024M01` to `2024-01`; else null."""
    text = normalize_text(x)
    return F.when(text.rlike(r"^[0-9]{4}M(0[1-9]|1[0-2])$"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 6, 2)))


def date_period(x: Column) -> Column:
    """The month of `2024-02-31` by its form alone, days 01 to 31, white space at the ends left out; else null."""
    text = trimmed(x)
    return F.when(text.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), F.substring(text, 1, 7))


def updated_on(x: Column) -> Column:
    """The ISO date of `Updated on July 02, 2026`; null if it can't be read."""
    return F.try_to_timestamp(F.trim(F.regexp_extract(normalize_text(x), r"(?i)Updated on\s+(.+)$", 1)), F.lit("MMMM d, yyyy")).cast("date").cast("string")


def percent_change(now: Column, before: Column) -> Column:
    """Unrounded; null where the base is 0 or missing."""
    return F.when(before != 0, (now - before) / before * 100)


def carried_rate(x: Column) -> Column:
    """Two places, ties toward plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


def filename_part(x: Column, fallback: str) -> Column:
    text = F.regexp_replace(F.regexp_replace(trimmed(x), r'[\\/:*?"<>|]+', "_"), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.substring(text, 1, 40), F.lit("")), F.lit(fallback))


def csv_text(x: Column, guard: bool = True) -> Column:
    """A quoted cell; text that a spreadsheet would take for a formula gets a leading apostrophe."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    if guard:
        text = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_number(x: Column, places: int = 4) -> Column:
    return F.coalesce(fixed(x, places), F.lit(""))


def csv_plain_number(x: Column, places: int = 6) -> Column:
    """plain_number() as a cell: bare, or quoted where it is empty or has an exponent."""
    return F.coalesce(short_number(x, places), csv_text(F.when(finite(x), x.cast("string")), guard=False))


def signed_percent(x: Column, places: int = 2) -> Column:
    """`▲ +1.20%`, `▼ -1.20%` or `— 0.00%`; the sign is that of the rounded value."""
    text = fixed(x, places)
    zero = f"{0:.{places}f}"
    mark = F.when(text == zero, "— ").when(text.startswith("-"), "▼ ").otherwise("▲ +")
    return F.concat(mark, text, F.lit("%"))


def number_text(x: Column, small: int = 2, large: int = 0) -> Column:
    """Thousands separators; more places under 10; a dash if not finite."""
    return F.when(~finite(x) | x.isNull(), "—").when(F.abs(x) < 10, F.format_number(x, small)).otherwise(F.format_number(x, large))


def period_text(x: Column) -> Column:
    return F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.replace(x, F.lit("-"), F.lit("/"))).otherwise(x)


def local_minute(x: Column, zone: str = "Asia/Taipei") -> Column:
    """A UTC time in ISO form as local minutes; text that is no time stays."""
    at = F.try_to_timestamp(F.regexp_replace(x, r"Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce(F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm"), x)


def utc_second(at: Column | None = None) -> Column:
    """A time as ISO text in UTC to the second, `2026-07-02T08:00:00Z`. Give the run's time, so that a run can
    be repeated with the same result; by default it is the time at which the query starts."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_stamps(at: Column) -> Column:
    """The stamps of file labels: compact `20260702`, day `2026-07-02`, minute `2026/07/02 08:00`."""
    form = lambda name, pattern: F.date_format(at, pattern).alias(name)
    return F.struct(form("compact", "yyyyMMdd"), form("day", "yyyy-MM-dd"), form("minute", "yyyy/MM/dd HH:mm"))


def safe_message(x: Column, length: int = 500) -> Column:
    """Text without control characters, cut to `length` code points."""
    return F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1F\x7F]", ""), 1, length)


def direction(x: Column, dead_band: float = 0.0005) -> Column:
    return F.when(x > dead_band, "up").when(x < -dead_band, "down").when(x.isNotNull(), "flat")
