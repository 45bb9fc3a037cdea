"""Column functions on text, phones and languages. All are built-in expressions.

Regular expressions use explicit ASCII classes instead of ``\\b``, ``\\s`` and
``\\w``, whose meaning differs between engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudlens import constants as C

BLANKS = r"[ \t\n\r\f]+"
#: Start of an ASCII word, which takes no character, and its end as a group that takes one or none.
START, END = "(?<![A-Za-z0-9_])", "(?:[^A-Za-z0-9_]|$)"


def begins(words: Sequence[str]) -> str:
    """A look at the next character, which most places of a text fail at once: the first of one of ``words``, then the start of a word."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}]){START}"


def once(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def filled(x: Column) -> Column:
    """Null for an empty text."""
    return once(x, lambda v: F.when(v != "", v))


def any_of(words: Sequence[str]) -> str:
    return "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w)))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def text_normalized(x: Column) -> Column:
    """Lower case, runs of blanks as one, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), BLANKS, " "))


def fingerprint(x: Column) -> Column:
    return F.sha2(text_normalized(x), 256)


def analysis_key(x: Column, source: Column, version: str = "v1") -> Column:
    return F.concat_ws(":", F.lit("analysis"), F.lit(version), source, F.sha2(stripped(x), 256))


def name_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def phone_canonical(x: Column) -> Column:
    """Ten digits of an Indian mobile number, ``+digits`` of another with 10 to 15 digits, else null."""
    d = digits(x)
    n = F.length(d)
    mobile = lambda at: F.substring(d, at, 1).isin("6", "7", "8", "9")
    last = F.substring(d, -10, 10)
    local = ((n == 12) & d.startswith("91") & mobile(3)) | ((n == 11) & d.startswith("0") & mobile(2)) | ((n == 10) & mobile(1))
    return F.when((n < 10) | (n > 15), None).when(local, last).otherwise(F.concat(F.lit("+"), d))


# What counts as a phone, a payment id, an amount, an agent, a place, a role and a company.
PHONE_PATTERN = r"(?=[+0-9])(?<![A-Za-z0-9_])(\+?[0-9][0-9 \t\n\r\f()\-]{8,}[0-9])"
UPI_PATTERN = r"(?<![A-Za-z0-9_])([a-zA-Z0-9_][a-zA-Z0-9.\-_]++@[a-zA-Z]{2,}+)"


def phones(x: Column) -> Column:
    """Canonical phones of a text, distinct, first seen first. A run of digits
    and blanks is one candidate, so two numbers with a blank between are none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(PHONE_PATTERN), F.lit(1)), phone_canonical)
    return F.array_distinct(F.array_compact(found))


def upi_ids(x: Column, exclude_email: bool = False) -> Column:
    """Payment ids, lower case, distinct, first seen first; heads of e-mail
    addresses count too unless excluded."""
    pattern = UPI_PATTERN + (r"(?![a-zA-Z0-9_]|\.[a-zA-Z])" if exclude_email else r"(?![a-zA-Z0-9_])")
    marked = F.when(x.contains("@"), x).otherwise("")  # texts without the sign are not searched
    return F.array_distinct(F.transform(F.regexp_extract_all(marked, F.lit(pattern), F.lit(1)), F.lower))


NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]+)(?:\.[0-9]+)?"
GAP, GAPS = r"[ \t\n\r\f]*", r"[ \t\n\r\f]+"


def amount_patterns(words: Sequence[str]) -> tuple[str, str]:
    """The word and the number are whole words: something that is no word
    character stands between them, and round both."""
    key = any_of(words)
    currency = rf"(?:(?:rs|inr|aed){GAPS}|rs\.{GAP})"
    plain, marked = f"(?:{GAPS}(?:is{GAPS})?|{GAP}[:=]{GAP})", f"(?:{GAPS}(?:is{GAP})?|{GAP}[:=]{GAP})"
    after = f"(?i){begins(words)}(?:{key})(?:{plain}|{marked}{currency})({NUMBER}){END}"
    before = f"(?i)(?=[0-9]){START}({NUMBER}){GAPS}{currency}?(?:{key}){END}"
    return after, before


def amount(x: Column, words: Sequence[str]) -> Column:
    """The number after one of the words, else the number before one, cut to an integer."""
    found = [filled(F.regexp_extract(F.coalesce(x, F.lit("")), p, 1)) for p in amount_patterns(words)]
    return F.regexp_replace(F.coalesce(*found), ",", "").try_cast("double").try_cast("bigint")


def cleaned_phrase(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, BLANKS, " "), r"^[ \-,:.;]+|[ \-,:.;]+$", "")


def before_stop_token(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"(?is)(?:^|(?<=[^A-Za-z0-9_]))(?:{any_of(C.STOP_TOKENS)})(?![A-Za-z0-9_]).*$", ""))


def _first(x: Column, pattern: str) -> Column:
    """The group of the first match, empty if there is none."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), pattern, 1)


AGENT_PATTERN = f"(?i){begins('abc')}(?:agent|broker|contact(?:[ \\t\\n\\r\\f]+person)?){GAP}[:=-]?{GAP}([A-Za-z][A-Za-z.'-]*)"


def agent(x: Column) -> Column:
    return F.initcap(F.lower(cleaned_phrase(filled(_first(x, AGENT_PATTERN)))))


_PLACE = r"([A-Za-z][A-Za-z \t\n\r\f,.\-]{2,%d})"
LOCATION_PATTERNS = (
    f"(?i){begins('lp')}(?:location|loc|place){GAP}[:=-]?{GAP}" + _PLACE % 60,
    f"(?i){begins('bpw')}(?:based[ \\t\\n\\r\\f]+in|posted[ \\t\\n\\r\\f]+in|work[ \\t\\n\\r\\f]+location){GAP}[:=-]?{GAP}" + _PLACE % 60,
    f"(?i){begins('iaft')}(?:in|at|from|to)[ \\t\\n\\r\\f]+" + _PLACE % 50,
)


def location(x: Column) -> Column:
    """A place named after a location word, cut at stop tokens, five words at
    most; else the longest known place in the text, the first listed of equals. Capitals follow blanks."""
    named = [filled(cleaned_phrase(before_stop_token(cleaned_phrase(_first(x, p))))) for p in LOCATION_PATTERNS]
    named = F.array_join(F.slice(F.split(F.coalesce(*named), " "), 1, 5), " ")
    low = F.lower(F.coalesce(x, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(f"{begins(C.LOCATIONS)}({any_of(C.LOCATIONS)})(?![A-Za-z0-9_])"), F.lit(1))
    known = F.array_min(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), F.array_position(F.array(*map(F.lit, C.LOCATIONS)), w).alias("i"), w.alias("w"))))["w"]
    return F.initcap(F.lower(F.coalesce(named, known)))


_STOP = f"(?=(?<![A-Za-z0-9_])(?:{any_of(C.STOP_TOKENS)})(?![A-Za-z0-9_])|$)"
ROLE_PATTERN = f"(?i){begins('rpjvod')}(?:role|position|job|vacancy|opening|designation){GAP}(?::|as|for)?[ \\t\\n\\r\\f]+([A-Za-z][A-Za-z \\t\\n\\r\\f]{{1,50}}?){_STOP}"
ROLE_ENDS = ("salary", "fee", "registration", "call", "contact", "agent", "broker", "phone", "company", "location")


def role(x: Column, place: Column) -> Column:
    """A role named after a role word, else the text before the location or
    the first keyword if it has one to six words and is no urgency phrase."""
    text = F.coalesce(x, F.lit(""))
    tagged = filled(cleaned_phrase(_first(text, ROLE_PATTERN)))
    # the text before the place as a whole word; a character that ends the word before stays
    before = F.regexp_replace(text, F.concat(F.lit(f"(?is){START}\\Q"), place, F.lit(f"\\E{END}.*$")), F.lit(""))
    head = F.when(place.isNull(), text).otherwise(before)
    head = F.regexp_replace(head, f"(?is){begins(ROLE_ENDS)}(?:{any_of(ROLE_ENDS)})(?![A-Za-z0-9_]).*$", "")
    fits = lambda h: (h != "") & (F.size(F.split(h, " ")) <= 6) & ~F.lower(h).isin("urgent", "immediate", "apply now", "apply today")
    return F.coalesce(tagged, once(cleaned_phrase(head), lambda h: F.when(fits(h), h)))


_FIRM = r"([A-Za-z][A-Za-z0-9&.,'\- \t\n\r\f]{1,60}?)"
COMPANY_PATTERNS = (f"(?i){begins('cof')}(?:company|organization|firm){GAP}[:=-]?{GAP}{_FIRM}{_STOP}", f"(?i){begins('af')}(?:at|from)[ \\t\\n\\r\\f]+{_FIRM}{_STOP}")


def company(x: Column) -> Column:
    return F.initcap(F.lower(F.coalesce(*[filled(cleaned_phrase(_first(x, p))) for p in COMPANY_PATTERNS])))


def urgency_flags(x: Column) -> Column:
    """The urgency phrases in a text, in the list's order."""
    found = lambda low: F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in C.URGENCY_PHRASES]))
    return once(F.lower(F.coalesce(x, F.lit(""))), found)


def detected_language(x: Column, tokens: Sequence[str] = C.ROMAN_HINDI) -> Column:
    """``hi`` for Devanagari, two romanised tokens, or one in six words or fewer; else ``en``."""
    text = F.coalesce(x, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(*tokens)))
    return F.when(text.rlike("[ऀ-ॿ]"), "hi").when((hits >= 2) | ((hits >= 1) & (F.size(words) <= 6)), "hi").otherwise("en")


def script_hint(x: Column) -> Column:
    text = F.coalesce(x, F.lit(""))
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", ""))
    deva, tamil, latin = count("ऀ-ॿ"), count("஀-௿"), count("A-Za-z")
    return (
        F.when((tamil > 10) & (deva < 5), "tamil").when(tamil > 10, "mixed").when((deva > 20) & (latin < 20), "hindi").when(deva > 5, "mixed").otherwise("english")
    )


def text_clean(x: Column) -> Column:
    out = F.regexp_replace(F.coalesce(x, F.lit("")), "[\f\x00]", "")
    return stripped(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "[ \t]+", " "))


def language_code(x: Column) -> Column:
    v = F.lower(stripped(F.coalesce(x, F.lit(""))))
    return F.when(v.isin("en", "english"), "en").when(v.isin("hi", "hindi", "हिंदी", "हिन्दी"), "hi")


def language_command(x: Column) -> Column:
    """A message that only asks for a language."""
    v = F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "[^a-zA-Zऀ-ॿ ]+", "")))
    english, hindi = ("en", "english", "lang en", "language en", "language english"), ("hi", "hindi", "हिंदी", "हिन्दी", "lang hi", "language hi", "language hindi")
    return F.when(v.isin(*english), "en").when(v.isin(*hindi), "hi")


# ISO 8601: a day of a month or of a week, then perhaps a clock time with a fraction, then perhaps an offset.
_DAY = r"(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2})|([0-9]{4})-W([0-9]{2})(?:-([1-7])(?![0-9]))?|([0-9]{4})W([0-9]{2})([1-7])?(?![0-9]))"
_CLOCK = r"([01][0-9]|2[0-3])(?::([0-5][0-9])(?::([0-5][0-9])(?:[.,]([0-9]+))?)?|([0-5][0-9])(?:([0-5][0-9])(?:[.,]([0-9]+))?)?)?"
_OFFSET = r"([+-])([01][0-9]|2[0-3])(?::([0-5][0-9])(?::([0-5][0-9]))?|([0-5][0-9])([0-5][0-9])?)?"
_ISO = rf"^{_DAY}(?:(?s:.){_CLOCK}(?:{_OFFSET})?)?\z"
#: year, month, day, week, day of the week, hour, minute, second, fraction, sign, hours, minutes and seconds of the offset
_ISO_PARTS = "$1$4$7$10;$2$5;$3$6;$8$11;$9$12;$13;$14$17;$15$18;$16$19;$20;$21;$22$24;$23$25"


def _instant(parts: Column) -> Column:
    year, month, day, week, weekday, hour, minute, second, fraction, sign, *offset = (F.get(parts, F.lit(i)) for i in range(13))
    number = lambda c, empty: F.coalesce(c.try_cast("int"), F.lit(empty))
    in_week_one = F.concat(year, F.lit("-01-04")).try_cast("date")
    of_week = F.date_add(F.trunc(in_week_one, "week"), (number(week, 1) - 1) * 7 + number(weekday, 1) - 1)
    exists = (F.date_part(F.lit("YEAROFWEEK"), of_week) == number(year, 0)) & (F.year(of_week) <= 9999)
    date = F.when(week == "", F.concat_ws("-", year, month, day).try_cast("date")).when(exists, of_week)
    two = lambda c: F.lpad(c, 2, "0")
    clock = F.concat(two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0"))
    at = F.concat(date.cast("string"), F.lit(" "), clock, F.lit("+00:00")).try_cast("timestamp")
    hours, minutes, seconds = (number(c, 0) * F.when(sign == "-", -1).otherwise(1) for c in offset)
    return F.when(year != "0000", at - F.make_dt_interval(F.lit(0), hours, minutes, seconds.cast("decimal(18,6)")))


def parsed_timestamp(x: Column) -> Column:
    """An ISO 8601 date or time as an instant; null if it does not parse.

    Dates may be basic (``20240506``) or of a week (``2024-W19-1``; a week alone
    is its Monday). Any one character parts date and time, except a digit after a
    week date, where one could not tell it from a day; a time may end after
    the hour or the minute and need no colons. ``Z`` and offsets are read, a time
    without one is UTC. Of a fraction six digits are kept.
    """
    v = F.replace(x, F.lit("Z"), F.lit("+00:00"))
    parts = F.split(F.regexp_replace(v, _ISO, _ISO_PARTS), ";")
    # in an array, so that the text is matched once for all parts
    return F.when(v.rlike(_ISO), F.get(F.transform(F.array(parts), _instant), F.lit(0)))


def iso_timestamp(x: Column) -> Column:
    """An instant in ISO 8601, UTC."""
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parsed_bool(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("1", "true", "yes")


def safe_int(x: Column) -> Column:
    return F.trim(x).try_cast("double").try_cast("bigint")


def source_name(x: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(x, F.lit("dashboard"))))
    return F.when(v.isin("browser_extension", "extension"), "extension").when(v.isin("whatsapp", "dashboard"), v).otherwise("dashboard")


def entity_key(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), F.lit("unknown")), F.trim(value))


def entity_key_parts(key: Column) -> Column:
    """struct(entity_type, entity_value); a key without a colon has type ``unknown``."""
    parts = F.split(key, ":", 2)
    has = F.size(parts) > 1
    return F.struct(F.when(has, F.get(parts, F.lit(0))).otherwise("unknown").alias("entity_type"), F.when(has, F.get(parts, F.lit(1))).otherwise(key).alias("entity_value"))


def page_text(html: Column) -> Column:
    """What a browser shows of a page: no comments, scripts, styles or tags."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(script|style|head)[ >].*?</(script|style|head)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, BLANKS, " "))
