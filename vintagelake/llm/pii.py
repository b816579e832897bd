"""Personal data as format-preserving pseudonyms, in DataFrame functions only.

Kinds are sought one after the other. A text is split at a kind's findings; each finding that is valid for its kind is
read as a number in the kind's own domain, permuted there by a keyed Feistel network, and written back in its own format.
A domain of a * b values is walked as pairs (left, right); each round adds a keyed hash of one half to the other, modulo
a or b in turn, which can be undone, so different values stay different and equal values get equal pseudonyms in all
documents. A valid finding leaves a mark in the text while the other kinds are sought, so no part of it is taken twice;
a finding that is not valid goes back into the text, where the kinds after it may find what it had swallowed.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Lengths of international account numbers with the countries that have them.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What is looked for, kind after kind. No repeated group without a small bound, which the JVM would match by recursion.
#: Lengths are those of the forms' own rules.
PATTERNS = {
    "email": r"[\p{L}\p{Nd}_][\p{L}\p{M}\p{Nd}._%+-]{0,63}@[\p{L}\p{Nd}](?:[\p{L}\p{M}\p{Nd}.-]{0,251}[\p{L}\p{M}\p{Nd}])?",
    "iban": r"\b(?:" + "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNT_LENGTHS.items()) + r")\b",
    "phone": r"\+[1-9]\d{0,2}[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}\b|\+[1-9](?:[ ()-]{0,2}\d){7,14}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b",
    "date": r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{2}[/.]\d{2}[/.]\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b|\b3[47]\d{2}[ -]?\d{6}[ -]?\d{5}\b",
}
#: A kind's valid findings stand in the text as this character and the kind's own; the character itself as it and a semicolon.
MARK = "\u0001"
MARKS = dict(zip(PATTERNS, "!\"&',<>", strict=True))
#: First code point and number of the letters and digits that are moved among themselves: Latin, digits, Latin with accents,
#: Cyrillic, Greek, kana, Chinese characters, Hangul.
ALPHABETS = ((97, 26), (65, 26), (48, 10), (224, 23), (192, 23), (1072, 32), (1040, 32), (945, 25), (913, 17), (12353, 86), (12449, 90), (19968, 20_992), (44_032, 11_172))
#: The dates that can be exchanged: one Gregorian cycle of 400 years, 146,097 = 773 * 189 days.
FIRST_DAY, CYCLE = "1800-01-01", (773, 189)
#: Those of them with a day of the month after the 12th, which mm/dd/yyyy tells from dd/mm/yyyy: 88,497 = 9 * 9,833.
LATE_DAYS = (9, 9833)
#: What spark.sql.redaction.string.regex can be set to.
REDACTED = "pii-key-[0-9a-f]+"
_SESSION_KEYS: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that the session names in spark.vintagelake.pii.key; else one drawn at random for this application, so that
    pseudonyms are linked inside its runs and by nobody else. Plans hold its hash, not the key, behind a fixed word, so
    spark.sql.redaction.string.regex = REDACTED keeps it out of what explain and the web page show."""
    given = spark.conf.get("spark.vintagelake.pii.key", None)
    key = given or _SESSION_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))
    return f"pii-key-{hashlib.sha256(key.encode()).hexdigest()}"


def keyed(key: str, label: Column | str, round_: Column, half: Column) -> Column:
    """A keyed hash as a number below 2**52."""
    label = F.lit(label) if isinstance(label, str) else label
    text = F.concat_ws("|", F.lit(key), label, round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def permuted(value: Column, a: int | Column, b: int | Column, key: str, label: str | Column) -> Column:
    """A bijection of 0 .. a*b-1: even rounds move the left half, odd rounds the right one. A fold, so the plan stays small."""
    start = F.struct((value / F.lit(b)).cast("bigint").alias("l"), F.pmod(value, F.lit(b)).cast("bigint").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + keyed(key, label, i, acc["r"]), F.lit(a))).otherwise(acc["l"]).cast("bigint").alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + keyed(key, label, i, acc["l"]), F.lit(b))).cast("bigint").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def poured(shape: Column, digits: Column) -> Column:
    """The characters of shape with its digits exchanged for those of `digits`, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits where those at places of parity `doubled` from the left count twice, less 9 above 9."""
    parts = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def card_name(x: Column, key: str) -> Column:
    """A card number with a right check digit: its payload permuted (of 15 digits' cards after the two that name their kind), the check digit made anew."""
    d = digits_of(x)
    long = F.lpad(permuted(F.substring(d, 1, 15).cast("bigint"), 10**8, 10**7, key, "card").cast("string"), 15, "0")
    short = F.concat(F.substring(d, 1, 2), F.lpad(permuted(F.substring(d, 3, 12).cast("bigint"), 10**6, 10**6, key, "card15").cast("string"), 12, "0"))
    check = lambda payload, doubled: F.pmod(-luhn_sum(payload, doubled), F.lit(10)).cast("string")
    return poured(x, F.when(F.length(d) == 16, F.concat(long, check(long, 0))).otherwise(F.concat(short, check(short, 1))))


def phone_name(x: Column, key: str) -> Column:
    """The last ten digits, permuted; what stands before them stays. A number with its country code that has ten digits
    at most keeps its first two."""
    d = digits_of(x)
    kept = F.when(x.startswith("+") & (F.length(d) <= 10), F.lit(2)).otherwise(F.length(d) - 10)
    width = F.length(d) - kept
    half = F.ceil(width / F.lit(2)).cast("int")
    size = lambda n: F.pow(F.lit(10), n).cast("bigint")
    label = F.concat(F.lit("phone"), F.when(width < 10, width.cast("string")).otherwise(F.lit("")))
    new = F.lpad(permuted(F.substr(d, kept + 1).cast("bigint"), size(half), size(width - half), key, label).cast("string"), width, F.lit("0"))
    return poured(x, F.concat(F.substr(d, F.lit(1), kept), new))


def letters_moved(x: Column, key: str, label: str) -> Column:
    """Letters, capitals and digits each moved inside their own alphabet; the rest stays.

    A Feistel network over the two halves: every round moves each character of one half by a keyed hash of the whole
    other half and of its place.
    """
    cut = (F.length(x) / F.lit(2)).cast("int")
    start = F.struct(F.substr(x, F.lit(1), cut).alias("l"), F.substr(x, cut + 1).alias("r"))
    alphabets = F.array(*(F.struct(F.lit(zero).alias("zero"), F.lit(n).alias("n")) for zero, n in ALPHABETS))

    def moved(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            k = keyed(key, F.concat(F.lit(label), at.cast("string")), i, other)
            code = F.ascii(c)
            within = F.filter(alphabets, lambda a: code.between(a["zero"], a["zero"] + a["n"] - 1))
            new = F.transform(within, lambda a: (code - a["zero"] + k % a["n"]) % a["n"] + a["zero"])
            return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(F.get(new, F.lit(0))), 4, "0")), "UTF-16BE"), c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(moved(acc["r"], acc["l"], i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def iban_rest(plain: Column, check: Column) -> Column:
    """An account number's remainder by 97 with these check digits: the rest, the country and the check, letters as 10 to 35."""
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 2), check)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.rlike(r"^\d$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def iban_name(x: Column, key: str) -> Column:
    """The account part with its characters moved, check digits made anew, blanks where they were."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    made = F.array(F.concat(F.substring(plain, 1, 4), letters_moved(F.substr(plain, F.lit(5)), key, "iban")))

    def write(new: Column) -> Column:
        full = F.concat(F.substring(new, 1, 2), F.lpad((98 - iban_rest(new, F.lit("00"))).cast("string"), 2, "0"), F.substr(new, F.lit(5)))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substr(full, acc["at"] + 1, F.lit(1)))).alias("out"), (acc["at"] + (c != " ").cast("int")).alias("at"))
        return F.aggregate(F.split(x, ""), start, step, lambda s: s["out"])

    return F.element_at(F.transform(made, write), 1)


def ip_name(x: Column, key: str) -> Column:
    """Four octets as a number below 2**32, permuted."""
    n = F.aggregate(F.split(x, r"\."), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.cast("bigint"))
    p = F.array(permuted(n, 1 << 16, 1 << 16, key, "ip"))
    return F.element_at(F.transform(p, lambda v: F.concat_ws(".", *((F.shiftright(v, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)))), 1)


def ssn_name(x: Column, key: str) -> Column:
    """Area (001-899 without 666), group (01-99) and serial (0001-9999) as one number, permuted."""
    area, group, serial = (F.split_part(x, F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2, 3))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    p = F.array(permuted((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"))

    def write(v: Column) -> Column:
        place = (v / F.lit(99 * 9999)).cast("bigint")
        area = place + 1 + F.when(place >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(((v / F.lit(9999)).cast("bigint") % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    return F.element_at(F.transform(p, write), 1)


def iso(x: Column) -> Column:
    """A date of any of the forms as year-month-day."""
    d = digits_of(x)
    last = x.rlike(r"^\d{2}\D")
    part = lambda a, b, n: F.when(last, F.substring(d, b, n)).otherwise(F.substring(d, a, n))
    return F.concat_ws("-", part(1, 5, 4), part(5, 3, 2), part(7, 1, 2))


def day_of(x: Column) -> Column:
    """Days from the first one to a date; null if it is none."""
    return F.datediff(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))


def month_first(x: Column) -> Column:
    """mm/dd/yyyy as year-month-day; null where the day may be a month, as the day comes first then."""
    return F.when(x.rlike(r"^\d{2}/") & (F.substring(x, 4, 2) > "12"), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2)))


def late_day(x: Column, key: str) -> Column:
    """A day after its month's 12th as another one: its rank among all of them is permuted.

    A month's first such day has the rank of the days before the month, less 12 for each month; a month has 18.44 of
    them on average, so the month of a rank is one of five.
    """
    first = F.lit(FIRST_DAY).cast("date")
    months = (F.substring(x, 1, 4).cast("int") - int(FIRST_DAY[:4])) * 12 + F.substring(x, 6, 2).cast("int") - 1
    start = lambda m: F.datediff(F.add_months(first, m), first) - m * 12

    def write(rank: Column) -> Column:
        near = F.floor(rank / F.lit(LATE_DAYS[0] * LATE_DAYS[1] / 4800)).cast("int")
        month = F.array_max(F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), near + 2), lambda m: start(m) <= rank))
        return F.date_add(first, (rank + (month + 1) * 12).cast("int"))

    return let(permuted((day_of(x) - (months + 1) * 12).cast("bigint"), *LATE_DAYS, key, "late day"), write)


def date_name(x: Column, key: str) -> Column:
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted(day_of(iso(x)).cast("bigint"), *CYCLE, key, "date").cast("int"))
    usual = F.when(x.rlike(r"^\d{2}\D"), F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "yyyyMMdd"))
    return poured(x, F.when(month_first(x).isNotNull(), F.date_format(late_day(month_first(x), key), "MMddyyyy")).otherwise(usual))


def email_name(x: Column, key: str) -> Column:
    """The local part with its characters moved. The domain name stays as it is."""
    local = F.substring_index(x, "@", 1)
    return F.concat(letters_moved(local, key, "email"), F.substr(x, F.length(local) + 1))


def valid(x: Column, kind: str) -> Column:
    """Whether a finding of this form can be a value of its kind."""
    if kind == "email":  # a host name of two labels or more, none of them empty
        host = F.substring_index(x, "@", -1)
        return host.contains(".") & ~host.contains("..") & ~host.startswith(".")
    if kind == "iban":
        plain = F.replace(x, F.lit(" "), F.lit(""))
        return iban_rest(plain, F.substring(plain, 3, 2)) == 1
    if kind == "card":
        d = digits_of(x)
        return F.when(F.length(d) == 16, luhn_sum(d, 0) % 10 == 0).otherwise(luhn_sum(d, 1) % 10 == 0)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255) & F.forall(F.split(x, r"\."), lambda o: (o == "0") | ~o.startswith("0"))
    if kind == "ssn":
        area = F.substring(x, 1, 3).cast("int")
        return (area > 0) & (area != 666) & (area < 900) & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000")
    if kind == "date":
        return F.coalesce(day_of(F.coalesce(month_first(x), iso(x))).between(0, CYCLE[0] * CYCLE[1] - 1), F.lit(False))
    return F.length(digits_of(x)) <= 15  # phone numbers: the most that a number with its country code has


def joined(pieces: Column, between: Column) -> Column:
    """Pieces of a text with what stood between them."""
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def finding(x: Column, name: Callable[[Column, str], Column], kind: str) -> Column:
    return F.struct(x.alias("x"), name(x, kind).alias("name"))


def sought(docs: DataFrame, text: str, name: Callable[[Column, str], Column]) -> tuple[DataFrame, str]:
    """The rows with a column for the text in search and one for each kind's findings (x, name), and the prefix of their names.

    Kind after kind: findings with a name are exchanged for a mark, the others are text again for the kinds after their own.
    A text that has neither a digit nor an @ is null there, as every finding has one.
    """
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    t, rest = F.col(f"{prefix}text"), F.col(f"`{text}`")
    escaped = F.when(rest.rlike("[0-9@]"), F.replace(rest, F.lit(MARK), F.lit(MARK + ";")))
    docs = docs.withColumn(f"{prefix}text", escaped)
    for kind, pattern in PATTERNS.items():
        one, mark = partial(finding, name=name, kind=kind), F.lit(MARK + MARKS[kind])
        docs = docs.withColumn(prefix + kind, F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: one(x)))  # noqa: B023
        marks = F.transform(prefix + kind, lambda f: F.when(f["name"].isNotNull(), mark).otherwise(f["x"]))  # noqa: B023
        docs = docs.withColumn(f"{prefix}text", F.when(named(prefix + kind), joined(F.split(t, pattern, -1), marks)).otherwise(t))
    return docs, prefix


def named(found: str) -> Column:
    """Whether any of the findings has a name."""
    return F.exists(found, lambda f: f["name"].isNotNull())


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same rows and columns with the text's findings exchanged. A null text stays null, an empty one empty; equal
    rows get equal texts, an empty table gives an empty one, and other columns pass as they are, whatever their names.

    Forms: e-mail addresses with letters of any script, phone numbers with 8 to 15 digits after a plus sign or with ten
    as (ddd) ddd-dddd or ddd-ddd-dddd, dates from 1800 to 2199 as yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy, dd.mm.yyyy or, where
    the day is no month, mm/dd/yyyy, social security numbers, IPv4 addresses, cards of 16 digits or of 15 with their
    check digit, and international account numbers with their country's length and check digits. Nothing is joined or shuffled.
    """
    makers = {"email": email_name, "iban": iban_name, "phone": phone_name, "date": date_name, "ssn": ssn_name, "ip": ip_name, "card": card_name}
    rows, prefix = sought(docs, text, lambda x, kind: F.when(valid(x, kind), makers[kind](x, key)))
    t = F.col(f"{prefix}text")
    for kind in PATTERNS:
        names = F.transform(F.filter(prefix + kind, lambda f: f["name"].isNotNull()), lambda f: f["name"])
        rows = rows.withColumn(f"{prefix}text", F.when(named(prefix + kind), joined(F.split(t, MARK + MARKS[kind], -1), names)).otherwise(t))
    new = F.coalesce(F.replace(t, F.lit(MARK + ";"), F.lit(MARK)), F.col(f"`{text}`"))
    return rows.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_found and n_valid of every row: what has the form of personal data, and what is valid too; what fails as
    one kind and is found again as another counts for both. A null or empty text has none; rows stay, repeated ones alike."""
    rows, prefix = sought(docs, text, lambda x, kind: F.when(valid(x, kind), x))
    some = lambda kind: F.coalesce(F.size(F.filter(prefix + kind, lambda f: f["name"].isNotNull())), F.lit(0))
    found, ok = (sum((F.greatest(n, F.lit(0)) for n in counts), F.lit(0)) for counts in ([F.coalesce(F.size(prefix + k), F.lit(0)) for k in PATTERNS], [some(k) for k in PATTERNS]))
    return rows.select("doc_id", found.cast("bigint").alias("n_found"), ok.cast("bigint").alias("n_valid"))
