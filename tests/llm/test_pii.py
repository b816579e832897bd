"""Pseudonyms keep form and validity, differ for different values, and are equal for equal ones."""

import hashlib
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from vintagelake.llm import pii

KEY = "k"


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)]
    return sum(v if i % 2 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(d)) % 10 == 0


def named(spark, rows, schema="doc_id long, text string"):
    return [r.text for r in pii.pseudonymize(spark.createDataFrame(rows, schema), KEY).orderBy("doc_id").collect()]


def test_forms_and_links(spark):
    texts = [
        "mail Ann.Lee9@example.com and Ann.Lee9@example.com", "call +1 (415) 555-0123 or +1 (415) 555-0124", "born 1999-02-28, 2000-02-29", "ssn 123-45-6789, 665-01-0001, 667-01-0001",
        "ip 10.0.255.1 and 300.1.1.1 and 01.2.3.4", "card 4111-1111-1111-1111, 4111 1111 1111 1112, 4111111111111111", "date 1999-02-30 and 2400-01-01, ssn 666-12-3456 000-12-3456", "nothing 12 here", "", None,
    ]
    got = named(spark, list(enumerate(texts)), "doc_id long, text string")
    assert got[7:] == ["nothing 12 here", "", None] and got[6] == texts[6]
    a, b = re.findall(r"\S+@\S+", got[0])
    assert a == b != "Ann.Lee9@example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@example\.com", a)
    a, b = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])
    assert a != b and a not in texts[1]
    for d in re.findall(r"\d{4}-\d{2}-\d{2}", got[2]):
        assert "1800-01-01" <= d < "2200-01-01"
    ssns = re.findall(r"\d{3}-\d{2}-\d{4}", got[3])
    assert len(set(ssns)) == 3 and all(x[:3] not in ("000", "666") and x[:3] < "900" and x[4:6] != "00" and x[7:] != "0000" for x in ssns)
    assert "300.1.1.1" in got[4] and "01.2.3.4" in got[4] and "10.0.255.1" not in got[4]
    cards = re.findall(r"\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}", got[5])
    assert luhn(cards[0]) and luhn(cards[2]) and cards[1] == "4111 1111 1111 1112" and cards[0].replace("-", "") == cards[2] and cards[0] != "4111-1111-1111-1111"


def test_permutations_are_bijections(spark):
    """Whole small domains and a stretch of a large one: no two values share a pseudonym."""
    ids = spark.range(7 * 11)
    assert ids.select(pii.permuted(F.col("id"), 7, 11, KEY, "t").alias("p")).distinct().count() == 77
    days = spark.range(146_097).select(pii.permuted(F.col("id"), *pii.CYCLE, KEY, "date").alias("p"))
    assert days.distinct().count() == 146_097 and days.agg(F.min("p"), F.max("p")).first() == (0, 146_096)


def test_equal_values_in_other_documents_and_keys(spark):
    rows = [(1, "x 123-45-6789"), (1, "x 123-45-6789"), (2, "y,123-45-6789."), (None, "123-45-6789")]
    found = [re.search(r"\d{3}-\d{2}-\d{4}", t)[0] for t in named(spark, rows)]
    assert len(set(found)) == 1 and found[0] != "123-45-6789"
    other = pii.pseudonymize(spark.createDataFrame(rows[:1], "doc_id long, text string"), "other").first().text
    assert found[0] not in other


def test_whole_long_text_and_columns(spark):
    text = "word " * 50_000 + "a@b.co"
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, found int")
    out = pii.pseudonymize(docs, KEY)
    assert out.columns == docs.columns and not out.first().text.endswith("a@b.co") and out.first().text.startswith("word word")
    assert pii.pseudonymize(docs.limit(0), KEY).count() == 0


def test_other_forms(spark):
    texts = ["+1 415-555-0123 +14155550123 (415) 555-0123", "28/02/1999 28.02.1999 1999/02/28 1999-02-28 31/02/1999", "3782 822463 10005, 378282246310005, 378282246310006", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE88 3704 0044 0532 0130 00"]
    got = named(spark, list(enumerate(texts)))
    tens = {re.sub(r"\D", "", x)[-10:] for x in re.findall(r"\+1 \d{3}-\d{3}-\d{4}|\+1\d{10}|\(\d{3}\) \d{3}-\d{4}", got[0])}
    assert len(tens) == 1 and "4155550123" not in tens
    d = got[1].split()
    assert d[0].replace("/", ".") == d[1] and d[2].replace("/", "-") == d[3] == "-".join(reversed(d[1].split("."))) != "1999-02-28" and d[4] == "31/02/1999"
    a, b, c = got[2].split(", ")
    assert a.replace(" ", "") == b != "378282246310005" and b[:2] == "37" and c == "378282246310006"
    digits = [int(x) for x in b]
    assert sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(digits)) % 10 == 0
    ibans = re.findall(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{1,3})?", got[3])
    assert all(int("".join(str(int(ch, 36)) for ch in x.replace(" ", "")[4:] + x.replace(" ", "")[:4])) % 97 == 1 for x in ibans[:2])
    assert ibans[0] != "DE89 3704 0044 0532 0130 00" and re.fullmatch(r"GB\d{2}[A-Z]{4}\d{14}", ibans[1]) and ibans[2] == "DE88 3704 0044 0532 0130 00"


def plain_permuted(value, a, b, key, label):
    """The Feistel network by its definition."""
    left, right = divmod(value, b)
    for i in range(pii.ROUNDS):
        keyed = int(hashlib.sha256(f"{key}|{label}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:13], 16)
        if i % 2 == 0:
            left = (left + keyed) % a
        else:
            right = (right + keyed) % b
    return left * b + right


def test_pseudonyms_against_a_plain_feistel_network(spark):
    got = named(spark, [(1, "123-45-6789"), (2, "10.1.2.3"), (3, "2020-02-29"), (4, "+1 (415) 555-0123")])
    place = plain_permuted((122 * 99 + 44) * 9999 + 6788, 898 * 99, 9999, KEY, "ssn")
    area = place // (99 * 9999) + 1
    assert got[0] == f"{area + (area >= 666):03d}-{place // 9999 % 99 + 1:02d}-{place % 9999 + 1:04d}"
    n = plain_permuted(int.from_bytes(bytes([10, 1, 2, 3])), 1 << 16, 1 << 16, KEY, "ip")
    assert got[1] == ".".join(map(str, n.to_bytes(4)))
    first = date(1800, 1, 1)
    assert got[2] == str(first + timedelta(plain_permuted((date(2020, 2, 29) - first).days, *pii.CYCLE, KEY, "date")))
    ten = f"{plain_permuted(4155550123, 10**5, 10**5, KEY, 'phone'):010d}"
    assert got[3] == f"+1 ({ten[:3]}) {ten[3:6]}-{ten[6:]}"


def test_very_long_findings(spark):
    """No pattern is matched by recursion, and long runs of what may begin a finding take linear time."""
    texts = ["u@a" + ".b" * 100_000, "a." * 300_000, "u@" + "a" * 300_000, "1-" * 300_000, "DE89 " + "3704 " * 100_000, "." * 300_000 + "@", "+1 " + "(415) " * 100_000]
    got = named(spark, list(enumerate(texts)))
    assert len(got) == len(texts) and all(len(g) == len(t) for g, t in zip(got, texts, strict=True))


def mod97(x):
    plain = x.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97


def test_what_a_failed_finding_swallows_is_found(spark):
    texts = [
        "ES91 2100 0418 4502 0005 1332 AND more", "NO12 4111 1111 1111 1111", "AB12 2024 0102 123-45-6789", "GB12 4111 1111 1111 1111 AB", "123-45-6789@foo and 4111 1111 1111 1111@x",
        "999.10.0.0.1 10.0.0.1", "\u0001! \u0001; 123-45-6789 \u0001",
    ]
    got = named(spark, list(enumerate(texts)))
    account = got[0].removesuffix(" AND more")
    assert got[0] != texts[0] and account.startswith("ES") and len(account) == 29 and mod97(account) == 1
    assert got[1].startswith("NO12 ") and luhn(got[1][5:]) and got[1] != texts[1]
    assert got[2].startswith("AB12 2024 0102 ") and "123-45-6789" not in got[2]
    assert got[3].startswith("GB12 ") and got[3].endswith(" AB") and "4111" not in got[3]
    assert "123-45-6789" not in got[4] and "4111 1111 1111 1111" not in got[4] and got[4].endswith("@x")
    assert got[5].endswith(got[5].split()[1]) and "10.0.0.1" not in got[5].split()[1]
    assert got[6].startswith("\u0001! \u0001; ") and got[6].endswith(" \u0001") and "123-45-6789" not in got[6]


def test_forms_of_other_countries(spark):
    texts = ["joe@ex\u00e4mple.com, \u044e\u0440\u0438\u0439@\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444, joe@ex\u00e4mple.com", "415-555-0123 (415) 555-0123", "+44 20 7946 0958 +47 22 86 24 00 +33 1 23 45 67 89", "12/25/1990 and 25/12/1990, 13/13/1990", "sum +1 000 000, 1+2345678.5"]
    got = named(spark, list(enumerate(texts)))
    a, b, c = got[0].split(", ")
    assert a == c != "joe@ex\u00e4mple.com" and a.endswith("@ex\u00e4mple.com")
    assert b.endswith("@\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444") and b[:4] != "\u044e\u0440\u0438\u0439" and re.fullmatch("[\u0430-\u044f]{4}", b[:4])
    tens = {re.sub(r"\D", "", x) for x in re.findall(r"\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", got[1])}
    assert len(tens) == 1 and "4155550123" not in tens
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4} \+47 \d\d \d\d \d\d \d\d \+3\d \d \d\d \d\d \d\d \d\d", got[2])
    assert not any(p in got[2] for p in ("7946", "22 86", "23 45 67"))
    d = re.findall(r"\d{2}/\d{2}/\d{4}", got[3])
    assert int(d[0][:2]) <= 12 < int(d[0][3:5]) and d[0] != "12/25/1990" and int(d[1][3:5]) <= 12 and d[1] != "25/12/1990" and d[2] == "13/13/1990"
    assert got[4].startswith("sum +1 000 000,")


def test_late_days_are_permuted_among_themselves(spark):
    """All 88,497 days after the 12th of a month: each is the pseudonym of exactly one."""
    first = F.lit(pii.FIRST_DAY).cast("date")
    days = spark.range(146_097).select(F.date_add(first, F.col("id").cast("int")).alias("d")).where(F.dayofmonth("d") > 12)
    out = days.select(pii.late_day(F.date_format("d", "yyyy-MM-dd"), KEY).alias("p"))
    assert days.count() == 88_497 == out.where((F.dayofmonth("p") > 12) & F.col("p").between("1800-01-01", "2199-12-31")).distinct().count()


def test_findings_count_each_kind(spark):
    rows = [(1, "NO12 4111 1111 1111 1111, 1234 5678 9012 3456"), (2, None), (3, ""), (4, "a@b.co a@b.co")]
    got = {r.doc_id: (r.n_found, r.n_valid) for r in pii.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 1), 2: (0, 0), 3: (0, 0), 4: (2, 2)}


def test_key_can_be_kept_out_of_plans(spark):
    key = pii.session_key(spark)
    out = pii.pseudonymize(spark.createDataFrame([(1, "123-45-6789")], "doc_id long, text string"), key)
    spark.conf.set("spark.sql.redaction.string.regex", pii.REDACTED)
    try:
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.redaction.string.regex")
    assert key == pii.session_key(spark) and key not in plan and key in out._jdf.queryExecution().toString()
