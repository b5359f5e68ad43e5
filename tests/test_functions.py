import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from maskspark.functions import canonical, checkdigits, crypto, dates
from maskspark.operators import pseudonyms

CANONICAL = [
    ("PERSON", "Dr. Priya Sharma", "priya sharma"), ("PERSON", "SHARMA, Priya", "priya sharma"), ("PERSON", "Ｐriya Sharma", "priya sharma"), ("PERSON", "a, b, c", "a b c"),
    ("PERSON", "Dr. Mr.", ""), ("ORG", "Acme Widgets Pvt Ltd", "acme widgets"), ("ORG", "Ltd", "ltd"), ("ORGANIZATION", "Straße GmbH", "strasse"),
    ("PHONE", "+91 98765-43210", "919876543210"), ("PAN", "abcde1234f", "abcde1234f"), ("EMAIL", " A b@X.com ", "ab@x.com"), ("LOCATION", "New-York,  USA", "new york usa"), ("ORG", "", ""),
]


def test_canonical_forms(spark):
    rows = spark.createDataFrame([(k, s) for k, s, _ in CANONICAL], "t string, s string")
    got = rows.select(canonical.canonical(F.col("t"), F.col("s"))).collect()
    assert [r[0] for r in got] == [c for _, _, c in CANONICAL]


def test_classes_and_prefixes(spark):
    rows = spark.createDataFrame([("per",), ("COMPANY",), ("GPE",), ("Email",), ("CREDIT_CARD",), ("A_VERY_LONG_TYPE_NAME",), ("___",)], "t string")
    got = [tuple(r) for r in rows.select(canonical.entity_class(F.col("t")), canonical.type_prefix(F.col("t"))).collect()]
    assert got == [("person", "User"), ("org", "Org"), ("loc", "Loc"), ("email", "Email"), ("credit_card", "CreditCard"), ("a_very_long_type_name", "AVeryLongTyp"), ("___", "Ent")]


@pytest.mark.parametrize(("surface", "days", "moved", "year"), [
    ("2024-03-12", 40, "2024-04-21", "2024"), ("12/03/2024", 1, "13/03/2024", "2024"), ("12/25/2024", 1, "12/26/2024", "2024"), ("March 12, 2024", 1, "March 13, 2024", "2024"),
    ("5 sep 2023", 2, "07 Sep 2023", "2023"), ("3/4/85", 1, "04/04/85", "1985"), ("3/4/68", 0, "03/04/68", "2068"), ("2024-1-5T3:04:05", 30, "2024-02-04T03:04:05", "2024"),
    (" 12.03.1999 ", 1, "13.03.1999", "1999"), ("2024-02-30", 1, None, None), ("not a date", 1, None, None), ("12 March", 1, None, None), (None, 1, None, None),
])
def test_dates(spark, surface, days, moved, year):
    row = spark.createDataFrame([(surface, days)], "s string, n int").select(dates.shifted(F.col("s"), F.col("n")), dates.year_only(F.col("s"))).head()
    assert tuple(row) == (moved, year)


def test_check_digits(spark):
    rng = random.Random(7)
    numbers = ["".join(rng.choice("0123456789") for _ in range(n)) for n in (12, 13, 15, 16, 19) for _ in range(40)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string")
    for r in rows.select("n", checkdigits.luhn_fix(F.col("n")).alias("l"), checkdigits.verhoeff_fix(F.col("n")).alias("v")).collect():
        assert checkdigits.luhn_ok(r.l) and checkdigits.verhoeff_ok(r.v) and r.l[:-1] == r.v[:-1] == r.n[:-1]
    got = spark.createDataFrame([("4111111111111111", "236"), ("4111111111111112", "237"), ("x", "1")], "a string, b string").select(checkdigits.luhn_valid(F.col("a")), checkdigits.verhoeff_valid(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]


def test_hmac_is_hmac(spark):
    for salt in (b"s" * 16, b"t" * 100):
        rows = spark.createDataFrame([("PERSON", "anil rao")], "t string, c string")
        got = pseudonyms.with_digest(rows, salt, F.col("t"), F.col("c")).head()
        assert got.digest == hmac.new(salt, b"1.0.0|person|anil rao", hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        crypto.key_table(spark, b"short")


def test_published_vectors():
    block = crypto.np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), crypto.np.uint8).reshape(1, 16)
    assert crypto.AES(bytes(range(32))).encrypt(block).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    key, tweak = bytes.fromhex("EF4359D8D580AA4F7F036D6F04FC6A94"), bytes.fromhex("D8E7920AFA330A73")
    assert crypto.FF3(key, tweak).encrypt(["890121234567890000"]) == ["750918814058654607"]


def test_fpe_domain_and_layout(spark):
    rows = spark.createDataFrame([("12345",), ("1" * 57,), ("4111-1111 1111 1111",), ("none",), (None,)], "s string")
    got = rows.select(crypto.fpe_digits(crypto.digits_of(F.col("s")), b"k" * 32, b"tweak77").alias("c"), "s").collect()
    assert [r.c is None for r in got] == [True, True, False, True, True] and len(got[2].c) == 16
    laid = spark.createDataFrame([("4111-1111 11", "9876543210")], "s string, d string").select(crypto.with_digits(F.col("s"), F.col("d"))).head()[0]
    assert laid == "9876-5432 10"


def test_seal_and_open(spark):
    rows = spark.createDataFrame([("Anil", "User_1", bytearray(b"v" * 32))], "o string, p string, k binary")
    sealed = rows.withColumn("c", crypto.sealed(F.col("o"), F.col("k"), F.col("p")))
    assert sealed.select(crypto.opened(F.col("c"), F.col("k"), F.col("p"))).head()[0] == "Anil"
    with pytest.raises(Exception):
        sealed.select(crypto.opened(F.col("c"), F.col("k"), F.lit("User_2"))).collect()
