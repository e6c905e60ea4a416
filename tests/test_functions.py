"""Known answers of ids and curves, and properties of the curves."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import curves as V
from termloom.functions import keccak as K

WAD = V.WAD
LINEAR, PROGRESSIVE, NO_OFFSET = V.Linear(), V.OffsetProgressive(2 * WAD, WAD // 2), V.OffsetProgressive(2 * WAD, 0)


def test_many_digests_equal_single_ones():
    messages = [b"x" * n for n in (0, 1, 55, 134, 135, 136, 137, 271, 272, 273, 1000)] * 2
    assert K.keccak256_many(messages) == [K.keccak256(m) for m in messages] and K.keccak256_many([]) == []


def test_keccak_and_ids():
    assert K.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    for n in (1, 134, 135, 136, 137, 271, 272, 273):
        assert len(K.keccak256(b"x" * n)) == 32
    subject, predicate, object_ = "0x05bb6d28ed5ca3c5206f33f5818da27b3b0bbf6401cd40f082e8db7fcf481787", "0xdb3dc8c92d6141c4e0c9b453b00fc1f237624ef8373b6ae9972d09557d8aaa8d", "0x39afce29ac0e4be2400fa0421b537f63ad2d78d7f8b4be4ff839a162ff3e5ffc"
    assert K.triple_id("atom:" + subject, predicate, "triple:" + object_) == "0x57946a02776dbd4eec339ecf5cdf6e0005b8de381fb3d9a2bf303da083bf5166"
    assert K.triple_id("17", predicate, object_) is None
    assert K.checksum_address("0xd8da6bf26964af9d7eed9e03e53415d37aa96045") == "0xd8dA6BF26964aF9D7eEd9e03E53415D37aA96045"
    assert K.atom_id("0x6869") == K.atom_id("hi") != K.atom_id("0x686")


#: Known answers of the deployed contracts: curve, operation, amount, assets, shares, result (fixed values).
KNOWN = [
    (LINEAR, "deposit", WAD, 0, 0, WAD), (LINEAR, "deposit", WAD, 10 * WAD, 5 * WAD, 500000000000000000), (LINEAR, "deposit", 25 * WAD, 100 * WAD, 50 * WAD, 12500000000000000000),
    (LINEAR, "mint", WAD, 3 * WAD + 1, 2 * WAD, 1500000000000000001), (LINEAR, "withdraw", WAD, 3 * WAD, 2 * WAD, 666666666666666667), (LINEAR, "redeem", WAD, 20 * WAD, 5 * WAD, 4 * WAD), (LINEAR, "price", 0, 10 * WAD, 5 * WAD, 2 * WAD),
    (PROGRESSIVE, "deposit", WAD, 0, 0, 618033988749894848), (PROGRESSIVE, "deposit", 1000 * WAD, 0, 0, 31126729201736938386), (PROGRESSIVE, "deposit", 100 * WAD, 0, 10 * WAD, None), (PROGRESSIVE, "deposit", 10**6, 0, 0, 999999), (PROGRESSIVE, "deposit", 1, 0, 0, 0),
    (PROGRESSIVE, "mint", WAD, 0, 0, 2 * WAD), (PROGRESSIVE, "mint", WAD, 0, 10 * WAD, 22 * WAD), (PROGRESSIVE, "mint", 5 * WAD, 0, 10 * WAD, 130 * WAD), (PROGRESSIVE, "redeem", WAD, 0, 10 * WAD, 20 * WAD), (PROGRESSIVE, "redeem", 10 * WAD, 0, 10 * WAD, 110 * WAD),
    (PROGRESSIVE, "withdraw", WAD, WAD, 10 * WAD, 47727519816563834), (PROGRESSIVE, "withdraw", 50 * WAD, 50 * WAD, 100 * WAD, 249064842266932598), (PROGRESSIVE, "price", 0, 0, 10 * WAD, 21 * WAD), (NO_OFFSET, "deposit", 100 * WAD, 0, 0, 10 * WAD), (NO_OFFSET, "price", 0, 0, 0, 0),
]


@pytest.mark.parametrize("curve, operation, amount, assets, shares, result", KNOWN)
def test_known_curve_answers(curve, operation, amount, assets, shares, result):
    if result is not None:
        assert getattr(curve, operation)(amount, assets, shares) == result


def test_curve_limits_and_errors():
    assert PROGRESSIVE.max_shares == 340282366920938463462874607431768211455
    assert PROGRESSIVE.max_assets == 115792089237316195423570985008687907852589169931798687112530
    for slope in (0, 3):
        with pytest.raises(V.CurveError, match="invalid_slope"):
            V.OffsetProgressive(slope, 1)
    for error, call in {
        "assets_exceed_total": lambda: LINEAR.withdraw(2, 1, 1), "shares_exceed_total": lambda: LINEAR.redeem(2, 1, 1), "assets_overflow_max": lambda: LINEAR.deposit(V.LIMIT, 1, 1), "shares_overflow_max": lambda: LINEAR.mint(V.LIMIT, 1, 1),
        "domain_exceeded": lambda: PROGRESSIVE.price(0, 0, V.LIMIT), "division_by_zero": lambda: LINEAR.deposit(1, 0, 1), "overflow": lambda: V.ratio(V.LIMIT, V.LIMIT, 1),
    }.items():
        with pytest.raises(V.CurveError, match=error):
            call()


def test_fees():
    assert [V.fee_on(1, bps, 10_000) for bps in (25, 50, 100)] == [1, 1, 1] and V.fee_on(1000, 100, 10_000) == 10 and V.fee_on(WAD, 0, 10_000) == 0
    fees = V.Fees(100, 50, 25, 25, 150)
    q = V.deposit_quote(LINEAR, 10 * WAD, 0, 0, fees, kind="atom")
    assert (q["protocol_fee"], q["entry_fee"], q["wallet_fee"]) == (100000000000000000, 50000000000000000, 25000000000000000) and q["assets_before"] - q["assets_after"] == q["total_fees"]
    assert V.deposit_quote(LINEAR, 10 * WAD, 0, 0, fees, kind="triple")["fraction"] == 150000000000000000
    assert V.redeem_quote(LINEAR, 10 * WAD, 10 * WAD, 10 * WAD, fees)["exit_fee"] == 25000000000000000


amounts = st.integers(1, 10**24)


@settings(max_examples=60, deadline=None)
@given(amounts, amounts, amounts)
def test_no_profit_from_a_round_trip(x, assets, shares):
    for curve in (LINEAR, PROGRESSIVE):
        got = curve.deposit(x, assets, shares)
        if curve is LINEAR:
            assert curve.redeem(got, assets + x, shares + got) <= x
        else:
            assert curve.redeem(got, assets + x, shares + got) <= x + 1
        assert curve.deposit(x + 1, assets, shares) >= got


def test_columns(spark):
    rows = spark.createDataFrame([("1000000000000000000", "0", "0"), ("2", "1", "1"), (None, "1", "1")], "x string, a string, s string")
    got = rows.select(V.preview(LINEAR, "withdraw", F.col("x"), F.col("a"), F.col("s")).alias("r")).collect()
    assert [(r.r.value, r.r.error) for r in got] == [(None, "assets_exceed_total"), (None, "assets_exceed_total"), (None, None)]
    ids = rows.select(K.atom_id_of(F.col("x")).alias("i"), K.triple_id_of(F.col("x"), F.col("a"), F.col("s")).alias("t")).collect()
    assert ids[0].i == K.atom_id("1000000000000000000") and ids[2].i is None and ids[0].t is None


def test_fnv_and_slugs(spark):
    from termloom.operators import atoms as A
    from termloom.operators import sites as S

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return f"{h:08x}"

    texts = ["", "a", "foobar", "ünïcode 日本", json.dumps({"k": [1, 2]})]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.fnv1a32(F.col("t")).alias("h"), S.slugify(F.col("t")).alias("s")).collect()
    assert {r.t: r.h for r in got} == {t: fnv(t) for t in texts} and fnv("a") == "e40c292c"
    assert {r.t: r.s for r in got}["foobar"] == "foobar"
