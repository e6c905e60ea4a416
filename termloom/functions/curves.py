"""Bonding curves in exact 256-bit integer arithmetic, as column functions over decimal strings.

Spark's decimals end at 38 digits, so amounts travel as strings and are computed with
Python integers inside Arrow batches; a failed domain check comes back as an error name.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = (1 << 256) - 1
WAD = 10**18


class CurveError(ValueError):
    """One of: invalid_slope, assets_exceed_total, shares_exceed_total, assets_overflow_max, shares_overflow_max, domain_exceeded, division_by_zero, overflow, underflow."""


def _fits(x: int) -> int:
    if x < 0:
        raise CurveError("underflow")
    if x > LIMIT:
        raise CurveError("overflow")
    return x


def ratio(x: int, y: int, by: int, up: bool = False) -> int:
    """x * y / by with an unbounded product, rounded down or up."""
    if by == 0:
        raise CurveError("division_by_zero")
    return _fits(-(-x * y // by) if up else x * y // by)


def wad_sqrt(x: int) -> int:
    return _fits(isqrt(x * WAD))


def fee_on(amount: int, fee: int, denominator: int) -> int:
    return ratio(amount, fee, denominator, up=True)


def market_cap(shares: int, price: int) -> int:
    return ratio(shares, price, WAD)


def _need(ok: bool, error: str) -> None:
    if not ok:
        raise CurveError(error)


@dataclass(frozen=True)
class Linear:
    """Shares and assets in proportion to the vault's totals."""

    max_assets: int = LIMIT
    max_shares: int = LIMIT

    def _domain(self, assets: int, shares: int) -> None:
        _need(assets <= self.max_assets and shares <= self.max_shares, "domain_exceeded")

    def deposit(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= self.max_assets - assets, "assets_overflow_max")
        out = ratio(x, shares, assets) if shares else x
        _need(out <= self.max_shares - shares, "shares_overflow_max")
        return out

    def mint(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= self.max_shares - shares, "shares_overflow_max")
        out = ratio(x, assets, shares, up=True) if shares else x
        _need(out <= self.max_assets - assets, "assets_overflow_max")
        return out

    def withdraw(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= assets, "assets_exceed_total")
        return ratio(x, shares, assets, up=True) if shares else x

    def redeem(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= shares, "shares_exceed_total")
        return ratio(x, assets, shares) if shares else x

    def price(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        return ratio(WAD, assets, shares) if shares else WAD


class OffsetProgressive(Linear):
    """A price that rises with supply by slope from an offset; areas under the line are assets."""

    def __init__(self, slope: int, offset: int) -> None:
        _need(slope > 0 and slope % 2 == 0, "invalid_slope")
        most = _fits(wad_sqrt(LIMIT // WAD) - offset)
        for name, value in (("slope", slope), ("half", slope // 2), ("offset", offset), ("max_shares", most)):
            object.__setattr__(self, name, value)
        span = _fits(ratio(most + offset, most + offset, WAD) - ratio(offset, offset, WAD, up=True))
        object.__setattr__(self, "max_assets", ratio(span, self.half, WAD))

    def deposit(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= self.max_assets - assets, "assets_overflow_max")
        s = _fits(shares + self.offset)
        out = _fits(wad_sqrt(_fits(ratio(s, s, WAD) + ratio(x, WAD, self.half))) - s)
        _need(out <= self.max_shares - shares, "shares_overflow_max")
        return out

    def mint(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= self.max_shares - shares, "shares_overflow_max")
        s = _fits(shares + self.offset)
        area = _fits(ratio(s + x, s + x, WAD, up=True) - ratio(s, s, WAD))
        out = ratio(area, self.half, WAD, up=True)
        _need(out <= self.max_assets - assets, "assets_overflow_max")
        return out

    def withdraw(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= assets, "assets_exceed_total")
        s = _fits(shares + self.offset)
        return _fits(s - wad_sqrt(_fits(ratio(s, s, WAD) - ratio(x, WAD, self.half, up=True))))

    def redeem(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        _need(x <= shares, "shares_exceed_total")
        s = _fits(shares + self.offset)
        return ratio(_fits(ratio(s, s, WAD) - ratio(s - x, s - x, WAD)), self.half, WAD)

    def price(self, x: int, assets: int, shares: int) -> int:
        self._domain(assets, shares)
        return ratio(_fits(shares + self.offset), self.slope, WAD)


@dataclass(frozen=True)
class Fees:
    """Fee rates over one denominator; wallet is for atom deposits, fraction for triple deposits."""

    protocol: int = 0
    entry: int = 0
    exit: int = 0
    wallet: int = 0
    fraction: int = 0
    denominator: int = 10_000


def deposit_quote(curve: Linear, amount: int, assets: int, shares: int, fees: Fees, entry: bool = True, kind: str = "basic", with_fraction: bool = True) -> dict[str, int]:
    """Shares and fee parts of a deposit; kind is basic, atom (wallet fee) or triple (atom-deposit fraction)."""
    parts = {
        "protocol_fee": fee_on(amount, fees.protocol, fees.denominator), "entry_fee": fee_on(amount, fees.entry, fees.denominator) if entry else 0, "exit_fee": 0,
        "wallet_fee": fee_on(amount, fees.wallet, fees.denominator) if kind == "atom" else 0, "fraction": fee_on(amount, fees.fraction, fees.denominator) if kind == "triple" and with_fraction else 0,
    }
    after = _fits(amount - _fits(sum(parts.values())))
    return {"shares": curve.deposit(after, assets, shares), "assets_before": amount, "assets_after": after, **parts, "total_fees": _fits(sum(parts.values()))}


def redeem_quote(curve: Linear, amount: int, assets: int, shares: int, fees: Fees, exit_fee: bool = True) -> dict[str, int]:
    """Assets and fee parts of a redemption; fees come off what the shares redeem for."""
    before = curve.redeem(amount, assets, shares)
    parts = {"protocol_fee": fee_on(before, fees.protocol, fees.denominator), "exit_fee": fee_on(before, fees.exit, fees.denominator) if exit_fee else 0}
    return {"shares": amount, "assets_before": before, "assets_after": _fits(before - _fits(sum(parts.values()))), **parts, "total_fees": _fits(sum(parts.values()))}


#: Numbers from 1 to this have products and quotients that a decimal(38, 0) holds exactly.
SMALL = 10**15


def _in_jvm(operation: str, x: Column, assets: Column, shares: Column) -> Column:
    """The value of a linear curve without limits, for small numbers, in decimals; null where that can't be done."""
    whole = lambda c: c.cast("decimal(38,0)")
    small = lambda c: whole(c).between(F.lit(1), F.lit(SMALL))
    over, by, up, fits = {
        "deposit": ((x, shares), assets, False, small(x) & small(shares)), "mint": ((x, assets), shares, True, small(x) & small(assets)),
        "withdraw": ((x, shares), assets, True, small(x) & small(shares) & (whole(x) <= whole(assets))), "redeem": ((x, assets), shares, False, small(x) & small(assets) & (whole(x) <= whole(shares))),
        "price": ((F.lit(WAD), assets), shares, False, whole(assets).between(F.lit(1), F.lit(10**13))),
    }[operation]
    by = by.cast("decimal(19,0)")
    product = over[0].cast("decimal(19,0)") * over[1].cast("decimal(19,0)") + (by - 1 if up else F.lit(0))
    exact = ((product - product % by) / by).cast("decimal(38,0)")  # a multiple of by, so the quotient is whole
    return F.when(F.coalesce(fits & small(by), F.lit(False)), exact.cast("string"))


def preview(curve: Linear, operation: str, amount: Column, assets: Column, shares: Column) -> Column:
    """struct(value, error) of deposit, mint, withdraw, redeem or price; inputs and value are decimal strings, null in gives null.

    A linear curve without limits is computed in the JVM where numbers are small enough for
    exact decimals; what is larger, or may be an error, goes through Python's integers.
    """
    if type(curve) is Linear and curve.max_assets == curve.max_shares == LIMIT:
        quick = _in_jvm(operation, amount, assets, shares)
        rest = _preview(curve, operation, *[F.when(quick.isNull(), c) for c in (amount, assets, shares)])
        return F.struct(F.coalesce(quick, rest["value"]).alias("value"), F.when(quick.isNull(), rest["error"]).alias("error"))
    return _preview(curve, operation, amount, assets, shares)


def _preview(curve: Linear, operation: str, amount: Column, assets: Column, shares: Column) -> Column:

    @F.pandas_udf("struct<value string, error string>")
    def run(x: pd.Series, a: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        if x.isna().all():
            return pd.DataFrame({"value": x, "error": x})
        for one in zip(x, a, s, strict=True):
            if any(pd.isna(v) for v in one):
                out.append((None, None))
                continue
            try:
                out.append((str(getattr(curve, operation)(*map(int, one))), None))
            except CurveError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["value", "error"])

    return run(amount.cast("string"), assets.cast("string"), shares.cast("string"))


def quote(curve: Linear, operation: str, amount: Column, assets: Column, shares: Column, fees: Fees, kind: str = "basic") -> Column:
    """struct of a deposit or redeem quote as decimal strings, with error; null in gives null."""
    names = ("shares", "assets_before", "assets_after", "total_fees")

    @F.pandas_udf("struct<shares string, assets_before string, assets_after string, total_fees string, error string>")
    def run(x: pd.Series, a: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for one in zip(x, a, s, strict=True):
            if any(pd.isna(v) for v in one):
                out.append((None,) * 5)
                continue
            try:
                q = deposit_quote(curve, *map(int, one), fees, kind=kind) if operation == "deposit" else redeem_quote(curve, *map(int, one), fees)
                out.append((*(str(q[n]) for n in names), None))
            except CurveError as e:
                out.append((None, None, None, None, str(e)))
        return pd.DataFrame(out, columns=[*names, "error"])

    return run(amount.cast("string"), assets.cast("string"), shares.cast("string"))
