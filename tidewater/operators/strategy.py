"""Strategies replayed over bars, one account after the other along its own bars, accounts spread over tasks.

An account's bars are taken time by time: those of a time first enter its history, then the strategy decides,
then a snapshot is taken. Bars before the period only fill the history. What an account holds in memory is its
history of bounded depth, its positions and the running time's bars.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.folds import folded
from tidewater.operators.ledger import BUY, SELL, Account

FIELDS = "account string, kind string, created_at timestamp, seq bigint, symbol string, side int, price double, volume double, filled_volume double, fee double, cash double, holding double, cost_price double, nav double"


class Context:
    """What a strategy sees: the simulated time, its step in the period (from 1), the histories, and the account."""

    def __init__(self, name: str, cash: float, depth: int):
        self.account_name, self.account = name, Account(cash)
        self.now: datetime | None = None
        self.step = 0
        self.histories: dict[tuple[str, str], deque] = defaultdict(lambda: deque(maxlen=depth))
        self.rows: list[tuple] = []
        self.params: dict[str, Any] = {}

    def history(self, symbol: str, n: int, frequency: str | None = None) -> list:
        """The last ``n`` bars of a symbol, oldest first; of the first frequency seen if none is named."""
        known = [k for k in self.histories if k[0] == symbol and frequency in (None, k[1])]
        return list(self.histories[known[0]])[-n:] if known else []

    def order(self, symbol: str, side: int, volume: float | None = None, percent: float | None = None, price: float | None = None) -> float:
        """Fill an order at ``price`` (the symbol's last one by default); returns the volume that was filled, 0 where cash or holding do not suffice."""
        price = self.account.price.get(symbol) if price is None else price
        if not price or price <= 0:
            return 0.0
        asked, filled, fee = self.account.order(symbol, side, price, volume, percent)
        held, cost = self.account.held.get(symbol, (0.0, 0.0))
        self._add("order", self.now, symbol, side, float(price), float(asked), float(filled), float(fee), float(held), float(cost))
        return filled

    def buy(self, symbol: str, volume: float | None = None, percent: float | None = None) -> float:
        return self.order(symbol, BUY, volume, percent)

    def sell(self, symbol: str, volume: float | None = None, percent: float | None = None) -> float:
        return self.order(symbol, SELL, volume, percent)

    def _add(self, kind: str, at: datetime, symbol=None, side=None, price=None, volume=None, filled=None, fee=None, held=None, cost=None) -> None:
        a = self.account
        self.rows.append((self.account_name, kind, at, len(self.rows) + self.params["_before"], symbol, side, price, volume, filled, fee, a.cash, held, cost, a.value()))


Strategy = Callable[[Context, list], None]


def backtest(bars: DataFrame, decide: Strategy, start: str, end: str, account_col: str | None = None, depth: int = 100, cash: float = 1_000_000.0) -> DataFrame:
    """Orders and snapshots (``kind``) of every account, numbered by ``seq`` in the order in which they came about.

    ``decide(context, bars)`` is called for each time of the period with that time's bars. Bars are an account's
    own by ``account_col``, or all of one account. The first step of the period that has bars before it is
    preceded by a snapshot of the untouched account at the time before.
    """
    lo, hi = datetime.fromisoformat(start), datetime.fromisoformat(end)
    d = bars.withColumn("account", F.col(account_col).cast("string") if account_col else F.lit("all")).where(F.col("eob").isNotNull())
    names = [c for c in d.columns if c != "account"]

    def begin() -> dict:
        return {"context": None, "time": None, "last": None, "bars": [], "before": 0}

    def flush(s: dict) -> list[tuple]:
        c: Context = s["context"]
        if c is None or not s["bars"]:
            return []
        for b in s["bars"]:
            c.histories[b.symbol, b.frequency].append(b)
            if b.close and b.close > 0:
                c.account.price[b.symbol] = b.close
        c.now, c.rows = s["time"], []
        c.params["_before"] = s["before"]
        if lo <= s["time"].replace(tzinfo=None) <= hi:
            if c.step == 0 and s["last"] is not None:
                c._add("snapshot", s["last"])
            c.step += 1
            decide(c, s["bars"])
            c._add("snapshot", s["time"])
        s["before"] += len(c.rows)
        s["last"], s["bars"] = s["time"], []
        return c.rows

    def step(s: dict, row) -> list[tuple]:
        out = flush(s) if s["bars"] and row.eob != s["time"] else []
        if s["context"] is None:
            s["context"] = Context(row.account, cash, depth)
        s["time"] = row.eob
        s["bars"].append(row)
        return out

    order = [c for c in ("eob", "symbol", "frequency") if c in names]
    return folded(d.select("account", *names), ["account"], order, begin, step, FIELDS, flush)


def snapshots(result: DataFrame) -> DataFrame:
    """Cash and net asset value after each time; where a time has several, the last."""
    return result.where("kind = 'snapshot'").select("account", "created_at", "seq", "cash", "nav")


def fills(result: DataFrame) -> DataFrame:
    """The orders, as the functions of :mod:`tidewater.operators.ledger` take them."""
    return result.where("kind = 'order'").drop("kind")
