"""Session-by-session portfolio simulation: a fold over one run's events, many runs in parallel.

A run's rows (kind: session, bar, action, target, treatment, complex) meet in one grouped-map call; a
run is a strategy's decisions over a few thousand sessions. Within a session: entitlements before
the open, reviewed treatments and splits (also of pending orders), dividend entitlement, fills at the raw
open (sells first, then by ticker), entitlements after the close, valuation with stale prices
carried, dividend cash, snapshot, and new orders for the next session.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd

TINY = 1e-9
#: Columns of a run's input rows.
INPUT = "run_id string, kind string, session date, ticker string, open double, close double, available boolean, weight double, factor double, amount double, other string, timing string"
#: Columns of the records that a run produces.
OUTPUT = "run_id string, record string, session date, ticker string, side string, status string, quantity double, price double, notional double, commission double, slippage double, nav double, cash double, positions int, realized double, unrealized double, reason string"
FIELDS = [c.split()[0] for c in OUTPUT.split(", ")]


class UnmodelledAction(ValueError):
    """A held name has a complex corporate action without a reviewed treatment."""


@dataclass
class Config:
    initial_cash: float = 1_000_000.0
    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    fractional: bool = True


@dataclass
class Position:
    quantity: float = 0.0
    cost: float = 0.0  # of the whole position
    price: float = 0.0

    @property
    def value(self) -> float:
        return self.quantity * self.price


@dataclass
class Ledger:
    """Cash and positions at average cost."""

    cash: float
    positions: dict[str, Position] = field(default_factory=dict)
    realized: float = 0.0

    def buy(self, ticker: str, quantity: float, notional: float, commission: float) -> None:
        p = self.positions.setdefault(ticker, Position())
        p.quantity += quantity
        p.cost += notional + commission
        self.cash -= notional + commission

    def sell(self, ticker: str, quantity: float, notional: float, commission: float) -> None:
        p = self.positions[ticker]
        basis = p.cost * quantity / p.quantity
        self.realized += notional - commission - basis
        self.cash += notional - commission
        p.quantity -= quantity
        p.cost -= basis
        if p.quantity <= TINY:
            del self.positions[ticker]

    def split(self, ticker: str, factor: float) -> None:
        p = self.positions.get(ticker)
        if p:
            p.quantity *= factor
            p.price /= factor

    @property
    def nav(self) -> float:
        return self.cash + sum(p.value for p in self.positions.values())


@dataclass
class Order:
    ticker: str
    side: str
    quantity: float


def whole(quantity: float, config: Config) -> float:
    return quantity if config.fractional else float(math.floor(quantity + TINY))


class Run:
    def __init__(self, rows: pd.DataFrame, config: Config):
        self.config, self.ledger = config, Ledger(config.initial_cash)
        self.pending: list[Order] = []
        self.records: list[dict] = []
        self.entitled: dict[tuple, float] = {}
        self.by: dict[tuple[str, object], list] = {}
        for row in rows.itertuples(index=False):
            self.by.setdefault((row.kind, row.session), []).append(row)
        self.sessions = sorted({row.session for row in self.by_kind("session")})

    def by_kind(self, kind: str):
        return [r for (k, _), rows in self.by.items() if k == kind for r in rows]

    def note(self, record: str, session, **values) -> None:
        self.records.append({"record": record, "session": session, **values})

    def play(self) -> list[dict]:
        for session in self.sessions:
            bars = {b.ticker: b for b in self.by.get(("bar", session), [])}
            self.entitlements(session, "pre_open")
            treated = self.treatments(session)
            self.splits(session, bars, treated)
            due = {a.ticker: self.held(a.ticker) for a in self.actions(session, "dividend") if a.ticker not in treated}
            self.fill(session, bars)
            self.entitlements(session, "post_close")
            self.value(session, bars)
            self.dividends(session, due)
            self.snapshot(session)
            if targets := self.by.get(("target", session)):
                self.order(session, bars, targets)
        return self.records

    def held(self, ticker: str) -> float:
        p = self.ledger.positions.get(ticker)
        return p.quantity if p else 0.0

    def actions(self, session, suffix: str) -> list:
        return sorted((a for a in self.by.get(("action", session), []) if a.other.lower().endswith(suffix)), key=lambda a: a.ticker)

    def entitlements(self, session, timing: str) -> None:
        for t in self.by_kind("treatment"):
            if t.timing == timing and t.session == session:
                self.entitled[t.ticker, t.other] = self.held(t.ticker)

    def treatments(self, session) -> set[str]:
        """Reviewed spin-offs and recapitalisations; a held name's unreviewed complex event is an error."""
        reviewed: dict[str, list] = {}
        for t in self.by.get(("treatment", session), []):
            reviewed.setdefault(t.ticker, []).append(t)
        done = set()
        for event in sorted(self.by.get(("complex", session), []), key=lambda e: e.ticker):
            if self.held(event.ticker) <= TINY:
                continue
            if event.ticker not in reviewed:
                raise UnmodelledAction(f"{event.ticker} on {session}: {event.other}")
            for t in reviewed[event.ticker]:
                before = self.entitled.get((t.ticker, t.other), self.held(t.ticker))
                if pd.notna(t.factor) and not t.other:
                    self.ledger.split(t.ticker, t.factor)
                elif t.other and pd.notna(t.factor):
                    got = self.ledger.positions.setdefault(t.other, Position())
                    got.quantity += before * t.factor
                    got.price = t.open if pd.notna(t.open) else got.price
                if pd.notna(t.amount):
                    self.ledger.cash += before * t.amount
                    self.note("cash_flow", session, ticker=t.ticker, status="recapitalization_cash", quantity=before, price=t.amount, notional=before * t.amount)
            done.add(event.ticker)
        return done

    def splits(self, session, bars, treated: set[str]) -> None:
        for a in self.actions(session, "split"):
            if a.ticker in treated:
                continue
            p = self.ledger.positions.get(a.ticker)
            self.ledger.split(a.ticker, a.factor)
            if p and not self.config.fractional:
                rest = p.quantity - math.floor(p.quantity + TINY)
                if rest > TINY:
                    bar = bars.get(a.ticker)
                    if bar is None or pd.isna(bar.open):
                        raise ValueError(f"no open for cash in lieu: {a.ticker} {session}")
                    self.ledger.sell(a.ticker, rest, rest * bar.open, 0.0)
                    self.note("cash_flow", session, ticker=a.ticker, status="cash_in_lieu", quantity=rest, price=bar.open, notional=rest * bar.open)
            for o in self.pending:
                if o.ticker == a.ticker:
                    o.quantity *= a.factor

    def fill(self, session, bars) -> None:
        c = self.config
        fee, slip = c.commission_bps / 1e4, c.slippage_bps / 1e4
        for o in sorted(self.pending, key=lambda o: (o.side != "sell", o.ticker)):
            bar = bars.get(o.ticker)
            if bar is None or pd.isna(bar.open):
                self.note("execution", session, ticker=o.ticker, side=o.side, status="unfilled", quantity=0.0, reason="missing_execution_open")
                continue
            price = bar.open * (1 + slip if o.side == "buy" else 1 - slip)
            most = self.ledger.cash / (price * (1 + fee)) if o.side == "buy" else self.held(o.ticker)
            quantity = whole(max(0.0, min(o.quantity, most)), c)
            cut = quantity < o.quantity - TINY
            reason = None if not cut else "reduced_to_available_position_or_whole_shares" if o.side == "sell" else "reduced_to_available_cash" if most < o.quantity - TINY else "reduced_to_whole_shares"
            if quantity <= TINY:
                self.note("execution", session, ticker=o.ticker, side=o.side, status="unfilled", quantity=0.0, reason=reason or "insufficient_position")
                continue
            notional = quantity * price
            (self.ledger.buy if o.side == "buy" else self.ledger.sell)(o.ticker, quantity, notional, notional * fee)
            self.note("execution", session, ticker=o.ticker, side=o.side, status="partially_filled" if cut else "filled", quantity=quantity, price=price, notional=notional, commission=notional * fee, slippage=abs(price - bar.open) * quantity, reason=reason)
        self.pending = []

    def value(self, session, bars) -> None:
        for ticker, p in self.ledger.positions.items():
            bar = bars.get(ticker)
            if bar is not None and bar.available and pd.notna(bar.close):
                p.price = bar.close
            elif p.price <= 0 or not math.isfinite(p.price):
                raise ValueError(f"no valuation price for {ticker} on {session}")

    def dividends(self, session, due: dict[str, float]) -> None:
        for a in self.actions(session, "dividend"):
            if (quantity := due.get(a.ticker, 0.0)) * a.amount > TINY:
                self.ledger.cash += quantity * a.amount
                self.note("cash_flow", session, ticker=a.ticker, status="dividend", quantity=quantity, price=a.amount, notional=quantity * a.amount)

    def snapshot(self, session) -> None:
        held = self.ledger.positions.values()
        self.note("snapshot", session, nav=self.ledger.nav, cash=self.ledger.cash, positions=len(held), realized=self.ledger.realized, unrealized=sum(p.value - p.cost for p in held))

    def order(self, session, bars, targets) -> None:
        nav, weights = self.ledger.nav, {t.ticker: t.weight for t in targets if t.ticker}
        for ticker in sorted(set(weights) | set(self.ledger.positions)):
            p = self.ledger.positions.get(ticker)
            change = weights.get(ticker, 0.0) * nav - (p.value if p else 0.0)
            if abs(change) <= TINY:
                continue
            bar = bars.get(ticker)
            if bar is None or pd.isna(bar.close) or not bar.available:
                raise ValueError(f"no decision close for {ticker} on {session}")
            quantity = whole(abs(change) / bar.close, self.config)
            if quantity > TINY:
                self.pending.append(Order(ticker, "buy" if change > 0 else "sell", quantity))
                self.note("order", session, ticker=ticker, side=self.pending[-1].side, quantity=quantity, price=bar.close)


def simulate(rows: pd.DataFrame, config: Config | None = None) -> pd.DataFrame:
    """The records of one run's rows (INPUT), in OUTPUT's columns."""
    out = pd.DataFrame(Run(rows, config or Config()).play(), columns=[f for f in FIELDS if f != "run_id"])
    out.insert(0, "run_id", rows["run_id"].iloc[0])
    return out[FIELDS].astype(object).where(lambda x: x.notna(), None)
