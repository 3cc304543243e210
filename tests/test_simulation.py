"""Session order, fills, splits, dividends and errors of the portfolio simulation."""

from __future__ import annotations

from datetime import date

import pandas as pd
import pytest

from tidemark.operators.simulation import FIELDS, Config, UnmodelledAction, simulate

D = [date(2025, 1, k) for k in (2, 3, 6, 7, 8)]
COLUMNS = ["run_id", "kind", "session", "ticker", "open", "close", "available", "weight", "factor", "amount", "other", "timing"]


def _rows(*rows):
    sessions = [{"kind": "session", "session": d} for d in D]
    return pd.DataFrame([{"run_id": "r"} | r for r in (*sessions, *rows)], columns=COLUMNS)


def _bars(opens, closes, ticker="A"):
    return [{"kind": "bar", "session": d, "ticker": ticker, "open": o, "close": c, "available": True} for d, o, c in zip(D, opens, closes)]


def _target(day, weight=1.0, ticker="A"):
    return {"kind": "target", "session": day, "ticker": ticker, "weight": weight}


def _play(*rows, **config):
    out = simulate(_rows(*rows), Config(initial_cash=1000.0, **config))
    assert list(out.columns) == FIELDS
    return out


def test_orders_fill_at_the_next_open():
    out = _play(*_bars([10, 20, 20, 20, 20], [10, 25, 25, 25, 30]), _target(D[0]))
    fill = out[out.record == "execution"].iloc[0]
    assert (fill.session, fill.price, fill.quantity, fill.reason) == (D[1], 20, 50, "reduced_to_available_cash")
    assert out[out.record == "snapshot"].nav.tolist() == [1000, 1250, 1250, 1250, 1500]


def test_missing_open_is_not_rolled():
    out = _play(*_bars([10, None, 20, 20, 20], [10, 25, 25, 25, 30]), _target(D[0]))
    assert out[out.record == "execution"].status.tolist() == ["unfilled"]


def test_split_scales_positions_and_pending_orders():
    out = _play(*_bars([10, 10, 5, 5, 5], [10, 10, 5, 5, 5]), _target(D[0]), {"kind": "action", "session": D[2], "ticker": "A", "factor": 2.0, "other": "split"})
    assert out[out.record == "snapshot"].nav.tolist() == [1000] * 5


def test_dividend_is_paid_on_what_was_held_before_the_open():
    paid = {"kind": "action", "session": D[1], "ticker": "A", "amount": 1.0, "other": "cash_dividend"}
    assert "dividend" not in _play(*_bars([10] * 5, [10] * 5), _target(D[0]), paid).status.tolist()
    later = _play(*_bars([10] * 5, [10] * 5), _target(D[0]), paid | {"session": D[2]})
    assert later[later.status == "dividend"].notional.tolist() == [100.0]


def test_costs_and_whole_shares():
    out = _play(*_bars([10, 3, 3, 3, 3], [3, 3, 3, 3, 3]), _target(D[0], 0.5), commission_bps=10, slippage_bps=100, fractional=False)
    fill = out[out.record == "execution"].iloc[0]
    assert fill.quantity == 166 and fill.price == pytest.approx(3.03) and fill.commission == pytest.approx(166 * 3.03 * 0.001)


def test_a_held_name_needs_a_reviewed_treatment():
    event = {"kind": "complex", "session": D[2], "ticker": "A", "other": "complex_distribution"}
    with pytest.raises(UnmodelledAction):
        _play(*_bars([10] * 5, [10] * 5), _target(D[0]), event)
    spin = {"kind": "treatment", "session": D[2], "ticker": "A", "other": "B", "factor": 0.5, "open": 4.0, "timing": "pre_open"}
    out = _play(*_bars([10, 10, 8, 8, 8], [10, 10, 8, 8, 8]), *_bars([4] * 5, [4] * 5, "B"), _target(D[0]), event, spin)
    assert out[out.record == "snapshot"].nav.tolist() == [1000] * 5
