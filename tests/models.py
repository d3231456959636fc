"""Slow, sequential models of the order flow, written from its rules."""

from __future__ import annotations

import math

WINDOW = 900


def history(orders, chargebacks=()):
    """orders: (customer, t, seq, cents, bin). Returns seq -> history tuple."""
    rows = [(t, 0, seq, c, cents, b) for c, t, seq, cents, b in orders]
    rows += [(t, 1, seq, c, 0, "") for c, t, seq in chargebacks]
    state: dict = {}
    out = {}
    for t, kind, seq, customer, cents, bin_ in sorted(rows, key=lambda r: r[:3]):
        own = state.setdefault(customer, {"past": [], "bins": set(), "cb": 0})
        if kind == 1:
            own["cb"] += 1 if own["past"] else 0
            continue
        past = own["past"]
        out[seq] = (
            len(past),
            sum(p[1] for p in past),
            sum(1 for p in past if p[2]),
            bool(bin_) and bin_ not in own["bins"],
            sum(1 for p in past if p[0] >= t - WINDOW),
            own["cb"],
        )
        past.append((t, cents, bin_))
        if bin_:
            own["bins"].add(bin_)
    return out


def zscore(past: list[int], amount: int) -> float:
    n = len(past)
    if n < 3:
        return 0.0
    mean = sum(past) / n
    sd = math.sqrt(max(0.0, sum(float(p) ** 2 for p in past) / n - mean**2))
    if sd <= 0:
        return 4.0 if amount > mean else 0.0
    return max(0.0, min(4.0, (amount - mean) / sd))


def admit(stock, requests):
    """requests: (warehouse, sku, t, seq, quantity). Returns (w, s, seq) -> bool."""
    left = dict(stock)
    out = {}
    for w, s, _, seq, q in sorted(requests, key=lambda r: (r[2], r[3])):
        ok = left.get((w, s), 0) >= q
        if ok:
            left[(w, s)] -= q
        out[(w, s, seq)] = ok
    return out


def pick(stock, lines):
    best = None
    for sku, q in lines:
        for (w, s), available in stock.items():
            if s == sku and available - q >= 0:
                offer = (-(available - q), w)
                best = offer if best is None or offer < best else best
    return best[1] if best else None


def allocate(stock, orders, live_picks=False):
    """orders: order_id -> (t, seq, [(sku, q)]). Returns order_id -> (w, ok)."""
    left = dict(stock)
    out = {}
    for order_id, (t, seq, lines) in sorted(orders.items(), key=lambda o: o[1][:2]):
        w = pick(left if live_picks else stock, lines)
        ok = w is not None and all(left.get((w, s), -1) >= q for s, q in lines)
        if ok:
            for s, q in lines:
                left[(w, s)] -= q
        out[order_id] = (w, ok)
    return out, left


def ledger(stock, moves):
    """stock rows and (warehouse, sku, kind, quantity, t, seq). Returns cells and applied seqs."""
    cells = {(w, s): [h, r, a, v] for w, s, h, r, a, v in stock}
    applied = set()
    for w, s, kind, q, _, seq in sorted(moves, key=lambda m: (m[4], m[5])):
        own = cells.get((w, s))
        if own is None or q is None or q < 1:
            continue
        at, taken = (2, own[2]) if kind == "reserve" else (1, own[1])
        if kind not in ("reserve", "release", "commit") or taken < q:
            continue
        own[at] -= q
        if kind == "reserve":
            own[1] += q
        elif kind == "release":
            own[2] += q
        else:
            own[0] -= q
        own[3] += 1
        applied.add(seq)
    return {k: tuple(v) for k, v in cells.items()}, applied
