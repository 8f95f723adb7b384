"""The replay rules as one plain loop over a run's bars; the tests' independent yardstick."""

from __future__ import annotations


class Leg:
    def __init__(self, conf, row, run):
        self.c, self.run = conf, run
        self.offset = row["strike_offset"]
        self.raw, self.entry_spot = row["close"], row["spot"]
        self.sign = 1.0 if conf["position"] == "buy" else -1.0
        self.qty = float(conf["lots"] * run["lot_size"])
        self.entry = slip(self.raw, conf["position"], run)
        self.price, self.spot, self.hi, self.lo = self.entry, self.entry_spot, self.entry, self.entry
        self.n, self.pnl, self.hw, self.state = 0, 0.0, None, "active"

    def mark(self, row):
        self.price, self.spot = row["close"], row["spot"]
        first = self.n == 0
        self.hi = self.price if first else max(row["high"], self.price)
        self.lo = self.price if first else min(row["low"], self.price)
        self.n += 1
        self.pnl = (self.price - self.entry) * self.sign * self.qty
        c = self.c
        if not c["trail_sl_enabled"]:
            return
        if self.state == "active":
            prem = self.entry * self.qty
            if (self.pnl / prem * 100 if self.entry > 0 else 0.0) >= c["trail_sl_activate_at"]:
                self.state, self.hw = "on", self.pnl
        elif self.state == "on":
            self.hw = max(self.hw, self.pnl)
            if c["trail_sl_mode"] == "lock":
                fire = self.pnl < self.hw * (c["trail_sl_lock_in"] / 100)
            else:
                t = c["trail_sl_value"] * self.qty if c["trail_sl_unit"] == "points" else self.hw * (c["trail_sl_value"] / 100)
                fire = self.hw - self.pnl >= t and t > 0
            if fire:
                self.state = "hit"

    @property
    def worst(self):
        return self.hi if self.sign < 0 else self.lo

    @property
    def best(self):
        return self.lo if self.sign < 0 else self.hi

    def stopped(self):
        c = self.c
        if self.state == "hit":
            return True
        if not c["stop_loss_enabled"]:
            return False
        v, k = c["stop_loss_value"], c["stop_loss_type"]
        lose = -(self.worst - self.entry) * self.sign
        if k == "points":
            return lose >= v
        if k == "percent_of_premium":
            return (lose / self.entry * 100 if self.entry > 0 else 0.0) >= v
        if k == "percent_of_margin":
            m = max(3 * self.entry, 0.12 * self.entry_spot)
            return (lose / m * 100 if m > 0 else 0.0) >= v
        if k == "index_points":
            return (self.spot - self.entry_spot) * -self.sign >= v
        return False

    def reached(self):
        c = self.c
        if not c["target_profit_enabled"]:
            return False
        gain = (self.best - self.entry) * self.sign
        if c["target_profit_type"] == "points":
            return gain >= c["target_profit_value"]
        if c["target_profit_type"] == "percent_of_premium":
            return (gain / self.entry * 100 if self.entry > 0 else 0.0) >= c["target_profit_value"]
        return False


def slip(price, side, run):
    v, m = run["slippage_value"], run["slippage_model"]
    if m == "fixed_pts":
        return max(price - v, 0.01) if side == "sell" else price + v
    if m == "percent":
        return price * (1 - v / 100) if side == "sell" else price * (1 + v / 100)
    return price


def choose(conf, rows):
    rows = [r for r in rows if r["option_type"] == conf["option_type"]]
    rows.sort(key=lambda r: r["strike_offset"])
    mode = conf["strike_mode"]
    if mode == "atm_offset":
        rows = [r for r in rows if r["strike_offset"] == conf["strike_offset"]]
        return rows[0] if rows else None
    if not rows:
        return None
    if mode == "premium":
        goal = 200.0 if conf["premium_target"] is None else conf["premium_target"]
        return min(rows, key=lambda r: abs(r["close"] - goal))
    if mode == "percent_otm":
        return min(rows, key=lambda r: abs(r["strike_offset"] - conf["strike_offset"]))
    return next((r for r in rows if r["strike_offset"] == 0), rows[0])


def overall(kind, value, amount, premium, rupee):
    if kind == "percent_of_premium":
        return (amount / premium * 100 if premium > 0 else 0.0) >= value
    return kind in rupee and amount >= value


def replay(run, legs, bars, signals=None):
    """(trades, snapshots) of one run over one symbol's bars (dicts); ``signals`` by (date, time)."""
    groups = {}
    for b in sorted(bars, key=lambda b: (b["date"], b["time"], b["strike_offset"], b["option_type"])):
        groups.setdefault((b["date"], b["time"]), []).append(b)
    trades, snaps, pos, realized = [], [], None, 0.0
    # One tracker for each leg that may re-enter.
    watch = [dict(c=l, state="idle", left=0, done=0) for l in legs if l["reentry_on_sl"] or l["reentry_on_target"]]
    waits_for_time = any(l["reentry_mode"] == "same_time" for l in legs)
    armed, attempt, last = False, 0, None

    def close(reason, key):
        nonlocal realized
        for leg in pos["legs"]:
            wick = leg.c["stop_loss_type"] in ("points", "percent_of_premium", "percent_of_margin")
            raw = leg.price
            if reason == "stop_loss" and wick:
                raw = leg.worst
            if reason == "target":
                raw = leg.best
            side = leg.c["position"]
            out = slip(raw, "sell" if side == "buy" else "buy", run)
            broker = run["brokerage_per_lot"] * leg.c["lots"] * 2
            stt = (leg.entry if side == "sell" else out) * leg.qty * 0.000625 if run["stt_on_sell"] else 0.0
            other = 0.0
            for px, buy in ((leg.entry, side == "buy"), (out, side == "sell")):
                t = px * leg.qty
                other += t * 0.00053 + t * 0.000001 + (t * 0.00003 if buy else 0) + (broker / 2 + t * 0.00053 + t * 0.000001) * 0.18
            gross = (out - leg.entry) * leg.sign * leg.qty
            net = gross - broker - stt - other
            realized += net
            trades.append(
                dict(entry=pos["key"], exit=key, reason=reason, leg_no=leg.no, entry_price=leg.entry, exit_price=out,
                     gross=gross, net=net, bars_held=leg.n, attempt=pos["attempt"], offset=leg.offset)
            )

    for key, rows in groups.items():
        last = key
        if pos is None and armed:
            for w in watch:
                if w["state"] == "cooling":
                    w["left"] -= 1
                    if w["left"] <= 0:
                        w["state"] = "ready"
                elif w["state"] == "waiting":
                    agrees = "bearish" if w["c"]["position"] == "sell" else "bullish"
                    if (signals or {}).get(key) == agrees:
                        w["state"] = "ready"
        if pos is None:
            if armed:
                go = any(w["state"] == "ready" for w in watch) and (not waits_for_time or key[1] == run["entry_time"])
            else:
                go = key[1] == run["entry_time"]
            if go:
                opened = []
                for no, conf in enumerate(legs):
                    row = choose(conf, rows)
                    if row is not None:
                        leg = Leg(conf, row, run)
                        leg.no = no
                        opened.append(leg)
                if opened:
                    label = 0
                    if armed:
                        attempt += 1
                        label, armed = attempt, False
                        for w in watch:
                            if w["state"] == "ready":
                                w["state"], w["done"] = "idle", w["done"] + 1
                    pos = dict(key=key, legs=opened, attempt=label)
        if pos is not None:
            for leg in pos["legs"]:
                for r in rows:
                    if r["option_type"] == leg.c["option_type"] and r["strike_offset"] == leg.offset:
                        leg.mark(r)
                        break
            total = 0.0
            prem = 0.0
            for leg in pos["legs"]:
                total += leg.pnl
                prem += leg.entry * leg.qty
            reason = None
            if any(l.stopped() for l in pos["legs"]):
                reason = "stop_loss"
            elif run["overall_sl_enabled"] and overall(run["overall_sl_type"], run["overall_sl_value"], -total, prem, ("points", "combined_premium")):
                reason = "combined_sl"
            elif any(l.reached() for l in pos["legs"]):
                reason = "target"
            elif run["overall_target_enabled"] and overall(run["overall_target_type"], run["overall_target_value"], total, prem, ("points",)):
                reason = "combined_target"
            elif key[1] >= run["exit_time"]:
                reason = "time_exit"
            if reason:
                close(reason, key)
                pos = None
                for w in watch:
                    rule = w["c"]
                    hit = (reason in ("stop_loss", "combined_sl") and rule["reentry_on_sl"]) or (
                        reason in ("target", "combined_target") and rule["reentry_on_target"]
                    )
                    if w["state"] == "idle" and hit and w["done"] < rule["reentry_max_attempts"]:
                        mode = rule["reentry_mode"]
                        w["left"] = rule["reentry_cooldown_bars"] if mode == "after_n_bars" else 0
                        w["state"] = "waiting" if mode == "momentum_confirm" else "cooling" if w["left"] else "ready"
                armed = any(w["state"] != "idle" for w in watch)
        open_pnl = sum(l.pnl for l in pos["legs"]) if pos else 0.0
        snaps.append((key, run["capital"] + realized + open_pnl))
    if pos is not None:
        close("end_of_data", last)
    return trades, snaps
