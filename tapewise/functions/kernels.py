"""Domain formulas as Column expressions; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def rounded(x: Column | str, digits: int) -> Column:
    """A double to ``digits`` places as DuckDB rounds it: times ten to the places, to
    the nearest whole (halves away from zero), divided again. ``F.round`` takes the
    shortest decimal that reads as the double, which differs next to a half. What
    would leave the range of doubles stays as it is, like NaN and infinities."""
    x = F.col(x) if isinstance(x, str) else x
    scale = 10.0**digits
    return F.coalesce(F.when(F.abs(x) < 1e300, F.round(x * scale) / scale), x)


def finite(x: Column) -> Column:
    """0 for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def sigmoid(x: Column, mid: float, steep: float) -> Column:
    return clamp(1.0 / (1.0 + F.exp(-steep * (finite(x) - mid))), 0, 1)


def bell(x: Column, center: float, width: float) -> Column:
    d = (finite(x) - center) / width
    return clamp(F.exp(-0.5 * d * d), 0, 1)


def confidence(n: Column, target: int) -> Column:
    return clamp(F.sqrt(n / F.lit(float(target))), 0, 1)


def shrink(score: Column, conf: Column) -> Column:
    return clamp(50.0 + (score - 50.0) * conf, 0, 100)


def weighted(*parts: tuple[Column, float]) -> Column:
    total = sum(w for _, w in parts)
    return reduce(lambda a, b: a + b, [c * F.lit(w) for c, w in parts]) / F.lit(total)


def cascade(*rules: tuple[Column, object], other: object) -> Column:
    """First value whose condition holds."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(other)


def entry_edge_bps(side: Column, price: Column, later: Column) -> Column:
    """Null without a later price: ``greatest`` alone would take 1 for it."""
    p = F.greatest(F.abs(price), F.lit(1.0))
    return F.when(later.isNull(), None).when(side == "buy", (later / p - 1.0) * 1e4).when(side == "sell", (p / F.greatest(F.abs(later), F.lit(1.0)) - 1.0) * 1e4)


STYLES = ("scalp", "momentum", "mean_reversion", "swing")


def style_fits(m: dict[str, Column]) -> dict[str, Column]:
    """Fit of each trading style from a trader's metrics."""
    edge, gain = m["entry_timing_edge_bps"], m["expectancy_bps"]
    momentum = weighted((sigmoid(edge, 10.0, 0.15), 0.40), (sigmoid(gain, 5.0, 0.2), 0.30), (sigmoid(m["favorable_entry_rate_pct"], 55.0, 0.12), 0.20), (bell(m["avg_holding_hours"], 12.0, 20.0), 0.10))
    reversion = weighted((sigmoid(-edge, 5.0, 0.15), 0.40), (sigmoid(gain, 3.0, 0.25), 0.25), (sigmoid(m["profit_factor"] - 1.0, 0.5, 1.5), 0.20), (sigmoid(m["recovery_factor"], 1.0, 0.8), 0.15))
    fits = {
        "scalp": weighted((1.0 - sigmoid(m["avg_holding_hours"], 4.0, 0.5), 0.45), (sigmoid(m["fills_30d"], 50.0, 0.04), 0.30), (bell(m["avg_leverage"], 5.0, 3.0), 0.15), (1.0 - sigmoid(m["sizing_cv"], 0.8, 3.0), 0.10)),
        "momentum": F.when((edge <= 0) | (gain <= 0), 0.0).otherwise(momentum),
        "mean_reversion": F.when((edge >= 0) | (gain <= 0), 0.0).otherwise(reversion),
        "swing": weighted((sigmoid(m["avg_holding_hours"], 24.0, 0.06), 0.45), (1.0 - sigmoid(m["fills_30d"], 20.0, 0.08), 0.25), (1.0 - sigmoid(m["max_drawdown_pct"], 15.0, 0.1), 0.20), (1.0 - sigmoid(m["leverage_volatility"], 3.0, 0.4), 0.10)),
    }
    return {k: clamp(v, 0, 1) for k, v in fits.items()}


def best_styles(fits: dict[str, Column]) -> Column:
    """Styles by fit, the best first, ties in the order given."""
    return F.sort_array(F.array(*(F.struct(f.alias("fit"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, (k, f) in enumerate(fits.items()))), asc=False)


def classify_style(m: dict[str, Column]) -> Column:
    """Best style, or unknown if weak or, other than swing, hardly ahead."""
    ranked = best_styles(style_fits(m))
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    weak = (best["fit"] < 0.35) | ((best["name"] != "swing") & (best["fit"] - second["fit"] < 0.05))
    return F.when(weak, "unknown").otherwise(best["name"])


def rank_tier(tier: Column, whale: Column, promoted: Column, behavior: Column, discovery: Column) -> Column:
    return cascade(
        (tier.isNotNull() & (tier != ""), tier),
        (whale, "whale"),
        (promoted & (behavior >= 80) & (discovery >= 70), "elite"),
        (promoted & (discovery >= 60), "active_tracked"),
        (discovery >= 72, "high_quality"),
        (discovery >= 45, "watchlist"),
        other="monitored",
    )


def age_minutes(us: Column, now: int) -> Column:
    whole = F.greatest(F.floor((F.lit(now) - us) / 60_000_000).cast("double"), F.lit(0.0))
    return F.when(us.isNull(), 10_000.0).otherwise(whole)


def market_regime(funding: Column, interest: Column, mom15: Column, vol: Column) -> Column:
    return cascade(((interest > 0) & (F.abs(funding) < 0.001) & (F.abs(mom15) > 12), "trend_expansion"), (F.abs(funding) >= 0.0015, "crowded"), (vol > 90, "volatile"), other="balanced")


def momentum_score(direction: Column, mom5: Column, mom15: Column) -> Column:
    mean = F.when(direction == "long", (mom5 + mom15) / 2).when(direction == "short", (-mom5 - mom15) / 2).otherwise(0.0)
    return (clamp(mean / 25.0, -1, 1) + 1.0) * 50.0


def vol_regime(vol: Column) -> Column:
    return cascade((vol >= 150, "extreme"), (vol >= 90, "high"), (vol <= 20, "low"), other="normal")


def vol_score(vol: Column) -> Column:
    return cascade((vol >= 150, 20.0), (vol >= 90, 45.0), (vol <= 20, 70.0), other=85.0)


def signal_confidence(traders: Column, least: int, score: Column, momentum: Column, vol: Column) -> Column:
    agree = F.least(traders / float(max(least, 1)), F.lit(2.0)) / 2.0 * 100.0
    return clamp(agree * 0.25 + clamp(score / 100.0, 0, 1) * 100.0 * 0.40 + momentum * 0.20 + vol_score(vol) * 0.15, 0, 100)


def directional_return_bps(direction: Column, entry: Column, price: Column) -> Column:
    safe = F.when(price != 0, price)
    return F.when(entry <= 0, 0.0).when(direction == "long", (price / F.when(entry > 0, entry) - 1.0) * 1e4).when(direction == "short", (entry / safe - 1.0) * 1e4).otherwise(0.0)


def favorable_bps(direction: Column, entry: Column, hi: Column, lo: Column) -> Column:
    best = F.when(direction == "long", hi).otherwise(lo)
    return F.greatest(directional_return_bps(direction, entry, best), F.lit(0.0))


def adverse_bps(direction: Column, entry: Column, hi: Column, lo: Column) -> Column:
    worst = F.when(direction == "long", lo).otherwise(hi)
    return F.least(directional_return_bps(direction, entry, worst), F.lit(0.0))


def outcome_label(bps: Column) -> Column:
    return cascade((bps >= 35, "strong_win"), (bps > 0, "win"), (bps <= -35, "loss"), other="flat")


def risk_fraction(conf: Column, base: Column, most: Column, scale: Column) -> Column:
    return F.least(F.greatest(base + clamp(conf / 100.0, 0, 1) * scale, base), most)


def effective_slippage(base_bps: float, risk: Column, conf: Column, vol: Column, mom5: Column, mom15: Column, regime: Column) -> Column:
    shock = 1.0 + clamp(vol / 80.0, 0, 2)
    drift = 1.0 + clamp((F.abs(mom5) + F.abs(mom15)) / 100.0, 0, 1) * 0.15
    size = 1.0 + clamp(risk / 0.02, 0, 2) * 0.25
    trust = 1.0 + conf / 100.0 * 0.2
    return F.lit(base_bps) * shock * drift * size * trust * cascade((regime == "high", 1.2), (regime == "extreme", 1.5), other=1.0)


def apply_slippage(direction: Column, price: Column, bps: Column, entry: bool) -> Column:
    """Worse in either direction: buys pay more, sells get less."""
    sign = 1.0 if entry else -1.0
    return F.when(direction == "long", price * (1.0 + sign * bps / 1e4)).when(direction == "short", price * (1.0 - sign * bps / 1e4)).otherwise(price)


def timing_from_hold(hours: Column) -> Column:
    h = F.greatest(hours, F.lit(0.0))
    return cascade((h < 1, 25.0 * h), (h < 4, 25.0 + 20.0 * (h - 1.0) / 3.0), (h <= 48, 92.0), (h <= 168, F.greatest(F.lit(25.0), 92.0 * (1.0 - (h - 48.0) / 120.0))), other=F.greatest(F.lit(8.0), 25.0 * F.exp(-(h - 168.0) / 240.0)))


def stability(days: Column, rolls: Column, deviation: Column, prior: Column) -> Column:
    """Steadiness of a wallet's rolling win rates: its exit days (null without trips),
    how many days have a rate, the rates' deviation, and the rate of a lone one."""
    steady = clamp(100.0 * (1.0 - deviation), 0, 100)
    few = F.greatest(F.lit(20.0), 100.0 * (1.0 - F.coalesce(prior, F.lit(0.45))))
    return cascade((days.isNull(), 25.0), (days < 4, 35.0), (rolls < 2, few), other=steady)


def linear_score(x: Column, good: float, bad: float) -> Column:
    """100 at ``good``, 0 at ``bad``, in either order."""
    return clamp((x - bad) / (good - bad), 0, 1) * 100.0


def completeness(fills: Column, snaps: Column, scored: Column) -> Column:
    behavior = F.when(scored, 10.0).otherwise(F.least(fills / 50.0, F.lit(1.0)) * 10.0)
    return F.least(F.lit(100.0), F.least(fills / 100.0, F.lit(1.0)) * 35.0 + F.least(snaps / 30.0, F.lit(1.0)) * 40.0 + F.when(scored, 15.0).otherwise(0.0) + behavior)


def average_confidence(fills: Column, snaps: Column, timing: Column) -> Column:
    parts = [(fills, 50), (snaps, 30), (snaps, 20), (fills, 20), (timing, 25)]
    return reduce(lambda a, b: a + b, [F.least(F.lit(1.0), F.sqrt(n / float(t))) for n, t in parts]) / 5.0


def behavior_tier(score: Column, conf: Column, comp: Column) -> Column:
    return cascade((score.isNull(), "watchlist"), ((score >= 75) & (conf >= 0.70) & (comp >= 85), "high_quality"), ((score >= 40) & (conf >= 0.50), "active_tracked"), other="watchlist")


def hf_label(n: Column, span_days: Column, cap: int = 10_000) -> Column:
    return cascade((n == 0, "NEW_WALLET"), ((n >= cap) & (span_days < 30), "ULTRA_HF_BOT"), ((n >= cap) & (span_days < 90), "HIGH_FREQUENCY"), ((n >= cap) | (span_days >= 90), "NORMAL"), other="NEW_WALLET")


def spread_bps(bid: Column, ask: Column) -> Column:
    mid = (bid + ask) / 2.0
    return F.when(mid > 0, (ask - bid) / mid * 1e4)


def z_spread(x: Column, mu: Column, sigma: Column, n: Column) -> Column:
    return F.when(n >= 5, (x - mu) / F.greatest(sigma, F.lit(1e-6)))


def channel_status(lag: Column, warn: float = 300.0, critical: float = 900.0) -> Column:
    return cascade((lag.isNull(), "missing"), (lag > critical, "critical"), (lag > warn, "warn"), other="ok")


def signed_delta(fill_dir: Column, side: Column, size: Column, price: Column) -> Column:
    """Signed quantity of a fill from its direction label, else its side."""
    d = F.lower(F.trim(fill_dir))
    plus = (d.startswith("open") & d.contains("long")) | (d.startswith("close") & d.contains("short")) | (~(d.startswith("open") | d.startswith("close")) & (side == "buy"))
    return F.when((price > 0) & (size > 0), F.when(plus, size).otherwise(-size))


def leg_size(notional: Column, scale: float, equity: Column, pct: float, most: float, dust: float) -> tuple[Column, Column]:
    """Size in dollars and the reason for it."""
    wanted, cap = notional * scale, F.least(equity * pct, F.lit(most))
    size = F.least(wanted, cap)
    return F.when(size < dust, 0.0).otherwise(size), cascade((size < dust, "DUST"), (wanted > cap, "RISK_CAP"), other="OK")


def kelly_size(win: Column, payoff: Column, equity: Column, copy: Column, stop: Column, last: Column, *, fraction: float = 0.25, risk: float = 0.01, cap: float = 0.15, growth: float = 1.05, dust: float = 1.0) -> Column:
    """struct(usd, bound, skip): one round trip's notional from slow ``equity``.

    A fraction of Kelly, weighted by copyability (0.2 at least) and by 0.6 below
    even wins, is bound by the stop's risk and by a cap on the position; it
    grows by ``growth`` over the ``last`` one at most. ``skip`` tells why a trip
    isn't taken, null where it is."""
    kelly = F.when(payoff > 0, (win * payoff - (1.0 - win)) / F.when(payoff > 0, payoff))
    stake = equity * kelly * fraction * F.greatest(copy, F.lit(0.2)) * F.when(win >= 0.5, 1.0).otherwise(0.6)
    by_stop = F.when(stop > 0, equity * risk / F.when(stop > 0, stop)).otherwise(stake)
    limit = lambda value, place, name: F.struct(value.alias("v"), F.lit(place).alias("o"), F.lit(name).alias("name"))
    least = F.array_min(F.array(limit(by_stop, 0, "stop"), limit(stake, 1, "kelly"), limit(equity * cap, 2, "max_cap")))
    held = F.when(last > 0, F.least(least["v"], last * growth)).otherwise(least["v"])
    bound = cascade((held < dust, "dust"), (held < least["v"] - 1e-9, "ratchet"), other=least["name"])
    none = ~F.coalesce(kelly > 0, F.lit(False))
    skip = F.when(none, "NEGATIVE_EXPECTANCY").when(held < dust, "DUST")
    return F.struct(F.when(none, 0.0).otherwise(held).alias("usd"), F.when(none, "dust").otherwise(bound).alias("bound"), skip.alias("skip"))


def edge_filter(win: Column, gain: Column, loss: Column, *, cost_bps: float = 10.0, times: float = 2.0, least: float = 0.45) -> Column:
    """Whether the expected edge of a trip covers ``times`` its round-trip cost."""
    edge = win * gain - (1.0 - win) * loss
    return cascade((win < least, "WIN_RATE_TOO_LOW"), (edge < cost_bps / 1e4 * times, "INSUFFICIENT_EDGE"), other="OK")


def copyability_gate(copy: Column, trips: Column, *, least: float = 0.30, least_trips: int = 20) -> Column:
    """Whether enough of a wallet's trips can be copied to stand for it."""
    return cascade((trips < least_trips, "INSUFFICIENT_TRIPS"), (copy < least, "LOW_COPYABILITY"), other="OK")


def variance_drain_pct(position_pct: Column, trades: Column) -> Column:
    """Half the squared position share, in percent, for every trade."""
    share = position_pct / 100.0
    return F.when(trades > 0, share * share / 2.0 * trades * 100.0).otherwise(0.0)


def verdict(edge: Column, gate: Column, dynamic_pct: Column, exchange_pct: Column, trips: Column) -> Column:
    """A copied wallet's verdict from its gates and its returns: copied ones may
    be 20 times the exchange's at most to count as credible."""
    flat = F.abs(exchange_pct) < 1e-9
    ratio = F.when(flat, F.when(F.abs(dynamic_pct) > 1e-9, float("inf")).otherwise(1.0)).otherwise(F.abs(dynamic_pct / F.when(~flat, exchange_pct)))
    return cascade((trips == 0, "NO_DATA"), (edge != "OK", "FILTERED_EDGE"), (gate != "OK", "FILTERED_COPYABILITY"), ((dynamic_pct > 0) & (ratio <= 20.0), "LIVE_CANDIDATE"), (dynamic_pct >= -2.0, "MONITOR"), other="REVIEW")


def whale_tier(volume: Column) -> Column:
    return cascade((volume >= 1e9, "mega"), (volume >= 1e8, "whale"), (volume >= 1e7, "large"), other="active")


def should_promote(volume: Column, hit: Column, roi: Column, *, least_volume: float, least_hit: float, elite: bool) -> Column:
    """Promotion by hit rate, or without one by volume and return; an elite
    wallet without a hit rate has to be a whale of 10 % return."""
    by_hit = F.coalesce(hit >= least_hit, F.lit(False))
    by_size = (volume >= 1e8) & (roi >= 0.10) if elite else ((volume >= 5e7) & (roi >= 0.08)) | (volume >= 1e8)
    return (volume >= least_volume) & (roi > 0) & (by_hit | by_size)


def is_spot(coin: Column) -> Column:
    """Spot pairs are named by number: ``@142``."""
    return F.coalesce(F.trim(coin).rlike("^@[0-9]+$"), F.lit(False))


def order_kind(status: Column, side: Column, reduce_only: Column, coin: Column) -> Column:
    """Chart class of a limit order; side A sells, B buys."""
    st = F.lower(F.coalesce(status, F.lit("")))
    canceled, sells, buys = st.contains("cancel"), side == "A", side == "B"
    spot = cascade((canceled | st.contains("reject"), "spot_limit_canceled"), (reduce_only, "spot_limit_close"), (buys, "spot_limit_buy"), (sells, "spot_limit_sell"), other="other")
    shorts = (~reduce_only & sells) | (reduce_only & buys)
    perp = cascade((canceled & shorts, "canceled_short"), (canceled, "canceled"), (reduce_only & sells, "long_close"), (reduce_only & buys, "short_close"), (buys, "long_open"), (sells, "short_open"), other="other")
    return F.when(is_spot(coin), spot).otherwise(perp)


def order_ambiguous(coin: Column, reduce_only: Column) -> Column:
    """A perpetual's order that isn't reduce-only may open either way."""
    return ~is_spot(coin) & ~reduce_only
