"""Fisher's exact test on one row, by log-gamma."""

from __future__ import annotations

from math import exp, inf, isnan, lgamma, nan


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of [[a, b], [c, d]]: p sums the tables no likelier than this one."""
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    if 0 in (r1, r2, c1, n - c1):
        return nan, 1.0
    odds = a * d / (b * c) if b * c else inf
    choose = lambda m, k: lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)
    logp = lambda x: choose(r1, x) + choose(r2, c1 - x) - choose(n, c1)
    here = logp(a)
    p = sum(exp(l) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (l := logp(x)) <= here + 1e-7)
    return odds, min(1.0, p)


def matched_summary(matched: int, b_uns: int, b_grd: int, v_uns: int, v_grd: int) -> dict:
    """The matched A/B report from its 2x2 cells."""
    b_dec, v_dec = b_uns + b_grd, v_uns + v_grd
    odds, p = fisher_exact(b_uns, b_grd, v_uns, v_grd)
    rate = lambda x, n: x / n if n else 0.0
    b, v = rate(b_uns, b_dec), rate(v_uns, v_dec)
    return {
        "matched_trials": matched,
        "baseline_unsupported_rate": round(b, 4),
        "verified_unsupported_rate": round(v, 4),
        "relative_change": round((v - b) / b, 4) if b_dec and v_dec and b_uns else 0.0,
        "odds_ratio": odds if isnan(odds) or odds == inf else round(odds, 4),
        "fisher_p": round(p, 4),
        "significant_05": p < 0.05,
    }
