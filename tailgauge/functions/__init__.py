from .parsing import coerce_numeric, eligible_session, parse_flag, parse_instant, parse_trading_date
from .risk import (
    ALPHA,
    binomial_loglik,
    chi_square_tail,
    erfc,
    finite,
    is_violation,
    known,
    normal_quantile,
    pinball,
    var_from_quantile,
    x_log_p,
)
from .windows import before, ending_here, full_window_quantile, ordered_by, so_far, when_full

__all__ = [
    "ALPHA", "before", "binomial_loglik", "chi_square_tail", "coerce_numeric", "eligible_session", "ending_here",
    "erfc", "finite", "full_window_quantile", "is_violation", "known", "normal_quantile", "ordered_by", "parse_flag", "parse_instant",
    "parse_trading_date", "pinball", "so_far", "var_from_quantile", "when_full", "x_log_p",
]
