"""Camera transfer curves and log shapers as column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lattice import clamp

# The published constants of four camera encodings.
LOGC3 = {"cut": 0.010591, "a": 5.555556, "b": 0.052272, "c": 0.247190, "d": 0.385537, "e": 5.367655, "f": 0.092809}
LOGC4 = {"a": 2231.82630906905, "b": 64.0, "c": 0.0740718950408889, "s": 7.0, "t": 1.0}
SLOG3 = {"cut": 0.01125, "knee": 171.2102946929, "black": 95.0, "grey": 420.0, "scale": 261.5, "white": 1023.0, "gain": 0.19, "lift": 0.01}
VLOG = {"cut": 0.01, "cut_log": 0.181, "b": 0.00873, "c": 0.241514, "d": 0.598206, "slope": 5.6, "offset": 0.125}
TINY = 1e-10  # logarithms take nothing smaller


def _floor(c: Column) -> Column:
    return F.greatest(c, F.lit(TINY))


def logc3_to_linear(x: Column) -> Column:
    k = LOGC3
    return F.when(x > k["e"] * k["cut"] + k["f"], (F.pow(F.lit(10.0), (x - k["d"]) / k["c"]) - k["b"]) / k["a"]).otherwise((x - k["f"]) / k["e"])


def linear_to_logc3(x: Column) -> Column:
    k = LOGC3
    return F.when(x > k["cut"], k["c"] * F.log10(_floor(k["a"] * x + k["b"])) + k["d"]).otherwise(k["e"] * x + k["f"])


def logc4_to_linear(x: Column) -> Column:
    k = LOGC4
    return F.when(x >= 0.0, (F.pow(F.lit(2.0), (x - k["t"]) * k["s"]) - k["b"]) / k["a"]).otherwise(x * k["c"])


def linear_to_logc4(x: Column) -> Column:
    k = LOGC4
    return F.when(x >= (1.0 - k["b"]) / k["a"], F.log2(_floor(k["a"] * x + k["b"])) / k["s"] + k["t"]).otherwise(x / k["c"])


def slog3_to_linear(x: Column) -> Column:
    k = SLOG3
    code = x * k["white"]
    bright = F.pow(F.lit(10.0), (code - k["grey"]) / k["scale"]) * k["gain"] - k["lift"]
    return F.when(x >= k["knee"] / k["white"], bright).otherwise((code - k["black"]) * k["cut"] / (k["knee"] - k["black"]))


def linear_to_slog3(x: Column) -> Column:
    k = SLOG3
    bright = k["grey"] + F.log10(_floor((x + k["lift"]) / k["gain"])) * k["scale"]
    return F.when(x >= k["cut"], bright).otherwise(x * (k["knee"] - k["black"]) / k["cut"] + k["black"]) / k["white"]


def vlog_to_linear(x: Column) -> Column:
    k = VLOG
    return F.when(x < k["cut_log"], (x - k["offset"]) / k["slope"]).otherwise(F.pow(F.lit(10.0), (x - k["d"]) / k["c"]) - k["b"])


def linear_to_vlog(x: Column) -> Column:
    k = VLOG
    return F.when(x < k["cut"], k["slope"] * x + k["offset"]).otherwise(k["c"] * F.log10(_floor(x + k["b"])) + k["d"])


Curve = Callable[[Column], Column]
#: Encoding: (to linear, from linear). "linear" and "unknown" have none.
CURVES: dict[str, tuple[Curve, Curve]] = {"log_c3": (logc3_to_linear, linear_to_logc3), "log_c4": (logc4_to_linear, linear_to_logc4), "slog3": (slog3_to_linear, linear_to_slog3), "vlog": (vlog_to_linear, linear_to_vlog)}


def curves(name: str) -> tuple[Curve | None, Curve | None]:
    return CURVES.get(name, (None, None))


def log_shaper(x: Column, grey: float = 0.18, stops: float = 10.0) -> Column:
    """Stops around middle grey, from -stops to stops, onto 0 to 1."""
    return clamp((F.log2(_floor(x) / grey) + stops) / (2.0 * stops))


def log_shaper_inverse(y: Column, grey: float = 0.18, stops: float = 10.0) -> Column:
    return grey * F.pow(F.lit(2.0), y * (2.0 * stops) - stops)


def shaper(transfer: str, include: bool | None = None) -> tuple[Curve, Curve, str]:
    """(forward, inverse, mode) for a transfer function: linear input is log-shaped, all else passes as it is.

    `include` False switches shaping off; True names the mode "forced" but shapes the same inputs.
    """
    if include is False:
        return (lambda c: c), (lambda c: c), "disabled"
    mode = "forced" if include else "auto"
    return (log_shaper, log_shaper_inverse, mode) if transfer == "linear" else ((lambda c: c), (lambda c: c), mode)
