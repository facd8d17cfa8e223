"""Exponentially weighted means as window sums.

y[t] = r[t] y[t-1] + (1 - r[t]) x[t] with r = 1 - a for an observation right behind the last one and
r = w / (w + a), w = (1 - a) ** (g + 1), behind g nulls. With L[t] the sum of ln r up to t,
y[t] = exp(L[t]) * sum(c[i] * exp(-L[i])), c being x for the first observation and (1 - r) x for later ones.
All series of a table share one shuffle. exp(-L) stays finite for some 3000 rows at a span of 9 and more at longer ones, so the sums
run over segments of at most SEGMENT rows, and each segment takes on the value at the end of the one before. Ends of segments are gathered within groups of FAN segments, and
ends of groups over the series, so a row holds few of them however long a series is: ten years of minutes are 80 groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("symbol", "timeframe")
#: Rows of a segment at most.
SEGMENT = 2000
#: Segments of a group.
FAN = 32
#: No observation keeps less than exp(FAINT) of the mean before it, far below a double's precision; else a long gap would overflow.
FAINT = -100.0


def running(key=KEY, order: str = "t"):
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def with_ew(df: DataFrame, means: dict[str, tuple[str, float, int]], key=KEY, order: str = "t") -> DataFrame:
    """df with a column per entry: name -> (input column, a, least number of observations). ``order`` numbers the rows of a series from 1."""
    now = running(key, order)
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inputs = sorted({m[0] for m in means.values()})
    df = df.withColumns({f"_n_{x}": F.count(x).over(now) for x in inputs} | {f"_p_{x}": F.last(F.when(F.col(x).isNotNull(), F.col(order)), True).over(before) for x in inputs})
    size = max(1, min(SEGMENT, int(500 / max(-math.log(1 - a) for _, a, _ in means.values()))))
    within = Window.partitionBy(*key, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda x, a: F.pow(F.lit(1 - a), F.col(order) - F.col(f"_p_{x}"))
    share = {name: kept(x, a) / (kept(x, a) + a) for name, (x, a, _) in means.items()}
    later = {name: F.col(x).isNotNull() & F.col(f"_p_{x}").isNotNull() for name, (x, _, _) in means.items()}
    log = {name: F.when(later[name], F.when(F.col(order) - F.col(f"_p_{x}") == 1, F.lit(math.log(1 - a))).otherwise(F.greatest(F.lit(FAINT), (F.col(order) - F.col(f"_p_{x}")) * math.log(1 - a) - F.log(kept(x, a) + a)))).otherwise(0.0) for name, (x, a, _) in means.items()}
    part = {name: F.when(later[name], (1 - share[name]) * F.col(x)).otherwise(F.col(x)) for name, (x, _, _) in means.items()}
    df = df.withColumns({"_s": F.floor((F.col(order) - 1) / size), "_u": F.floor((F.col(order) - 1) / (size * FAN))})
    df = df.withColumns({f"_l_{n}": F.sum(log[n]).over(within) for n in means} | {f"_c_{n}": part[n] for n in means})
    df = df.withColumns({f"_y_{n}": F.coalesce(F.exp(F.col(f"_l_{n}")) * F.sum(F.col(f"_c_{n}") * F.exp(-F.col(f"_l_{n}"))).over(within), F.lit(0.0)) for n in means})
    grouped = Window.partitionBy(*key, "_u").orderBy(order)
    last, first = F.col(order) % size == 0, F.col(order) % size == F.lit(1 % size)
    df = df.withColumn("_e", F.collect_list(F.when(last, F.struct(*(f"_{k}_{n}" for n in means for k in "ly")))).over(grouped.rowsBetween(Window.unboundedPreceding, -1)))
    carried = {n: F.when(first, F.aggregate("_e", _nothing(), _onwards(n))) for n in means}
    df = df.withColumns({f"_b_{n}": F.first(carried[n], True).over(within) for n in means}).drop("_e")
    df = df.withColumns({f"_l_{n}": F.col(f"_l_{n}") + F.col(f"_b_{n}.l") for n in means} | {f"_y_{n}": F.col(f"_y_{n}") + F.exp(F.col(f"_l_{n}")) * F.col(f"_b_{n}.y") for n in means})
    last, first = F.col(order) % (size * FAN) == 0, F.col(order) % (size * FAN) == 1
    df = df.withColumn("_e", F.collect_list(F.when(last, F.struct(*(f"_{k}_{n}" for n in means for k in "ly")))).over(before))
    carried = {n: F.when(first, F.aggregate("_e", _nothing(), _onwards(n))) for n in means}
    df = df.withColumns({f"_b_{n}": F.first(carried[n], True).over(grouped.rowsBetween(Window.unboundedPreceding, 0)) for n in means}).drop("_e")
    df = df.withColumns({n: F.when(F.col(f"_n_{x}") >= least, F.col(f"_y_{n}") + F.exp(F.col(f"_l_{n}")) * F.col(f"_b_{n}.y")) for n, (x, _, least) in means.items()})
    return df.drop("_s", "_u", *[c for c in df.columns if c[:3] in ("_n_", "_p_", "_l_", "_c_", "_y_", "_b_")])


def _nothing():
    return F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("y"))


def _onwards(name: str):
    """The log weight and value at the end of a stretch, from those before it."""
    return lambda x, e: F.struct((x["l"] + e[f"_l_{name}"]).alias("l"), (e[f"_y_{name}"] + F.exp(e[f"_l_{name}"]) * x["y"]).alias("y"))


def span(n: int) -> float:
    return 2 / (n + 1)
