"""Non-linear least squares on the few points of each group, inside expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 200
TOLERANCE = 1e-10
LARGEST_DAMPING = 1e15


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sums(points: Column, a: Column, k: Column) -> Column:
    """Second moments of the derivatives of a exp(-k x), their products with the residuals, and the squared residuals."""
    names = ("haa", "hak", "hkk", "ga", "gk", "sse")

    def add(s, p):
        def with_e(e):
            r, dk = p["y"] - a * e, -a * p["x"] * e
            return F.struct(*[(s[n] + v).alias(n) for n, v in zip(names, (e * e, e * dk, dk * dk, e * r, dk * r, r * r))])

        return _let(F.exp(-k * p["x"]), with_e)

    return F.aggregate(points, F.struct(*[F.lit(0.0).alias(n) for n in names]), add)


def exponential_fit(points: Column, a: Column, k: Column) -> Column:
    """Struct (a, k, sse, steps) of the least squares a exp(-k x) for ``points`` array<struct<x, y>>, from a start.

    Damped Gauss-Newton: the diagonal of the normal equations grows tenfold after a step that would raise the squared
    residuals and shrinks tenfold after one that lowers them. It stops when a step changes both parameters by less than
    TOLERANCE of them. Null without that after STEPS steps, with a singular system throughout, or with a null start.
    """
    def state(a_, k_, mu, s, steps, done, found):
        return F.struct(a_.alias("a"), k_.alias("k"), mu.alias("mu"), s.alias("s"), steps.alias("steps"),
                        done.alias("done"), found.alias("found"))

    def step(st, _):
        s, up = st["s"], 1 + st["mu"]
        det = s["haa"] * s["hkk"] * up * up - s["hak"] * s["hak"]

        def moved(d):
            small = (F.abs(d["a"]) <= TOLERANCE * (F.abs(st["a"]) + TOLERANCE)) & (
                F.abs(d["k"]) <= TOLERANCE * (F.abs(st["k"]) + TOLERANCE))
            small = F.coalesce(small, F.lit(False))

            def judged(t):
                better = F.coalesce((t["sse"] <= s["sse"]) & ~F.isnan(t["sse"]), F.lit(False))
                mu = F.when(better, F.greatest(st["mu"] / 10, F.lit(1e-12))).otherwise(st["mu"] * 10)
                return state(
                    F.when(better, st["a"] + d["a"]).otherwise(st["a"]), F.when(better, st["k"] + d["k"]).otherwise(st["k"]),
                    mu, F.when(better, t).otherwise(s), st["steps"] + 1, small | (mu > LARGEST_DAMPING), small)

            return _let(_sums(points, st["a"] + d["a"], st["k"] + d["k"]), judged)

        da = F.try_divide(s["ga"] * s["hkk"] * up - s["gk"] * s["hak"], det)
        dk = F.try_divide(s["gk"] * s["haa"] * up - s["ga"] * s["hak"], det)
        return F.when(st["done"], st).otherwise(_let(F.struct(da.alias("a"), dk.alias("k")), moved))

    a, k = a.cast("double"), k.cast("double")
    start = state(a, k, F.lit(1e-3), _sums(points, a, k), F.lit(0), F.lit(False), F.lit(False))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return _let(end, lambda e: F.when(e["found"], F.struct(
        e["a"].alias("a"), e["k"].alias("k"), e["s"]["sse"].alias("sse"), e["steps"].alias("steps"))))


def exponential_fits(points: DataFrame, keys: list[str], start: DataFrame) -> DataFrame:
    """keys, a, k, sse, steps, n_points, r2 of each group of ``points`` (keys, x, y); nulls where the fit diverges.

    ``start``: keys, a0, k0. A group is a histogram or a few horizons: its points are collected into one row.
    """
    own = points.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_p"),
        F.count(F.lit(1)).alias("n_points"), (F.var_pop("y") * F.count("y")).alias("_tot"))
    d = own.join(start, keys).withColumn("_f", exponential_fit(F.col("_p"), F.col("a0"), F.col("k0")))
    return d.select(*keys, "_f.a", "_f.k", "_f.sse", "_f.steps", "n_points",
                    (1 - F.try_divide(F.col("_f.sse"), F.when(F.col("_tot") > 0, F.col("_tot")))).alias("r2"))


def sql(points: str, start: str, keys: str) -> str:
    """The same loop as DuckDB SQL: common table expressions up to ``fitted`` (keys, a, k, sse, n_points)."""
    def total(term: str, a: str, k: str) -> str:
        return f"list_sum(list_transform(pts, lambda p: {term.format(a=a, k=k, e=f'exp(-({k}) * p.x)')}))"

    terms = {"haa": "{e} * {e}", "hak": "-({a}) * p.x * {e} * {e}", "hkk": "({a}) * ({a}) * p.x * p.x * {e} * {e}",
             "ga": "{e} * (p.y - ({a}) * {e})", "gk": "-({a}) * p.x * {e} * (p.y - ({a}) * {e})",
             "sse": "(p.y - ({a}) * {e}) * (p.y - ({a}) * {e})"}
    now = ", ".join(f"{total(t, 'a', 'k')} AS {n}" for n, t in terms.items())
    small = f"(abs(da) <= {TOLERANCE!r} * (abs(a) + {TOLERANCE!r}) AND abs(dk) <= {TOLERANCE!r} * (abs(k) + {TOLERANCE!r}))"
    return f"""
pts AS (SELECT {keys}, list({{'x': x::DOUBLE, 'y': y::DOUBLE}} ORDER BY x, y) AS pts FROM {points} GROUP BY {keys}),
it AS (
  SELECT {keys}, pts, a0::DOUBLE AS a, k0::DOUBLE AS k, 1e-3::DOUBLE AS mu, 0 AS steps, FALSE AS done, FALSE AS found FROM pts JOIN {start} USING ({keys})
  UNION ALL
  SELECT {keys}, pts, CASE WHEN better THEN a + da ELSE a END, CASE WHEN better THEN k + dk ELSE k END, mu2, steps + 1, small OR mu2 > {LARGEST_DAMPING!r}, small
  FROM (SELECT *, CASE WHEN better THEN greatest(mu / 10, 1e-12) ELSE mu * 10 END AS mu2 FROM (
    SELECT *, coalesce({total(terms['sse'], 'a + da', 'k + dk')} <= sse, FALSE) AS better, coalesce({small}, FALSE) AS small FROM (
      SELECT *, (ga * hkk * (1 + mu) - gk * hak) / det AS da, (gk * haa * (1 + mu) - ga * hak) / det AS dk FROM (
        SELECT *, nullif(haa * hkk * (1 + mu) * (1 + mu) - hak * hak, 0) AS det FROM (
          SELECT *, {now} FROM it WHERE NOT done AND steps < {STEPS}))))) q),
fitted AS (SELECT {keys}, a, k, {total(terms['sse'], 'a', 'k')} AS sse, len(pts) AS n_points FROM it WHERE found)"""
