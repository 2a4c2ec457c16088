"""Queries on whole feature families (FEA, DET09 on wide columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import families as A
from tessera.operators import ranking as R
from tessera.operators import tables as T
from tessera.plans.bindings import PTS, pts
from tessera.plans.registry import query
from tessera.plans.spatial import D2

COLS = ["v", "px", "k"]
P3 = f"{PTS.replace('* 30 AS v', '* 30 AS v, (vec_id % 20)::DOUBLE AS k')}"


def points(spark, d):
    return pts(spark, d).withColumn("k", (F.col("i") % 20).cast("double"))


def _wide_sql():
    inside = lambda r, x: f"avg({x}) FILTER (WHERE {D2} <= {r * r})"
    out = []
    for c in COLS:
        out.append(f"round(any_value(a.{c}), 6) AS {c}")
        out += [f"round({inside(r, f'b.{c}')}, 6) AS {c}_mean{r}" for r in A.MEANS]
        out += [f"round(sqrt(greatest({inside(r, f'b.{c} * b.{c}')} - ({inside(r, f'b.{c}')}) ** 2, 0)), 4) AS {c}_sd{r}" for r in A.SPREADS]
        out += [f"round(any_value(a.{c}) - {inside(r, f'b.{c}')}, 6) + 0 AS {c}_diff{r}" for r in A.SPREADS]
        out += [f"round({inside(r, f'CAST(b.{c} < a.{c} AS DOUBLE)')}, 6) AS {c}_below{r}" for r in A.SPREADS]
    return f"WITH {P3} SELECT a.unit, a.i, {', '.join(out)} FROM pts a JOIN pts b ON a.unit = b.unit AND {D2} <= 676 GROUP BY a.unit, a.i"


@query("FEA03_wide_columns", _wide_sql())
def fea03_wide(spark, d):
    w = A.wide_statistics(points(spark, d), COLS)
    return w.select("unit", "i", *[(F.round(c, 4 if "_sd" in c else 6) + (0.0 if "_diff" in c else 0)).alias(c) for c in w.columns[2:]])


SEAM = f"""WITH {P3}, e AS (SELECT a.unit, a.i AS src, b.i AS dst, {', '.join(f'b.{c} AS t_{c}' for c in COLS)} FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i AND {D2} <= 64),
    o AS (SELECT unit, src AS i, {', '.join(f'sum(t_{c}) AS s_{c}' for c in COLS)} FROM e GROUP BY ALL), w AS (SELECT a.unit, a.src AS i, {', '.join(f'sum(CASE WHEN b.dst <> a.src THEN b.t_{c} END) AS w_{c}' for c in COLS)} FROM e a JOIN e b ON a.unit = b.unit AND a.dst = b.src GROUP BY ALL)
    SELECT p.unit, p.i, {', '.join(f'round(p.{c}, 6) AS {c}, round(coalesce(s_{c}, 0), 5) + 0 AS {c}_contact, round(coalesce(w_{c}, 0), 4) + 0 AS {c}_walk2' for c in COLS)} FROM pts p LEFT JOIN o USING (unit, i) LEFT JOIN w USING (unit, i)"""


@query("FEA20_seam_columns", SEAM)
def fea20_seam(spark, d):
    s = A.seam_columns(points(spark, d), COLS)
    places = {"contact": 5, "walk2": 4}
    return s.select("unit", "i", *[(F.round(c, places.get(c.rpartition("_")[2], 6)) + (0.0 if "_" in c else 0)).alias(c) for c in s.columns[2:]])


@query("DET09_wide_field")
def det09_wide(spark, d):
    """The table field on all columns of the wide family: digits per unit, seeded pair tables, counts, score, call and AUC."""
    w = A.wide_statistics(points(spark, d), COLS)
    names = w.columns[2:]
    dig = A.digits_of(w, names).withColumn("y", (F.col("i") % 7 == 0).cast("int"))
    tables = [(names[a], names[b]) for a, b in T.random_pairs(len(names), 20260725, 4)]
    a = T.table_addresses(dig, tables, ["unit", "i", "y"])
    s = T.score_rows(a, T.cells(a), ["unit", "i", "y"], F.lit(0.0)).withColumn("score", F.round("score", 9))
    m = R.confusion(s.withColumn("called", R.top_share("score", 0.1)), F.col("called"), "y", ["unit"])
    return R.auc(s, "score", "y").join(m, "unit")
