"""Voids of a unit: clusters of empty spheres, and what each owner of points lines of them.

Everything after the spheres is joins and grouped sums over incidence rows
(sphere, corner). Spheres link to voids through a radius join of their centres;
a void's span is the widest pair among the corners of its centres' hull, so no
void is held against itself; depths come from the unit's hull planes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected, hop_rows
from tessera.operators.hull import hull_corners, hull_depth, hull_planes
from tessera.operators.linear import void_spheres
from tessera.operators.ordered import placed
from tessera.operators.spatial import XYZ, radius_pairs
from tessera.session import stored

CENTRE = ("cx", "cy", "cz")


def whole(x: Column) -> Column:
    """The nearest whole number, halves to even."""
    return F.bround(x, 0).cast("long")


def permille(part: Column, of: Column) -> Column:
    return F.coalesce(whole(1000 * part / F.nullif(of.cast("double"), F.lit(0.0))), F.lit(0).cast("long"))


def clustered(points: DataFrame, low: float, high: float, link: float) -> DataFrame:
    """unit, s, void, a, b, c, d, cx, cy, cz, radius: spheres with radii in the band, numbered in the order of their corners, and the void (its least number) that each belongs to."""
    spheres = stored(placed(void_spheres(points, low, high), ["unit", "a", "b", "c", "d"], "s"), "spheres")
    centres = spheres.select("unit", F.col("s").alias("i"), *[F.col(c).alias(p) for c, p in zip(CENTRE, XYZ, strict=True)])
    near = radius_pairs(centres, link).select("unit", F.col("a_i").alias("a"), F.col("b_i").alias("b"))
    roots = connected(near, centres).select("unit", F.col("i").alias("s"), F.col("root").alias("void"))
    return stored(spheres.join(roots, ["unit", "s"]), "voids")


def spans(spheres: DataFrame) -> DataFrame:
    """void, span: the widest distance between two centres of a void, both corners of its hull."""
    centres = spheres.select(F.col("void").alias("unit"), F.col("s").alias("i"), *[F.col(c).alias(p) for c, p in zip(CENTRE, XYZ, strict=True)])
    rim = hull_corners(centres)
    other = rim.select("unit", *[F.col(c).alias(f"o{c}") for c in XYZ])
    d2 = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in XYZ), F.lit(0.0))
    return rim.join(other, "unit").groupBy(F.col("unit").alias("void")).agg(F.sqrt(F.max(d2)).alias("span"))


def depths(lining: DataFrame, pairs: DataFrame) -> DataFrame:
    """unit, void, owner, depth_in_void: hops in a void's lining to its rim, the owners that hold up one of its spheres.

    lining: unit, void, owner, spheres; pairs: unit, owner, other in contact. A
    void without a rim has depth 0; owners whom no path leads to the rim get one
    more than the hops to the farthest they can reach.
    """
    ends = [lining.select("unit", "void", F.col("owner").alias(c)) for c in ("owner", "other")]
    touch = stored(pairs.filter("owner <> other").join(ends[0], ["unit", "owner"]).join(ends[1], ["unit", "void", "other"]).select(F.col("void").alias("unit"), F.col("owner").alias("src"), F.col("other").alias("dst")), "touch")
    rim = lining.filter("spheres = 1").select(F.col("void").alias("unit"), F.col("owner").alias("i"))
    seen = front = stored(rim.withColumn("hop", F.lit(0)), "depth")
    while not front.isEmpty():
        new = front.select("unit", F.col("i").alias("src"), "hop").join(touch, ["unit", "src"]).select("unit", F.col("dst").alias("i"), (F.col("hop") + 1).alias("hop")).distinct()
        front = stored(new.join(seen, ["unit", "i"], "left_anti"), "depth")
        seen = seen.unionByName(front)
    rest = lining.select(F.col("void").alias("unit"), F.col("owner").alias("i")).join(rim.select("unit").distinct(), "unit").join(seen, ["unit", "i"], "left_anti")
    cut = touch.join(rest.withColumnRenamed("i", "src"), ["unit", "src"], "left_semi")
    farthest = hop_rows(cut, 1 << 30).groupBy("unit", F.col("source").alias("i")).agg(F.max("hop").alias("far"))
    lost = rest.join(farthest, ["unit", "i"], "left").select("unit", "i", (F.coalesce("far", F.lit(0)) + 1).alias("hop"))
    found = seen.unionByName(lost).select(F.col("unit").alias("void"), F.col("i").alias("owner"), F.col("hop").cast("long").alias("depth_in_void"))
    return lining.select("unit", "void", "owner").join(found, ["void", "owner"], "left").select("unit", "void", "owner", F.coalesce("depth_in_void", F.lit(0)).alias("depth_in_void"))


def void_columns(points: DataFrame, low: float = 3.0, high: float = 6.0, link: float = 1.73, gate: float = 18.0, contact: float = 7.0, tight: float = 3.5, wide: float = 4.5) -> DataFrame:
    """One row an (unit, owner) of points (unit, i, px, py, pz, owner, side): 45 whole numbers, all 0 but the depth where an owner lines no void.

    Lengths are in hundredths, shares in thousandths. The best void of an owner
    is the one with the most owners, ties by the smaller number.
    """
    p = stored(points.select("unit", "i", *XYZ, "owner", "side"), "points")
    spheres = clustered(p, low, high, link)
    corner = spheres.select("unit", "s", "void", "radius", F.explode(F.array("a", "b", "c", "d")).alias("i"))
    inc = stored(corner.join(p.select("unit", "i", "owner", "side"), ["unit", "i"]), "incidence")
    owners = p.groupBy("unit", "owner").agg(F.count(F.lit(1)).alias("heavy"), *[F.avg(c).alias(c) for c in XYZ])
    planes = hull_planes(hull_corners(p))
    centroid = stored(owners.withColumnRenamed("owner", "i"), "centroids")
    depth = hull_depth(centroid, planes).select("unit", F.col("i").alias("owner"), whole(100 * F.col("depth")).alias("hull_distance_centi"))

    side = lambda c: F.count_distinct(F.when(F.col("side"), F.col(c)))
    own = inc.groupBy("unit", "owner").agg(F.count_distinct("s").alias("alpha_spheres"), F.count_distinct("i").alias("alpha_atoms"), F.count(F.lit(1)).alias("alpha_incidences"), side("i").alias("alpha_sc_atoms"))
    lined = inc.select("unit", "owner", "s", "void", "radius").distinct()
    radii = lined.groupBy("unit", "owner").agg(whole(100 * F.max("radius")).alias("alpha_r_max_centi"), whole(100 * F.min("radius")).alias("alpha_r_min_centi"), whole(100 * F.median("radius")).alias("alpha_r_median_centi"), whole(100 * (F.max("radius") - F.min("radius"))).alias("alpha_r_range_centi"), F.count_if(F.col("radius") < tight).alias("alpha_n_tight"), F.count_if(F.col("radius") > wide).alias("alpha_n_open"))

    # voids: lining, sizes, order in the unit, place along the owners' order, depth
    lining = stored(lined.groupBy("unit", "void", "owner").agg(F.count(F.lit(1)).alias("spheres")), "lining")
    size = inc.groupBy("unit", "void").agg(F.count_distinct("owner").alias("res"), F.count_distinct("s").alias("sph"), F.count_distinct("i").alias("atoms"), side("i").alias("sc"))
    breadth = spheres.groupBy("unit", "void").agg(F.max("radius").alias("r_max"), F.avg("radius").alias("r_mean"))
    along = Window.partitionBy("unit", "void").orderBy("owner")
    steps = lining.withColumn("gap", (F.col("owner") - F.lag("owner").over(along) > 1).cast("long"))
    order = steps.groupBy("unit", "void").agg((1 + F.coalesce(F.sum("gap"), F.lit(0))).alias("segments"), (F.max("owner") - F.min("owner")).alias("seq_span"), F.median("owner").alias("seq_mid"))
    below = hull_depth(spheres.select("unit", F.col("s").alias("i"), *[F.col(c).alias(q) for c, q in zip(CENTRE, XYZ, strict=True)]), planes).withColumnRenamed("i", "s")
    sunk = spheres.select("unit", "s", "void").join(below, ["unit", "s"]).groupBy("unit", "void").agg(F.min("depth").alias("hull_min"), F.max("depth").alias("hull_max"))
    unit = Window.partitionBy("unit")
    void = size.join(breadth, ["unit", "void"]).join(order, ["unit", "void"]).join(sunk, ["unit", "void"]).join(spans(spheres), "void")
    void = void.withColumn("rank", F.row_number().over(unit.orderBy(F.desc("res"), "void"))).withColumn("n_all", F.count(F.lit(1)).over(unit)).withColumn("sph_all", F.sum("sph").over(unit))
    void = stored(void, "void-columns")

    mine = lining.join(void.select("unit", "void", "res"), ["unit", "void"]).groupBy("unit", "owner").agg(F.count(F.lit(1)).alias("n_voids"), F.min("res").alias("min_void_residues"), F.sum("res").alias("void_residues_total"), F.max(F.struct("res", (-F.col("void")).alias("v"))).alias("top"))
    best = stored(mine.select("unit", "owner", "n_voids", "min_void_residues", "void_residues_total", (-F.col("top.v")).alias("void")), "best")
    place = lining.withColumn("place", F.row_number().over(Window.partitionBy("unit", "void").orderBy(F.desc("spheres"), "owner"))).select("unit", "void", "owner", "place")

    # company within the two balls about an owner's centroid, itself included
    pairs = radius_pairs(centroid, gate).select("unit", F.inline(F.array(*[F.struct(F.col(f"{s}_i").alias("owner"), F.col(f"{t}_i").alias("other"), F.col("d")) for s, t in ("ab", "ba")])))
    pairs = stored(pairs.unionByName(centroid.select("unit", F.col("i").alias("owner"), F.col("i").alias("other"), F.lit(0.0).alias("d"))), "balls")
    member = lining.select("unit", "void", F.col("owner").alias("other"), F.lit(True).alias("in"))
    around = pairs.join(best.select("unit", "owner", "void"), ["unit", "owner"]).join(member, ["unit", "void", "other"], "left")
    close = F.col("d") <= contact
    balls = around.groupBy("unit", "owner").agg(F.count(F.lit(1)).alias("ball_gate_residues"), F.count_if(F.col("in")).alias("ball_gate_in_void"), F.count_if(close).alias("n_close"), F.count_if(close & F.col("in")).alias("in_close"))

    deep = depths(lining, pairs.filter(F.col("d") <= contact))

    c = F.col
    chosen = best.join(void, ["unit", "void"]).join(deep, ["unit", "void", "owner"]).join(place, ["unit", "void", "owner"]).join(balls, ["unit", "owner"]).select(
        "unit", "owner", "n_voids", c("res").alias("best_void_residues"), c("sph").alias("best_void_spheres"), c("atoms").alias("best_void_atoms"), "min_void_residues", "void_residues_total",
        permille(c("rank"), c("n_all")).alias("best_void_rank_permille"), permille(c("sph"), c("sph_all")).alias("best_void_share_permille"),
        permille(c("place"), c("res")).alias("rank_in_void_permille"), (c("in_close") - 1).alias("void_neighbours"), permille(c("in_close") - 1, c("res")).alias("void_neighbour_permille"),
        whole(100 * c("span")).alias("void_span_centi"), whole(100 * c("span") / c("res")).alias("void_span_per_residue_centi"), whole(100 * c("sph") / c("res")).alias("void_spheres_per_residue_centi"),
        whole(100 * c("r_max")).alias("void_r_max_centi"), whole(100 * c("r_mean")).alias("void_r_mean_centi"), permille(c("sc"), c("atoms")).alias("void_sc_permille"),
        c("segments").alias("void_seq_segments"), c("seq_span").alias("void_seq_span"), whole(100 * c("seq_span") / c("res")).alias("void_seq_span_per_residue_centi"), permille(F.abs(c("owner") - c("seq_mid")), c("seq_span")).alias("own_seq_offset_permille"),
        "ball_gate_residues", "ball_gate_in_void", permille(c("ball_gate_in_void"), c("ball_gate_residues")).alias("ball_gate_purity_permille"), permille(c("in_close"), c("n_close")).alias("ball_contact_purity_permille"),
        (permille(c("in_close"), c("n_close")) - permille(c("ball_gate_in_void"), c("ball_gate_residues"))).alias("purity_gain_permille"),
        "depth_in_void", (c("depth_in_void") >= 2).cast("long").alias("is_void_core"), whole(100 * c("hull_min")).alias("void_hull_min_centi"), whole(100 * c("hull_max")).alias("void_hull_max_centi"), whole(100 * (c("hull_max") - c("hull_min"))).alias("void_hull_range_centi"),
    )
    alpha = own.withColumn("alpha_bb_atoms", c("alpha_atoms") - c("alpha_sc_atoms")).withColumn("alpha_sc_permille", permille(c("alpha_sc_atoms"), c("alpha_atoms")))
    out = owners.select("unit", "owner", "heavy").join(depth, ["unit", "owner"], "left").join(alpha, ["unit", "owner"], "left").join(radii, ["unit", "owner"], "left").join(chosen, ["unit", "owner"], "left")
    out = out.withColumn("alpha_atom_permille", permille(c("alpha_atoms"), c("heavy"))).drop("heavy")
    return out.select("unit", "owner", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in out.columns if x not in ("unit", "owner")])
