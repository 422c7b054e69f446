"""Triangulated solids as obstacles: what lies inside and what is blocked.

``meshes`` has ``obstacle_id``, ``vertices`` (an array of x, y, z arrays) and
``faces`` (an array of three vertex numbers).  A surface is not inside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.grid import along_cells, cell, cell_side, in_cells
from ..plans.rounds import staged

#: The directions in which rays are sent, each tried if those before met an edge.
RAYS = (
    (0.7430863, 0.4217634, 0.5197221),
    (-0.3894103, 0.8142371, 0.4306857),
    (0.1948572, -0.5583211, 0.8064128),
)
_LOW, _HIGH = ["min_x", "min_y", "min_z"], ["max_x", "max_y", "max_z"]
_A, _B, _C, _N = (v.vector(p) for p in ("a", "b", "c", "n"))
_P = v.vector("")


@dataclass(frozen=True)
class SolidObstacles:
    """``triangles(obstacle_id, face_id, corners, normal)`` and inflated ``boxes``."""

    triangles: DataFrame
    boxes: DataFrame
    tolerance: float
    side: float

    @staticmethod
    def of(meshes: DataFrame, tolerance: float = 1e-6) -> SolidObstacles:
        """Faces without area are left out; a mesh with none left, a face with an
        unknown vertex or a vertex that is not finite raises an error."""
        if not tolerance > 0:
            raise ValueError("the tolerance must be above 0")
        t = float(tolerance)
        faces = meshes.select("obstacle_id", "vertices", F.posexplode("faces").alias("face_id", "f"))
        size = F.size("vertices")
        unknown = (F.size("f") != 3) | F.exists("f", lambda i: (i < 0) | (i >= size))
        told = F.concat_ws(" ", F.lit("mesh"), "obstacle_id", F.lit("has a face with an unknown vertex"))
        f = F.when(unknown, F.raise_error(told).cast("array<int>")).otherwise(F.col("f").cast("array<int>"))
        odd = F.exists(F.flatten("vertices"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        wrong = F.concat_ws(" ", F.lit("mesh"), "obstacle_id", F.lit("has a vertex that is not finite"))
        points = F.when(odd, F.raise_error(wrong).cast("array<array<double>>")).otherwise(F.col("vertices").cast("array<array<double>>"))
        corner = [
            F.element_at(F.element_at(F.col("p"), F.element_at(F.col("f"), k + 1) + 1), axis + 1).alias(f"{'abc'[k]}{'xyz'[axis]}")
            for k in range(3)
            for axis in range(3)
        ]
        raw = faces.select("obstacle_id", "face_id", f.alias("f"), points.alias("p")).select("obstacle_id", "face_id", *corner)
        normal = v.cross(v.minus(_B, _A), v.minus(_C, _A))
        whole = raw.withColumns({name: F.expr(e) for name, e in zip(_N, normal)})
        triangles = staged(whole.where(F.expr(v.length(_N)) > t * t), "triangles")
        if not meshes.select("obstacle_id").join(triangles.select("obstacle_id"), "obstacle_id", "left_anti").isEmpty():
            raise ValueError("a mesh has no face with an area")
        ends = {
            **{lo: F.min(F.least(*[f"{k}{x}" for k in "abc"])) - t for lo, x in zip(_LOW, "xyz")},
            **{hi: F.max(F.greatest(*[f"{k}{x}" for k in "abc"])) + t for hi, x in zip(_HIGH, "xyz")},
        }
        boxes = staged(triangles.groupBy("obstacle_id").agg(*[e.alias(n) for n, e in ends.items()]), "boxes")
        return SolidObstacles(triangles, boxes, t, cell_side(boxes, _LOW, _HIGH))

    def _flat(self, hits: DataFrame) -> DataFrame:
        """``key`` of ``hits(key, obstacle_id, x, y, z)`` that lie inside a flat part of the surface.

        Touching triangles must be parallel, and every side of one that passes
        through the place must be a side of another.
        """
        t = self.tolerance
        near = staged(
            hits.join(self.triangles, "obstacle_id").where(F.expr(v.to_triangle(_P, _A, _B, _C, _N)) <= t), "touching"
        )
        lead = near.groupBy("key").agg(F.min_by(F.struct(*_N), "face_id").alias("lead"), F.count("*").alias("faces"))
        first = tuple(f"lead.{x}" for x in _N)
        skew = f"{v.length(v.cross(first, _N))} > 1e-9 * {v.length(first)} * {v.length(_N)}"
        slanted = near.join(lead, "key").groupBy("key", "faces").agg(F.bool_or(F.expr(skew)).alias("slanted"))
        pairs = (("a", "b"), ("b", "c"), ("c", "a"))
        sides = near.select("key", "face_id", *_P, F.explode(F.array(*[
            F.struct(*[F.col(f"{k}{x}").alias(f"{n}{x}") for k, n in zip(pair, "ab") for x in "xyz"]) for pair in pairs
        ])).alias("s")).select("key", "face_id", *_P, "s.*")
        passing = sides.where(F.expr(v.to_segment(_P, _A, _B)) <= t)
        other = sides.select("key", F.col("face_id").alias("other"), *[F.col(f"a{x}").alias(f"p{x}") for x in "xyz"], *[F.col(f"b{x}").alias(f"q{x}") for x in "xyz"])
        p, q = v.vector("p"), v.vector("q")
        same = (
            f"({v.length(v.minus(_A, p))} <= {t}d AND {v.length(v.minus(_B, q))} <= {t}d) OR "
            f"({v.length(v.minus(_A, q))} <= {t}d AND {v.length(v.minus(_B, p))} <= {t}d)"
        )
        matched = passing.join(other, "key").where("face_id <> other").where(F.expr(same)).select("key", "face_id", *_A, *_B).distinct()
        open_ = passing.select("key", "face_id", *_A, *_B).join(matched, ["key", "face_id", *_A, *_B], "left_anti").select("key").distinct()
        return slanted.where("faces >= 2 and not slanted").select("key").join(open_, "key", "left_anti")

    def _near(self, points: DataFrame) -> DataFrame:
        dealt = points.select("id", "x", "y", "z").withColumns({f"cell{i}": cell(F.col(c), self.side) for i, c in enumerate("xyz")})
        return dealt.join(in_cells(self.boxes, _LOW, _HIGH, self.side), ["cell0", "cell1", "cell2"]).where(
            " and ".join(f"{c} between min_{c} and max_{c}" for c in "xyz")
        ).select("id", "x", "y", "z", "obstacle_id")

    def contains(self, points: DataFrame) -> DataFrame:
        """``id, inside`` for ``points(id, x, y, z)``: rays leave it through an odd number of places.

        Within the tolerance of a face is outside.  A ray that meets an edge is
        given up for the next one, unless the surface is flat there.
        """
        t = self.tolerance
        left = staged(self._near(points), "near")
        touching = left.join(self.triangles, "obstacle_id").where(F.expr(v.to_triangle(_P, _A, _B, _C, _N)) <= t)
        left = left.join(touching.select("id", "obstacle_id").distinct(), ["id", "obstacle_id"], "left_anti")
        verdicts: list[DataFrame] = []
        for ray in RAYS:
            d = tuple(f"{x}d" for x in ray)
            asked = staged(left, "asked")
            under = f"{v.dot(_N, d)}"
            hits = asked.join(self.triangles, "obstacle_id").where(
                f"abs({under}) > 1e-12 * {v.length(_N)} * {v.length(d)}"
            ).withColumn("t", F.expr(f"{v.dot(_N, v.minus(_A, _P))} / {under}")).where("t > 0")
            h = v.vector("h")
            # Written out here so that the next step's long expressions start from columns.
            hits = staged(hits.withColumns({n: F.expr(e) for n, e in zip(h, v.plus(_P, d, "t"))}), "plane")
            hits = staged(
                hits.where(F.expr(v.to_triangle(h, _A, _B, _C, _N)) <= t)
                .withColumn("clean", F.expr(v.to_sides(h, _A, _B, _C)) > t)
                .select("id", "obstacle_id", "t", "clean", *h),
                "hits",
            )
            unclean = hits.where("not clean").select(F.struct("id", "obstacle_id", "t").alias("key"), "obstacle_id", *[F.col(a).alias(b) for a, b in zip(h, _P)])
            flat = self._flat(unclean).select("key.*").withColumn("flat", F.lit(True))
            judged = hits.join(flat, ["id", "obstacle_id", "t"], "left")
            gone = judged.where("not clean and flat is null").select("id", "obstacle_id").distinct()
            order = Window.partitionBy("id", "obstacle_id").orderBy("t")
            # Hits closer together than the tolerance are one place.
            counted = judged.withColumn("gap", F.col("t") - F.lag("t").over(order)).groupBy("id", "obstacle_id").agg(
                F.count_if(F.col("gap").isNull() | (F.col("gap") > t)).alias("n")
            )
            settled = staged(
                asked.select("id", "obstacle_id").join(gone, ["id", "obstacle_id"], "left_anti")
                .join(counted, ["id", "obstacle_id"], "left").select("id", "obstacle_id", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("odd")),
                "settled",
            )
            verdicts.append(settled)
            left = asked.join(settled.select("id", "obstacle_id"), ["id", "obstacle_id"], "left_anti")
            if left.isEmpty():
                break
        inside = verdicts[0]
        for more in verdicts[1:]:
            inside = inside.union(more)
        hit = inside.where("odd").select("id").distinct().withColumn("hit", F.lit(True))
        return points.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("inside"))

    def blocks(self, segments: DataFrame) -> DataFrame:
        """``id, blocked`` for ``segments(id, px, py, pz, qx, qy, qz)``.

        A segment that passes through a face, clear of its edges, is blocked at
        once; others are cut where they touch, and the middles of the pieces decide.
        """
        t = self.tolerance
        start, end = v.vector("p"), v.vector("q")
        seg = staged(segments.select("id", *start, *end).withColumn("len", F.expr(v.length(v.minus(end, start)))), "segments")
        short = seg.where(F.col("len") <= t).select("id", *[F.col(a).alias(b) for a, b in zip(start, _P)])
        long = seg.where(F.col("len") > t)
        for c in "xyz":
            long = long.withColumn(f"s0{c}", F.least(f"p{c}", f"q{c}")).withColumn(f"s1{c}", F.greatest(f"p{c}", f"q{c}"))
        pairs = (
            along_cells(long, list(start), list(end), self.side)
            .join(in_cells(self.boxes, _LOW, _HIGH, self.side), ["cell0", "cell1", "cell2"])
            .where(" and ".join(f"s0{c} <= max_{c} and s1{c} >= min_{c}" for c in "xyz"))
            .select("id", *start, *end, "len", "obstacle_id").distinct()
        )
        d = v.minus(end, start)
        under = v.dot(_N, d)
        h = v.vector("h")
        met = pairs.join(self.triangles, "obstacle_id").where(f"abs({under}) > 1e-12 * {v.length(_N)} * len").withColumn(
            "t", F.expr(f"{v.dot(_N, v.minus(_A, start))} / {under}")
        ).where((F.col("t") >= -t / F.col("len")) & (F.col("t") <= 1 + t / F.col("len")))
        met = staged(met.withColumns({n: F.expr(e) for n, e in zip(h, v.plus(start, d, "t"))}), "plane")
        met = staged(
            met.where(F.expr(v.to_triangle(h, _A, _B, _C, _N)) <= t).withColumn("clean", F.expr(v.to_sides(h, _A, _B, _C)) > t)
            .select("id", "obstacle_id", "t", "len", "clean", *h),
            "met",
        )
        unclean = met.where("not clean").select(F.struct("id", "obstacle_id", "t").alias("key"), "obstacle_id", *[F.col(a).alias(b) for a, b in zip(h, _P)])
        flat = self._flat(unclean).select("key.*").withColumn("flat", F.lit(True))
        judged = met.join(flat, ["id", "obstacle_id", "t"], "left").withColumn("clear", F.col("clean") | F.coalesce("flat", F.lit(False)))
        inner = (F.col("t") > t / F.col("len")) & (F.col("t") < 1 - t / F.col("len"))
        through = staged(judged.where(F.col("clear") & inner).select("id").distinct(), "through")
        cuts = judged.where(~(F.col("clear") & inner)).select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "t")).alias("cut"))
        ends = pairs.select("id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("cut")).distinct()
        order = Window.partitionBy("id").orderBy("cut")
        pieces = ends.union(cuts).join(through, "id", "left_anti").withColumn("next", F.lead("cut").over(order)).where("next is not null").join(long.select("id", *start, *end, "len"), "id")
        middles = pieces.where((F.col("next") - F.col("cut")) * F.col("len") > t).withColumn("m", F.expr("(cut + next) / 2"))
        middles = middles.select("id", *[F.expr(e).alias(n) for n, e in zip(_P, v.plus(start, d, "m"))])
        asked = staged(middles.union(short).withColumn("key", F.struct("id", *_P)), "middles")
        inside = self.contains(asked.select(F.col("key").alias("id"), *_P).distinct()).where("inside").select(F.col("id.id").alias("id"))
        hit = inside.union(through).distinct().withColumn("hit", F.lit(True))
        return seg.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("blocked"))
