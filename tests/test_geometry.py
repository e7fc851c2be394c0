"""Result sizes of a 200 x 100 source."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.plans import geometry, options

FIT = [(50, 50, 50, 25), (50, 20, 40, 20), (20, 50, 20, 10), (300, 300, 200, 100), (300, 50, 100, 50), (100, 300, 100, 50),
       (0, 50, 100, 50), (50, 0, 50, 25), (0, 200, 200, 100), (300, 0, 200, 100)]
FIT_ENLARGE = [(300, 300, 300, 150), (300, 125, 250, 125), (250, 300, 250, 125), (0, 200, 400, 200), (300, 0, 300, 150)]
FILL_ENLARGE = [(50, 50, 50, 50), (50, 20, 50, 20), (300, 125, 300, 125), (250, 300, 250, 300), (0, 200, 400, 200)]
FILL_DOWN = [(50, 50, 50, 50), (20, 50, 20, 50), (300, 300, 100, 100), (300, 125, 200, 83), (250, 300, 83, 100),
             (0, 50, 100, 50), (300, 0, 200, 100)]
CASES = (
    [(w, h, "fit", {}, rw, rh) for w, h, rw, rh in FIT]
    + [(w, h, "fit", {"enlarge": True}, rw, rh) for w, h, rw, rh in FIT_ENLARGE]
    + [(w, h, "fill", {"enlarge": True}, rw, rh) for w, h, rw, rh in FILL_ENLARGE]
    + [(w, h, "fill-down", {}, rw, rh) for w, h, rw, rh in FILL_DOWN]
    + [
        (0, 100, "fit", {"max_dim": 100}, 100, 50),
        (150, 0, "fit", {"max_dim": 50}, 50, 25),
        (1000, 1000, "fit", {"max_dim": 100, "enlarge": True}, 100, 50),
        (1000, 2000, "fit", {"max_dim": 100, "extend": True}, 50, 100),
        (1000, 2000, "fit", {"max_dim": 100, "extend_ar": True}, 50, 100),
        (100, 150, "fit", {"max_dim": 100, "rotate": 90}, 50, 100),
    ]
)
SETTINGS = "i int, width long, height long, resizing_type string, enlarge boolean, extend boolean, extend_ar boolean, rotate long, max_dim long"


def test_result_sizes(spark):
    rows = [
        (
            i, w, h, kind, more.get("enlarge", False), more.get("extend", False), more.get("extend_ar", False),
            more.get("rotate", 0), more.get("max_dim", 0),
        )
        for i, (w, h, kind, more, _, _) in enumerate(CASES)
    ]
    df = spark.createDataFrame(rows, SETTINGS)
    missing = {c: F.lit(v) for c, v in options.GEOMETRY_DEFAULTS.items() if c not in df.columns}
    facts = {
        "img_w": F.lit(200), "img_h": F.lit(100), "orientation": F.lit(1), "frames": F.lit(1), "has_alpha": F.lit(False),
        "src_format": F.lit("png"), "format": F.lit("png"), "crop_type": F.lit(None).cast("string"),
    }
    got = geometry.result_size(geometry.plan_geometry(df.withColumns({**missing, **facts})))
    sizes = {r.i: (r.result_w, r.result_h) for r in got.select("i", "result_w", "result_h").collect()}
    assert sizes == {i: (c[4], c[5]) for i, c in enumerate(CASES)}


def test_filter_on_a_planned_size_stays_small(spark, sf_dir):
    """A late filter must not drag the whole planner into the predicate."""
    from gravure.registry.fixtures import table

    df = geometry.result_size(geometry.plan_geometry(table(spark, sf_dir, "geo"))).filter(F.col("result_w") > 100)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000
    assert df.count() > 0
