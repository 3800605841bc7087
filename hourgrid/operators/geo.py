"""Joining activity with cell polygons."""

from pyspark.sql import DataFrame, functions as F

from hourgrid.functions import geometry as G


def attach_geometry(activity: DataFrame, lookup: DataFrame, strategy="auto") -> DataFrame:
    """Left join on the grid id; activity rows without a polygon stay.

    `auto` leaves the choice to the optimizer, which goes by size at run time; `merge` asks for a sort-merge join.
    """
    if strategy not in ("auto", "merge"):
        raise ValueError(f"unknown join strategy {strategy!r}")
    side = lookup if strategy == "auto" else lookup.hint(strategy)
    return activity.join(side, "grid_id", "left")


def enriched(joined: DataFrame) -> DataFrame:
    return joined.select(
        "grid_id", "timestamp", "sms_in", "sms_out", "call_in", "call_out",
        "internet_activity", "total_activity", "geometry",
    )


def unmatched_grids(activity: DataFrame, lookup: DataFrame) -> DataFrame:
    """Grids seen in the activity that have no polygon."""
    return activity.select("grid_id").distinct().join(
        lookup.select("grid_id"), "grid_id", "left_anti"
    )


def join_validation(activity: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows kept, grids kept and polygon coverage.

    Both sides are reduced to one row per grid before they are counted.
    """
    before = activity.groupBy("grid_id").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.struct(F.sum("_n").alias("rows"), F.count("grid_id").alias("grids"))
    ).scalar()
    per_grid = joined.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("geometry").alias("_located")
    )
    return per_grid.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_after"),
        F.count("grid_id").alias("grids_after"),
        F.count_if(F.col("_located") == 0).alias("missing_grids"),
    ).withColumns({
        "rows_before": before.getField("rows"),
        "grids_before": before.getField("grids"),
    }).withColumns({
        "coverage_percent":
            (F.col("grids_before") - F.col("missing_grids")) / F.col("grids_before") * 100,
        "rows_kept": F.col("rows_before") == F.col("rows_after"),
        "grids_kept": F.col("grids_before") == F.col("grids_after"),
    })


def top_grids_with_geometry(activity: DataFrame, lookup: DataFrame, k=10) -> DataFrame:
    """Top grids by total; polygons join only the k rows that remain."""
    top = activity.groupBy("grid_id").agg(F.sum("total_activity").alias("total_activity"))
    top = top.orderBy(F.desc("total_activity"), F.asc("grid_id")).limit(k)
    # At most k keys go to the lookup and at most k matches come back; the lookup is not moved.
    few = lookup.join(F.broadcast(top.select("grid_id")), "grid_id").select("grid_id", "geometry")
    return top.join(F.broadcast(few), "grid_id", "left")


def centroids_by_vertex(lookup: DataFrame) -> DataFrame:
    ring = G.outer_ring("geometry")
    return lookup.select(
        "grid_id",
        G.vertex_mean(ring, 0).alias("centroid_longitude"),
        G.vertex_mean(ring, 1).alias("centroid_latitude"),
    )


def centroids_by_box(lookup: DataFrame, reference="milano-grid.geojson") -> DataFrame:
    """Bounding-box middle of Polygon cells, with the reference text of the dimension."""
    ring = G.outer_ring("geometry", kinds=("Polygon",))
    located = lookup.withColumn("_ring", ring).filter(F.size("_ring") > 0)
    return located.select(
        "grid_id",
        G.box_middle(F.col("_ring"), 1).alias("centroid_latitude"),
        G.box_middle(F.col("_ring"), 0).alias("centroid_longitude"),
        F.concat(F.lit(f"{reference}#"), F.col("grid_id")).alias("geometry_reference"),
    )


def neighbour_distances(lookup: DataFrame) -> DataFrame:
    """Centroid distance of each cell to the next numbered one; for spot checks."""
    here = centroids_by_vertex(lookup).withColumn("_n", F.col("grid_id").try_cast("bigint"))
    following = here.select(
        (F.col("_n") - 1).alias("_n"), F.col("grid_id").alias("next_grid_id"),
        F.col("centroid_longitude").alias("_x"), F.col("centroid_latitude").alias("_y"),
    )
    return here.join(following, "_n").select("grid_id", "next_grid_id", G.distance(
        F.col("centroid_longitude"), F.col("centroid_latitude"), F.col("_x"), F.col("_y")
    ).alias("distance"))
