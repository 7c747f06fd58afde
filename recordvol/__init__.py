"""Record-volume analytics on Spark: one lazy DataFrame plan from bars to reports."""
