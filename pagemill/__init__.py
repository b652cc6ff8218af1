"""pagemill: job-queue and page-raster analytics as PySpark DataFrame operators."""
