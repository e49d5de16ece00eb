"""feedlake: product-feed jobs and training-data jobs as Spark DataFrame operators."""
