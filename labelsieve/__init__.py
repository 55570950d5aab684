"""labelsieve: label-screening jobs for Spark, all of them DataFrame in, DataFrame out."""
