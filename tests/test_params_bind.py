from pyspark.sql import functions as F

from tidemark.plans import catalogue


def test_params_bind_gives_every_row(spark, tmp_path):
    import shutil

    from tests.conftest import DATA

    shutil.copytree(DATA, tmp_path / "data")
    shutil.rmtree(tmp_path / "data/part.parquet", ignore_errors=True)
    (tmp_path / "data/part.parquet").unlink(missing_ok=True)
    part = spark.range(100_001).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size"), F.lit("Brand#12").alias("p_brand"))
    part.write.parquet(str(tmp_path / "data/part.parquet"))
    assert catalogue.params_bind(spark, str(tmp_path / "data")).count() == 100_001
