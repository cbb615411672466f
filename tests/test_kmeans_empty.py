from pyspark.sql import functions as F

from quarry.operators import kmeans


def test_partitions_without_rows(spark):
    """A file cut into more splits than it has row groups gives such partitions."""
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(8, F.col("id") * 0)
    assert df.select(F.spark_partition_id()).distinct().count() == 1 and df.rdd.getNumPartitions() == 8
    got = kmeans.cluster(df, 6)
    assert got.centroids.shape == (6, 2) and got.inertia < 1e-9
    assert kmeans.assign(df, got.centroids).count() == 30
