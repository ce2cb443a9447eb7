"""What a query shuffles."""


def shuffled_mb(spark, df):
    """MB that writing ``df`` shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def now():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size())) / 1e6

    before = now()
    df.write.format("noop").mode("overwrite").save()
    return now() - before
