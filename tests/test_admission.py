"""Energy admission whose keys share states."""

import random

from pyspark.sql import functions as F

from structlake.streaming import jobs


def test_keys_share_states_and_equal_the_batch_rule(spark, tmp_path):
    rng = random.Random(5)
    kinds = "key long, id long, e double, ts timestamp"
    days = [[(None if k == 0 else 2**60 + k, 1000 * d + n, rng.choice([None, float("nan"), rng.uniform(0, 50)]) if n % 7 == 0 else rng.uniform(0, 50), 86_400 * d + rng.randrange(86_400)) for n, k in enumerate(rng.choices(range(60), k=200))] for d in range(1, 4)]
    for n, rows in enumerate([*days, [(None, 9999, 1.0, 86_400 * 400)]]):
        made = spark.createDataFrame(rows, "key long, id long, e double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.stream_energy_admission(stream.select("key", "id", "e", "ts"), "key", "e", "ts", "id", 5.0, "1 day", key_groups=3)
    run = got.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    # three groups and that of no key; a state for each of sixty keys before
    assert 0 < run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4
    rows = spark.read.schema(kinds).parquet(f"{tmp_path}/in").filter("id < 9999").withColumn("e", F.nanvl("e", F.lit(None).cast("double")))
    want = {(r.key, r.id, r.admitted) for r in jobs.energy_admission_batch(rows, "key", "e", "ts", "id", 5.0).collect()}
    seen = [(r.key, r.id, r.admitted) for r in spark.read.parquet(f"{tmp_path}/out").filter("id < 9999").collect()]
    assert len(seen) == len(set(seen)) == 600 and set(seen) == want and {a for _, _, a in seen} == {True, False}
