import shutil
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlens.sources import memo, versions

NOW = datetime(2025, 5, 10, 12)


def test_the_same_question():
    same = [{"q": " Milch ", "retailers": "spar, billa,", "public": "true", "limit": 30}, {"limit": 30, "public": True, "retailers": ["billa", "spar", " billa"], "q": "milch"}]
    assert memo.canonical(same[0]) == memo.canonical(same[1])
    assert memo.canonical(same[0]) != memo.canonical(same[0] | {"limit": 31})


def test_kept_until_old_or_changed(spark, tmp_path):
    root = f"{tmp_path}/offers"
    versions.write(spark.range(50).select("id", (F.col("id") % 5).cast("string").alias("r")), root, "r", 4)
    kept = memo.Memo(spark, f"{tmp_path}/memo")
    asked = []

    def ask(now=NOW, limit=3, **params):
        def make():
            asked.append(1)
            return versions.read(spark, root).orderBy(F.desc("id")).limit(limit)

        return [r.id for r in kept.remember(versions.state(spark, root).version, "top", params | {"limit": limit}, make, now).collect()]

    assert ask(q="A") == [49, 48, 47] and ask(q=" a") == [49, 48, 47] and len(asked) == 1
    assert ask(q="b") == [49, 48, 47] and ask(limit=4, q="a") == [49, 48, 47, 46] and len(asked) == 3
    assert ask(NOW + timedelta(hours=12), q="a") and len(asked) == 3
    assert ask(NOW + timedelta(hours=13), q="a") and len(asked) == 4
    assert ask(NOW + timedelta(hours=14), q="a") and len(asked) == 4  # made anew an hour ago
    base = versions.state(spark, root)
    shutil.move(f"{root}/versions", f"{root}/hidden")
    assert ask(NOW + timedelta(hours=14), q="a") == [49, 48, 47]  # no file of the offers is read
    shutil.move(f"{root}/hidden", f"{root}/versions")
    part = sorted(base.parts)[0]
    versions.rewrite(versions.read(spark, root, [part]).filter("id < 40"), root, [part], base)
    assert ask(NOW + timedelta(hours=14), q="a") == [r.id for r in versions.read(spark, root).orderBy(F.desc("id")).limit(3).collect()] and len(asked) == 5
    assert kept.forget(versions.state(spark, root).version) == 1 and kept.get(base.version, "top", {"q": "a", "limit": 3}, NOW) is None
    assert kept.forget() == 1


def test_half_written_entries_don_t_count(spark, tmp_path):
    kept = memo.Memo(spark, f"{tmp_path}/memo")
    kept.remember("v", "x", {}, lambda: spark.range(2), NOW)
    (folder,) = (tmp_path / "memo" / "v").iterdir()
    (entry,) = folder.iterdir()
    (entry / "_SUCCESS").unlink()
    assert kept.get("v", "x", {}, NOW) is None


def test_time_limit(spark):
    quick, done = memo.within(spark.range(5), 60)
    assert done and quick.count() == 5
    wait = F.udf(lambda x: time.sleep(30) or x, "long")
    began = time.time()
    slow, done = memo.within(spark.range(8).select(wait("id").alias("id"), F.lit("a").alias("t")), 3)
    assert not done and time.time() - began < 20 and slow.count() == 0 and slow.dtypes == [("id", "bigint"), ("t", "string")]
    time.sleep(1)
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        memo.within(spark.range(5).select(F.assert_true(F.col("id") < 0, F.lit("no")), (F.lit(1) / F.col("id")).alias("x")).select("x"), 60)


def test_rankings_are_remembered_by_version(spark, tmp_path):
    from offerlens.plans import offers, served

    root = f"{tmp_path}/offers"
    versions.write(offers.offer_view(spark, "/root/testdata/sf0.001"), root, "retailer_key", 4)
    kept = memo.Memo(spark, f"{tmp_path}/memo")
    first = {k: v.collect() for k, v in served.remembered_ranking(kept, root, NOW, limit=7).items()}
    shutil.move(f"{root}/versions", f"{root}/hidden")
    again = {k: v.collect() for k, v in served.remembered_ranking(kept, root, NOW, limit=7).items()}
    assert first == again and len(first["items"]) == 7
    assert served.snapshot(spark.range(3)).count() == 3
