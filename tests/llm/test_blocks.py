import time

import numpy as np
import pytest

from fraglens.llm import blocks as B


@pytest.mark.parametrize("n", [1, 2, 3, 12, 1000, 10**6])
def test_buckets_of_sorted_keys(n):
    """Every key is in the bucket of its leading bits, and only occupied ones come out."""
    rng = np.random.RandomState(0)
    for size in (0, 1, 5, 3000):
        keys = np.sort(rng.randint(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        width = (1 << 64) // n + 1
        want = {}
        for i, k in enumerate(keys.tolist()):
            want.setdefault(k // width, []).append(i)
        got = list(B.split_sorted(keys, n))
        assert [b for b, _ in got] == sorted(want) and all(0 <= b < n for b, _ in got)
        assert {b: list(range(s.start, s.stop)) for b, s in got} == want


def test_cut_leaves_no_shuffle_files(spark):
    """The rows are in the checkpoint folder; what was shuffled on the way to them goes without a garbage collection, and the session's setting comes back."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = shuffled(), spark.conf.get(setting, "false")
    df = spark.range(20_000).selectExpr("id % 1000 as k", "id as v").repartition(3, "v").groupBy("k").count()
    got = B.cut(df)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert got.count() == 1000 and got.columns == ["k", "count"] and {r["count"] for r in got.collect()} == {20}
    assert B.cut(df).count() == 1000
    assert spark.conf.get(setting, "false") == given
