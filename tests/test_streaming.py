"""Open molecules over micro-batches: the same as a batch run, whatever files the records come in; late records are kept."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fraglens import quantify as Q
from fraglens.operators import resolution as R
from fraglens.operators import simulate as M
from fraglens.sources import annotation as N
from fraglens.streaming import molecules as S
from tests.test_quantify import GENES

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def shape(df):
    return sorted(map(str, df.select("qname", "hit", "num_hits", "splice_type", "strand", "candidates").collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_equals_batch(spark, tmp_path, seed):
    t = Q.index(N.parse_gtf(spark.createDataFrame([(x,) for x in GENES], "value string"))).cache()
    refs = spark.createDataFrame([("chr1", 30000)], "ref string, length long")
    rows = M.paired_records(M.fragments(t.withColumns({"abundance": F.lit(1.0), "nrna_abundance": F.lit(0.0)}), refs, 60, 0, 10, M.SimConfig(seed=2)))
    rnd = random.Random(seed)
    every = sorted(rows.collect())
    rnd.shuffle(every)
    # Mates come up to 40 s apart, and records out of order by up to 20 s.
    timed = [(*r, START + datetime.timedelta(seconds=k + rnd.uniform(0, 20))) for k, r in enumerate(every[:60])]
    names = {r[0] for r in every[:60]}
    mates = [(*r, START + datetime.timedelta(seconds=rnd.uniform(40, 90))) for r in every[60:] if r[0] in names]
    timed = sorted(timed + mates, key=lambda r: r[-1])
    files = [timed[i : i + 17] for i in range(0, len(timed), 17)]
    schema = N.ALIGNMENT_SCHEMA + ", seen timestamp"
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = S.OpenMolecules(spark, f"{tmp_path}/out", 100, lambda rows: R.resolve_all(rows.drop("seen"), t))
    S.each_batch(S.read_alignments(spark, f"{tmp_path}/in", 2), sink, f"{tmp_path}/check").awaitTermination()
    sink.finish()
    assert sink.late().count() == 0
    want = R.resolve_all(spark.createDataFrame(timed, schema).drop("seen"), t)
    assert shape(sink.closed()) == shape(want)


def test_late_records_and_reruns(spark, tmp_path):
    row = lambda q, s: (q, 99, "chr1", 1, 60, "5M", "*", -1, 0, 1, -1, None, None, START + datetime.timedelta(seconds=s))
    df = lambda *rows: spark.createDataFrame(list(rows), N.ALIGNMENT_SCHEMA + ", seen timestamp")
    sink = S.OpenMolecules(spark, str(tmp_path), 10)
    sink(df(row("a", 0), row("b", 5)), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        sink(df(row("c", 30)), 1)  # closes a and b
    sink(df(row("a", 1), row("c", 15), row("d", 19), row("e", 60)), 2)  # a and d are late, c is open
    sink(spark.createDataFrame([], N.ALIGNMENT_SCHEMA + ", seen timestamp"), 3)
    assert sorted((r.qname, r.batch) for r in sink.late().collect()) == [("a", 2), ("d", 2)]
    assert sorted(r.qname for r in sink.closed().collect()) == ["a", "b", "c", "c"]
    sink.finish()
    assert sorted(r.qname for r in sink.closed().collect()) == ["a", "b", "c", "c", "e"]
