"""What is shuffled for a staged table goes with its query; signatures are joined in turns with the same classes."""

import time

import numpy as np
import pyarrow as pa

from mendtrace.llm import common as C
from mendtrace.llm import jaccard_join as J
from mendtrace.sources import staging


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")}


def test_no_shuffle_files_are_left(spark):
    for stage in (C.stage_table, staging.staged):
        before = shuffled(spark)
        rows = stage(spark.range(20_000).groupBy("id").count(), "counts")
        until = time.time() + 20
        while shuffled(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffled(spark) - before and rows.count() == 20_000


def test_classes_by_turns(spark):
    r = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in r.integers(0, 5_000, 120)]
        texts.append(" ".join(words))
        for _ in range(int(r.integers(0, 4))):
            words[int(r.integers(0, 120))] = "other"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(J.jaccard_classes(docs).collect())
    assert len({x["class_id"] for x in want}) < len(texts)
    assert sorted(J.jaccard_classes(docs, turns=3).collect()) == want


def test_a_turn_sends_its_share():
    """All turns together send what one scan does, each about its share; documents come with the first turn only."""
    r = np.random.default_rng(4)
    b = pa.record_batch({"id": pa.array(range(30)), "text": [" ".join(f"w{x}" for x in r.integers(0, 9_000, 300)) for _ in range(30)]})

    def sent(*turn):
        rows = [x for got in J._scan(5, 80, 64, *turn)(iter([b])) for x in got.to_pylist()]
        return sum(len(x["entries"]) for x in rows if x["kind"] == "s"), sum(x["kind"] == "d" for x in rows)

    every, share = sent(), [sent(k, 4) for k in range(4)]
    assert sum(x for x, _ in share) == every[0] and max(x for x, _ in share) < 0.4 * every[0]
    assert [d for _, d in share] == [30, 0, 0, 0] and every[1] == 30
