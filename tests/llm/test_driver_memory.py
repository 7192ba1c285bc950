"""What the driver's JVM has freed beside its heap goes back to the system."""

import gc
import re
import time
from pathlib import Path

import pytest

from tallywright.llm import latent_decontam, shared

PIECES, BYTES, KEPT = 2000, 64 << 10, 20  # one piece of KEPT stays, so that the allocator can't give the others back unasked


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory can't be read here")
def test_native_memory_goes_back(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    shared.stored(spark.range(5), "few")
    taken = [jvm.java.nio.ByteBuffer.allocateDirect(BYTES) for _ in range(PIECES)]
    taken = taken[::KEPT]
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
    freed, before = PIECES * BYTES * (1 - 1 / KEPT) / (1 << 20), resident()
    shared.tidy(spark)  # as after each stored table
    assert len(taken) == PIECES // KEPT and before - resident() > freed / 2


def test_a_jvm_without_the_command(spark, monkeypatch):
    class Closed:
        class java:
            class lang:
                class Class:
                    @staticmethod
                    def forName(name):
                        raise shared.Py4JError(name)

    monkeypatch.setattr(spark.sparkContext, "_jvm", Closed)
    shared._trim_jvm(spark)


def test_decontamination_gives_memory_back_before_the_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")], "doc_id long, text string")
    calls = []
    monkeypatch.setattr(latent_decontam, "tidy", lambda s: calls.append(s))
    latent_decontam.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))
    assert len(calls) == 2
