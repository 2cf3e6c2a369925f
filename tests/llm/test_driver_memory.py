"""What the driver has let go of goes back to the system with each step."""

import gc
import os
import re
import time

import pytest

from kinfold.llm.store import materialize


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux's figures of a process")
def test_native_memory_of_the_jvm_goes_back(spark):
    """Of 2000 buffers all but each twentieth go; by itself the C library keeps their pages."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def anonymous():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    materialize(spark.range(10).toDF("id"))  # what the first step loads stays
    held = [jvm.java.nio.ByteBuffer.allocateDirect(60_000) for _ in range(2000)]
    held = held[::20]
    gc.collect()
    time.sleep(1)
    jvm.System.gc()  # the heap shrinks here, and the buffers are freed
    time.sleep(2)
    before = anonymous()
    made = materialize(spark.range(10).toDF("id"))
    assert before - anonymous() > 60
    assert made.count() == 10 and len(held) == 100
