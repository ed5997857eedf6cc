import re
from pathlib import Path

import pytest

from lodestream.session import settle


def _resident_mb(pid: int) -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="needs /proc")
def test_settle_gives_native_memory_of_the_driver_back(spark):
    jvm = spark.sparkContext._jvm
    pid = int(jvm.java.lang.ProcessHandle.current().pid())
    # about 0.27 MB each outside the heap; every 32nd stays, so that the C library keeps the rest unless it is asked
    own = [jvm.java.util.zip.Deflater() for _ in range(640)]
    for i, d in enumerate(own):
        if i % 32 != 31:
            d.end()
    jvm.System.gc()
    before = _resident_mb(pid)
    settle(spark)
    after = _resident_mb(pid)
    for d in own[31::32]:
        d.end()
    assert after < before - 60
