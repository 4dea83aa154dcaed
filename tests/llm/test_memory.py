"""Workers give back what they don't use."""

import ctypes

import pytest

from quillon.llm import common


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc alone trims")
def test_freed_memory_goes_back_to_the_system():
    held = [bytes(60_000) + b"x" for _ in range(4_000)]
    pinned = held[::400]
    del held
    before = _resident()
    common.give_back()
    assert before - _resident() > 100_000_000 and len(pinned) == 10
