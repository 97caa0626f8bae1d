"""Workers give back what a group or a stage needed: they outlive their stages, and their memory would add up."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Blocks below glibc's mmap threshold, freed under a block that stays, so the heap's end can't move down by itself.
HELD = """
import re, sys
def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def fill():
    parts = [bytearray(60_000) for _ in range(3000)]
    stays = bytearray(60_000)
    return stays
def of_group(key, table):
    return fill()
def of_pair(key, left, right):
    return fill()
def of_batches(batches):
    for b in batches:
        yield fill()
import numpy, pyarrow
from corpusloom.llm.common import tidy
kept, before = [], anon()
"""
CALLS = {"group": "kept.append({0}(of_group)(1, 2))", "pair": "kept.append({0}(of_pair)(1, 2, 3))", "batches": "kept.extend({0}(of_batches)([1]))"}


def grown(call: str) -> float:
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))}
    return float(subprocess.run([sys.executable, "-c", f"{HELD}\n{call}\nprint(anon() - before)"], capture_output=True, text=True, env=env, check=True).stdout)


@pytest.mark.parametrize("kind", CALLS)
def test_workers_give_memory_back(kind):
    assert grown(CALLS[kind].format("")) > 100, "the fixture no longer holds memory"
    assert grown(CALLS[kind].format("tidy")) < 20
