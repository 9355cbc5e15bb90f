"""Memory of the Python workers, which share an executor's limit with its heap."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ENCODE = """
import re, sys
from pathlib import Path
import numpy as np
import pyarrow as pa
from lectern.llm import token_files
from lectern.llm.queries import tokenizer_path

def most():
    return int(re.search(r"VmHWM:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

token_files.TaskContext = type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)})
token_files.encoder_for(tokenizer_path())(pa.array(["a word"]))
rng, before = np.random.default_rng(1), most()

def batches():
    for lo in range(0, 600, 100):
        letters = rng.integers(97, 123, (100, 2500, 8)).astype(np.uint8)
        letters[:, :, 7] = 32
        yield pa.record_batch([pa.array(range(lo, lo + 100), pa.int64()), pa.array([x.tobytes().decode() for x in letters])], ["doc_id", "text"])

written = [b for m in token_files._write(tokenizer_path(), "file://" + sys.argv[1])(batches()) for b in m.to_pylist()]
print(sum(b["n_docs"] for b in written), most() - before)
"""


def test_encoding_new_words_holds_little(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", ENCODE, str(tmp_path)], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == "600" and float(out[1]) < 250, f"{out[1]} MB"
