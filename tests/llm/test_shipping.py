"""Executors without the package, one memory for each worker, and special tokens when packing."""

import os
import subprocess
import sys
import zlib

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from ledgerloom.session import build_session
spark = build_session("elsewhere", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}})
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
for name, build in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        print("RAN", name, len(build(spark, {folder!r}).collect()))
"""


def test_queries_run_where_executors_lack_the_package(tmp_path):
    """The driver knows the package by sys.path alone, and workers start elsewhere."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "elsewhere.py"
    script.write_text(ELSEWHERE.format(root=ROOT, folder="/root/testdata/sf0.001"))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    ran = [line.split() for line in done.stdout.splitlines() if line.startswith("RAN")]
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(ran) == 14 and all(int(r[2]) > 0 for r in ran if not r[1].startswith("op2_"))


def test_a_worker_keeps_one_memory():
    from ledgerloom.llm import common

    try:
        first = common.remembered("a", dict)
        first["x"] = 1
        common.forget("a")
        assert common.remembered("a", dict) is first
        common.remembered("b", dict)
        assert list(common._MEMORY) == ["b"] and common.remembered("a", dict) == {}
        common.forget(None)
        assert common._MEMORY == {}
    finally:
        common._MEMORY.clear()


@pytest.mark.parametrize("capacity", [1024, 5])
def test_special_tokens_of_the_vocabulary_are_themselves(spark, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    from ledgerloom.llm.packing import pack

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y, <|endoftext|>.", "no  such\n<|endoftext|>  \n token",
             "<|endoftext|><|endoftext|> ends <|endoftext|> ", "almost <|endoftext |> it", "word " * 50 + "<|endoftext|>"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in pack(docs, path, capacity).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert sum(p[2] for p in pieces[i]) == len(ids)
        for _, start, length, crc in pieces[i]:
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
