"""What encoding costs beside the library's own work: calls for each part, threads; and that the lookup by integers is exact."""

import itertools
import os
import random
import subprocess
import sys

import numpy as np

from sparkredact.llm import tokens
from sparkredact.llm.token_files import tokenizer_path


def test_new_parts_call_python_once():
    encoder = tokens.TextEncoder(tokenizer_path())
    names = ["".join(c) for c in itertools.product("abcdefgh", repeat=4)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = encoder.encode(["x " + " ".join(names)])[0]
    finally:
        sys.setprofile(None)
    assert calls < 1.5 * len(names)  # a call for each unknown word, none for the part that it is
    assert got.tolist() == encoder._plain("x " + " ".join(names)).tolist()


def test_encoder_starts_no_threads():
    code = """
import os
from sparkredact.llm import tokens
from sparkredact.llm.token_files import tokenizer_path
before = len(os.listdir("/proc/self/task"))
tokens.encode_column([" ".join(f"w{n}x" for n in range(3000))], tokenizer_path(), 2)
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    assert subprocess.run([sys.executable, "-c", code], env=env, check=True, capture_output=True, text=True).stdout.split() == ["0"]


def test_parts_of_every_length_and_odd_bytes():
    rng = random.Random(5)
    signs = ["a", "b", "\0", "é", "語", "😀", ".", "1", "\n", " "]
    for limit in (0, 3, 100_000):
        encoder = tokens.TextEncoder(tokenizer_path(), cache_parts=limit)
        for _ in range(3):
            texts = ["".join(rng.choices([*signs, " "], [2, 2, 1, 1, 1, 1, 1, 1, 0.2, 0.2, 3], k=rng.choice([0, 1, 30, 400]))) for _ in range(60)]
            texts += [" ".join("a" * n + end for n in range(40) for end in ("", "\0", "\0\0", "b")), "", " ", "  x"]
            for text, got in zip(texts, encoder.encode(texts), strict=True):
                assert got.tolist() == encoder._plain(text).tolist()


def test_table_with_all_keys_in_one_place(monkeypatch):
    table = tokens._Table(50)
    monkeypatch.setattr(table, "_home", lambda lo, hi: np.full(len(lo), table.last, dtype=np.int64))
    keys = np.arange(50, dtype=np.uint64)
    table.add(np.arange(30), keys[:30], keys[:30])
    assert table.find(keys, keys).tolist() == [*range(30), *[-1] * 20]
    table.add(np.arange(30, 50), keys[30:], keys[30:])
    assert table.find(keys, keys).tolist() == list(range(50)) and table.find(keys, keys + np.uint64(1)).tolist() == [-1] * 50
