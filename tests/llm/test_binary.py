from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from llm_helpers import ODD, no_documents, odd_documents, prose

from quillfold.llm import binary
from quillfold.llm.store import shared_folder

PATHS = pytest.importorskip("public_tokenizers")
BYTE = PATHS.path("byte_bpe_50k.json")


def test_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(binary, "CHUNK_IDS", 500)
    docs = [(997 * i % 1009, prose(i, i % 90)) for i in range(300)] + [(2000 + i, t) for i, (_, t, *_) in enumerate(ODD)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int")
    folder = shared_folder(spark)
    parts = binary.write_tokens(frame, folder, BYTE)
    found = sorted(binary.read_tokens(parts, folder, BYTE).collect())
    code = Tokenizer.from_file(BYTE)
    start, want = 0, []
    for i, text in sorted(docs):
        ids = np.array([*code.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == want
    # the files alone are the sequence of ids
    local = folder.removeprefix("file://")
    flat = np.concatenate([np.fromfile(f"{local}/{x}", "<u2") for x in sorted(os.listdir(local)) if x.endswith(".bin")])
    assert len(flat) == start and not [x for x in os.listdir(local) if x.split(".")[1].isdigit()]
    assert parts.selectExpr("sum(n_docs)", "sum(n_ids)").first() == (len(docs), start)


def test_null_and_repeated_ids(spark):
    found = binary.tokenise(odd_documents(spark), BYTE).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(r[0]) for r in ODD)
    assert next(r.start for r in found if r.doc_id is None) == 0
    assert sorted(r.start for r in found) == np.cumsum([0, *[r.n_tokens for r in sorted(found, key=lambda r: r.start)]])[:-1].tolist()


def test_no_rows(spark):
    assert binary.tokenise(no_documents(spark), BYTE).collect() == []
