"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped on reading.

Per part: `part-N.bin` holds the ids of its documents one after another, little-endian unsigned 16-bit if the
vocabulary fits, else 32-bit; `part-N.off` the 64-bit start of each document in it and the end of the last;
`part-N.doc` the 64-bit document ids. Parts are ranges of the document id in ascending order, so the parts one after
another are one sequence of ids; the base of a part is the prefix sum of the sizes before it (`manifest`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import by_text_size, texts_of
from .store import Folder, saved, shared_folder
from .tokens import encoder

#: Stands for a null document id in a `.doc` file. Such documents come first.
NULL_ID = -(2**63)
#: Ids read at a time.
CHUNK_IDS = 4_000_000


def _dtype(path: str) -> str:
    return "<u2" if encoder(path).vocabulary <= 2**16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files of all `docs` (doc_id, text) and returns the manifest (part, n_docs, n_ids, base_doc, base_id).

    Every whole text is encoded without special tokens and `end_id` appended; a null or empty text gives `end_id` alone.
    Documents stand in ascending doc_id order, null first; rows of one doc_id in the order of a hash of their text, so
    repeated rows stay and are files' rows of their own. Other columns are ignored. No rows give no part. A file gets
    its name only when it is whole; a task that runs again writes the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        task = TaskContext.get()
        part, out = task.partitionId(), Folder(folder)
        mine = f"part-{part:06d}.{task.taskAttemptId()}"
        kind, end, docs_done, ids_done, files = _dtype(tokenizer), np.uint32(end_id), 0, 0, None
        for batch in by_text_size(batches):
            if files is None:
                files = {x: out.writer(f"{mine}.{x}") for x in ("bin", "off", "doc")}
                files["off"].write(np.zeros(1, "<i8").tobytes())
            ids, sizes = encoder(tokenizer).encode(texts_of(batch))
            ends = np.cumsum(sizes)
            files["bin"].write(np.insert(ids, ends, end).astype(kind).tobytes())
            files["off"].write((ids_done + np.cumsum(sizes + 1)).astype("<i8").tobytes())
            names = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            files["doc"].write(names.astype("<i8").tobytes())
            docs_done += len(sizes)
            ids_done += int(sizes.sum()) + len(sizes)
        if files is None:
            return
        for x, file in files.items():
            file.close()
            out.publish(f"{mine}.{x}", f"part-{part:06d}.{x}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [docs_done], "n_ids": [ids_done]}, parts_schema)

    parts_schema = pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    parts = saved(ordered.mapInArrow(write, "part long, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return parts.select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base_doc"),
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base_id"),
    )


def read_tokens(manifest: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A part is one task's work; its files are mapped and read in pieces of bounded size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kind, store = _dtype(tokenizer), Folder(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base_id").to_pylist(), strict=True):
                name = f"part-{part:06d}"
                flat, off = store.mapped(f"{name}.bin", kind), store.mapped(f"{name}.off", "<i8")
                docs = store.mapped(f"{name}.doc", "<i8")
                at = 0
                while at < len(docs):
                    till = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_IDS, "right")) - 1)
                    till = min(till, len(docs))
                    ids = flat[off[at] : off[till]].astype("<u4")
                    cuts = (off[at : till + 1] - off[at]).tolist()
                    view = memoryview(ids.tobytes())
                    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    named = np.asarray(docs[at:till])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(named, mask=named == NULL_ID),
                            pa.array(np.asarray(off[at:till]) + base),
                            pa.array(np.diff(off[at : till + 1])),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = till

    spread = manifest.repartition("part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files in the shared folder and returns what they hold of each document."""
    folder = shared_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder, tokenizer)
