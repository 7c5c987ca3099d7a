"""sentencepiece encoding and decoding through a table of distinct marked words.

No piece of the model crosses a white-space mark (checked when it is loaded), so each
distinct marked word is segmented once per Python worker and ids are joined back by
position. The table is kept where texts are read: a table joined across the cluster would
shuffle every position of the corpus.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import ship
from siftline.llm.tokens import encoder, groups


def _coded(path: str, keep: bool):
    def run(batches):
        coder = encoder("piece", path)
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1).to_pylist()):
                coded = coder(texts)
                decoded = coder.decode([ids for ids, _ in coded])
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    pa.array([sha(s) for _, s in coded]),
                    pa.array([sha(s) for s in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array([ids for ids, _ in coded], pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    return run


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``keep`` also the
    ids (array<int>) and the decoded text.

    Null texts count as empty and have no ids. Rows that repeat a doc_id each give a
    row. An empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_coded(path, keep), schema + ", ids array<int>, decoded string" * keep)
