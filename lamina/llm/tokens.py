"""Operator 10: whole texts to BPE ids and back, by the merge rounds of :mod:`lamina.llm.bpe`.

Per input row one output row, so repeated rows stay repeated; null text counts as empty (no ids, empty
decoded text); empty tables give empty results; columns other than the key and the text are ignored,
so clashing names do no harm; very long texts are handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.bpe import encoder, portions
from lamina.llm.memory import tidy

#: Name and type of everything that ``encode`` can return.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """The key and the chosen ``outputs`` of each row; ``path``: a tokenizer file present on every executor."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                rows = enc.encode_batch(texts[a:b])
                out = {"key": batch.column(0).slice(a, b - a)}
                if "n_tokens" in outputs:
                    out["n_tokens"] = pa.array([len(r) for r in rows], pa.int64())
                if "ids" in outputs:
                    out["ids"] = pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))
                if "ids_sha256" in outputs:
                    out["ids_sha256"] = pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string())
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    flat, ends = enc.vocab.decode_bytes(np.concatenate([*rows, np.zeros(0, np.uint32)]))
                    cut = np.r_[0, ends][np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)]
                    whole = flat.tobytes()
                    back = [whole[cut[i] : cut[i + 1]].decode("utf-8", "replace") for i in range(len(rows))]
                    if "decoded" in outputs:
                        out["decoded"] = pa.array(back, pa.string())
                    if "decoded_sha256" in outputs:
                        out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
                yield pa.RecordBatch.from_arrays([out["key"], *[out[o] for o in outputs]], names=["key", *outputs])

    schema = f"key {kind}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
