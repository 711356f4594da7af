"""BPE ids of whole texts and back, by contiguous rank arrays (operator 6)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creaseline.llm.bpe import word_ids
from creaseline.llm.common import map_texts


def encode_texts(docs: DataFrame, tokenizer: str, keep_text: bool = False) -> DataFrame:
    """Rows of `docs` with `n_tokens` and `token_ids` (an array of ints).

    Texts are encoded without added special tokens; special tokens spelled in a text are recognised.  A null text
    has no ids.  Other columns pass through, columns of these names are replaced, rows are neither merged nor dropped.
    """

    def encode(texts):
        ids = [np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32) for parts in word_ids(tokenizer)([t or "" for t in texts])]
        return {"n_tokens": list(map(len, ids)), "token_ids": ids}

    fields = {"n_tokens": T.LongType(), "token_ids": T.ArrayType(T.IntegerType())}
    return map_texts(docs, encode, fields, drop=() if keep_text else ("text",), after=lambda: word_ids(tokenizer).forget())


def decode_ids(rows: DataFrame, tokenizer: str, ids: str = "token_ids") -> DataFrame:
    """Rows with `decoded`: the library's text of the ids.  Null ids decode to the empty text."""
    import pyarrow as pa

    from creaseline.llm.common import SLICE_CHARS

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "decoded"], T.StructField("decoded", T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        decode = word_ids(tokenizer).compute.__self__.decode
        for batch in batches:
            step = max(1, SLICE_CHARS * max(1, batch.num_rows) // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                texts = [decode(x or []).decode() for x in part.column(names.index(ids)).to_pylist()]
                columns = [c.cast(arrow.field(n).type) for n, c in zip(names, part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, type=arrow.field("decoded").type)], schema=arrow)

    return rows.select(*names).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of `docs` without text, with `n_tokens` and the SHA-256 of the ids and of the decoded text.

    The ids are digested as little-endian unsigned 32-bit integers.  Nulls, clashing names and repeated rows are
    handled as in `encode_texts`; ids and decoded texts never leave the task.
    """

    def digests(texts):
        memo = word_ids(tokenizer)
        decode = memo.compute.__self__.decode
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for parts in memo([t or "" for t in texts]):
            ids = b"".join(parts)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(np.frombuffer(ids, dtype="<u4").tolist())).hexdigest())
        return out

    return map_texts(docs, digests, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()})
