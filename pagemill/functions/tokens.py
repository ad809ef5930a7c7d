"""Tokenizer columns: ids, counts, unknown tokens and texts decoded again, by public vocabulary files.

`vocabulary` is the path of a file: *.tiktoken (ranks of byte pairs), *.json (the tokenizers library) or *.model (sentencepiece).
It is read by the driver and travels with the function, a fixed size, so workers need no path of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_unknown", T.IntegerType()), T.StructField("decoded", T.StringType())])
_ready: dict[bytes, tuple[Callable, Callable, int | None]] = {}


def _coder(kind: str, data: bytes) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str], int | None]:
    """encode, decode and the id of the unknown token, if there is one."""
    name = hashlib.sha256(data).digest()
    if name not in _ready:
        if kind == ".tiktoken":
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, special_tokens={})
            _ready[name] = own.encode_ordinary, own.decode, None
        elif kind == ".json":
            from tokenizers import Tokenizer, decoders

            own = Tokenizer.from_str(data.decode())
            if own.decoder is None:
                own.decoder = decoders.BPEDecoder()  # word ends are written </w>
            own.encode_special_tokens = True
            unknown = next((i for t in ("[UNK]", "<unk>") if (i := own.token_to_id(t)) is not None), None)
            _ready[name] = lambda x: own.encode(x, add_special_tokens=False).ids, lambda ids: own.decode(ids, skip_special_tokens=True), unknown
        elif kind == ".model":
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_proto=data)
            _ready[name] = own.encode, own.decode, own.unk_id()
        else:
            raise ValueError(f"no tokenizer for {kind}")
    return _ready[name]


def tokenized(text: Column | str, vocabulary: str) -> Column:
    """struct<ids, n_tokens, n_unknown, decoded>; a null text is empty."""
    data, kind = Path(vocabulary).read_bytes(), Path(vocabulary).suffix

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.DataFrame:
        encode, decode, unknown = _coder(kind, data)
        ids = [list(encode(x or "")) for x in texts]
        return pd.DataFrame({"ids": ids, "n_tokens": [len(x) for x in ids], "n_unknown": [x.count(unknown) if unknown is not None else 0 for x in ids], "decoded": [decode(x) for x in ids]})

    return run(F.col(text) if isinstance(text, str) else text)
