"""Token counts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the file itself is never part of this repository.
FOLDER = os.environ.get("SUFRAGIO_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of a byte-level rank file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = FILE) -> str:
    return os.path.join(FOLDER, name)


def counter(path: str) -> Callable[[Sequence[str]], list[int]]:
    """A function from texts to token counts; special tokens in a text are ordinary text. A rank
    file (.tiktoken) and a tokenizer description (.json) of one vocabulary give the same counts."""
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for i in range(0, len(texts), 64) for e in t.encode_batch(texts[i : i + 64], add_special_tokens=False)]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(own.encode_ordinary(t)) for t in texts]


def counted(texts: pd.Series, count: Callable[[Sequence[str]], list[int]]) -> pd.Series:
    """Token counts of a batch; repeated texts are counted once, null ones have none."""
    texts = texts.fillna("")
    todo = list(dict.fromkeys(texts))
    return texts.map(dict(zip(todo, count(todo)))).astype("int64")


def sizes(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, tokens: null texts have none."""
    path = path or tokenizer_path()
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "tokens": counted(pdf["t"], count)})

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, tokens bigint")
    return out.withColumnRenamed("k", key)
